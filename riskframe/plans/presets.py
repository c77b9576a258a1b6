"""Survey presets: the variable codes and thresholds of the cardiovascular study.

These bind the generic operators to a multi-cycle health-survey table linked to
mortality records.  The test-table queries use the same operators with other
columns (see :mod:`riskframe.plans.cohorts`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from riskframe.functions.rules import Rule
from riskframe.operators import clean, labels

# ---- fixed values (must equal the study's definitions) ----------------------
# Leading underlying cause of death codes, in code order.
CAUSE_OF_DEATH = {
    1: "HEART_DISEASE",
    2: "MALIGNANT_NEOPLASMS",
    3: "CHRONIC_LOWER_RESPIRATORY_DISEASE",
    4: "ACCIDENTS",
    5: "CEREBROVASCULAR_DISEASE",
    6: "ALZHEIMERS_DISEASE",
    7: "DIABETES_MELLITUS",
    8: "INFLUENZA_PNEUMONIA",
    9: "NEPHRITIS_NEPHROTICSYNDROME_NEPHROSIS",
    10: "ALL_OTHER_CAUSES",
    11: "NOT_DEAD",
}
NOT_DEAD = 11
CVR_CAUSES = [1, 5]

COHORT_COLS = ["RIDAGEYR", "RHD143", "SDDSRVYR"]
CONDITION_COLS = ["MCQ160F", "MCQ160C", "MCQ160B", "MCQ160E"]
SYMPTOM_COLS = ["CDQ001", "CDQ002", "CDQ003", "CDQ004", "CDQ005", "CDQ006", "CDQ009A",
                "CDQ009B", "CDQ009C", "CDQ009D", "CDQ009E", "CDQ009F", "CDQ009G", "CDQ009H",
                "CDQ008", "CDQ010"]
LAB_COLS = ["LBXTC", "LBDTCSI", "LBDLDL", "LBDLDLSI", "LBDHDD", "LBDHDDSI", "LBXGLU", "LBDGLUSI",
            "LBXTR", "LBDTRSI", "LBXSCH", "LBDSCHSI", "LBXSGL", "LBDSGLSI", "LBXSTR", "LBDSTRSI"]
HYPERTENSION_FEATURES = ["RIAGENDR", "RIDAGEYR", "RIDRETH1", "BMXBMI", "DIQ010", "SMQ020", "KIQ022"]
SYSTOLIC_COLS = ["BPXSY1", "BPXSY2", "BPXSY3"]
HANDPICKED = ["RIDAGEYR", "RIAGENDR", "RIDRETH1",
              "LBXTC", "LBDLDL", "LBXTR", "LBDHDD", "LBXGLU", "LBXIN", "LBXHGB", "LBXGH", "LBXAPB",
              "URXUIO", "URXUCR",
              "CDQ001", "CDQ010", "SMQ020", "MCQ010"]

CONDITION_RULES = [Rule("MCQ160F", "==", 1), Rule("MCQ160C", "==", 1),
                   Rule("MCQ160B", "==", 1), Rule("MCQ160E", "==", 1)]
SYMPTOM_RULES = [Rule("CDQ001", "==", 1), Rule("CDQ005", "==", 2),
                 Rule("CDQ009G", "==", 7), Rule("CDQ009H", "==", 9)]
LAB_FLAGS = [Rule("LBXTC", ">", 239), Rule("LBDLDL", ">", 130), Rule("LBDHDD", "<", 40),
             Rule("LBXGLU", ">", 200), Rule("LBXTR", ">", 200)]
ADULT_NOT_PREGNANT = [Rule("RIDAGEYR", ">=", 20), Rule("RHD143", "!=", 1)]
LINKED = [Rule("ELIGSTAT", "==", 1)]
LINKED_DEAD = [Rule("ELIGSTAT", "==", 1), Rule("MORTSTAT", "==", 1)]
LINKED_ALIVE = [Rule("ELIGSTAT", "==", 1), Rule("MORTSTAT", "==", 0)]
HYPERTENSION_CYCLES = [9, 10]
SYSTOLIC_THRESHOLD = 130.0
LAB_THRESHOLD = 2


def main_cohort(survey: DataFrame) -> DataFrame:
    return clean.filter_rules(survey, ADULT_NOT_PREGNANT)


def conditions(survey: DataFrame, mortality_cols: list[str]) -> DataFrame:
    return labels.label_any(survey, CONDITION_RULES, drop=CONDITION_COLS + mortality_cols)


def symptoms(survey: DataFrame, mortality_cols: list[str]) -> DataFrame:
    return labels.label_any(survey, SYMPTOM_RULES, drop=SYMPTOM_COLS + mortality_cols)


def biomarkers(survey: DataFrame, mortality_cols: list[str], threshold: int = LAB_THRESHOLD) -> DataFrame:
    present = [c for c in LAB_COLS if c in survey.columns]
    return labels.label_flag_threshold(survey, LAB_FLAGS, threshold, drop=present + mortality_cols)


def cvr_death(survey: DataFrame, mortality_cols: list[str]) -> DataFrame:
    return labels.label_cause(survey, LINKED_DEAD, "UCOD_LEADING", CVR_CAUSES, CAUSE_OF_DEATH,
                              NOT_DEAD, drop=mortality_cols)


def mean_systolic(survey: DataFrame, key: list[str]) -> DataFrame:
    return labels.label_mean_threshold(survey, key, HYPERTENSION_CYCLES, "SDDSRVYR", SYSTOLIC_COLS,
                                       ["BMXBMI"], SYSTOLIC_THRESHOLD, HYPERTENSION_FEATURES)


def hypertension_contributed(survey: DataFrame, key: list[str]) -> DataFrame:
    return labels.label_contributing(survey, LINKED_DEAD, "HYPERTEN", key, HYPERTENSION_FEATURES)
