"""Registered queries: each operator of the inventory bound to the test tables.

Every query reads whole tables (or data Spark derives from them) and returns a
DataFrame; doubles are rounded to 6 places only here, at the output boundary,
so results compare across engines.
"""

from __future__ import annotations

from functools import reduce
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.functions import rules as R
from riskframe.functions.rules import Rule, hash_key, hash_unit
from riskframe.operators import clean, labels, outliers, profile, splits
from riskframe.plans import cohorts as C
from riskframe.plans import presets
from riskframe.session import cut_lineage
from riskframe.sources import io

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def finish(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles (also inside arrays) and turn booleans into ints."""
    exprs = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), digits)
        elif isinstance(f.dataType, T.BooleanType):
            c = c.cast("int")
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, (T.DoubleType, T.FloatType)):
            c = F.transform(c, lambda x: F.round(x.cast("double"), digits))
        exprs.append(c.alias(f.name))
    return df.select(*exprs)


def query(name: str):
    def deco(fn):
        QUERIES[name] = lambda spark, sf_dir: finish(fn(spark, sf_dir))
        QUERIES[name].__doc__ = fn.__doc__
        QUERIES[name].__name__ = name
        return fn
    return deco


# ---------------------------------------------------------------- sources S*

@query("load_cycles")
def q_load_cycles(spark, d):
    """Customer and supplier as two 'cycles' with different column sets."""
    cust = C.table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nationkey"),
        F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("mktsegment"))
    supp = C.table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nationkey"),
        F.col("s_acctbal").alias("acctbal"))
    return io.union_cycles({1: R.nan_to_null(cust), 2: R.nan_to_null(supp)}, "cycle")


@query("link_mortality")
def q_link_mortality(spark, d):
    """Orders linked to customers (left equi join)."""
    o = C.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    c = C.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_acctbal")
    return io.link_mortality(o, c, "o_custkey")


@query("numeric_only")
def q_numeric_only(spark, d):
    """S3: string columns dropped from T1."""
    return io.numeric_only(C.t1(spark, d, extra=True))


@query("schema_table")
def q_schema_table(spark, d):
    """(column_name, data_type, ordinal) of lineitem."""
    return io.schema_table(C.table(spark, d, "lineitem"))


@query("sink_roundtrip")
def q_sink_roundtrip(spark, d):
    """T1 label counts written as CSV and read back."""
    vc = profile.value_counts(C.t1(spark, d), "label")
    return io.sink_and_reload(vc, "label_info", "csv")


FIXED_LAYOUT = [io.Field("n_nationkey", 1, 5, "int"), io.Field("n_name", 6, 25, "string"),
                io.Field("n_regionkey", 31, 5, "int")]


@query("read_fixed_width")
def q_read_fixed_width(spark, d):
    """Nation written as fixed-width text, parsed back with a layout."""
    from riskframe.session import shared_path
    path = shared_path(spark, "fixed_width")
    io.to_fixed_width(C.table(spark, d, "nation"), FIXED_LAYOUT).write.mode("overwrite").text(path)
    return io.read_fixed_width(spark, path, FIXED_LAYOUT)


# ------------------------------------------------------- filters / cleaning F*

@query("cohort_linked")
def q_cohort_linked(spark, d):
    """linked and dead cohort of T2."""
    return clean.filter_rules(C.t2(spark, d), presets.LINKED_DEAD).select(
        "o_orderkey", "o_totalprice", "c_acctbal")


@query("cohort_null_safe")
def q_cohort_null_safe(spark, d):
    """F2: quantity >= 20 and tax != 0.02, a missing tax keeps the row."""
    t = C.t1(spark, d)
    return clean.filter_rules(t, [Rule("l_quantity", ">=", 20), Rule("l_tax", "!=", 0.02)]).select(*C.T1_KEY)


@query("cycle_in")
def q_cycle_in(spark, d):
    """cycles 4 and 6 of T2."""
    return clean.cycle_in(C.t2(spark, d), [4, 6]).select("o_orderkey", "SDDSRVYR")


@query("dropna_subset")
def q_dropna_subset(spark, d):
    """rows of T1 with both discount and tax present."""
    return clean.dropna_subset(C.t1(spark, d), ["l_discount", "l_tax"]).select(
        *C.T1_KEY, "l_discount", "l_tax")


@query("drop_leakage")
def q_drop_leakage(spark, d):
    """label-source columns removed (unknown names are an error)."""
    return clean.drop_columns(C.t1(spark, d, extra=True), ["l_returnflag", "l_linestatus", "ship_year"])


@query("select_features")
def q_select_features(spark, d):
    """fixed feature projection of T2."""
    return clean.select_columns(C.t2(spark, d), ["o_orderkey", *C.T2_FEATURES, "label"])


@query("select_available")
def q_select_available(spark, d):
    """wanted names intersected with the available ones."""
    return clean.select_available(C.t1(spark, d), ["l_tax", "l_quantity", "c_acctbal", "l_orderkey", "label"])


@query("align_columns")
def q_align_columns(spark, d):
    """F8: hold-out rows of T2 projected on the training columns."""
    held = splits.split_holdout(C.t2(spark, d), C.T2_KEY, 0.1)
    return clean.select_columns(held.where("is_holdout = 1"), ["o_orderkey", "c_acctbal", "o_totalprice"])


@query("drop_sparse")
def q_drop_sparse(spark, d):
    """sparse-column report, keep = non_null >= rows * 0.5."""
    return clean.DropSparse(C.T1_FEATURES, 0.5).report(C.t1(spark, d))


@query("drop_any_null")
def q_drop_any_null(spark, d):
    """keep only columns without NULL."""
    return clean.DropAnyNull(C.T1_FEATURES).report(C.t1(spark, d))


@query("impute_mean")
def q_impute_mean(spark, d):
    """means fitted on the train split, applied to the test split."""
    flagged = splits.split_stratified(C.t1(spark, d), C.T1_KEY, "label", 0.2)
    train, test = splits.train_test(flagged)
    model = clean.MeanImputer(C.T1_FEATURES).fit(train)
    return model.transform(test).select(*C.T1_KEY, *C.T1_FEATURES)


@query("impute_keep_empty")
def q_impute_keep_empty(spark, d):
    """mean fill that keeps an all-missing column (filled 0)."""
    t = C.t1(spark, d).withColumn("l_empty", F.lit(None).cast("double"))
    feats = [*C.T1_FEATURES, "l_empty"]
    return clean.MeanImputer(feats, keep_empty=True).fit(t).transform(t).select(*C.T1_KEY, *feats)


@query("fill_zero")
def q_fill_zero(spark, d):
    """constant 0 fill of discount and tax."""
    return clean.fill_value(C.t1(spark, d), ["l_discount", "l_tax"], 0.0).select(*C.T1_KEY, "l_discount", "l_tax")


@query("quality_report")
def q_quality_report(spark, d):
    """rows and NULL count per feature."""
    return clean.quality_report(C.t1(spark, d), C.T1_FEATURES)


@query("harmonize_variables")
def q_harmonize_variables(spark, d):
    """F16: 'balance' read from o_totalprice in cycles 3-5, c_acctbal in 6-9."""
    t = clean.harmonize(C.t2(spark, d), "balance", {"o_totalprice": [3, 4, 5], "c_acctbal": [6, 7, 8, 9]})
    return t.select("o_orderkey", "SDDSRVYR", "balance")


@query("combine_measures")
def q_combine_measures(spark, d):
    """rename + mean of repeated measures + mean post-fill."""
    t = clean.rename(C.t1(spark, d), {"l_quantity": "qty"})
    t = clean.combine_measures(t, ["l_discount", "l_tax"], "rate", fill_mean=True)
    return t.select(*C.T1_KEY, "qty", "rate")


@query("yes_no_recode")
def q_yes_no_recode(spark, d):
    """code = custkey mod 3 (1 yes, 2 no, 0 -> NULL)."""
    t = C.t2(spark, d).withColumn("code", (F.col("o_custkey") % 3).cast("int"))
    return clean.yes_no_recode(t, ["code"]).select("o_orderkey", "code")


# ------------------------------------------------------------ row functions M*

T1_FLAGS = [Rule("l_quantity", ">", 25), Rule("l_extendedprice", ">", 40000.0),
            Rule("l_discount", "<", 0.03), Rule("l_tax", ">", 0.05)]


@query("flag_count")
def q_flag_count(spark, d):
    """M1: number of raised flags per row (missing -> not raised)."""
    return C.t1(spark, d).select(*C.T1_KEY, R.flag_count(T1_FLAGS).alias("flags"))


@query("row_mean")
def q_row_mean(spark, d):
    """M2: mean over the non-missing of discount and tax."""
    return C.t1(spark, d).select(*C.T1_KEY, R.row_mean(["l_discount", "l_tax"]).alias("mean_rate"))


@query("decode_codes")
def q_decode_codes(spark, d):
    """M5: cause-of-death decode, missing -> NOT_DEAD."""
    t = C.t2(spark, d)
    return t.select("o_orderkey",
                    R.decoded_code("UCOD_LEADING", presets.CAUSE_OF_DEATH, presets.NOT_DEAD).alias("code"),
                    R.decode("UCOD_LEADING", presets.CAUSE_OF_DEATH, presets.NOT_DEAD).alias("cause"))


# ------------------------------------------------------------------ labels L*/K*

@query("label_any_condition")
def q_label_any_condition(spark, d):
    """L1: any of four == rules; the rule columns are dropped."""
    t = C.t1(spark, d).drop("label")
    rules = [Rule("l_linenumber", "==", 1), Rule("l_quantity", "==", 50),
             Rule("l_discount", "==", 0.0), Rule("l_tax", "==", 0.08)]
    return labels.label_any(t, rules, drop=["l_discount", "l_tax"])


@query("label_any_code")
def q_label_any_code(spark, d):
    """L2: any of coded answers (string and numeric codes)."""
    t = C.t1(spark, d, extra=True).drop("label")
    rules = [Rule("l_returnflag", "==", "A"), Rule("l_linestatus", "==", "O"),
             Rule("l_tax", "==", 0.01), Rule("l_discount", "==", 0.1)]
    return labels.label_any(t, rules, drop=["l_returnflag", "l_linestatus", "ship_year"])


@query("label_flag_threshold")
def q_label_flag_threshold(spark, d):
    """L3: label = more than 2 of 4 flags raised; flag columns dropped."""
    t = C.t1(spark, d).drop("label")
    return labels.label_flag_threshold(t, T1_FLAGS, 2, drop=["l_discount", "l_tax"])


@query("label_cause_of_death")
def q_label_cause_of_death(spark, d):
    """L4: linked and dead; label = cause in {1, 5}; mortality columns dropped."""
    t = C.t2(spark, d).drop("label").select("o_orderkey", *C.T2_FEATURES, "ELIGSTAT", "MORTSTAT",
                                            "UCOD_LEADING", "HYPERTEN")
    return labels.label_cause(t, presets.LINKED_DEAD, "UCOD_LEADING", presets.CVR_CAUSES,
                              presets.CAUSE_OF_DEATH, presets.NOT_DEAD,
                              drop=["ELIGSTAT", "MORTSTAT", "UCOD_LEADING", "HYPERTEN"])


@query("label_mean_threshold")
def q_label_mean_threshold(spark, d):
    """Ship years 1995-1996, complete rows, label = mean(quantity, discount %, tax %) >= 12,
    two features kept, then IQR outlier removal within each class."""
    t = C.t1(spark, d, extra=True).drop("label").withColumn("disc_pct", F.col("l_discount") * 100) \
        .withColumn("tax_pct", F.col("l_tax") * 100)
    return labels.label_mean_threshold(t, C.T1_KEY, [1995, 1996], "ship_year",
                                       ["l_quantity", "disc_pct", "tax_pct"], ["l_extendedprice"], 12.0,
                                       ["l_quantity", "l_extendedprice"])


@query("label_contributing")
def q_label_contributing(spark, d):
    """Linked and dead; label = HYPERTEN with missing -> 0."""
    return labels.label_contributing(C.t2(spark, d), presets.LINKED_DEAD, "HYPERTEN", C.T2_KEY, C.T2_FEATURES)


@query("risk_condition")
def q_risk_condition(spark, d):
    """K1: outcome of an any-rule."""
    rules = [Rule("o_orderpriority", "==", "1-URGENT"), Rule("o_orderpriority", "==", "2-HIGH")]
    return labels.risk_any(C.t2(spark, d), rules, C.T2_KEY)


@query("risk_cause")
def q_risk_cause(spark, d):
    """K2: cause in {1, 5}, no cohort filter."""
    return labels.risk_cause(C.t2(spark, d), C.T2_KEY, "UCOD_LEADING", presets.CVR_CAUSES,
                             presets.CAUSE_OF_DEATH, presets.NOT_DEAD)


@query("risk_contributing")
def q_risk_contributing(spark, d):
    """K3: HYPERTEN == 1 with missing -> 0."""
    return labels.risk_flag(C.t2(spark, d), C.T2_KEY, "HYPERTEN")


# ------------------------------------------------------------- profiling A1-A8

@query("describe")
def q_describe(spark, d):
    """A1: count, mean, std, min, quartiles, max of T1 features."""
    return profile.describe(C.t1(spark, d), C.T1_FEATURES)


@query("value_counts")
def q_value_counts(spark, d):
    """A2: label counts of T1."""
    return profile.value_counts(C.t1(spark, d), "label")


@query("correlation")
def q_correlation(spark, d):
    """A3: |corr(feature, label)| on T1."""
    return profile.correlation(C.t1(spark, d), C.T1_FEATURES, "label")


@query("correlation_top_decile")
def q_correlation_top_decile(spark, d):
    """A4: features at or above the 0.9 quantile of |corr| (T1 plus derived features)."""
    t = C.t1(spark, d)
    derived = {"gross": F.col("l_extendedprice") * (1 + F.coalesce("l_tax", F.lit(0.0))),
               "net": F.col("l_extendedprice") * (1 - F.coalesce("l_discount", F.lit(0.0))),
               "unit_price": F.col("l_extendedprice") / F.col("l_quantity"),
               "line": F.col("l_linenumber").cast("double")}
    t = t.withColumns(derived)
    feats = [*C.T1_FEATURES, *derived]
    return profile.top_fraction(profile.correlation(t, feats, "label"), 0.9)


@query("iqr_bounds")
def q_iqr_bounds(spark, d):
    """A5: quartiles and fences of T1 features."""
    return outliers.iqr_bounds(C.t1(spark, d), C.T1_FEATURES)


@query("cohort_sizes")
def q_cohort_sizes(spark, d):
    """Entire / linked / dead / alive / main cohort sizes of T2."""
    t = C.t2(spark, d)
    return profile.cohort_sizes(t, {
        "linked": R.all_of(presets.LINKED), "dead": R.all_of(presets.LINKED_DEAD),
        "alive": R.all_of(presets.LINKED_ALIVE),
        "main": R.all_of([Rule("o_totalprice", ">=", 20000.0), Rule("HYPERTEN", "!=", 1)])})


@query("non_null_counts")
def q_non_null_counts(spark, d):
    """Non-null count per feature."""
    return profile.non_null_counts(C.t1(spark, d), C.T1_FEATURES)


# ------------------------------------------------------------------ outliers O*

@query("iqr_removal")
def q_iqr_removal(spark, d):
    """O1: events whose value lies outside the IQR fences are removed."""
    ev = C.table(spark, d, "events").select("event_id", "value")
    return outliers.iqr_removal(ev, ["value"])


@query("iqr_removal_by_class")
def q_iqr_removal_by_class(spark, d):
    """O2: T3 outliers removed within each class."""
    return outliers.iqr_removal_by_class(C.t3(spark, d), ["n_chars", "n_words"], "label") \
        .select("doc_id", "n_chars", "n_words", "label")


# -------------------------------------------------------------------- splits P*

@query("split_stratified")
def q_split_stratified(spark, d):
    """Exact 80/20 per class in md5 order (seed 42)."""
    return splits.split_stratified(C.t1(spark, d), C.T1_KEY, "label", 0.2).select(*C.T1_KEY, "label", "is_test")


@query("split_holdout")
def q_split_holdout(spark, d):
    """Exact unstratified 10 % hold-out."""
    return splits.split_holdout(C.t2(spark, d), C.T2_KEY, 0.1).select("o_orderkey", "is_holdout")


@query("folds_stratified")
def q_folds_stratified(spark, d):
    """10 stratified folds."""
    return splits.folds_stratified(C.t1(spark, d), C.T1_KEY, "label", 10).select(*C.T1_KEY, "label", "fold")


@query("split_by_class")
def q_split_by_class(spark, d):
    """Positives and the rest, tagged."""
    pos, neg = splits.split_by_class(C.t3(spark, d), "label")
    return pos.select("doc_id", F.lit("pos").alias("part")).unionByName(
        neg.select("doc_id", F.lit("rest").alias("part")))


@query("split_majority")
def q_split_majority(spark, d):
    """P5: majority / minority tag (ties -> class 0 majority)."""
    return splits.split_majority(C.t3(spark, d), "label").select("doc_id", "label", "is_majority")


# ---------------------------------------------------------- joins / unions J*, U*

@query("align_by_key")
def q_align_by_key(spark, d):
    """Documents that have labels (left semi join on the key)."""
    docs = C.table(spark, d, "documents").select("doc_id", "n_chars")
    return docs.join(C.table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")


@query("union_all_parts")
def q_union_all_parts(spark, d):
    """Class parts of T3 put back together."""
    from functools import reduce
    parts = splits.split_by_class(C.t3(spark, d), "label")
    return reduce(lambda a, b: a.unionByName(b), parts).select("doc_id", "label")


@query("union_tagged")
def q_union_tagged(spark, d):
    """Label counts of two labellers, tagged and stacked."""
    t = C.t1(spark, d)
    a = profile.value_counts(t, "label").withColumn("pipeline", F.lit("returned_open"))
    b = profile.value_counts(labels.label_flag_threshold(t.drop("label"), T1_FLAGS, 1), "label") \
        .withColumn("pipeline", F.lit("flags_gt1"))
    return a.unionByName(b)


# ------------------------------------------------------------ evaluation A9-A19

from riskframe.operators import evaluate  # noqa: E402
from riskframe.plans import ensemble  # noqa: E402

SCORERS = [("qty", "s_qty"), ("disc", "s_disc"), ("tax", "s_tax")]
GRID_THRESHOLDS = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]


def t1_scored(spark, d):
    """T1 with three bounded rule scores."""
    return C.t1(spark, d).select(
        *C.T1_KEY, "label", "l_extendedprice",
        F.least(F.col("l_quantity") / 50, F.lit(1.0)).alias("s_qty"),
        (F.coalesce(F.col("l_discount"), F.lit(0.0)) * 10).alias("s_disc"),
        (F.coalesce(F.col("l_tax"), F.lit(0.0)) * 12.5).alias("s_tax"))


def grid_scores(spark, d):
    t = t1_scored(spark, d)
    return evaluate.threshold_grid(t, [(n, F.col(c)) for n, c in SCORERS], GRID_THRESHOLDS)


@query("confusion_matrix")
def q_confusion_matrix(spark, d):
    """Tn, fp, fn, tp of 'quantity score > 0.5' against the T1 label."""
    t = t1_scored(spark, d).withColumn("pred", (F.col("s_qty") > 0.5).cast("int"))
    return evaluate.confusion(t)


@query("classification_metrics")
def q_classification_metrics(spark, d):
    """A10: precision, recall, f1, accuracy, auc_roc (hard predictions)."""
    t = t1_scored(spark, d).withColumn("pred", (F.col("s_qty") > 0.5).cast("int"))
    return evaluate.classification_metrics(t)


@query("pr_curve")
def q_pr_curve(spark, d):
    """Precision-recall points per distinct quantity score."""
    return evaluate.pr_curve(t1_scored(spark, d), "label", "s_qty")


@query("roc_curve")
def q_roc_curve(spark, d):
    """ROC points and trapezoid area, score = extended price (many distinct values)."""
    return evaluate.roc_curve(t1_scored(spark, d), "label", "l_extendedprice")


@query("evaluate_models")
def q_evaluate_models(spark, d):
    """27 rule models scored from one long prediction table."""
    return grid_scores(spark, d)


@query("best_per_group")
def q_best_per_group(spark, d):
    """Best threshold per scorer by f1 (first ordinal on ties)."""
    return evaluate.best_per_group(grid_scores(spark, d), ["model"], "f1", "ordinal") \
        .select("model", "ordinal", "threshold", "f1")


@query("argmax_first")
def q_argmax_first(spark, d):
    """Best config overall by f1 (first on ties)."""
    return evaluate.argmax_first(grid_scores(spark, d), "f1", "ordinal").select("model", "ordinal", "f1")


@query("closest_to_center")
def q_closest_to_center(spark, d):
    """Configs whose f1 is closest to the median and to the mean."""
    s = grid_scores(spark, d).select("ordinal", "f1")
    med = evaluate.closest_to_center(s, "f1", "ordinal", "median").withColumn("center", F.lit("median"))
    avg = evaluate.closest_to_center(s, "f1", "ordinal", "mean").withColumn("center", F.lit("mean"))
    return med.unionByName(avg)


@query("top_k_per_group")
def q_top_k_per_group(spark, d):
    """Top 3 configs per scorer by f1."""
    return evaluate.top_k_per_group(grid_scores(spark, d), ["model"], "f1", "ordinal", 3) \
        .select("model", "ordinal", "f1", "rank")


@query("cv_summary")
def q_cv_summary(spark, d):
    """Mean / std / rank of fold f1 per config (10 stratified folds)."""
    t = splits.folds_stratified(t1_scored(spark, d), C.T1_KEY, "label", 10)
    per_fold = evaluate.threshold_grid(t, [(n, F.col(c)) for n, c in SCORERS], GRID_THRESHOLDS, "label", ["fold"])
    return evaluate.cv_summary(per_fold, ["model", "ordinal"], ["f1", "precision"], "f1")


T2_VOTES = [("o_totalprice", ">", 150000.0), ("c_acctbal", ">", 5000.0), ("n_regionkey", ">=", 2)]


@query("risk_score")
def q_risk_score(spark, d):
    """Votes of three rule models per order."""
    t = C.t2(spark, d).select("o_orderkey", *[Rule(c, op, v).to_column().alias(f"p{i}")
                                               for i, (c, op, v) in enumerate(T2_VOTES)])
    return evaluate.risk_score(t, ["o_orderkey"], ["p0", "p1", "p2"])


@query("risk_table")
def q_risk_table(spark, d):
    """(score, risk, total) with risk = urgent or high priority."""
    t = C.t2(spark, d)
    votes = R.flag_count([Rule(c, op, v) for c, op, v in T2_VOTES])
    risk = R.any_of([Rule("o_orderpriority", "==", "1-URGENT"), Rule("o_orderpriority", "==", "2-HIGH")])
    return evaluate.risk_table(t.select(votes.alias("score"), risk.cast("int").alias("risk")))


def t2_labellers():
    cause = labels.cause_in("UCOD_LEADING", presets.CVR_CAUSES, presets.CAUSE_OF_DEATH, presets.NOT_DEAD)
    dead = R.all_of(presets.LINKED_DEAD)
    return [
        ensemble.Labeller("urgent", F.col("label"),
                          ensemble.ThresholdRule(F.col("o_totalprice"),
                                                 [100000.0, 150000.0, 200000.0, 250000.0, 300000.0])),
        ensemble.Labeller("cvr_death", cause,
                          ensemble.ThresholdRule(F.col("c_acctbal"), [0.0, 2500.0, 5000.0, 7500.0]), dead),
        ensemble.Labeller("contributing", F.coalesce(F.col("HYPERTEN"), F.lit(0.0)).cast("int"),
                          ensemble.ThresholdRule(F.col("n_regionkey").cast("double"), [0.5, 1.5, 2.5, 3.5]), dead),
    ]


@query("risk_ensemble")
def q_risk_ensemble(spark, d):
    """Three labellers fitted on the core 90 %, votes summed on the 10 % hold-out."""
    risks = {"condition": R.any_of([Rule("o_orderpriority", "==", "1-URGENT"),
                                    Rule("o_orderpriority", "==", "2-HIGH")]),
             "cvr_death": labels.cause_in("UCOD_LEADING", presets.CVR_CAUSES, presets.CAUSE_OF_DEATH,
                                          presets.NOT_DEAD)}
    return ensemble.risk_ensemble(C.t2(spark, d), C.T2_KEY, t2_labellers(), risks, 0.1)


@query("correlation_sorted")
def q_correlation_sorted(spark, d):
    """The correlation table of T1 from high to low."""
    t = C.t1(spark, d)
    return profile.sort_by_value(profile.correlation(t, C.T1_FEATURES, "label"))


@query("study_correlation")
def q_study_correlation(spark, d):
    """Two labellers on T1 -> mean impute -> |corr| -> top-decile flag."""
    t = C.t1(spark, d, extra=True).drop("label")
    labellers = {
        "returned_open": R.all_of([Rule("l_returnflag", "==", "R"), Rule("l_linestatus", "==", "O")]),
        "flags_gt1": R.flag_count(T1_FLAGS) > 1,
    }
    feats = [*C.T1_FEATURES, "ship_year"]
    return ensemble.study_correlation(t, labellers, feats)


# ------------------------------------------------------------ scaling / selection C*, E*

from riskframe.operators import cluster, knn, models, resample, scale  # noqa: E402
from riskframe.operators import select as fselect  # noqa: E402
from riskframe.plans import grid, process  # noqa: E402


def _scaled(spark, d, est):
    t = C.t1(spark, d)
    return est(C.T1_FEATURES).fit(t).transform(t).select(*C.T1_KEY, *C.T1_FEATURES)


@query("scale_minmax")
def q_scale_minmax(spark, d):
    """Min-max scaling of T1 features (NULL stays NULL)."""
    return _scaled(spark, d, scale.MinMaxScaler)


@query("scale_standard")
def q_scale_standard(spark, d):
    """Standardisation with the population std."""
    return _scaled(spark, d, scale.StandardScaler)


@query("scale_robust")
def q_scale_robust(spark, d):
    """C4: (x - median) / IQR with exact quantiles."""
    return _scaled(spark, d, scale.RobustScaler)


@query("scale_normalizer")
def q_scale_normalizer(spark, d):
    """Rows divided by their L2 norm (NULL counts as 0 in the norm)."""
    return scale.normalize_rows(C.t1(spark, d), C.T1_FEATURES).select(*C.T1_KEY, *C.T1_FEATURES)


@query("select_percentile")
def q_select_percentile(spark, d):
    """Top 10 % of the 64 embedding dimensions by |corr| with label 0 (wide route)."""
    t = C.t4(spark, d)
    sel = fselect.SelectPercentile(C.T4_FEATURES, "label", 10.0)
    scores = sel.scores(t)
    chosen = sel.fit(t).selected
    return scores.withColumn("selected", F.col("feature").isin(chosen).cast("int"))


SEPARABLE = [*C.T3_FEATURES, "sep"]


def _separable(spark, d):
    """T3, min-max scaled, with a column that separates the classes up to noise: label + u, u in [0, 0.9)."""
    t = C.t3(spark, d).withColumn("sep", F.col("label") + 0.9 * hash_unit(hash_key(42, "sep", C.T3_KEY)))
    t = cut_lineage(t)  # the texts are read once; the scaler and fits read the numbers many times
    return scale.MinMaxScaler(SEPARABLE).fit(t).transform(t)


@query("select_l1")
def q_select_l1(spark, d):
    """Optimality of the L1 logistic fit: every gradient is within the penalty, and at it
    (with the coefficient's sign) where the coefficient is not 0; selected = non-zero."""
    t = _separable(spark, d)
    n = t.count()
    est = fselect.SelectFromL1(SEPARABLE, "label", 1.0)
    coef = est.coefficients(t)
    z = reduce(lambda a, b: a + b, [F.col(f) * F.lit(c) for f, c in coef.items()]) + F.lit(est.intercept)
    slope = lambda f: F.avg((1 / (1 + F.exp(-z)) - F.col("label")) * F.col(f))
    at, tol = est.penalty(n), 0.02
    optimal = [F.abs(slope(f) + F.signum(F.lit(c)) * at) <= tol * at if c else F.abs(slope(f)) <= (1 + tol) * at
               for f, c in coef.items()]
    return _checks_df(t, {"rows_seen": F.count(F.lit(1)), "optimal": reduce(lambda a, b: a & b, optimal).cast("int"),
                          "keeps_separating": F.lit(int("sep" in est.fit(t).selected))})


# ------------------------------------------------------------ neighbours J5, B4, R*

@query("knn_join")
def q_knn_join(spark, d):
    """5 nearest neighbours of every embedding (exact, blocked)."""
    t = C.t4(spark, d, as_columns=False)
    return knn.knn_join(t, t, 5, ["vec_id"], exclude_self=True)


@query("clf_knn")
def q_clf_knn(spark, d):
    """5-NN vote for the test split of T4."""
    flagged = splits.split_stratified(C.t4(spark, d, as_columns=False), ["vec_id"], "label", 0.2)
    train, test = splits.train_test(flagged)
    return knn.knn_classify(train, test, ["vec_id"], 5).select("vec_id", "label", "pred")


@query("under_random")
def q_under_random(spark, d):
    """Majority cut to the minority size in hash order."""
    return resample.under_random(C.t3(spark, d), ["doc_id"]).select("doc_id", "label")


@query("over_random")
def q_over_random(spark, d):
    """R2: minority replicated to the majority size."""
    return resample.over_random(C.t3(spark, d), ["doc_id"]).select("doc_id", "label", "copy")


@query("over_smote")
def q_over_smote(spark, d):
    """SMOTE rows of T4 in long form (vec_id, copy, nn, gap, dim, value)."""
    syn = resample.smote(C.t4(spark, d, as_columns=False), ["vec_id"])
    return syn.select("vec_id", "copy", "nn_vec_id", "gap", F.posexplode("vec").alias("dim", "value"))


@query("clean_enn")
def q_clean_enn(spark, d):
    """Edited nearest neighbours (k=3) on the majority class."""
    return resample.clean_enn(C.t4(spark, d, as_columns=False), ["vec_id"]).select("vec_id", "label")


@query("smote_enn")
def q_smote_enn(spark, d):
    """SMOTE then ENN over both classes."""
    return resample.smote_enn(C.t4(spark, d, as_columns=False), ["vec_id"]).select("vec_id", "copy", "label")


@query("clean_tomek")
def q_clean_tomek(spark, d):
    """Majority members of Tomek links removed."""
    return resample.clean_tomek(C.t4(spark, d, as_columns=False), ["vec_id"]).select("vec_id", "label")


@query("smote_tomek")
def q_smote_tomek(spark, d):
    """SMOTE then both members of every Tomek link removed."""
    return resample.smote_tomek(C.t4(spark, d, as_columns=False), ["vec_id"]).select("vec_id", "copy", "label")


@query("silhouette")
def q_silhouette(spark, d):
    """Exact Euclidean silhouette of the 10 embedding classes."""
    return cluster.silhouette(C.t4(spark, d, as_columns=False), ["vec_id"], "class")


def _checks(spark, pairs):
    return spark.createDataFrame([(k, int(v)) for k, v in pairs], "check string, value bigint")


def _checks_df(df: DataFrame, exprs: dict) -> DataFrame:
    """Invariant table (check, value) computed by one aggregation over ``df``."""
    one = df.agg(*[e.cast("bigint").alias(k) for k, e in exprs.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check"), F.col(k).alias("value"))
                                          for k in exprs])).alias("c")).select("c.*")


@query("under_centroids")
def q_under_centroids(spark, d):
    """Majority replaced by n_minority KMeans centroids: counts, and their mean squared
    distance to the majority is below that of as many majority rows."""
    t = _separable(spark, d)
    out = cut_lineage(cluster.under_centroids(t, SEPARABLE))
    vec = F.array(*[F.col(f) for f in SEPARABLE]).alias("vec")
    majority = t.where("label = 0").select(F.col("doc_id").alias("id"), vec)
    centres = out.where("label = 0").select(F.monotonically_increasing_id().alias("id"), vec)
    rows = cut_lineage(resample.under_random(t, C.T3_KEY).where("label = 0").select(F.col("doc_id").alias("id"), vec))
    cost = lambda to: knn.knn_join(majority, to, 1, ["id"]).agg(F.avg(F.col("dist") * F.col("dist"))).first()[0]
    return _checks_df(out, {"minority_rows": F.count(F.when(F.col("label") == 1, 1)),
                            "majority_rows": F.count(F.when(F.col("label") == 0, 1)),
                            "cheaper_than_rows": F.lit(int(cost(centres) < cost(rows)))})


def _planted(rows: DataFrame, key: str, spots: dict) -> DataFrame:
    """Rows with columns a, b around planted spots: ``spots`` maps a label (None: all rows) to (upper share, x, y)."""
    u = lambda tag: hash_unit(hash_key(42, tag, [key]))
    at = {}
    for c, axis in (("a", 1), ("b", 2)):
        place = None
        for label, groups in spots.items():
            for share, *xy in groups:
                here = u("group") < share
                if label is not None:
                    here = here & (F.col("label") == label)
                place = F.when(here, xy[axis - 1]) if place is None else place.when(here, xy[axis - 1])
        at[c] = place + u(c)
    return rows.withColumns(at)


@query("cluster_sizes")
def q_cluster_sizes(spark, d):
    """Sizes of KMeans clusters (k=3) of T4's rows around three planted spots, largest first."""
    t = _planted(C.t4(spark, d, as_columns=False), "vec_id", {None: [(0.5, 0.0, 0.0), (0.8, 30.0, 0.0), (1.0, 0.0, 40.0)]})
    return cluster.cluster_sizes(t, ["a", "b"], 3)


#: Two spots a class; the smaller minority spot and the larger majority spot lie farthest apart.
CLASS_SPOTS = {0: [(0.6, 0.0, 0.0), (1.0, 30.0, 0.0)], 1: [(0.6, 3.0, 0.0), (1.0, 60.0, 5.0)]}


@query("under_cluster_guided")
def q_under_cluster_guided(spark, d):
    """Rows kept of T3 around planted spots (k=2, highest silhouette): the minority and the majority
    cluster of the best separated pair."""
    t = _planted(C.t3(spark, d), "doc_id", CLASS_SPOTS)
    return cluster.under_cluster_guided(t, C.T3_KEY, ["a", "b"], "label", 2)[0].select("doc_id", "label")


@query("cluster_medoids")
def q_cluster_medoids(spark, d):
    """Medoids (k=3) of T3's rows around planted spots, with cluster size and cost."""
    t = _planted(C.t3(spark, d), "doc_id", {None: [(0.4, 0.0, 0.0), (0.7, 30.0, 0.0), (1.0, 0.0, 40.0)]})
    assigned, meds = cluster.medoids(t, C.T3_KEY, ["a", "b"], 3)
    far = F.sqrt((F.col("a") - F.col("ma")) * (F.col("a") - F.col("ma")) + (F.col("b") - F.col("mb")) * (F.col("b") - F.col("mb")))
    to = meds.select("cluster", F.col("doc_id").alias("medoid"), F.col("a").alias("ma"), F.col("b").alias("mb"))
    return assigned.join(to, "cluster").groupBy("medoid").agg(F.count(F.lit(1)).alias("size"),
                                                              F.round(F.sum(far), 6).alias("cost"))


# ------------------------------------------------------------ models B*, chains X*

def _model_checks(spark, d, kind, **params):
    """Test rows per class, and whether the model beats the majority class by half of what is left to gain."""
    flagged = splits.split_stratified(_separable(spark, d), C.T3_KEY, "label", 0.2)
    train, test = splits.train_test(flagged)
    m = models.Classifier(kind, SEPARABLE, "label", C.T3_KEY, **params).fit(train)
    cm = evaluate.classification_metrics(m.transform(test))
    rows, pos = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp"), F.col("fn") + F.col("tp")
    most = F.greatest(pos, rows - pos) / rows
    return cm.select(F.explode(F.array(
        F.struct(F.lit("test_rows").alias("check"), rows.alias("value")),
        F.struct(F.lit("test_pos").alias("check"), pos.alias("value")),
        F.struct(F.lit("beats_majority").alias("check"),
                 (F.col("accuracy") > (1 + most) / 2).cast("bigint").alias("value")),
    )).alias("c")).select("c.*")


@query("clf_knn_resampled")
def q_clf_knn_resampled(spark, d):
    """B4 after R2: 5-NN votes of T4's test split when training rows are repeated."""
    flagged = splits.split_stratified(C.t4(spark, d, as_columns=False), ["vec_id"], "label", 0.2)
    train, test = splits.train_test(flagged)
    return knn.knn_classify(resample.over_random(train, ["vec_id"]), test, ["vec_id"], 5).select("vec_id", "label", "pred")


@query("clf_logistic")
def q_clf_logistic(spark, d):
    """B1: logistic regression (C=1) on T3, test-split invariants."""
    return _model_checks(spark, d, "logistic")


@query("clf_forest")
def q_clf_forest(spark, d):
    """B2: random forest (100 trees, sqrt features, seed 42) on T3."""
    return _model_checks(spark, d, "forest")


@query("clf_svc")
def q_clf_svc(spark, d):
    """Linear SVC (C=1) on T3."""
    return _model_checks(spark, d, "svc")


@query("clf_mlp")
def q_clf_mlp(spark, d):
    """MLP with one hidden layer of 100 units on T3."""
    return _model_checks(spark, d, "mlp")


@query("fit_predict_chain")
def q_fit_predict_chain(spark, d):
    """Drop -> impute -> min-max -> top-decile |corr| -> cluster step -> SMOTE -> logistic, fit on train only."""
    # written: every step's fit reads the split
    flagged = cut_lineage(splits.split_stratified(_separable(spark, d), C.T3_KEY, "label", 0.2))
    train, test = splits.train_test(flagged)
    cfg = grid.Chain(0.5, True, "minmax", "percentile", "smote", "logistic", cluster=(2, "highest", "kmeans"))
    fitted = grid.fit_chain(cfg, train, SEPARABLE, C.T3_KEY)
    pred = fitted.transform(test)
    right = F.sum((F.col("pred") == F.col("label")).cast("int")) / F.count(F.lit(1))
    return _checks_df(pred, {"test_rows": F.count(F.lit(1)), "test_pos": F.sum("label"),
                             "beats_majority": (right > (1 + F.greatest(F.avg("label"), 1 - F.avg("label"))) / 2).cast("int")})


SMALL_GRID = {"scaler": ["minmax", "standard"], "selector": ["all", "percentile"],
              "sampler": ["none", "under_random"], "model": ["logistic"]}


@query("grid_search")
def q_grid_search(spark, d):
    """8-config grid x 3 stratified folds with prefix sharing (invariants)."""
    t = _separable(spark, d)
    cfgs = grid.grid_configs(SMALL_GRID)
    cv = grid.grid_search(t, cfgs, SEPARABLE, C.T3_KEY, "label", 3)
    return _checks_df(cv, {"configs": F.countDistinct("config"), "fold_rows": F.count(F.lit(1)),
                           "separating_fits": F.count(F.when((F.col("f1") > 0.4) & (F.col("train_f1") > 0.4), 1)),
                           "train_apart": F.max((F.col("train_f1") != F.col("f1")).cast("int")),
                           "scored_rows": F.sum(F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp"))})


@query("refit_top")
def q_refit_top(spark, d):
    """Top 2 configs of each of two pipelines refit on the train split, scored on train and test."""
    t = _separable(spark, d)
    flagged = splits.split_stratified(t, C.T3_KEY, "label", 0.2)
    train, test = splits.train_test(flagged)
    plain = {k: v for k, v in SMALL_GRID.items() if k != "sampler"}
    cfgs = grid.grid_configs(plain, "noSampling") + grid.grid_configs({**plain, "sampler": ["under_random"]}, "withSampling")
    cv = grid.grid_search(train, cfgs, SEPARABLE, C.T3_KEY, "label", 3)
    res = grid.refit_top(train, test, cfgs, cv, SEPARABLE, C.T3_KEY, "label", top=2)
    n = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    return _checks_df(res, {"refits": F.countDistinct("config"), "pipelines": F.countDistinct("pipeline"),
                            "sampled": F.count(F.when((F.col("pipeline") == "withSampling")
                                                      & (F.col("params")["sampler"] == "under_random")
                                                      & F.array_contains("steps", "sampler"), 1)),
                            "separating_fits": F.count(F.when(F.col("f1") > 0.4, 1)),
                            "train_rows": F.sum(F.when(F.col("split") == "train", n)),
                            "test_rows": F.sum(F.when(F.col("split") == "test", n))})


@query("train_best")
def q_train_best(spark, d):
    """train/test process: grid search on the train split, best of the refits by test f1 (checks)."""
    cfgs = grid.grid_configs({**SMALL_GRID, "selector": ["all"]})
    done = process.train_test_process(_separable(spark, d), cfgs, SEPARABLE, C.T3_KEY, "label", folds=3, top=2)
    n = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    again = evaluate.classification_metrics(done.model.transform(done.test)).first()
    best = done.scores.where((F.col("split") == "test") & (F.col("config") == done.config)).first()
    return _checks_df(done.scores, {
        "test_rows": F.sum(F.when(F.col("split") == "test", n)) / 2,
        "best_by_test": (F.max(F.when(F.col("split") == "test", F.col("f1"))) == F.lit(best.f1)).cast("int"),
        "model_is_the_best": F.lit(int(abs(again.f1 - best.f1) < 1e-9)),
        "separates": F.lit(int(again.f1 > 0.4))})


@query("run_labeller")
def q_run_labeller(spark, d):
    """One labeller end to end on T3: label counts and describe tables as written to the shared folder."""
    t = C.t3(spark, d).withColumnRenamed("label", "outcome")
    run = process.run_labeller(t, "low_quality", F.col("outcome") == 1, C.T3_FEATURES, C.T3_KEY,
                               configs=[grid.Chain(0.5, True, "minmax", "all", "none", "logistic")], folds=2, top=1)
    tables = {k: spark.read.parquet(v) for k, v in run.items()}
    counts = tables["label_counts"].select(F.concat(F.lit("label "), F.col("label").cast("string")).alias("name"),
                                           F.col("count").cast("double").alias("value"))
    described = tables["describe"].select(F.explode(F.array(*[
        F.struct(F.concat(F.col("feature"), F.lit(f" {c}")).alias("name"), F.round(F.col(c).cast("double"), 6).alias("value"))
        for c in ("count", "min", "p50", "max")])).alias("x")).select("x.*")
    sizes = tables["scores"].select(F.concat(F.lit("rows "), "split").alias("name"), (
        F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).cast("double").alias("value"))
    return counts.union(described).union(sizes)


@query("risk_ensemble_fitted")
def q_risk_ensemble_fitted(spark, d):
    """X8 with fitted chains: two labellers on T3, votes of their chains against two outcomes (checks)."""
    t = _separable(spark, d)
    chains = {"low_quality": grid.Chain(None, False, None, "all", "none", "logistic"),
              "long": grid.Chain(None, False, None, "all", "under_random", "svc")}
    label = {"low_quality": F.col("label"), "long": (F.col("n_words") > 0.05).cast("int")}
    fits = {n: lambda core, n=n: grid.fit_chain(chains[n], core.withColumn("label", label[n]), SEPARABLE, C.T3_KEY)
            for n in chains}
    table = ensemble.model_ensemble(t, C.T3_KEY, fits, {"quality": F.col("label") == 1, "toxic": F.col("toxic") > 0}, 0.2)
    on = lambda name, c: F.sum(F.when(F.col("risk_name") == name, F.col(c)))
    rate = lambda voted: (F.sum(F.when((F.col("risk_name") == "quality") & voted, F.col("risk")))
                          / F.sum(F.when((F.col("risk_name") == "quality") & voted, F.col("total"))))
    return _checks_df(table, {
        "quality_total": on("quality", "total"), "quality_risk": on("quality", "risk"),
        "toxic_total": on("toxic", "total"), "toxic_risk": on("toxic", "risk"),
        "votes_tell": (rate(F.col("score") > 0) > rate(F.col("score") == 0)).cast("int")})
