import pytest
from pyspark.sql import functions as F

from riskframe.operators import evaluate

# Published confusion matrices and scores (test and train tables of the study).
PUBLISHED = [
    (6564, 329, 96, 64, 0.2315, 0.1628, 0.4000, 0.9397, 0.6761),
    (6621, 272, 110, 50, 0.2075, 0.1553, 0.3125, 0.9458, 0.6365),
    (4670, 1132, 435, 816, 0.5102, 0.4189, 0.6523, 0.7778, 0.7286),
    (5561, 739, 236, 517, 0.5147, 0.4116, 0.6866, 0.8618, 0.7846),
    (119, 451, 31, 216, 0.4726, 0.3238, 0.8745, 0.4100, 0.5416),
    (26614, 956, 0, 641, 0.5728, 0.4014, 1.0000, 0.9661, 0.9827),
    (20782, 4416, 457, 2556, 0.5120, 0.3666, 0.8483, 0.8273, 0.8365),
    (554, 1727, 103, 882, 0.4908, 0.3381, 0.8954, 0.4397, 0.5692),
]


def test_published_metric_identities(spark):
    df = spark.createDataFrame([p[:4] for p in PUBLISHED], "tn bigint, fp bigint, fn bigint, tp bigint")
    got = df.select(*evaluate.metric_columns()).collect()
    for row, p in zip(got, PUBLISHED):
        assert (row.f1, row.precision, row.recall, row.accuracy, row.auc_roc) == pytest.approx(p[4:], abs=6e-5)


def test_zero_division(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (0, 0)], "label int, pred int")
    r = evaluate.classification_metrics(df).collect()[0]
    assert r.precision == 0.0 and r.f1 == 0.0 and r.recall == 0.0
    df2 = spark.createDataFrame([(0, 1), (0, 0)], "label int, pred int")
    r2 = evaluate.classification_metrics(df2).collect()[0]
    assert r2.recall == 0.0 and r2.f1 == 0.0


def test_argmax_first_on_ties(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 0.7), (3, 0.7)], "ordinal int, score double")
    assert evaluate.argmax_first(df, "score", "ordinal").collect()[0].ordinal == 2


def test_curves_match_bruteforce(spark):
    import random
    random.seed(1)
    rows = [(random.randint(0, 1), float(random.randint(0, 30))) for _ in range(300)]
    df = spark.createDataFrame(rows, "label int, score double").repartition(7)
    out = evaluate.roc_curve(df, "label", "score").collect()
    pts = {r.threshold: r for r in out if r.threshold is not None}
    auc = [r.auc for r in out if r.threshold is None][0]
    P = sum(y for y, _ in rows)
    N = len(rows) - P
    for t, r in pts.items():
        tp = sum(1 for y, s in rows if s >= t and y == 1)
        fp = sum(1 for y, s in rows if s >= t and y == 0)
        assert r.tpr == pytest.approx(tp / P) and r.fpr == pytest.approx(fp / N)
    xs = sorted(pts.values(), key=lambda r: -r.threshold)
    area, pf, pt = 0.0, 0.0, 0.0
    for r in xs:
        area += (r.fpr - pf) * (r.tpr + pt) / 2
        pf, pt = r.fpr, r.tpr
    assert auc == pytest.approx(area)
    # many buckets: same answer
    c1 = {r.threshold: r.tp for r in evaluate.cumulative_by_threshold(df, "label", "score", buckets=4).collect()}
    c2 = {r.threshold: r.tp for r in evaluate.cumulative_by_threshold(df, "label", "score", buckets=64).collect()}
    assert c1 == c2


def test_top_k_per_group_skew(spark):
    rows = [("hot", i, float(i % 50)) for i in range(2000)] + [("cold", i, float(i)) for i in range(3)]
    df = spark.createDataFrame(rows, "model string, ordinal int, f1 double")
    got = evaluate.top_k_per_group(df, ["model"], "f1", "ordinal", 3).orderBy("model", "rank").collect()
    hot = [(r.ordinal, r.rank) for r in got if r.model == "hot"]
    assert hot == [(49, 1), (99, 2), (149, 3)]
    assert [r.ordinal for r in got if r.model == "cold"] == [2, 1, 0]


def test_risk_table(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (2, 1), (2, 1), (3, 0)], "score int, risk int")
    got = {r.score: (r.risk, r.total) for r in evaluate.risk_table(df).collect()}
    assert got == {0: (1, 2), 2: (2, 2), 3: (0, 1)}
