from pyspark.sql import functions as F

from riskframe.operators import splits


def _data(spark, n=1000, parts=4):
    rows = [(i, int(i % 7 == 0)) for i in range(n)]
    return spark.createDataFrame(rows, "id bigint, label int").repartition(parts)


def test_split_exact_counts_and_repartition_invariance(spark):
    a = splits.split_stratified(_data(spark, parts=1), ["id"], "label", 0.2, bits=6)
    b = splits.split_stratified(_data(spark, parts=17), ["id"], "label", 0.2, bits=12)
    ta = {r.id for r in a.where("is_test = 1").collect()}
    tb = {r.id for r in b.where("is_test = 1").collect()}
    assert ta == tb
    counts = {r.label: r["count"] for r in a.where("is_test = 1").groupBy("label").count().collect()}
    n1 = sum(1 for i in range(1000) if i % 7 == 0)
    assert counts[1] == int(n1 * 0.2 + 0.5) and counts[0] == int((1000 - n1) * 0.2 + 0.5)


def test_rank_matches_plain_window(spark):
    from pyspark.sql import Window
    from riskframe.functions.rules import hash_key
    df = _data(spark)
    a = splits.exact_rank(df, ["id"], ["label"], 42, "t", bits=5).select("id", "rank")
    w = Window.partitionBy("label").orderBy(hash_key(42, "t", ["id"]), "id")
    b = df.select("id", F.row_number().over(w).alias("rank"))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_folds_balanced(spark):
    f = splits.folds_stratified(_data(spark), ["id"], "label", 10)
    sizes = [r["count"] for r in f.groupBy("fold").count().collect()]
    assert max(sizes) - min(sizes) <= 2 and sum(sizes) == 1000


def test_holdout(spark):
    h = splits.split_holdout(_data(spark), ["id"], 0.1)
    assert h.where("is_holdout = 1").count() == 100
