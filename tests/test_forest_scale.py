from pyspark.sql import functions as F

from riskframe.operators import models


def test_forest_tasks_do_not_grow_with_the_rows():
    assert models.fit_partitions("forest", 10_000, 12) == 1
    assert models.fit_partitions("forest", 2_400_000, 12) == 12  # 96 before
    assert models.fit_partitions("forest", 48_000_000, 12) == 48
    assert models.fit_partitions("svc", 2_400_000, 12) == 96
    assert models.fit_partitions("svc", 0, 12) == 1


def test_forest_keeps_the_node_of_each_row(spark):
    assert models._spark_estimator("forest", 100, 2, 42, {}).getCacheNodeIds()
    rows = spark.range(400).select(F.col("id"), (F.col("id") % 7).cast("double").alias("a"),
                                   (F.col("id") % 40).cast("double").alias("b"), (F.col("id") % 40 > 30).cast("int").alias("label"))
    fitted = models.Classifier("forest", ["a", "b"], key=["id"], n_trees=10).fit(rows)
    assert fitted.transform(rows).where("pred = label").count() > 390
