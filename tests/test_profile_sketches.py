"""Profiles by sketches, as batches leave them."""

from pyspark.sql import functions as F

from lakeward.operators import profile


def test_sketches_keep_few_fields_and_count_within_two_percent(spark):
    df = spark.range(100_000).select("id", (F.col("id") % 1000).cast("double").alias("x"), F.when(F.col("id") < 0, "a").alias("none"))
    found = profile.column_metrics(df, approximate=True)
    got = {r["column_name"]: r["distinct_count"] for r in found.collect()}
    assert abs(got["id"] - 100_000) < 2000 and abs(got["x"] - 1000) < 20 and got["none"] == 0
    assert len(found._jdf.queryExecution().executedPlan().toString()) < 100_000 and "approx_count_distinct" not in found._jdf.queryExecution().executedPlan().toString()
