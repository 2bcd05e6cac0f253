"""Tables of names must not go through the driver, however small their files are."""

from pyspark.sql import functions as F

from tessera.operators import naming


def test_only_grams_are_broadcast(spark):
    known = spark.range(50).select("id", F.concat(F.lit("Ann Sur"), F.col("id").cast("string")).alias("name"))
    said = spark.range(50).select("id", F.concat(F.lit("Ann Surr"), F.col("id").cast("string")).alias("said"))
    found = naming.resolve(said, known, "said")
    plan = found._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.split("\n") if "BroadcastHashJoin" in line]
    assert joins and all("_g#" in line and "BuildRight" in line for line in joins), joins
    assert found.where("tier = 2").count() == 50
