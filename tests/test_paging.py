"""Pages of sorted rows: an offset without a limit returns all the rest."""

import pytest
from pyspark.sql import functions as F

from tessera import registry
from tessera.operators import sequence


@pytest.mark.parametrize("n", [1, 4, 5, 6, 9, 20])
def test_rows_after_the_first(spark, n):
    rows = [(None, "a"), (1, "a"), (2, "c"), (2, "a"), (2, "b"), (2, "b"), (5, "a"), (3, "x"), (None, "b")]
    frame = spark.createDataFrame(rows, "k int, v string").repartition(3)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))[n:]
    got = [tuple(r) for r in sequence.after_first(frame, ["k"], n).collect()]
    assert [k for k, _ in got] == [k for k, _ in want] and sorted(map(str, got)) == sorted(map(str, want))


def test_nothing_to_page(spark):
    assert sequence.after_first(spark.createDataFrame([], "k int, v string"), ["k"], 3).collect() == []


def test_filters_return_more_than_a_million_rows(spark, tmp_path):
    orders = spark.range(1_000_300).select(F.col("id").alias("o_orderkey"), F.lit(1).cast("long").alias("o_custkey"), F.lit("1-urgent").alias("o_orderpriority"), F.lit("1997-01-01").cast("timestamp_ntz").alias("o_orderdate"))
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, "FURNITURE")], "c_custkey long, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    found = registry.QUERIES["relative_date_enum_paging"](spark, str(tmp_path)).agg(F.count("*"), F.min("o_orderkey"), F.max("o_orderkey")).first()
    assert tuple(found) == (1_000_290, 10, 1_000_299)
