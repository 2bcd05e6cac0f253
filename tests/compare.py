"""Runs registered queries and their SQL side by side: python -m tests.compare [sf_dir] [name ...]"""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd
import pyarrow as pa

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return db


def rows_of(frame: pd.DataFrame):
    columns = sorted(frame.columns)
    shown = lambda x: "null" if pd.api.types.is_scalar(x) and pd.isna(x) else f"{float(x) + 0.0:.6f}" if isinstance(x, float) else str(x)
    return columns, sorted(tuple(shown(x) for x in r) for r in frame[columns].astype(object).itertuples(index=False))


def difference(spark, db, sf_dir, query, sql):
    """None if both give the same rows, else what differs."""
    found = query(spark, sf_dir).toArrow()
    a, b = found.to_pandas(), db.execute(sql).df()
    # pandas would turn whole numbers with nulls into floats
    for c in found.column_names:
        if found[c].null_count and pa.types.is_integer(found[c].type):
            a[c] = found[c].to_pandas(types_mapper={found[c].type: pd.Int64Dtype() if found[c].type == pa.int64() else pd.Int32Dtype()}.get)
    (ca, ra), (cb, rb) = rows_of(a), rows_of(b)
    if ca != cb:
        return f"columns {ca} {cb}"
    kinds = {c: (str(a[c].dtype), str(b[c].dtype)) for c in ca if a[c].dtype != b[c].dtype and len(a)}
    if ra != rb:
        x, y = set(ra), set(rb)
        return f"{len(ra)} and {len(rb)} rows {kinds}; only here {sorted(x - y)[:2]}, only there {sorted(y - x)[:2]}"
    return f"types {kinds}" if kinds else None


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir, *names = sys.argv[1:] or ["/root/testdata/sf0.001"]
    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    db, queries, sql = database(sf_dir), entry.queries(), entry.oracle_sql()
    for name in names or sql:
        began = time.time()
        try:
            said = difference(spark, db, sf_dir, queries[name], sql[name]) or "same"
        except Exception as e:  # noqa: BLE001
            said = f"{type(e).__name__}: {str(e)[:700]}"
        print(f"{name}: {said} ({time.time() - began:.1f} s)", flush=True)


if __name__ == "__main__":
    main()
