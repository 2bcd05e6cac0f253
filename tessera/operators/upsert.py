"""Changes to keyed tables, as new tables: insert, upsert, update, delete, re-key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of_each(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def insert_if_absent(target: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``target`` and the first new row of each key that it lacks."""
    return target.unionByName(first_of_each(new, keys, order).join(target, list(keys), "left_anti"))


def upsert(target: DataFrame, new: DataFrame, keys: Sequence[str], columns: dict[str, str] | None = None, keep_when: Column | None = None) -> DataFrame:
    """``target`` with the rows of ``new`` (unique by key) put in.

    ``columns`` says what becomes of each column of a key on both sides:
    ``new`` takes the new value, ``old`` keeps the old one, ``coalesce`` takes the
    new one unless it is null, ``nonempty`` unless it is null or empty.  Others
    are ``new``.  Rows of ``target`` that fulfil ``keep_when`` stay as they are.
    """
    columns = columns or {}
    old = target.withColumn("_old", F.lit(True))
    if keep_when is not None:
        old = old.withColumn("_fixed", F.coalesce(keep_when, F.lit(False)))
    else:
        old = old.withColumn("_fixed", F.lit(False))
    both = old.alias("o").join(new.withColumn("_new", F.lit(True)).alias("n"), list(keys), "full_outer")

    def merged(c: str) -> Column:
        o, n = F.col(f"o.{c}"), F.col(f"n.{c}")
        found = F.col("_old").isNotNull() & F.col("_new").isNotNull()
        how = columns.get(c, "new")
        value = {"new": n, "old": o, "coalesce": F.coalesce(n, o), "nonempty": F.coalesce(F.nullif(n, F.lit("")), o) if how == "nonempty" else n}[how]
        return F.when(found & F.col("_fixed"), o).when(found, value).when(F.col("_old").isNotNull(), o).otherwise(n).alias(c)

    return both.select(*keys, *[merged(c) for c in target.columns if c not in keys]).select(target.columns)


def update_from(target: DataFrame, changes: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``target`` with columns replaced where ``changes`` (unique by key) has a non-null value."""
    new = changes.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = target.join(new, list(keys), "left")
    return joined.select(*[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in target.columns])


def delete_using(target: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return target.join(gone.select(*keys), list(keys), "left_anti")


def rekey(target: DataFrame, mapping: DataFrame, column: str, old: str = "old_id", new: str = "new_id") -> DataFrame:
    """``target`` with ids replaced by what ``mapping`` (unique by old id) says."""
    joined = target.join(mapping.select(F.col(old).alias("_old"), F.col(new).alias("_new")), F.col(column) == F.col("_old"), "left")
    return joined.withColumn(column, F.coalesce("_new", column)).select(target.columns)


def existing_changes(mapping: DataFrame, existing: DataFrame, key: str, old: str = "old_id", new: str = "new_id") -> DataFrame:
    """The rows of a mapping that change an id there is."""
    return mapping.where(F.col(old) != F.col(new)).join(existing.select(F.col(key).alias(old)), old, "left_semi").select(mapping.columns)


def keeps_order(existing: DataFrame, mapping: DataFrame, key: str, old: str = "old_id") -> DataFrame:
    """One row, keeps_order: whether some existing id is not in a mapping, so that it must be made from the order of the existing ones."""
    return existing.select(F.col(key).alias("_k")).distinct().join(mapping.select(F.col(old).alias("_k")), "_k", "left_anti").agg((F.count("*") > 0).alias("keeps_order"))


def numbered_ids(rows: DataFrame, base: str, order: Sequence[str], existing: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``id``: base, underscore and the least number from 1 that no row before it and no existing id has."""
    parts = existing.select(F.regexp_extract(key, r"^(?s)(.*)_(\d+)$", 1).alias("_b"), F.regexp_extract(key, r"_([1-9]\d*)$", 1).try_cast("long").alias("_n")).where("_n is not null").distinct()
    # the n-th free number is n and one more for each taken number that has fewer than n free ones before it
    taken = parts.select("_b", (F.col("_n") - F.row_number().over(Window.partitionBy("_b").orderBy("_n"))).alias("_v"), F.lit(1).alias("_taken"))
    new = rows.withColumn("_b", F.col(base)).withColumn("_v", F.row_number().over(Window.partitionBy("_b").orderBy(*order)).cast("long")).withColumn("_taken", F.lit(0))
    both = new.unionByName(taken, allowMissingColumns=True)
    before = F.sum("_taken").over(Window.partitionBy("_b").orderBy("_v", "_taken").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("_m", F.col("_v") + before).where("_taken = 0").withColumn("id", F.concat_ws("_", "_b", F.col("_m").cast("string"))).select(*rows.columns, "id")


def null_orphans(children: DataFrame, parents: DataFrame, column: str, parent_key: str) -> DataFrame:
    """``children`` with a reference to no existing parent set to null."""
    known = parents.select(F.col(parent_key).alias("_p")).distinct()
    return children.join(known, F.col(column) == F.col("_p"), "left").withColumn(column, F.col("_p")).select(children.columns)


def delete_cascading(tables: dict[str, DataFrame], name: str, gone: DataFrame, key: str, references: Sequence[tuple[str, str, str, str, str]]) -> dict[str, DataFrame]:
    """``tables`` after the rows of one are deleted whose ``key`` is in ``gone`` (a column of that name).

    A reference (child, column, parent, key, how) says what becomes of a child's rows
    whose parent goes: ``cascade`` deletes them, and what refers to them in turn;
    ``null`` empties their column.  References come after those that delete their
    parents' rows; rows that refer to nothing stay.
    """
    left, lost = dict(tables), {name: tables[name].join(gone.select(key).distinct(), key, "left_semi")}
    left[name] = tables[name].join(gone.select(key).distinct(), key, "left_anti")
    for child, column, parent, parent_key, how in references:
        if parent not in lost:
            continue
        parents = lost[parent].select(F.col(parent_key).alias("_p")).where("_p is not null").distinct()
        refers = F.col(column) == F.col("_p")
        if how == "cascade":
            dead = left[child].join(parents, refers, "left_semi")
            lost[child] = lost[child].unionByName(dead) if child in lost else dead
            left[child] = left[child].join(parents, refers, "left_anti")
        else:
            marked = left[child].join(parents, refers, "left")
            left[child] = marked.withColumn(column, F.when(F.col("_p").isNull(), F.col(column))).select(left[child].columns)
    return left


def backfill(target: DataFrame, changes: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``target`` with columns filled from ``changes`` (unique by key) where they are null."""
    new = changes.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = target.join(new, list(keys), "left")
    return joined.select(*[F.coalesce(F.col(c), F.col(f"_{c}")).alias(c) if c in columns else F.col(c) for c in target.columns])


def delete_all(target: DataFrame) -> tuple[DataFrame, int]:
    """An empty table of the same columns, and how many rows there were."""
    return target.where("false"), target.count()


def snapshot(target: DataFrame, path: str) -> DataFrame:
    """A copy of a table as it is now, in a new folder; an existing one is an error."""
    target.write.mode("errorifexists").parquet(path)
    return target.sparkSession.read.schema(target.schema).parquet(path)


def with_search_words(rows: DataFrame, *texts: Column, name: str = "words") -> DataFrame:
    """``rows`` with the distinct words of their texts in order, as a write derives them for full-text search."""
    from tessera.functions import text as ft

    return rows.withColumn(name, F.array_sort(F.array_distinct(ft.tokens(F.concat_ws(" ", *texts)))))


def due(watched: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Watched videos to process: automatic ones that aren't processed, never tried or last tried more than ``hours`` ago."""
    old = F.col("last_processed").isNull() | (F.col("last_processed") < now - F.expr(f"INTERVAL {hours} HOURS"))
    return watched.where(F.coalesce("auto_process", F.lit(False)) & (F.coalesce("status", F.lit("pending")) != "processed") & old)
