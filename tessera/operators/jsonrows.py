"""JSON texts as rows, by VARIANT columns: arrays exploded, objects filtered by their keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exploded(rows: DataFrame, text: str, path: str = "$", keep: bool = False) -> DataFrame:
    """``rows`` with ``place`` (from 0) and ``item`` (VARIANT) of each element of the array at ``path`` in a JSON text.

    Texts that aren't JSON, and values that aren't arrays there, have no elements;
    with ``keep`` rows without elements stay, with nulls.
    """
    name = next(n for n in ("_array", "_array_", "_array__") if n not in rows.columns)
    found = F.try_variant_get(F.try_parse_json(F.col(text)), path, "variant")
    # an object would be exploded by its keys
    lists = F.when(F.schema_of_variant(found).startswith("ARRAY"), found)
    parsed = rows.withColumn(name, lists)
    tables = parsed.sparkSession.tvf
    items = (tables.variant_explode_outer if keep else tables.variant_explode)(F.col(name).outer())
    return parsed.lateralJoin(items.select(F.col("pos").alias("place"), F.col("value").alias("item"))).drop(name)


def has_key(item: Column, key: str) -> Column:
    """Whether an object has a key, also with a null value; false for what is no object."""
    return F.coalesce(F.try_variant_get(item, f"$['{key}']", "variant").isNotNull(), F.lit(False))


def value_at(item: Column, path: str, kind: str = "string") -> Column:
    """The value at a path, or null if it is absent or of another kind."""
    return F.try_variant_get(item, path, kind)
