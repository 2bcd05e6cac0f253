"""The nearest spelling, by each way of finding candidates."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import fuzzy
from tessera.operators import naming


def test_few_of_names_alike_are_compared(spark, monkeypatch):
    """All names share all but digits; the comparisons grow with the names, not with their pairs."""
    compared = spark.sparkContext.accumulator(0)
    ratio = fuzzy.ratio

    @F.pandas_udf("double")
    def counted(a: pd.Series, b: pd.Series) -> pd.Series:
        compared.add(len(a))
        return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    monkeypatch.setattr(naming.fuzzy, "fuzz_ratio", counted)
    number = (F.col("id") * 7919 + 100000).cast("string")
    known = spark.range(400).select("id", F.concat(F.lit("ann sur"), number).alias("name"))
    said = spark.range(400).select(F.concat(F.lit("ann surr"), number).alias("n")).union(spark.range(40).select(F.concat(F.lit("nobody of this name "), number)))
    got = naming.nearest_names(said, known, "n", "id", "name", 88.0).collect()
    assert sorted((r.id, r.name) for r in got) == sorted((i, f"ann surr{i * 7919 + 100000}") for i in range(400))
    assert compared.value < 20 * 400


@pytest.mark.parametrize("share", [0.0, 0.05, 1e9])
def test_all_ways_find_the_same(spark, monkeypatch, share):
    """Subsequences and grams each find what all pairs give, also with ties, copies and characters of several bytes."""
    monkeypatch.setattr(naming, "GRAM_PAIRS", share)
    rng = random.Random(3)
    known = ["".join(rng.choice("abß😀 ") for _ in range(rng.randrange(1, 14))) for _ in range(120)] + ["aaaa", "aaaa", "aaaaaa", "x" * 60]

    def changed(s):
        for _ in range(rng.randrange(4)):
            p = rng.randrange(len(s) + 1)
            s = s[:p] + rng.choice(["", "a", "b", "ß"]) + s[p + rng.randrange(2) :]
        return s

    asked = sorted({changed(rng.choice(known)) for _ in range(150)} | {"aaaaa", "x" * 55 + "yyy", "x" * 47, None, ""}, key=str)
    rows = spark.createDataFrame([(a,) for a in asked], "n string")
    people = spark.createDataFrame([(i * 37 % 200, k) for i, k in enumerate(known)], "id long, name string")
    want = {}
    for a in asked:
        near = [(fuzzy.ratio(a, k), -(i * 37 % 200)) for i, k in enumerate(known) if k.strip(" ")]
        if a and a.strip(" ") and max(near)[0] >= 80:
            want[a] = max(near)
    got = {r.name: (r.similarity, -r.id) for r in naming.nearest_names(rows, people, "n", "id", "name", 80.0).collect()}
    assert len(want) > 80 and got == want
