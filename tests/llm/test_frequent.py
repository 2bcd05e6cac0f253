import random

from tessera.llm import frequent


def test_most_frequent(spark, monkeypatch):
    monkeypatch.setattr(frequent, "PARTS", 64)
    rng = random.Random(1)
    rows = [(i, rng.choice([1, 1, 1, 2, 3, 50, 51, 52, 900])) for i in range(3000)]
    counted = spark.createDataFrame(rows, "key long, n long")
    for most in (0, 10, 700, 1500, 2999, 3000, 5000):
        got = {r.key: r.n for r in frequent.most_frequent(counted, "n", "key", most).collect()}
        least = min(got.values(), default=1000)
        assert len(got) <= most and all(k in got for k, n in rows if n > least)
        assert len(got) > most - 0.1 * len(rows) or len(got) == len(rows)
    assert frequent.most_frequent(counted.where("false"), "n", "key", 5).count() == 0
