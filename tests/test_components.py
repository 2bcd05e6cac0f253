import random

from tessera.operators.components import connected_components


def naive(edges):
    label = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    return label


def test_chain_star_and_random(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(5, 5)]
    edges += [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert {r.node: r.component for r in got} == naive(edges)
    assert len(got) == len({x for e in edges for x in e})


def test_empty_and_null_ends(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
    assert connected_components(spark.createDataFrame([(None, 1), (2, 3)], "a long, b long"), "a", "b").count() == 2
