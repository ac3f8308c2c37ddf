import random

from cathodyne.plans.components import connected_components


def smallest(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {x: find(x) for x in parent if find(x) != x}


def check(spark, pairs):
    got = connected_components(spark.createDataFrame(pairs, "a long, b long"))
    assert {r.id: r.component for r in got.collect()} == smallest(pairs)


def test_random_graph(spark):
    rng = random.Random(1)
    check(spark, [(rng.randrange(200), rng.randrange(200)) for _ in range(120)])


def test_chain_star_and_odd_rows(spark):
    chain = list(range(40))
    random.Random(2).shuffle(chain)
    pairs = list(zip(chain, chain[1:])) + [(1000, 1000 + k) for k in range(30)] + [(5, 5), (None, 3), (7, None), (1, 2), (1, 2), (-9, 40)]
    check(spark, pairs)


def test_no_links(spark):
    check(spark, [])
