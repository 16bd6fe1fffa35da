"""Pairs of sets that overlap: every pair once, whatever sizes and repeats, and none shuffled."""

import random
from itertools import combinations

from lodestone.operators import joins


def brute(rows):
    sets = {}
    for k, i in rows:
        if k is not None and i is not None:
            sets.setdefault(k, set()).add(i)
    return sorted((a, b, len(sets[a] & sets[b])) for a, b in combinations(sorted(sets), 2) if sets[a] & sets[b])


def test_overlapping_sets(spark):
    r = random.Random(7)
    rows = [(k, r.randrange(150)) for k in range(40) for _ in range(r.randrange(1, 30))] + [(99, i) for i in range(100)] + [(None, 1), (1, None), (2, 5), (2, 5)]
    df = spark.createDataFrame(rows, "k long, i long")
    for most in (64, 10, 1):
        assert sorted(map(tuple, joins.overlapping(df, "k", "i", most=most).collect())) == brute(rows)


def test_pairs_are_not_summed(spark):
    df = spark.createDataFrame([(1, 1), (2, 1), (2, 2), (1, 2)], "k long, i long")
    out = joins.overlapping(df, "k", "i")
    assert "Aggregate" not in out._jdf.queryExecution().optimizedPlan().toString() and out.collect() == [(1, 2, 2)]
