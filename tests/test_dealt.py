"""Tables are dealt into tasks of so many rows."""

import pytest

from lodestone.operators import graph, handlers


@pytest.fixture(autouse=True)
def small(monkeypatch):
    monkeypatch.setattr(graph, "_ROWS_A_TASK", 3, raising=False)
    monkeypatch.setattr(handlers, "_ROWS_A_TASK", 3, raising=False)


def test_longest_prefixes_are_dealt_by_rows(spark):
    words = spark.createDataFrame([(i, w) for i, w in enumerate(["abc", "abd", "x", "ab", "zz", "abcd", "abc", "qq", "abce", "abz"])] + [(0, "ab")], "k long, w string")
    names = spark.createDataFrame([("abc",), ("abcq",), ("abc",), ("abz",)], "n string")
    out = handlers.longest_prefixes(words, "k", "w", names, "n")
    assert sorted(map(tuple, out.collect())) == [(0, "abc", 2), (1, "ab", 3), (3, "ab", 3), (5, "abc", 2), (6, "abc", 2), (8, "abc", 2), (9, "abz", 1)]
    assert out.rdd.getNumPartitions() == 4


def test_edges_are_dealt_by_rows(spark):
    rows = [(i % 2, "p", float(i), None if i == 9 else i % 5) for i in range(20)]
    out = graph.build_edges(spark.createDataFrame(rows, "s long, p string, q double, e long"), ["s", "p"], "q", "e")
    assert sorted(map(tuple, out.collect())) == [(0, "p", 18.0, 5), (1, "p", 19.0, 5)] and out.rdd.getNumPartitions() == 7
