"""Runs of periodic words against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from lodestone.llm import periodic, queries

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute_runs(words):
    """Every stretch with a period, extended as far as it goes, from the definition."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)  # ascending periods: the smallest stays
            i = j + 1
    return sorted((i, j - i, q) for (i, j), q in found.items())


def brute(doc_id, text):
    words = WORD.findall((text or "").encode())
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    dropped = {k for i, length, q in runs for k in range(i + q, i + length)}
    kept = b" ".join(w for k, w in enumerate(words) if k not in dropped)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    lines = "".join(f"{i},{length},{q}\n" for i, length, q in runs)
    return (doc_id, len(runs), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("index", [periodic.Hashes, periodic.Ranks])
def test_runs_equal_brute_force(index):
    rng = random.Random(7)
    for _ in range(300):
        texts = []
        for _ in range(rng.randrange(1, 6)):
            words: list[int] = []
            for _ in range(rng.randrange(6)):
                unit = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.randrange(1, 9))]
                words += (unit * rng.randrange(1, 9))[: rng.randrange(1, 60)]
            texts.append(words)
        bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        start, end, q = periodic.find(np.array(sum(texts, []), np.int64), bounds, index)
        expected = [(b + i, b + i + length, p) for b, t in zip(bounds.tolist(), texts, strict=False) for i, length, p in brute_runs(t)]
        assert list(zip(start.tolist(), end.tolist(), q.tolist(), strict=True)) == expected


def test_hash_collisions_of_structured_words_are_caught():
    """The Thue-Morse word and its complement share every polynomial sum modulo 2**64."""
    size = 1 << 12
    morse = np.array([bin(i).count("1") & 1 for i in range(size)], np.int64)
    text = np.concatenate((morse, 1 - morse, morse, 1 - morse, morse, 1 - morse))
    start, end, q = periodic.find(text, np.array([0, len(text)]))
    exact = periodic.find(text, np.array([0, len(text)]), periodic.Ranks)
    assert all(np.array_equal(x, y) for x, y in zip((start, end, q), exact, strict=True))
    assert not len(q)  # three periods of 2 * size words are too few
    twice = np.tile(text, 2)
    assert [x.tolist() for x in periodic.find(twice, np.array([0, len(twice)]))] == [[0], [len(twice)], [2 * size]]


def test_query_equals_brute_force_on_odd_rows(spark, tmp_path):
    rng = random.Random(3)
    texts = [None, "", " \t\n", "a", "x " * 7, "a b " * 12 + "\x0b\x0c" + "a b\x00 c", "  é " * 9, "été été " * 8, "w " * 4_000 + "z", "ab" * 400_000]
    texts += [" ".join(rng.choice(["p", "q", "r"]) for _ in range(rng.randrange(80))) for _ in range(400)]
    texts += [("\n".join(f"w{rng.randrange(9)}" for _ in range(rng.randrange(1, 30))) + " ") * rng.randrange(1, 9) for _ in range(100)]
    rows = [(i % 400 if i % 97 else None, t, i, "s") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h long, start string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op13_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted((brute(i, t) for i, t, *_ in rows), key=key)


def test_empty_table_and_collapsed_text(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert periodic.collapse(empty).count() == 0 and periodic.with_planted(empty).count() == 0
    row = periodic.collapse(spark.createDataFrame([(1, "so  it goes it goes\tit goes it goes on")], "doc_id long, text string")).first()
    assert row["collapsed"] == "so it goes on" and [tuple(r) for r in row["runs"]] == [(1, 8, 2)]
