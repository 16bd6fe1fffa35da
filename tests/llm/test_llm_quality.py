"""The quality rules: statistics and scores against plain Python, bounds of the sample, held-out accuracy."""

import math
import random
import re

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from lodestone.llm import quality, queries

TEXTS = [None, "", " ", "One two. Three!", "A|B | c\nA|B | c", "ÉCOLE école\t12½ — ok?", "$$$ ### a", "x" * 300_000, "word " * 50_000, "’quote’-mark;:"]


def plain(text):
    """The statistics by Python."""
    text = text or ""
    words, lines = re.split(r"[ \t\n\x0b\f\r]+", text), text.split("\n")
    blank = len(re.findall(r"[ \t\n\x0b\f\r]", text))
    solid = len(text) - blank
    over = lambda a, b: a / b if b > 0 else 0.0
    count = lambda p: len(regex.findall(p, text))
    marks = len(regex.sub(r"[\p{L}\p{M}\p{N}\s.,;:'’\-]+", "", text))
    return [
        len(words), over(solid, len(words)), over(len(set(words)), len(words)), over(len(words), len(lines)), over(len(set(lines)), len(lines)), over(count(r"\p{Lu}"), solid),
        over(count(r"\p{N}"), solid), over(marks, solid), over(text.count("|"), len(words)), over(count("[.!?]"), len(words)), over(text.count("!"), len(words)), over(blank, len(text)),
    ]


def test_statistics_and_scores_equal_plain_python(spark):
    model = quality.Model(0.3, [((("kinds", 0.2, np.inf), ("marks", -np.inf, 0.05)), 1.25), ((("words", -np.inf, 3.0),), -2.0), ((("upper", 0.01, 0.4),), 0.5)])
    docs = spark.createDataFrame([(i, t, 7.0, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_words double, q_words int")
    columns = [f"q_{n}" for n in quality.STATISTICS]
    got = {r[0]: list(r[1:]) for r in quality.with_statistics(docs.select("doc_id", "text")).select("doc_id", *columns).collect()}
    scores = {r["doc_id"]: r for r in quality.score(docs, model).collect()}
    for i, t in enumerate(TEXTS):
        stats = plain(t)
        assert got[i] == pytest.approx(stats), t and t[:30]
        held = quality.holds([r for r, _ in model.rules], np.array([stats]))[0]
        z = model.bias + sum(w for (_, w), h in zip(model.rules, held, strict=True) if h)
        assert scores[i]["score"] == pytest.approx(1 / (1 + math.exp(-z)))
        assert scores[i]["predicted"] == int(scores[i]["score"] >= 0.7)


def test_lasso_drops_rules_without_use():
    rng = np.random.default_rng(0)
    x = (rng.random((2000, 30)) < 0.5).astype(np.float32)
    y = (rng.random(2000) < 1 / (1 + np.exp(-(3 * x[:, 3] - 3 * x[:, 7])))).astype(float)
    w = quality.lasso(x, y, 0.02)
    assert set(np.flatnonzero(np.abs(w[:-1]) > 1e-4)) == {3, 7} and w[3] > 0 > w[7]


def test_learns_only_from_agreed_rows_that_are_not_held_out(spark):
    rng = random.Random(1)
    good = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(40)) + "."
    rows = [(i, good() if i % 2 else "SPAM! " * 40) for i in range(800)] + [(None, good())] * 5 + [(1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(800)] + [(3, 0), (None, 1), (5, None)], "doc_id long, quality int")
    values, y = quality.sample(docs, labels)
    held = {r[0] for r in docs.filter(quality.held_out() & F.col("doc_id").isNotNull()).select("doc_id").collect()}
    assert len(y) == len({i for i in range(800)} - held - {3}) + (1 not in held)  # id 3 has two labels, id 1 two texts
    flipped = labels.join(docs.filter(quality.held_out()).select("doc_id").distinct(), "doc_id", "left").selectExpr("doc_id", "quality")
    assert np.array_equal(quality.sample(docs, flipped)[1], y)
    out = quality.score(docs, quality.fit(values, y)).join(labels.filter("doc_id NOT IN (1, 3, 5)"), "doc_id")
    assert out.filter("held_out AND predicted <> quality").count() == 0


def test_a_hot_id_brings_no_more_than_the_bound(spark):
    docs = spark.range(20_000).selectExpr("7L AS doc_id", "repeat(concat('w', id, ' '), 3) AS text")
    labels = spark.createDataFrame([(7, 1)], "doc_id long, quality int")
    assert len(quality.sample(docs, labels, max_rows=50)[1]) == 50 or docs.filter(~quality.held_out()).isEmpty()


def test_no_labels_one_class_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r["score"] for r in quality.score(docs, quality.learn(docs, none)).collect()] == [0.5, 0.5]
    ones = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int")
    assert all(0.5 < r["score"] < 1 for r in quality.score(docs, quality.learn(docs, ones)).collect())
    assert quality.score(docs.limit(0), quality.Model()).count() == 0


def test_held_out_accuracy(spark, data):
    out = queries.op11_quality(spark, f"{data}/sf0.01")
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    labels = spark.read.parquet(f"{data}/sf0.01/labels.parquet")
    right = out.join(labels, "doc_id").filter("held_out").selectExpr("avg(int(predicted = quality))", "count(*)").first()
    assert right[0] > 0.95 and right[1] > 50
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
