"""Text quality by a sparse ensemble of rules over text statistics.

Statistics of a text are Spark column expressions. Shallow boosted trees over them propose rules: every
path from a root is a conjunction of thresholds. A logistic regression with a lasso penalty, whose
strength is chosen by folds of the learnable rows, keeps few of them, and what is left is compiled
into one Spark column: no text is scored outside the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: score from which a text counts as good.
CUT = 0.7
STATISTICS = ("words", "word_length", "kinds", "line_words", "line_kinds", "upper", "digits", "marks", "bars", "stops", "shouts", "blank")
#: lower bound (exclusive) and upper bound (inclusive) of some statistics: a conjunction.
Rule = tuple[tuple[str, float, float], ...]


def held_out(id_column: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 4. A null id is never learnt from."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(True))


def _without(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, ""))


def with_statistics(documents: DataFrame, text_column: str = "text") -> DataFrame:
    """The rows with a column `q_...` for each of STATISTICS of the whole text; null counts as empty, and a ratio
    without a base is 0. Counts are columns of their own below them, so that each is taken once a row."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    words, lines = F.split(text, r"\s+"), F.split(text, "\n")
    counts = {
        "chars": F.length(text), "words": F.size(words), "kinds": F.size(F.array_distinct(words)), "lines": F.size(lines), "line_kinds": F.size(F.array_distinct(lines)),
        "blank": F.length(text) - _without(text, r"\s+"), "upper": F.length(text) - _without(text, r"\p{Lu}+"), "digits": F.length(text) - _without(text, r"\p{N}+"),
        "marks": _without(text, r"[\p{L}\p{M}\p{N}\s.,;:'’\-]+"), "bars": F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit(""))),
        "stops": F.length(text) - _without(text, "[.!?]+"), "shouts": F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit(""))),
    }
    rows = documents.withColumns({f"n_{n}": c.cast("double") for n, c in counts.items()})
    c = lambda name: F.col(f"n_{name}")
    over = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    rows = rows.withColumn("n_solid", c("chars") - c("blank"))
    stats = {
        "words": c("words"), "word_length": over(c("solid"), c("words")), "kinds": over(c("kinds"), c("words")), "line_words": over(c("words"), c("lines")), "line_kinds": over(c("line_kinds"), c("lines")),
        "upper": over(c("upper"), c("solid")), "digits": over(c("digits"), c("solid")), "marks": over(c("marks"), c("solid")), "bars": over(c("bars"), c("words")),
        "stops": over(c("stops"), c("words")), "shouts": over(c("shouts"), c("words")), "blank": over(c("blank"), c("chars")),
    }
    return rows.withColumns({f"q_{n}": stats[n] for n in STATISTICS}).drop("n_solid", *(f"n_{n}" for n in counts))


def sample(documents: DataFrame, labels: DataFrame, max_rows: int = 6000) -> tuple[np.ndarray, np.ndarray]:
    """The STATISTICS and the labels of at most `max_rows` learnable rows.

    The ids that labels agree on are drawn by hash, `max_rows` at most, and meet the documents by a broadcast of
    that size; of what they select, equal rows count once and `max_rows` of the least hash reach the driver."""
    agreed = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("high")).filter("label = high AND label IN (0, 1)")
    ids = agreed.filter(~held_out()).select("doc_id", "label", F.xxhash64("doc_id").alias("draw")).orderBy("draw").limit(max_rows)
    chosen = with_statistics(documents.select("doc_id", "text").join(F.broadcast(ids), "doc_id"))
    columns = [f"q_{n}" for n in STATISTICS]
    rows = chosen.select("draw", "label", *columns).distinct().orderBy("draw", "label", *columns).limit(max_rows).collect()
    return np.array([r[2:] for r in rows], float).reshape(len(rows), len(columns)), np.array([r[1] for r in rows], float)


def _grow(bins: np.ndarray, pull: np.ndarray, weight: np.ndarray, at: np.ndarray, depth: int, least: int, path: list, found: list, step: np.ndarray) -> None:
    """Split the rows `at` by the best threshold, downwards; every node's path goes to `found`, leaf values to `step`."""
    total, mass = pull[at].sum(), weight[at].sum() + 1.0
    step[at] = total / mass
    if not depth or len(at) < 2 * least:
        return
    best = (1e-6, -1, -1)
    for j in range(bins.shape[1]):
        b = bins[at, j]
        left, left_mass, n = (np.cumsum(np.bincount(b, w, 64))[:-1] for w in (pull[at], weight[at], np.ones(len(at))))
        gain = left**2 / (left_mass + 1) + (total - left) ** 2 / (mass - left_mass) - total**2 / mass
        gain[(n < least) | (len(at) - n < least)] = -1
        k = int(gain.argmax())
        best = max(best, (float(gain[k]), j, k))
    _, j, k = best
    if j < 0:
        return
    for side, part in (("<=", at[bins[at, j] <= k]), (">", at[bins[at, j] > k])):
        found.append([*path, (j, side, k)])
        _grow(bins, pull, weight, part, depth - 1, least, found[-1], found, step)


def tree_rules(values: np.ndarray, labels: np.ndarray, trees: int = 40, depth: int = 3, seed: int = 11) -> list[Rule]:
    """The distinct paths of boosted trees, each grown on half of the rows."""
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(values[:, j], np.linspace(0, 1, 64)[1:-1])) for j in range(values.shape[1])]
    bins = np.stack([np.searchsorted(c, values[:, j]) for j, c in enumerate(cuts)], axis=1)
    score, rules = np.zeros(len(labels)), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        half = np.sort(rng.permutation(len(labels))[: max(1, len(labels) // 2)])
        found: list[list] = []
        step = np.zeros(len(labels))
        _grow(bins, labels - p, p * (1 - p), half, depth, max(5, len(labels) // 400), [], found, step)
        score[half] += 0.3 * step[half]
        for path in found:
            limits: dict[str, tuple[float, float]] = {}
            for j, side, k in path:
                low, high = limits.get(STATISTICS[j], (-np.inf, np.inf))
                x = float(cuts[j][k])
                limits[STATISTICS[j]] = (low, min(high, x)) if side == "<=" else (max(low, x), high)
            rules[tuple(sorted((n, low, high) for n, (low, high) in limits.items()))] = None
    return list(rules)


def holds(rules: list[Rule], values: np.ndarray) -> np.ndarray:
    """Which rows fulfil which rules, as 0 and 1."""
    out = np.ones((len(values), len(rules)), np.float32)
    for i, rule in enumerate(rules):
        for name, low, high in rule:
            x = values[:, STATISTICS.index(name)]
            out[:, i] *= (x > low) & (x <= high)
    return out


def lasso(x: np.ndarray, y: np.ndarray, penalty: float, start: np.ndarray | None = None, steps: int = 200) -> np.ndarray:
    """Weights of a logistic regression with a penalty on their absolute sum, the free bias last: accelerated proximal gradients."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    v = np.ones(x.shape[1], np.float32)
    for _ in range(20):
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v) or 1
    rate = 1 / max(float(np.linalg.norm(x @ v) ** 2) / len(x) * 0.25 * 1.05, 1e-9)
    w = np.zeros(x.shape[1], np.float32) if start is None else start.copy()
    ahead, t = w.copy(), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(x @ ahead)))
        new = ahead - rate * (x.T @ (p - y).astype(np.float32)) / len(x)
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * penalty, 0)
        t, last = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        ahead = new + np.float32((last - 1) / t) * (new - w)
        w = new
    return w


def _loss(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    z = x @ w[:-1] + w[-1]
    return float(np.mean(np.logaddexp(0, z) - y * z))


@dataclass
class Model:
    """A bias and weighted rules."""

    bias: float = 0.0
    rules: list[tuple[Rule, float]] = field(default_factory=list)

    def score(self) -> Column:
        """The probability of label 1 as an expression over the columns of the statistics."""
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            held = F.lit(True)
            for name, low, high in rule:
                x = F.col(f"q_{name}")
                held = held & (x > low if low > -np.inf else F.lit(True)) & (x <= high if high < np.inf else F.lit(True))
            total = total + F.when(held, weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def fit(values: np.ndarray, labels: np.ndarray, folds: int = 3) -> Model:
    """Rules and weights. The penalty is the strongest of a geometric row whose loss on left-out folds is within a
    hundredth of the least; in each fold the trees are grown anew, so that no rule has seen what judges it.

    Rows of one class only give the class's smoothed share as every score; no rows give 0.5."""
    n, ones = len(labels), float(labels.sum())
    if min(ones, n - ones) < 2 * folds:
        return Model(float(np.log((ones + 0.5) / (n - ones + 0.5))))
    path = 0.05 * 0.5 ** np.arange(8)
    losses = np.zeros(len(path))
    for fold in range(folds):
        test = np.arange(n) % folds == fold
        rules = tree_rules(values[~test], labels[~test])
        x, w = holds(rules, values), None
        for i, penalty in enumerate(path):
            w = lasso(x[~test], labels[~test], penalty, w)
            losses[i] += _loss(x[test], labels[test], w) / folds
    chosen = path[int(np.flatnonzero(losses <= losses.min() * 1.01)[0])]
    rules = tree_rules(values, labels)
    w = lasso(holds(rules, values), labels, chosen, steps=600)
    return Model(float(w[-1]), [(r, float(x)) for r, x in zip(rules, w[:-1].tolist(), strict=True) if abs(x) > 1e-4])


def learn(documents: DataFrame, labels: DataFrame, max_rows: int = 6000) -> Model:
    """A model of at most `max_rows` labelled rows that are not held out. Neither language nor source nor id is read."""
    return fit(*sample(documents, labels, max_rows))


def score(documents: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id long, held_out boolean, score double, predicted int of every row's whole text.

    `score` is the probability of label 1, `predicted` whether it is CUT at least. A null text counts as empty and is
    scored as that; rows that repeat get equal rows; ids may be null (held out); other columns, whatever their names, are
    ignored; an empty table gives no rows. The statistics are narrow: no shuffle, and no row leaves the JVM."""
    rows = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    scored = with_statistics(rows).select("doc_id", held_out().alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
