"""Toxicity by a subsequence string-kernel SVM with Nystrom landmarks.

Units are the words of a text, each behind a start mark, and words whose letters are spelled out or broken
by marks ("i d i o t", "id*iot") joined again. The kernel counts common subsequences of three bytes, each
weighted by LAMBDA to the length it spans, gaps included, and is normalised; so inserted characters
and gaps lower it only gradually. Training embeds units by Nystrom landmarks and fits a linear
squared-hinge SVM there. The decision function sum(beta_m k(x, landmark_m)) is linear in x's
subsequence features, so it is evaluated exactly from one weight per triple of bytes.

Labels are of whole texts, and words of insults may occur in clean ones by chance. A text is toxic by the
rate of its units that the SVM places beyond a margin; training alternates between choosing the units that
make each toxic text toxic and fitting the SVM to those against units of clean texts, and sets the rate
between the labelled texts of either kind. The margin is chosen among CUTS by two halves of the learnable texts that
judge each other.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.batches import map_in_arrow
from lodestone.llm.textbytes import LOWER, blocks, expand, span_hashes, text_buffer, words

SCORED = "doc_id long, score double, predicted int, worst string"
P, LAMBDA, WIDTH, STRIDE = 3, 0.75, 16, 8
#: The byte before a unit that begins with its word, the fewest units that a rate is taken of, how often a unit counts in a text, how much more frequent an insult is in toxic texts, and the bytes of a gram.
MARK, FLOOR, REPEATS, RATIO, GRAM = 1, 30, 3, 8.0, 5
#: Margins from which a unit may count.
CUTS = (0.3, 0.5, 0.7, 0.9, 1.1)
_CACHE = 1_000_000


def held_out(id_column: str = "doc_id"):
    """Whether crc32 of the id as text is 0 modulo 5. A null id is never learnt from."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


# ---- units -------------------------------------------------------------------------------------


def units(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Units of consecutive texts: bytes to draw from, starts, ends and each unit's text.

    A unit is a mark and up to WIDTH - 1 bytes of a word; longer words go on in overlapping windows without
    a mark, so that every byte is scored."""
    start, end, cut = words(data, offs)
    low = LOWER[data]
    n = len(start)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(cut))
    extra: list[bytes] = []
    extra_doc: list[int] = []
    if n > 1:
        same = doc[1:] == doc[:-1]
        gap = start[1:] - end[:-1]
        blank = np.concatenate(([0], np.cumsum(np.isin(data, (9, 10, 13, 32)))))
        blanks = blank[start[1:]] - blank[end[:-1]]
        letters = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        short = (letters[end] - letters[start]) <= 1
        tied = same & (gap <= 3) & ((blanks == 0) | (short[1:] & short[:-1] & (gap <= 1)))
        edge = np.diff(np.concatenate(([False], tied, [False])).astype(np.int8))
        for a, b in zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1)).tolist(), strict=True):
            if b - a >= 2 or not blanks[a]:  # a chain of words a..b
                extra.append(b"".join(low[start[i] : end[i]].tobytes() for i in range(a, b + 1)))
                extra_doc.append(int(doc[a]))
    if extra:
        size = np.array([len(x) for x in extra], np.int64)
        at = len(low) + np.concatenate(([0], np.cumsum(size)))
        low = np.concatenate((low, np.frombuffer(b"".join(extra), np.uint8)))
        start, end, doc = np.concatenate((start, at[:-1])), np.concatenate((end, at[1:])), np.concatenate((doc, np.array(extra_doc, doc.dtype)))
    size = np.minimum(end - start, WIDTH - 1)
    at = np.concatenate(([0], np.cumsum(size + 1)))
    marked = np.empty(int(at[-1]), np.uint8)
    marked[at[:-1]] = MARK
    marked[expand(at[:-1] + 1, size)] = low[expand(start, size)]
    long = np.flatnonzero(end - start > WIDTH - 1)
    pieces = -(-(end[long] - start[long] - (WIDTH - 1)) // STRIDE)
    s = np.repeat(start[long] + WIDTH - 1 - STRIDE, pieces) + STRIDE * expand(np.zeros(len(long), np.int64), pieces)
    e = np.minimum(s + WIDTH, np.repeat(end[long], pieces))
    return np.concatenate((marked, low)), np.concatenate((at[:-1], len(marked) + s)), np.concatenate((at[1:], len(marked) + e)), np.concatenate((doc, np.repeat(doc[long], pieces)))


# ---- kernel ------------------------------------------------------------------------------------


def self_kernel(a: np.ndarray) -> np.ndarray:
    """The kernel of equal-length rows of `a` with themselves."""
    rows, n = a.shape
    k = np.ones((n + 1, n + 1, rows), np.float32)
    equal = [[(a[:, i] == a[:, j]).astype(np.float32) * (LAMBDA * LAMBDA) for j in range(i + 1)] for i in range(n)]
    for p in range(1, P):
        new = np.zeros_like(k)
        for i in range(1, n + 1):
            row = np.zeros(rows, np.float32)
            for j in range(1, n + 1):
                e = equal[max(i, j) - 1][min(i, j) - 1]
                row = LAMBDA * row + e * k[i - 1, j - 1]
                new[i, j] = LAMBDA * new[i - 1, j] + row
        k = new
    out = np.zeros(rows, np.float32)
    for i in range(1, n + 1):
        for j in range(1, i + 1):
            term = equal[i - 1][j - 1] * k[i - 1, j - 1]
            out += term if i == j else 2 * term
    return out


def features(text: bytes, codes: np.ndarray, base: int) -> dict[int, float]:
    """The subsequence features of a short text, normalised: triples of codes and their weights."""
    own: Counter = Counter()
    c = codes[list(text)].tolist()
    for i in range(len(c)):
        for j in range(i + 1, len(c)):
            for k in range(j + 1, len(c)):
                own[(c[i] * base + c[j]) * base + c[k]] += LAMBDA ** (k - i + 1)
    norm = sum(v * v for v in own.values()) ** 0.5
    return {t: v / norm for t, v in own.items()}


class Kernel:
    """Normalised kernel values of texts with a fixed list of others, by their features: one column of
    weights per triple of bytes that the others have, a column for each of them (or a sum of them)."""

    def __init__(self, others: list[bytes], mixing: np.ndarray | None = None):
        used = sorted(set(b"".join(others)))
        self.codes = np.zeros(256, np.int32)
        self.codes[used] = np.arange(1, len(used) + 1)
        self.base = len(used) + 1
        mixing = np.eye(len(others)) if mixing is None else mixing
        self.weights = np.zeros((self.base**3, mixing.shape[1]), np.float32)
        for text, row in zip(others, mixing, strict=True):
            for t, v in features(text, self.codes, self.base).items():
                self.weights[t] += (v * row).astype(np.float32)

    def values(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, step: int = 16384) -> np.ndarray:
        """Rows of values for the spans of `data`, each of at most WIDTH bytes."""
        out = np.zeros((len(start), self.weights.shape[1]), np.float32)
        size = end - start
        for n in range(P, WIDTH + 1):
            which = np.flatnonzero(size == n)
            for i in range(0, len(which), step):
                w = which[i : i + step]
                raw = data[start[w][:, None] + np.arange(n)]
                c = self.codes[raw].T
                live = np.flatnonzero((c > 0).sum(0) >= P)  # without three bytes of the others it is 0
                if not len(live):
                    continue
                c, raw, total = np.ascontiguousarray(c[:, live]), raw[live], np.zeros((len(live), out.shape[1]), np.float32)
                for span in range(P, n + 1):
                    part = np.zeros_like(total)
                    for x in range(n - span + 1):
                        z = x + span - 1
                        ends = c[x] * (self.base * self.base) + c[z]
                        for y in range(x + 1, z):
                            part += self.weights[ends + c[y] * self.base]
                    total += np.float32(LAMBDA**span) * part
                far = np.flatnonzero(np.abs(total).max(1) > 1e-6)
                if len(far):
                    out[w[live[far]]] = total[far] / np.sqrt(np.maximum(self_kernel(np.ascontiguousarray(raw[far])), 1e-12))[:, None]
        return out


def gram(xs: list[bytes], ys: list[bytes]) -> np.ndarray:
    """Normalised kernel values of all pairs."""
    ends = np.cumsum([len(x) for x in xs])
    return Kernel(ys).values(np.frombuffer(b"".join(xs), np.uint8), np.concatenate(([0], ends[:-1])), ends, 2048)


# ---- model -------------------------------------------------------------------------------------


@dataclass
class Model:
    """beta over landmarks, a bias, the margin from which a unit counts, and the rate of such units at which a text is as likely toxic as not."""

    landmarks: list[bytes] = field(default_factory=list)
    beta: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -1.0
    rate: float = 1.0
    cut: float = CUTS[-1]

    def __post_init__(self) -> None:
        self.kernel = Kernel(self.landmarks, np.asarray(self.beta, float)[:, None])

    def margins(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The decision value of each unit data[start:end] of at most WIDTH bytes."""
        return self.kernel.values(data, start, end)[:, 0] + np.float32(self.bias)

    def score(self, top: np.ndarray, rate: np.ndarray) -> np.ndarray:
        """0.5 at the model's rate, more above it; below, at least what the worst unit's margin is worth, under 0.3."""
        odds = (rate / self.rate) ** 2
        return np.maximum(odds / (1 + odds), 0.3 / (1 + np.exp(-np.clip(2 * (top - self.cut), -30, 30))))


def rates(margins: np.ndarray, doc: np.ndarray, n: int, cut: float) -> np.ndarray:
    """Each text's share of units beyond the margin `cut`, of FLOOR units at least."""
    return np.bincount(doc, margins >= cut, n) / np.maximum(np.bincount(doc, minlength=n), FLOOR)


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, reg: float = 1e-4, steps: int = 15) -> tuple[np.ndarray, float]:
    """A linear squared-hinge SVM by Newton steps; the last weight is the bias."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    ridge = np.full(len(w), reg)
    ridge[-1] = 1e-6
    for _ in range(steps):
        m = y * (z @ w)
        live = m < 1
        if not live.any():
            break
        zl, wl = z[live], weight[live] / weight.sum()
        grad = ridge * w - zl.T @ (wl * y[live] * (1 - m[live]))
        step = np.linalg.solve(zl.T @ (zl * wl[:, None]) + np.diag(ridge), grad)
        w = w - step
        if np.abs(step).max() < 1e-7:
            break
    return w[:-1], float(w[-1])


def gapped(text: bytes, rng: np.random.Generator) -> bytes:
    """A copy with one or two strange characters put inside."""
    out = bytearray(text)
    for _ in range(1 + int(rng.integers(2))):
        out.insert(1 + int(rng.integers(max(1, len(out) - 1))), int(rng.choice(list(b"abcdefghijklmnopqrstuvwxyz0123456789"))))
    return bytes(out)[:WIDTH]


def fit(texts: list[str], toxic: list[int], landmarks: int = 96, rounds: int = 3, negatives: int = 12000, positives: int = 1500, seed: int = 5) -> Model:
    """Fit on a bounded sample of labelled texts. One class alone gives a model that flags nothing.

    Each half of the texts sets the rates for every margin of CUTS and is judged on the other half; the margin with the
    least sum of both classes' error shares is taken, the larger of equal ones."""
    model = trained(texts, toxic, landmarks, rounds, negatives, positives, seed)
    if model.landmarks:
        y = np.array(toxic, bool)
        wrong = np.zeros(len(CUTS))
        for side in (0, 1):
            own, other = [slice(k, None, 2) for k in (side, 1 - side)]
            half = trained(texts[own], toxic[own], landmarks, rounds, negatives, positives, seed)
            if half.landmarks:
                (m, doc), (m_other, doc_other) = _margins(half, texts[own]), _margins(half, texts[other])
                for i, cut in enumerate(CUTS):
                    level = threshold(rates(m, doc, len(y[own]), cut), y[own])
                    flagged = rates(m_other, doc_other, len(y[other]), cut) >= level
                    wrong[i] += sum((flagged != y[other])[y[other] == kind].mean() for kind in (False, True) if (y[other] == kind).any())
        model.cut = CUTS[int(np.flatnonzero(wrong <= wrong.min() + 1e-9)[-1])]
        m, doc = _margins(model, texts)
        model.rate = threshold(rates(m, doc, len(texts), model.cut), y)
    return model


def _margins(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The margin of each unit and its text."""
    buf, offs = text_buffer(pa.array([t or "" for t in texts], pa.string()))
    low, start, end, doc = units(buf, offs)
    _, first, code = np.unique(span_hashes(low, start, end), return_index=True, return_inverse=True)
    return model.margins(low, start[first], end[first])[code], doc


def trained(texts: list[str], toxic: list[int], landmarks: int, rounds: int, negatives: int, positives: int, seed: int) -> Model:
    """The SVM, its rate not yet set.

    It is given at most `positives` units of toxic texts (those of most texts first) and about
    `negatives` of clean ones (a third each: the most frequent, random ones, and those that the round before
    put nearest to the toxic side). Byte grams only pick the units of the first round."""
    if not 0 < sum(toxic) < len(toxic):
        return Model()
    rng = np.random.Generator(np.random.PCG64(seed))
    buf, offs = text_buffer(pa.array([t or "" for t in texts], pa.string()))
    low, start, end, doc = units(buf, offs)
    h = span_hashes(low, start, end)
    _, first, code = np.unique(h, return_index=True, return_inverse=True)
    y = np.array(toxic, bool)
    pair, times = np.unique(code.astype(np.int64) * len(texts) + doc, return_counts=True)
    times = np.minimum(times, REPEATS)
    unit, of = pair // len(texts), pair % len(texts)
    order = np.argsort(of, kind="stable")
    unit_by_text, by_text = unit[order], of[order]
    df1, df0 = np.bincount(unit, y[of] * times, len(first)), np.bincount(unit, ~y[of] * times, len(first))
    all1, all0 = max(1, int(times[y[of]].sum())), max(1, int(times[~y[of]].sum()))
    text = [low[a:b].tobytes() for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
    s, e = start[first], end[first]
    clean = (df0 > 0) & ((df0 + 1) * all1 * RATIO > df1 * all0)  # not so much more frequent in toxic texts
    # How far each unit speaks for toxicity: its best byte gram, by how frequent it is in the texts of either class.
    n_grams = np.maximum(e - s - (GRAM - 1), 0)
    at = expand(s, n_grams)
    g = np.zeros(len(at), np.uint64)
    for k in range(GRAM):
        g = g << np.uint64(8) | low[at + k].astype(np.uint64)
    g = np.unique(g, return_inverse=True)[1].astype(np.int32)
    cut = np.concatenate(([0], np.cumsum(n_grams)))
    n_kinds = int(g.max(initial=0)) + 1
    who = np.repeat(np.arange(len(first)), n_grams)
    g1, g0 = np.bincount(g, df1[who], n_kinds), np.bincount(g, df0[who], n_kinds)
    n1 = y.sum()
    odds = np.log((g1 + 0.5) / all1) - np.log((g0 + 0.5) / all0)
    odds[g1 < max(2, 0.015 * n1)] = -9.0
    odds = np.append(odds, -9.0)
    speak = np.where(n_grams > 0, np.maximum.reduceat(odds[np.append(g, n_kinds)], np.minimum(cut[:-1], len(g))), -9.0)
    speak[clean] = -9.0
    doc_cut = np.searchsorted(by_text, np.arange(len(texts) + 1))
    model = Model()
    frequent = np.argsort(-df0)[: negatives // 3]
    negative = np.unique(np.concatenate((frequent[df0[frequent] > 0], rng.choice(np.flatnonzero(clean), min(negatives // 3, int(clean.sum())), replace=False))))
    for turn in range(rounds):
        positive: set[int] = set()
        for d in np.flatnonzero(y).tolist():
            own = unit_by_text[doc_cut[d] : doc_cut[d + 1]]
            own = own[~clean[own]]
            if len(own):
                v = speak[own]
                best = v.max()
                if best < (2.0 if turn == 0 else -0.5):  # nothing in it speaks for its label
                    continue
                positive.update(own[v >= (best - 0.7 if turn == 0 else max(best - 0.4, min(best, 0.0)))].tolist())
        if not positive:
            return Model()
        pos = sorted(positive)
        if len(pos) > positives:
            pos = sorted(sorted(pos, key=lambda u: (-df1[u], u))[:positives])
        p_text = [text[u] for u in pos]
        p_weight = np.sqrt(df1[pos])
        spoiled = [gapped(t, rng) for t in p_text for _ in range(max(1, 600 // len(p_text))) if 4 <= len(t) < WIDTH]
        n_text = [text[u] for u in negative.tolist()]
        marks = pick(p_text, p_weight, landmarks * 2 // 3) + pick(n_text, np.ones(len(n_text)), landmarks - landmarks * 2 // 3)
        all_text = p_text + spoiled + n_text
        k = gram(all_text, marks)
        val, vec = np.linalg.eigh(gram(marks, marks).astype(float))
        keep = val > 1e-5
        root = vec[:, keep] / np.sqrt(val[keep])
        target = np.array([1.0] * (len(p_text) + len(spoiled)) + [-1.0] * len(n_text))
        each = np.concatenate((p_weight, np.full(len(spoiled), p_weight.mean() * len(p_text) / max(1, len(spoiled))), np.full(len(n_text), 1.0)))
        each[target > 0] *= 0.5 * each[target < 0].sum() / each[target > 0].sum()
        w, bias = svm(k @ root, target, each)
        model = Model(marks, root @ w, bias)
        f = model.margins(low, s, e)
        speak = np.where(clean, -9.0, f)
        hard = np.flatnonzero(clean & (f > -0.5))
        hard = hard[np.argsort(-f[hard])][: negatives // 3]
        negative = np.unique(np.concatenate((negative, hard)))
    return model


def pick(texts: list[bytes], weight: np.ndarray, n: int) -> list[bytes]:
    """Landmarks: the heaviest first, skipping those nearly equal to one chosen before."""
    best = [i for i in np.argsort(-weight, kind="stable").tolist() if len(texts[i]) >= P][: 2 * n]
    if not best:
        return []
    near = gram([texts[i] for i in best], [texts[i] for i in best]) >= 0.9
    chosen: list[int] = []
    for i in range(len(best)):
        if len(chosen) < n and not near[i, chosen].any():
            chosen.append(i)
    return [texts[best[i]] for i in chosen]


def threshold(rate: np.ndarray, y: np.ndarray) -> float:
    """The rate in the middle of the widest gap (as a factor) among cuts above 0 with the fewest errors; a gap counts from
    a quarter of its upper end, since the model has seen these clean texts and others may have a unit by chance."""
    order = np.argsort(rate, kind="stable")
    t, v = rate[order], y[order]
    wrong = np.concatenate(([0], np.cumsum(v))) + np.concatenate((np.cumsum((~v)[::-1])[::-1], [0]))
    lo, hi = np.concatenate(([0.0], t)), np.concatenate((t, [1.0]))
    real = np.flatnonzero(hi > lo)
    best = real[wrong[real] == wrong[real].min()]
    low = np.maximum(lo[best], hi[best] / 4)
    i = int(np.argmax(hi[best] / low))
    return float(np.sqrt(low[i] * hi[best][i]))


def learn(documents: DataFrame, labels: DataFrame, max_texts: int = 2000, landmarks: int = 96, negatives: int = 12000, positives: int = 1500, max_bytes: int = 64_000_000) -> Model:
    """Fit on at most about `max_texts` labelled texts that are not held out, by a hash of the id; half
    of them toxic if there are so many; `landmarks`, `negatives` and `positives` bound what `fit` draws from
    them. Of rows that share an id each text counts once, and texts of the least digests are taken while they are at most
    2 * `max_texts` and `max_bytes` bytes in all (one at least). Null labels, ids and texts are left out; an id with both labels is toxic."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)").filter(~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    wide, h = 1 << 30, F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30))
    bound = lambda k: min(wide, int(wide * (max_texts / 2) / max(1, n.get(k, 0))) + 1)
    chosen = known.filter(h < F.when(F.col("toxic") == 1, bound(1)).otherwise(bound(0)))
    ids = {r["doc_id"]: r["toxic"] for r in chosen.limit(2 * max_texts).collect()}
    if not ids:
        return Model()
    spark = documents.sparkSession
    wanted = F.broadcast(spark.createDataFrame(sorted(ids.items()), "doc_id long, toxic int"))  # at most 2 * max_texts rows
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null")
    sample = docs.join(wanted, "doc_id").select("doc_id", "text", "toxic", F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), "text")).alias("digest"))
    kept = {}
    for r in sample.select("digest", F.octet_length("text").alias("size")).distinct().orderBy("digest").limit(2 * max_texts).collect():
        if kept and sum(kept.values()) + r["size"] > max_bytes:
            break
        kept[r["digest"]] = r["size"]
    picked = F.broadcast(spark.createDataFrame([(d,) for d in kept], "digest string"))  # at most 2 * max_texts rows
    sample = sample.join(picked, "digest").groupBy("digest").agg(*(F.first(c).alias(c) for c in ("doc_id", "text", "toxic"))).drop("digest").repartition(1)
    r = map_in_arrow(sample, _fit(landmarks, negatives, positives), "landmarks array<binary>, beta array<double>, bias double, rate double, cut double").first()
    return Model([bytes(x) for x in r["landmarks"]], np.array(r["beta"]), r["bias"], r["rate"], r["cut"])


def _fit(landmarks: int, negatives: int, positives: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Fit on the bounded sample in one task, so that the driver holds neither texts nor features."""
        rows = sorted({row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)})
        model = fit([t for _, t, _ in rows], [y for *_, y in rows], landmarks, negatives=negatives, positives=positives)
        names = ["landmarks", "beta", "bias", "rate", "cut"]
        yield pa.RecordBatch.from_arrays([pa.array([model.landmarks], pa.list_(pa.binary())), pa.array([np.asarray(model.beta, float).tolist()], pa.list_(pa.float64())), *(pa.array([float(x)]) for x in (model.bias, model.rate, model.cut))], names)

    return run


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, value = np.zeros(0, np.uint64), np.zeros(0, np.float32)
        for batch in batches:
            buf, offs = text_buffer(batch.column(1))
            for a, b in blocks(offs):
                low, start, end, doc = units(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                h = span_hashes(low, start, end)
                order = np.argsort(h)
                sorted_h = h[order]
                fresh = np.concatenate(([True], sorted_h[1:] != sorted_h[:-1])) if len(h) else np.zeros(0, bool)
                u, pick_ = sorted_h[fresh], order[fresh]
                code = np.empty(len(h), np.int64)
                code[order] = np.cumsum(fresh) - 1
                at = np.minimum(np.searchsorted(known, u), max(len(known) - 1, 0))
                old = known[at] == u if len(known) else np.zeros(len(u), bool)
                f = np.empty(len(u), np.float32)
                f[old] = value[at[old]] if len(known) else f[old]
                f[~old] = model.margins(low, start[pick_[~old]], end[pick_[~old]])
                if len(known) > _CACHE:
                    known, value = np.zeros(0, np.uint64), np.zeros(0, np.float32)
                    old = np.zeros(len(u), bool)
                both = np.concatenate((known, u[~old]))
                by = np.argsort(both, kind="stable")
                known, value = both[by], np.concatenate((value, f[~old]))[by]
                top, worst = np.full(b - a, model.bias, np.float32), np.full(b - a, -1)
                m = f[code]
                rate = rates(m, doc, b - a, model.cut)
                if len(h):
                    by = np.lexsort((m, doc))
                    last = np.flatnonzero(np.concatenate((doc[by][1:] != doc[by][:-1], [True])))
                    top[doc[by][last]], worst[doc[by][last]] = m[by][last], by[last]
                score = model.score(top.astype(np.float64), rate)
                names = [low[start[i] : end[i]].tobytes().lstrip(bytes([MARK])).decode(errors="replace") if i >= 0 else None for i in worst.tolist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32), pa.int32()), pa.array(names, pa.string())], [batch.schema.names[0], "score", "predicted", "worst"])

    return run


def score(documents: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """`SCORED`: per row a score from 0 to 1 of the whole text, 1 predicted at 0.5, and its worst unit.

    The score goes by the share of a text's units (of FLOOR at least) that the SVM places beyond the model's margin. Null, empty
    and wordless texts get the score of no such unit and no worst one; repeated rows
    get equal rows; ids may be null; other columns are ignored; an empty table gives no rows."""
    return map_in_arrow(documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")), _score(model), SCORED)


def decide(documents: DataFrame, model: Model) -> DataFrame:
    """`row`, a struct of all columns of `documents` (text among them), beside score, predicted, worst."""
    kind = documents.select(F.struct("*").alias("row")).schema["row"].dataType.simpleString()
    return map_in_arrow(documents.select(F.struct("*").alias("row"), "text"), _score(model), SCORED.replace("doc_id long", f"row {kind}"))

