"""Benchmark decontamination by CGK embedding, bit sampling and exact word edit distance.

Texts and benchmark items are word sequences; a character of a script without spaces is a word. An item
is compared with windows of its size: those of which a run of words (a piece that e edits leave untouched,
up to four words of it) points to the start, and that hold n - e of the item's n words; neither gate
loses a match. Windows and items are embedded by CGK random walks: at every step a walk gives the word it
stands at and moves on or stays by a coin of step and word, so that sequences a few edits apart come
together again and agree at many steps. A repetition compares a few sampled steps of one walk; windows
that agree in one are candidates, and those are verified by exact edit distance.

How many steps and repetitions an item needs is measured, not assumed: `calibrate` plants random edits up
to the bound into items of its length and counts in how many walks they agree. A length for which no
number of repetitions reaches the target recall has all its windows verified.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.batches import map_in_arrow
from lodestone.llm.textbytes import blocks, expand, mix, span_hashes, text_buffer, units

FOUND = "doc_id long, item_id long, first_word long, last_word long, distance long, similarity double"
_STREAM = np.random.Generator(np.random.PCG64(17))
_PLACE = _STREAM.integers(1, 1 << 62, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Windows expanded from seeds, and words looked up, at a time.
PART = 1 << 20
#: The most repetitions (each is a walk of its own), and the most steps that one compares.
WALKS, SAMPLES = 64, 4
_PICKS = _STREAM.random((WALKS, SAMPLES))


@cache
def _coins(steps: int) -> np.ndarray:
    """An odd factor for each step and walk; a word's coin is the top bit of its product."""
    return np.random.Generator(np.random.PCG64(23)).integers(1, 1 << 62, (steps, WALKS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def embed(words: np.ndarray, start: np.ndarray, stop: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The sampled words (windows x WALKS x SAMPLES) of the walks over words[start:stop] for items of n words
    each: of 2 n steps, those that _PICKS names; 0 past the end."""
    out = np.zeros((len(start), WALKS, SAMPLES), np.uint64)
    order = np.argsort(-n, kind="stable")
    a = 0
    while a < len(order):  # some windows at a time, of about one length
        steps = 2 * int(n[order[a]])
        own = order[a : a + max(1, (1 << 21) // (steps * WALKS))]
        coins = _coins(1 << (steps - 1).bit_length())
        end = stop[own][:, None]
        at = np.repeat(np.minimum(start[own], stop[own])[:, None], WALKS, 1)
        seen = np.zeros((steps, len(own), WALKS), np.uint64)
        for j in range(steps):
            w = np.where(at < end, words[np.minimum(at, len(words) - 1)], np.uint64(0))
            seen[j] = w
            at = at + ((w * coins[j]) >> np.uint64(63)).astype(np.int64)
        picks = (_PICKS[None] * (2 * n[own])[:, None, None]).astype(np.int64)
        out[own] = seen[picks, np.arange(len(own))[:, None, None], np.arange(WALKS)[None, :, None]]
        a += len(own)
    return out


def agreeing(left: np.ndarray, right: np.ndarray, samples: int) -> np.ndarray:
    """In which walks (rows x WALKS) two embeddings agree at the first so many sampled steps."""
    return (left[..., :samples] == right[..., :samples]).all(-1)


def pieces(n: int, e: int) -> tuple[int, list[int]]:
    """Words of a seed, and where the e + 1 pieces of an item of n words begin, one of which e edits spare."""
    return min(4, n // (e + 1)), [i * n // (e + 1) for i in range(e + 1)]


@cache
def calibrate(n: int, e: int, recall: float, plants: int = 48) -> tuple[int, int]:
    """(steps compared, repetitions) with which copies with e edits of items of n different words are found in
    `recall` of the cases, as measured for each kind of edit; (0, 0) if that takes more than WALKS."""
    if not e:
        return SAMPLES, 1
    rng = np.random.Generator(np.random.PCG64([n, e]))
    q, begin = pieces(n, e)
    cases: list[list[tuple[np.ndarray, int]]] = []
    items = []
    for kind in range(4):
        for _ in range(plants):
            item = rng.integers(1, 1 << 62, n, dtype=np.uint64)
            edited, origin = item.tolist(), list(range(n))
            for at in sorted(rng.choice(n, e, replace=False).tolist(), reverse=True):
                new = int(rng.integers(1, 1 << 62))
                what = kind if kind < 3 else int(rng.integers(3))
                edited[at : at + 1], origin[at : at + 1] = ([], []) if what == 0 else ([new], [-1]) if what == 1 else ([edited[at], new], [origin[at], -1])
            text = np.concatenate((rng.integers(1, 1 << 62, n, dtype=np.uint64), np.array(edited, np.uint64), rng.integers(1, 1 << 62, n, dtype=np.uint64)))
            place = {o: n + k for k, o in enumerate(origin) if o >= 0}
            starts = {place[o] - o for o in begin if all(place.get(o + k, -1) == place.get(o, -2) + k for k in range(q))}
            items.append(item)
            cases.append([(text, s) for s in starts])
    owner = np.repeat(np.arange(len(cases)), [len(c) for c in cases])
    words = np.concatenate([text for c in cases for text, _ in c])
    start = np.array([s for c in cases for _, s in c], np.int64)
    base = np.concatenate(([0], np.cumsum([len(text) for c in cases for text, _ in c])))[:-1]
    size = np.full(len(start), n)
    windows = embed(words, base + start, base + start + n, size)
    own = embed(np.concatenate(items), np.arange(len(items)) * n, np.arange(1, len(items) + 1) * n, np.full(len(items), n))
    for samples in range(SAMPLES, 0, -1):
        hit = np.zeros((len(cases), WALKS), bool)
        np.logical_or.at(hit, owner, agreeing(windows, own[owner], samples))
        miss = 1 - (hit.sum(1) + 0.5) / (WALKS + 1)
        for repetitions in range(1, WALKS + 1):
            if (miss**repetitions).reshape(4, plants).mean(1).max() <= 1 - recall:
                return samples, repetitions
    return 0, 0


def plan(lengths: set[int], similarity: float, recall: float) -> dict[int, tuple[int, int]]:
    """`calibrate` for each length: of lengths with equal bounds the least, and beyond 100 words for every 25."""
    grid = {n: n if n <= 100 else n // 25 * 25 for n in lengths}
    least = {n: next(m for m in range(1, g + 1) if edit_bound(m, similarity) == edit_bound(g, similarity)) for n, g in grid.items()}
    return {n: calibrate(m, edit_bound(m, similarity), recall) for n, m in least.items()}


def edit_bound(n: int, similarity: float) -> int:
    """The most word edits that leave an item of n words similar enough."""
    return int(n * (1 - similarity) + 1e-9)


def nearest(item: list[int], text: list[int]) -> tuple[int, int]:
    """The least edit distance of `item` to a part of `text`, and that part's last place (the first
    such); Myers's bit-parallel scan."""
    m = len(item)
    at: dict[int, int] = {}
    for i, w in enumerate(item):
        at[w] = at.get(w, 0) | 1 << i
    mask, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = mask, 0, m, (m, -1)
    for j, w in enumerate(text):
        eq = at.get(w, 0)
        vertical = eq | down
        across = (((eq & up) + up) ^ up) | eq
        plus, minus = down | ~(across | up) & mask, up & across
        score += 1 if plus & top else -1 if minus & top else 0
        plus, minus = plus << 1 & mask, minus << 1 & mask
        up, down = minus | ~(vertical | plus) & mask, plus & vertical
        if score < best[0]:
            best = (score, j)
    return best


class Items:
    """The benchmark's items, their seeds, which words each holds, and their embeddings.

    repetitions: a `plan` for the items' lengths, or its target recall."""

    def __init__(self, rows: list[tuple[int, str]], similarity: float, repetitions: dict[int, tuple[int, int]] | float = 0.9999):
        self.ids, self.words, marks = [], [], []
        for i, text in sorted(rows):
            data = np.frombuffer(text.encode(), np.uint8)
            start, end, _ = units(data, np.array([0, len(data)]))
            if len(start):
                self.ids.append(i)
                self.words.append(span_hashes(data, start, end))
            elif text.strip():
                marks.append((i, text.strip().encode()))
        #: Items of marks alone, which are searched as they are; their numbers follow those of the others.
        self.marks = [(len(self.words) + k, x) for k, (_, x) in enumerate(marks)]
        self.ids += [i for i, _ in marks]
        self.lists = [w.tolist() for w in self.words] + [[] for _ in marks]
        self.n = np.array([len(w) for w in self.words], np.int64)
        self.bound = np.array([edit_bound(len(w), similarity) for w in self.words], np.int64)
        seeds: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for k, w in enumerate(self.words):
            q, begin = pieces(len(w), int(self.bound[k]))
            h = runs(w, q).tolist()
            seeds[q] += [(h[o], k, o) for o in begin]
        self.seeds = {}
        for q, found in seeds.items():
            found.sort()
            keys, first = np.unique(np.array([x[0] for x in found], np.uint64), return_index=True)
            maybe = np.zeros(1 << 20, bool)
            maybe[(keys >> np.uint64(44)).astype(np.int64)] = True
            self.seeds[q] = (keys, maybe, np.append(first, len(found)), *np.array([x[1:] for x in found], np.int64).T)
        pairs = max(1 << 10, 16 * int(self.n.sum()))
        self.shift = np.uint64(64 - pairs.bit_length())
        self.held = np.zeros(1 << pairs.bit_length(), bool)
        for k, w in enumerate(self.words):
            self.held[self._cells(w, np.full(len(w), k))] = True

        lengths = {len(w) for w in self.words}
        by = repetitions if isinstance(repetitions, dict) else plan(lengths, similarity, repetitions)
        self.samples, self.repetitions = np.array([by[len(w)] for w in self.words], np.int64).reshape(-1, 2).T
        ends = np.cumsum(self.n)
        self.embedded = embed(np.concatenate(self.words), ends - self.n, ends, self.n) if self.words else None

    def likely(self, h: np.ndarray, item: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Which windows h[start : stop] (some) agree with their item in one of its repetitions."""
        left = np.arange(len(item))
        out = self.samples[item] == 0
        left = left[~out]
        for a in range(0, len(left), 4096):
            w = left[a : a + 4096]
            k = item[w]
            got = embed(h, start[w], stop[w], self.n[k])
            for samples in np.unique(self.samples[k]).tolist():
                own = self.samples[k] == samples
                same = agreeing(got[own], self.embedded[k[own]], samples)
                out[w[own]] = (same & (np.arange(WALKS) < self.repetitions[k[own], None])).any(1)
        return out

    def _cells(self, word: np.ndarray, item: np.ndarray) -> np.ndarray:
        return (mix(word + item.astype(np.uint64) * _PLACE[7]) >> self.shift).astype(np.int64)

    def count(self, h: np.ndarray, item: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """How many of the words lo .. hi - 1 (some) each window's item holds, or more (cells clash)."""
        out, total = np.zeros(len(lo), np.int64), np.cumsum(hi - lo)
        a = 0
        while a < len(lo):
            b = max(a + 1, int(np.searchsorted(total, total[a] + PART)))
            n = hi[a:b] - lo[a:b]
            inside = self.held[self._cells(h[expand(lo[a:b], n)], np.repeat(item[a:b], n))]
            out[a:b] = np.add.reduceat(inside, np.cumsum(n) - n, dtype=np.int64)
            a = b
        return out


def runs(h: np.ndarray, q: int) -> np.ndarray:
    """Hashes of the runs of q words."""
    n = max(0, len(h) - q + 1)
    total = np.zeros(n, np.uint64)
    for k in range(q):
        total += h[k : k + n] * _PLACE[k]
    return mix(total)


def _windows(h: np.ndarray, cut: np.ndarray, items: Items) -> list[tuple[int, int, int, int]]:
    """The (text, item, first word, end) parts of the texts that can hold a match, counted in the block:
    the windows that seeds point to, that hold enough of the item's words and that agree with it in a
    repetition, joined where they meet."""
    found: list[np.ndarray] = []
    for q, (keys, maybe, first, item, offset) in items.seeds.items():
        g = runs(h, q)
        at = np.flatnonzero(maybe[(g >> np.uint64(44)).astype(np.int64)])
        if not len(at):
            continue
        k = np.minimum(np.searchsorted(keys, g[at]), len(keys) - 1)
        text = np.searchsorted(cut, at, "right") - 1
        hit = (keys[k] == g[at]) & (at + q <= cut[text + 1])
        at, k, text = at[hit], k[hit], text[hit]
        n = first[k + 1] - first[k]
        total, a = np.cumsum(n), 0
        while a < len(at):
            b = max(a + 1, int(np.searchsorted(total, total[a] + PART)))
            place = expand(first[k[a:b]], n[a:b])
            t, i, start = np.repeat(text[a:b], n[a:b]), item[place], np.repeat(at[a:b], n[a:b]) - offset[place]
            t, i, start = _joined(np.stack([t, i, start]), join=False)
            n, e = items.n[i], items.bound[i]
            lo, hi = np.maximum(cut[t], start - e), np.minimum(cut[t + 1], start + n + e)
            rows = np.stack([t, i, lo, hi, np.maximum(cut[t], start), np.minimum(cut[t + 1], start + n)])
            rows = rows[:, items.count(h, i, lo, hi) >= n - e]
            rows = rows[:4, items.likely(h, rows[1], rows[4], rows[5])]
            found.append(_joined(rows))
            a = b
    return list(map(tuple, _joined(np.hstack(found)).T.tolist())) if found else []


def _joined(rows: np.ndarray, join: bool = True) -> np.ndarray:
    """Columns (text, item, first word, end) in order, without repeats; with `join`, those of a text and
    item that meet made one."""
    rows = rows[:, np.lexsort(rows[::-1])]
    if not rows.shape[1]:
        return rows
    new = np.ones(rows.shape[1], bool)
    if not join:
        new[1:] = (rows[:, 1:] != rows[:, :-1]).any(axis=0)
        return rows[:, new]
    # the ends of a text's and item's rows, as far as any before reached
    group = np.cumsum(np.append(True, (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)))
    wide = int(rows[3].max()) + 1
    reach = np.maximum.accumulate(group * wide + rows[3]) - group * wide
    new[1:] = (group[1:] != group[:-1]) | (rows[2, 1:] > reach[:-1])
    at = np.flatnonzero(new)
    return np.vstack([rows[:3, at], reach[np.append(at[1:], len(new)) - 1]])


Best = dict[tuple[int, int], tuple[int, int, int]]


def _best(column: pa.Array, items: Items) -> Best:
    """(distance, first word, last word) of the best place of each (row, item's number) that matches."""
    buf, offs = text_buffer(column)
    best: Best = {}
    for a, b in blocks(offs):
        data = buf[offs[a] : offs[b]]
        start, end, cut = units(data, offs[a : b + 1] - offs[a])
        h = span_hashes(data, start, end)
        for t, k, lo, hi in _windows(h, cut, items):
            text, at = h[lo:hi].tolist(), lo - int(cut[t])
            d, last = nearest(items.lists[k], text)
            if d <= items.bound[k] and last >= 0:
                _, back = nearest(items.lists[k][::-1], text[last::-1])
                best[a + t, k] = min((d, at + last - back, at + last), best.get((a + t, k), (1 << 60,)))
        for t in range(a, b) if items.marks else ():
            raw = buf[offs[t] : offs[t + 1]].tobytes()
            for k, x in items.marks:
                if (at := raw.find(x)) >= 0:
                    first = int(np.searchsorted(start, offs[t] - offs[a] + at) - cut[t - a])
                    best[t, k] = (0, first, first - 1)
    return best


def _match(rows: list[tuple[int, str]], similarity: float, repetitions: dict[int, tuple[int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(rows, similarity, repetitions)
        for batch in batches:
            if best := _best(batch.column(1), items):
                ids = batch.column(0)
                out = [(ids[t].as_py(), items.ids[k], f, z, d, 1 - d / max(1, len(items.lists[k]))) for (t, k), (d, f, z) in sorted(best.items())]
                types = [pa.int64()] * 5 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], ["doc_id", "item_id", "first_word", "last_word", "distance", "similarity"])

    return run


def _without(rows: list[tuple[int, str]], similarity: float, repetitions: dict[int, tuple[int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(rows, similarity, repetitions)
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            keep[[t for t, _ in _best(batch.column(1), items)]] = False
            yield batch.filter(pa.array(keep))

    return run


def _passes(benchmark: DataFrame, similarity: float, recall: float, pass_bytes: int) -> Iterator[tuple[list[tuple[int, str]], dict[int, tuple[int, int]]]]:
    """The items, about `pass_bytes` bytes of their texts at a time, and the plan for their lengths."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-size // pass_bytes))
    for p in range(passes):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == p) if passes > 1 else items
        rows = sorted({(r["item_id"], r["text"]) for r in own.collect()})  # about pass_bytes
        lengths = {len(units(data, np.array([0, len(data)]))[0]) for data in (np.frombuffer(text.encode(), np.uint8) for _, text in rows)}
        yield rows, plan(lengths - {0}, similarity, recall)


def matches(documents: DataFrame, benchmark: DataFrame, similarity: float = 0.8, recall: float = 0.9999, pass_bytes: int = 8_000_000, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """`FOUND`: for each text and each item that a part of it matches, the best place (words, as of `units`, from 0)
    and its word edit distance, at most (1 - similarity) of the item's words. Exact copies are all found,
    edited ones with a probability of about `recall` or more each.

    Items are read in passes of about `pass_bytes` bytes of text, each sent to the executors, so a
    benchmark of any size works; every pass reads the documents once. Items that are null, blank or
    have a null id take no part; those too short for an edit (under five words at 0.8) match exact
    phrases, and those of punctuation alone its exact characters (last_word is then first_word - 1); items that repeat are all reported, rows that
    repeat give equal rows, null and empty texts give none. Other columns are ignored."""
    docs = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).filter("text is not null")
    return reduce(DataFrame.unionByName, [map_in_arrow(docs, _match(rows, similarity, by), FOUND) for rows, by in _passes(benchmark, similarity, recall, pass_bytes)])


def clean(documents: DataFrame, benchmark: DataFrame, similarity: float = 0.8, recall: float = 0.9999, pass_bytes: int = 8_000_000) -> DataFrame:
    """The rows of `documents` (text and others) whose own text matches no item, whatever their ids."""
    rows = documents.select(F.struct("*").alias("row"), "text")
    kind = rows.schema["row"].dataType.simpleString()
    for own, by in _passes(benchmark, similarity, recall, pass_bytes):
        rows = map_in_arrow(rows, _without(own, similarity, by), f"row {kind}, text string")
    return rows.select("row.*")
