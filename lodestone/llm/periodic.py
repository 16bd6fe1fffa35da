"""Runs of periodic words, by Main and Lorentz's divide and conquer on interned word ids.

The words of a block of texts are numbered. Blocks of 8, 16, 32, ... words are cut at their midpoints, all
blocks of a size at once: a run that crosses a midpoint m with period q holds two periods on one side of
it, so the Z-value of m + q against m (or, on the left, its mirror image) is q at least. The few pairs
(m, q) of which that holds are extended both ways to the run's ends; equal intervals are kept once, with
their smallest period. Z-values are found by halving steps over prefix hashes of the word ids, and each
run is then verified word by word; where one fails, exact ranks of word blocks take the hashes' place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.batches import map_in_arrow
from lodestone.llm.textbytes import blocks, expand, mix, runs_of, span_hashes, text_buffer

FOUND = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
#: A run has so many words and so many periods at least.
MIN_WORDS, MIN_PERIODS = 6, 4
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INNER = np.ones(256, bool)
_INNER[[9, 10, 11, 12, 13, 32]] = False


def intern(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word, the same for words of the same bytes and only for those."""
    h = span_hashes(data, starts, ends, fold=False)
    _, pick, code = np.unique(h, return_index=True, return_inverse=True)
    size, same = ends - starts, pick[code]
    if np.array_equal(size, size[same]) and np.array_equal(data[expand(starts, size)], data[expand(starts[same], size)]):
        return code.astype(np.int64)
    kinds: dict[bytes, int] = {}  # two words share a hash
    return np.array([kinds.setdefault(data[a:b].tobytes(), len(kinds)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)


class Hashes:
    """Tells apart stretches of words by polynomial prefix sums modulo 2**64: different ones may pass as equal."""

    def __init__(self, s: np.ndarray):
        self.powers = np.ones(len(s) + 1, np.uint64)
        np.cumprod(np.full(len(s), _BASE), out=self.powers[1:])
        self.sums = np.zeros(len(s) + 1, np.uint64)
        np.cumsum(mix(s.astype(np.uint64) + np.uint64(1)) * self.powers[:-1], out=self.sums[1:])

    def same(self, a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
        """Whether the 2**k words from a and from b are equal; a < b."""
        n = 1 << k
        return (self.sums[a + n] - self.sums[a]) * self.powers[b - a] == self.sums[b + n] - self.sums[b]


class Ranks:
    """As `Hashes`, exactly: the stretches of 2**k words are numbered for each k, pairs of numbers at a time."""

    def __init__(self, s: np.ndarray):
        self.s, self.tables = s, [np.unique(s, return_inverse=True)[1].astype(np.int64)]

    def same(self, a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
        while len(self.tables) <= k:
            t, half = self.tables[-1], 1 << (len(self.tables) - 1)
            n = max(len(self.s) - 2 * half + 1, 0)
            self.tables.append(np.unique(t[:n] * (int(t.max()) + 1) + t[half : half + n], return_inverse=True)[1].astype(np.int64))
        return self.tables[k][a] == self.tables[k][b]


def _forward(index: Hashes | Ranks, a: np.ndarray, b: np.ndarray, room: np.ndarray) -> np.ndarray:
    """How many words from a on equal those from b on, `room` at most."""
    got = np.zeros(len(a), np.int64)
    for k in range(int(room.max(initial=0)).bit_length() - 1, -1, -1):
        at = np.flatnonzero(got + (1 << k) <= room)
        at = at[index.same(a[at] + got[at], b[at] + got[at], k)]
        got[at] += 1 << k
    return got


def _backward(index: Hashes | Ranks, a: np.ndarray, b: np.ndarray, room: np.ndarray) -> np.ndarray:
    """How many words before a equal those before b, `room` at most."""
    got = np.zeros(len(a), np.int64)
    for k in range(int(room.max(initial=0)).bit_length() - 1, -1, -1):
        step = 1 << k
        at = np.flatnonzero(got + step <= room)
        at = at[index.same(a[at] - got[at] - step, b[at] - got[at] - step, k)]
        got[at] += step
    return got


def _crossing(s: np.ndarray, low: np.ndarray, high: np.ndarray, index: Hashes | Ranks) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Starts, ends and periods of the runs that cross midpoints, level by level; `low` and `high` bound each word's text."""
    half = 4
    while half < len(s):
        mid = np.arange(half, len(s), 2 * half)
        room = np.minimum(half, high[mid] - mid) // 2
        m, q = np.repeat(mid, room), expand(np.ones(len(mid), np.int64), room)
        at = np.flatnonzero(s[m] == s[m + q])
        m, q = m[at], q[at]
        at = np.flatnonzero(s[m + q - 1] == s[m + 2 * q - 1])
        m, q = m[at], q[at]
        after = _forward(index, m, m + q, high[m] - m - q)
        at = np.flatnonzero(after >= q)
        m, q, after = m[at], q[at], after[at]
        yield m - _backward(index, m, m + q, m - low[m]), m + q + after, q

        last = mid - 1  # the left side's last word, in the text of which both sides' periods lie
        room = np.minimum(half, mid - low[last]) // 2
        m, q = np.repeat(mid, room), expand(np.ones(len(mid), np.int64), room)
        at = np.flatnonzero(s[m - 1] == s[m - 1 - q])
        m, q = m[at], q[at]
        at = np.flatnonzero(s[m - q] == s[m - 2 * q])
        m, q = m[at], q[at]
        before = _backward(index, m - q, m, m - q - low[m - 1])
        at = np.flatnonzero(before >= q)
        m, q, before = m[at], q[at], before[at]
        yield m - q - before, m + _forward(index, m - q, m, high[m - 1] - m), q
        half *= 2


def find(s: np.ndarray, bounds: np.ndarray, index: type = Hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and smallest periods of the maximal runs in texts of word ids, by start, then period.

    s: the ids; bounds: the texts' limits in it."""
    if not len(s):
        return (np.zeros(0, np.int64),) * 3
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    found = list(_crossing(s, bounds[text], bounds[text + 1], index(s)))
    start, end, q = (np.concatenate([f[i] for f in found] or [np.zeros(0, np.int64)]) for i in range(3))
    long = np.flatnonzero(end - start >= np.maximum(MIN_WORDS, MIN_PERIODS * q))
    start, end, q = start[long], end[long], q[long]
    order = np.lexsort((q, end, start))
    start, end, q = start[order], end[order], q[order]
    first = np.ones(len(q), bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, q = start[first], end[first], q[first]
    for a, b, p in zip(start.tolist(), end.tolist(), q.tolist(), strict=True):
        if index is not Ranks and not np.array_equal(s[a : b - p], s[a + p : b]):
            return find(s, bounds, Ranks)
    order = np.lexsort((q, start))
    return start[order], end[order], q[order]


def _joined(data: np.ndarray, starts: np.ndarray, size: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The words of each text with a blank between them; bounds: the texts' limits in the words."""
    gap = np.ones(len(size), np.int64)
    gap[bounds[1:][np.diff(bounds) > 0] - 1] = 0
    ends = np.concatenate(([0], np.cumsum(size + gap)))
    out = np.full(int(ends[-1]), 32, np.uint8)
    out[expand(ends[:-1], size)] = data[expand(starts, size)]
    return pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(ends[bounds].astype(np.int64)), pa.py_buffer(out)).cast(pa.string())


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offs = text_buffer(batch.column(1))
        for a, b in blocks(offs):
            data = buf[offs[a] : offs[b]]
            starts, ends, bounds = runs_of(_INNER[data], offs[a : b + 1] - offs[a])
            start, end, q = find(intern(data, starts, ends), bounds)
            inside = np.zeros(len(starts) + 1, np.int64)
            np.add.at(inside, start + q, 1)
            np.add.at(inside, end, -1)
            kept = np.flatnonzero(np.cumsum(inside)[:-1] == 0)
            cut = np.searchsorted(start, bounds)
            fields = [pa.array(x, pa.int64()) for x in (start - np.repeat(bounds[:-1], np.diff(cut)), end - start, q)]
            runs = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
            collapsed = _joined(data, starts[kept], (ends - starts)[kept], np.searchsorted(kept, bounds))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(bounds), pa.int64()), runs, collapsed], ["doc_id", "n_words", "runs", "collapsed"])


def collapse(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """`FOUND`: the runs of every whole text, and the text with each run cut down to its first period.

    Words are what white space (blank, tab to carriage return) parts. A run is a longest stretch of MIN_WORDS
    words and MIN_PERIODS periods at least, with its smallest period; runs come by start, then period. `collapsed`
    has the words that no run holds after its first period, with a blank between them. A null or empty text has
    no words, no runs and an empty `collapsed`; rows that repeat are each searched, ids may be null or repeat, other
    columns are ignored, and an empty table gives no rows. A text is worked on in one task, in memory that grows with it."""
    return map_in_arrow(documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")), _collapse, FOUND)


def with_planted(documents: DataFrame) -> DataFrame:
    """`documents` where the texts of one id in ten, by crc32, repeat from some word on.

    With h the crc32 of the decimal id and g = h div 10, where h % 10 = 0 each word i >= a of the n words becomes word
    a + (i - a) % p, where a = g % n and p = 1 + (n - a) div (3 + g % 8). Null ids and texts without words stay."""
    repeated = """
    element_at(transform(array(filter(split(text, '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w <> '')), w ->
      concat_ws(' ', transform(array(int((h div 10) % size(w))), a -> transform(array(1 + int((size(w) - a) div (3 + (h div 10) % 8))), p ->
        slice(concat(slice(w, 1, a), flatten(array_repeat(slice(w, a + 1, p), int((size(w) - a) div p) + 1))), 1, size(w)))[0])[0])), 1)"""
    has_words = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return documents.select("doc_id", "text", h.alias("h")).select("doc_id", F.when((F.col("h") % 10 == 0) & has_words, F.expr(repeated)).otherwise(F.col("text")).alias("text"))
