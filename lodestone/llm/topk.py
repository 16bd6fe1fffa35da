"""Exact top-k inner products over a bit-sliced index.

Candidates are packed into blocks. A block is held as bit slices: for each attribute, one bitmap
per bit of its value divided by four. A query's score against the whole block is added up by
bitmap arithmetic (a ripple-carry adder over 64 rows a word), the highest rows are taken from the
most significant slice downward, and the rows that the dropped low bits leave open are settled by
exact integer products. Blocks keep their best k per query; a second, tiny shuffle merges them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.batches import map_in_arrow
from lodestone.scratch import materialize

LOW = 2  # bits dropped from values and queries in the slices
BEST = "query_id long, vec_id long, score long"


def quantise(column: str, scale: int = 256) -> Column:
    """floor(scale * x) of each component, x as double; null where any part is null or not finite."""
    v = F.transform(F.col(column), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    fine = F.forall(F.col(column), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(F.coalesce(fine, F.lit(False)), v)


def slices(values: np.ndarray) -> tuple[list[list[np.ndarray]], int]:
    """Two's-complement bit slices of each column of `values` (rows x attributes), lowest first,
    packed 64 rows to a word, and their number; the last is the sign."""
    rows = -(-len(values) // 64) * 64
    padded = np.zeros((values.shape[1], rows), np.int64)
    padded[:, : len(values)] = values.T
    bits = max(int(np.abs(values).max(initial=0)).bit_length() + 1, 2)
    return [[np.packbits((a >> b) & 1 == 1, bitorder="little").view(np.uint64) for b in range(bits)] for a in padded], bits


def _add(total: list[np.ndarray], term: list[np.ndarray], shift: int, negate: bool) -> None:
    """total += (-1)**negate * (term << shift), in place; `total` is wide enough for every sum."""
    carry = None
    for i in range(shift, len(total)):
        t = term[min(i - shift, len(term) - 1)]
        if negate:
            t = ~t
        x = total[i] ^ t
        if carry is None:
            carry, total[i] = (total[i] | t, ~x) if negate else (total[i] & t, x)
        else:
            total[i], carry = x ^ carry, (total[i] & t) | (carry & x)


def _values(total: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    """The sums of some rows."""
    out = np.zeros(len(rows), np.int64)
    word, bit = rows >> 6, (rows & 63).astype(np.uint64)
    for i, s in enumerate(total):
        out += ((s[word] >> bit) & np.uint64(1)).astype(np.int64) << i if i < len(total) - 1 else -(((s[word] >> bit) & np.uint64(1)).astype(np.int64) << i)
    return out


def _highest(total: list[np.ndarray], valid: np.ndarray, k: int) -> int:
    """The k-th highest sum among the valid rows, found from the sign slice downward."""
    live, need, kth = valid, k, 0
    for i in range(len(total) - 1, -1, -1):
        top = i == len(total) - 1
        want = live & (~total[i] if top else total[i])
        n = int(np.bitwise_count(want).sum())
        if n >= need:
            live, bit = want, not top
        else:
            need -= n
            live, bit = live & ~want, top
        if bit:
            kth += -(1 << i) if top else 1 << i
    return kth


class BitSlicedBlock:
    """The index of one block of integer vectors."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.values = ids[order], values[order]
        self.attributes, self.bits = slices(self.values >> LOW)
        self.words = -(-len(ids) // 64)
        flags = np.zeros(self.words * 64, bool)
        flags[: len(ids)] = True
        self.valid = np.packbits(flags, bitorder="little").view(np.uint64)
        self.norm = int(np.abs(self.values).sum(1).max(initial=0))

    def search(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of the k best rows but those with the query's id; ties to smaller ids.

        The slices hold s = sum(qh * vh), where q = 4 qh + ql with ql in -2..1 and v = 4 vh + vl
        with vl in 0..3, so the score lies between 16 s + min and 16 s + max with the bounds below."""
        coarse = (query + 2) >> LOW
        rest = query - (coarse << LOW)
        width = self.bits + int(np.abs(coarse).sum()).bit_length() + 1
        total = [np.zeros(self.words, np.uint64) for _ in range(width)]
        for j in np.flatnonzero(coarse):
            q, shift, negate = int(abs(coarse[j])), 0, bool(coarse[j] < 0)
            while q:
                if q & 1:
                    _add(total, self.attributes[j], shift, negate)
                q, shift = q >> 1, shift + 1
        own = slice(*np.searchsorted(self.ids, (query_id, query_id + 1)))
        valid = self.valid.copy()
        for r in range(own.start, own.stop):
            valid[r >> 6] &= ~np.uint64(1 << (r & 63))
        there = len(self.ids) - (own.stop - own.start)
        if there <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        c = coarse << LOW
        slack = 3 * int(np.abs(c).sum()) + 2 * int(np.abs(rest).max(initial=0)) * self.norm
        floor = _highest(total, valid, min(k, there)) - -(-slack // (1 << 2 * LOW)) if there > k else -(1 << (width - 1))
        rows = self._at_least(total, valid, floor)
        score = self.values[rows] @ query
        best = np.lexsort((self.ids[rows], -score))[:k]
        return self.ids[rows][best], score[best]

    @staticmethod
    def _at_least(total: list[np.ndarray], valid: np.ndarray, floor: int) -> np.ndarray:
        """The valid rows whose sum is `floor` or more, compared slice by slice."""
        floor = max(floor, -(1 << (len(total) - 1)))
        above, equal = np.zeros_like(valid), valid
        for i in range(len(total) - 1, -1, -1):
            bit, one = (floor >> i) & 1, total[i] if i < len(total) - 1 else ~total[i]
            if i == len(total) - 1:
                bit = 1 - bit
            if bit:
                equal = equal & one
            else:
                above, equal = above | (equal & one), equal & ~one
        return np.flatnonzero(np.unpackbits((above | equal).view(np.uint8), bitorder="little"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.int64)


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by block, dimension and kind: a block's candidates (kind 0), then queries."""
        key, rows, index = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                block, dim, kind = keys[a]
                ids, values = batch.column(3).slice(a, b - a).to_numpy(zero_copy_only=False), _matrix(batch.column(4).slice(a, b - a))
                if (block, dim) != key:
                    key, rows, index = (block, dim), [], None
                if kind == 0:
                    rows.append((ids, values))
                    continue
                if rows:
                    index, rows = BitSlicedBlock(np.concatenate([x for x, _ in rows]), np.concatenate([x for _, x in rows])), []
                if index is None:
                    continue
                found = [(i, *index.search(int(i), q, k)) for i, q in zip(ids, values, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, [len(x) for _, x, _ in found])), pa.array(np.concatenate([x for _, x, _ in found])), pa.array(np.concatenate([x for _, _, x in found]))], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_column: str = "vec_id", column: str = "embedding", rows_per_block: int = 16384, scale: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest integer inner products among
    the vectors of its dimension, but for those with its own id; ties go to the smaller id.

    Candidates are written once with a number that deals them over ceil(n / rows_per_block) blocks, whatever
    their ids and contents, so that equal ones spread and a task that is run again reads the same blocks;
    every block has a task of its own, which the whole query set goes through; every query block meets every candidate block (a stated query set
    against all rows), and only k rows of each meeting are shuffled on. Vectors that are null, or
    hold null or non-finite components, take no part, neither do null ids; of repeated rows each
    counts, but of repeated query ids the least vector is asked; an empty table gives no rows. Other columns are ignored."""

    def clean(df: DataFrame) -> DataFrame:
        return df.select(F.col(id_column).cast("long").alias("vec_id"), quantise(column, scale).alias("v")).filter("vec_id is not null and v is not null and size(v) > 0")

    dealt = clean(vectors).withColumn("deal", F.xxhash64("vec_id", F.spark_partition_id(), F.monotonically_increasing_id()))
    rows, asked = materialize(dealt, "topk-rows"), clean(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    n_blocks = max(1, -(-rows.count() // rows_per_block))
    held = rows.select(F.pmod("deal", F.lit(n_blocks)).cast("int").alias("block"), F.size("v").alias("dim"), F.lit(0).alias("kind"), "vec_id", "v")
    every = asked.select(F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), F.size("v").alias("dim"), F.lit(1).alias("kind"), "vec_id", "v")
    met = held.unionByName(every).repartitionById(n_blocks, "block").sortWithinPartitions("block", "dim", "kind", "vec_id")
    best = map_in_arrow(met, _search(k), BEST)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
