"""N-gram Jaccard join with Bayesian candidate pruning.

Texts with equal shingle sets form a class; only one text of each class goes on. MinHash bands make
buckets, and texts that share a bucket meet at the bucket's least member, its centre. There the
MinHash values of a pair are compared 32 at a time, and the pair is dropped as soon as the posterior
probability that its similarity reaches the threshold falls below `tolerance`. Pairs that stay are
verified on their exact shingle sets. Pairs never become rows: each meeting returns sums for its
members and edges that connect what it found linked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.batches import map_in_arrow
from lodestone.llm.components import components
from lodestone.llm.shingles import HASHES, min_hashes, set_key, shingle_sets
from lodestone.llm.textbytes import blocks, mix, text_buffer
from lodestone.scratch import free, materialize

ROWS, BANDS, STEP = 6, 42, 32
_FEATURES = "doc_id long, sha binary, key binary, n_shingles long, bands array<long>"
_LINKS = "node long, n_links long, n_linked_docs long, root long"
_ROW_FACTORS = np.random.Generator(np.random.PCG64(13)).integers(1, 1 << 62, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """For 32, 64, ... compared values the fewest matches with which the posterior, from a uniform
    prior, P(J >= threshold) is at least `tolerance`: a binomial tail of the beta distribution."""
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        tail, m = 0.0, 0
        while True:
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                break
            m += 1
        out.append(m)
    return out


def _band_hashes(values: np.ndarray) -> np.ndarray:
    v = values[:, : BANDS * ROWS].astype(np.uint64).reshape(len(values), BANDS, ROWS)
    return mix((v * _ROW_FACTORS).sum(2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offs = text_buffer(batch.column(1))
        for a, b in blocks(offs):
            sets = shingle_sets(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
            bands = _band_hashes(np.array([min_hashes(s) for s in sets]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(a, b - a),
                    batch.column(2).slice(a, b - a),
                    pa.array([set_key(s) for s in sets], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * BANDS, pa.int32()), pa.array(bands.ravel())),
                ],
                ["doc_id", "sha", "key", "n_shingles", "bands"],
            )


class Member:
    """A class's text at a meeting."""

    __slots__ = ("node", "block", "size", "centres", "set", "hashes")

    def __init__(self, node: int, block: int, size: int, centres: list[int], shingles: np.ndarray):
        self.node, self.block, self.size, self.centres, self.set = node, block, size, centres, shingles
        self.hashes = min_hashes(shingles)


def survivors(hashes: np.ndarray, left: np.ndarray, right: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Of all pairs of a left and a later right row, those that every comparison leaves likely."""
    found = []
    for i in left.tolist():
        js = right[right > i]
        n = np.zeros(len(js), np.int32)
        for step, need in enumerate(least):
            part = slice(step * STEP, (step + 1) * STEP)
            n += (hashes[js, part] == hashes[i, part]).sum(1)
            keep = n >= need
            if not keep.all():
                js, n = js[keep], n[keep]
            if not len(js):
                break
        if len(js):
            found.append((np.full(len(js), i), js))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def common(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The exact sizes of the intersections of pairs of sorted sets."""
    out = np.zeros(len(i), np.int64)
    if len(i) <= 2 * len(sets):
        for k, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
            x, y = (sets[a], sets[b]) if len(sets[a]) <= len(sets[b]) else (sets[b], sets[a])
            at = np.searchsorted(y, x)
            at[at == len(y)] = 0
            out[k] = np.count_nonzero(y[at] == x)
        return out
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    first = np.concatenate(([True], values[1:] != values[:-1]))
    column = np.cumsum(first) - 1
    shared = np.bincount(column)[column] > 1
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    for lo in range(0, int(column.max(initial=-1)) + 1, 4096):  # a strip of shingles at a time
        a, b = np.searchsorted(column, (lo, lo + 4096))
        strip = np.zeros((len(sets), 4096), np.float32)
        strip[owner[a:b], column[a:b] - lo] = 1
        product = strip @ strip.T
        out += product[i, j].astype(np.int64)
    return out


def _meeting(members: list[Member], centre: int, i_block: int, j_block: int, threshold: Fraction, least: list[int]) -> list[tuple]:
    """Sums and connecting edges of one meeting: all pairs of one block, or between two."""
    block = np.array([m.block for m in members])
    if i_block == j_block:
        left = right = np.arange(len(members))
    else:
        order = sorted(range(len(members)), key=lambda k: block[k] != i_block)
        members = [members[k] for k in order]
        n = int((block == i_block).sum())
        left, right = np.arange(n), np.arange(n, len(members))
    i, j = survivors(np.array([m.hashes for m in members]), left, right, least)
    if not len(i):
        return []
    used = np.unique(np.concatenate((i, j)))
    i, j = np.searchsorted(used, i), np.searchsorted(used, j)
    members = [members[k] for k in used.tolist()]
    both = common([m.set for m in members], i, j)
    size = np.array([len(m.set) for m in members])
    linked = both * threshold.denominator >= threshold.numerator * (size[i] + size[j] - both)
    # A pair that meets at several centres counts at the least of them.
    lowest = np.array([m.centres[0] == centre for m in members])
    for k in np.flatnonzero(linked & ~lowest[i] & ~lowest[j]).tolist():
        linked[k] = min(set(members[i[k]].centres) & set(members[j[k]].centres)) == centre
    i, j = i[linked], j[linked]
    docs = np.array([m.size for m in members])
    n = len(members)
    links = np.bincount(i, minlength=n) + np.bincount(j, minlength=n)
    linked_docs = np.bincount(i, docs[j], n) + np.bincount(j, docs[i], n)
    root = np.arange(n)
    while True:
        least_root = root.copy()
        np.minimum.at(least_root, i, root[j])
        np.minimum.at(least_root, j, root[i])
        least_root = least_root[least_root]
        if (least_root == root).all():
            break
        root = least_root
    return [(members[k].node, int(links[k]), int(linked_docs[k]), members[root[k]].node) for k in range(n) if links[k]]


def _verify(threshold: Fraction, least: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members, done = None, [], []

        def flush() -> None:
            if key is not None and len(members) > 1:
                done.extend(_meeting(members, *key, threshold, least))

        for batch in batches:
            buf, offs = text_buffer(batch.column(7))
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
            rest = list(zip(*(batch.column(k).to_pylist() for k in range(3, 7)), strict=True))
            for a, b in blocks(offs):
                sets = shingle_sets(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                for r in range(a, b):
                    if keys[r] != key:
                        flush()
                        key, members = keys[r], []
                    members.append(Member(*rest[r], sets[r - a]))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*done, strict=True)], ["node", "n_links", "n_linked_docs", "root"])
                done.clear()
        flush()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*done, strict=True)], ["node", "n_links", "n_linked_docs", "root"])

    return run


def _named(documents: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """doc_id, text, sha: each row and the digest of its text."""
    text = F.col(text_column)
    return documents.select(F.col(id_column).cast("long").alias("doc_id"), text.alias("text"), _sha(text).alias("sha"))


def _sha(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _first(*rest: str) -> Column:
    """The least (doc_id, sha), null ids last, and what stands beside it."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "sha", *rest))


def _resolve(documents: DataFrame, threshold: str, tolerance: float, block_texts: int, block_shingles: int, id_column: str, text_column: str) -> tuple[DataFrame, DataFrame]:
    """Features of each row, and of each class: key, doc_id and sha of its first row, class_size, n_links,
    n_linked_docs, group_id, and whether its group's first row is its own (`leads`).

    Classes are numbered by the table that is written of them, so neither repeated nor null ids matter."""
    docs = _named(documents, id_column, text_column)
    features = materialize(map_in_arrow(docs, _features, _FEATURES), "jaccard-features")
    classes = features.filter("n_shingles > 0").groupBy("key").agg(_first("n_shingles", "bands").alias("first"), F.count("*").alias("class_size"))
    classes = classes.select("key", "class_size", "first.doc_id", "first.sha", "first.n_shingles", "first.bands", F.monotonically_increasing_id().alias("node"))
    classes = materialize(classes, "jaccard-classes")
    bucketed = classes.select("node", "n_shingles", F.explode("bands").alias("bucket"))
    buckets = bucketed.groupBy("bucket").agg(F.min("node").alias("centre"), F.max("node").alias("last")).filter("last > centre").drop("last")
    met = materialize(bucketed.join(buckets, "bucket").select("node", "n_shingles", "centre").distinct(), "jaccard-meetings")
    sizes = met.groupBy("centre").agg(F.greatest(F.ceil(F.count("*") / block_texts), F.ceil(F.sum("n_shingles") / block_shingles)).cast("int").alias("n_blocks"))
    nodes = met.groupBy("node").agg(F.array_sort(F.collect_set("centre")).alias("centres"))
    nodes = nodes.join(classes.select("node", "class_size", F.col("doc_id").alias("first_id"), F.col("sha").alias("first_sha")), "node")
    own = (F.col("sha") == F.col("first_sha")) & F.col("doc_id").eqNullSafe(F.col("first_id"))
    texts = materialize(nodes.join(docs, own).groupBy("node", "class_size", "centres").agg(F.min("text").alias("text")), "jaccard-texts")
    seats = met.select("node", "centre").join(sizes, "centre").withColumn("block", F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int"))
    seats = seats.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    seats = seats.select("node", "centre", "block", F.least("block", "other").alias("i_block"), F.greatest("block", "other").alias("j_block"))
    tables = seats.join(texts, "node").select("centre", "i_block", "j_block", "node", "block", "class_size", "centres", "text")
    tables = tables.repartition("centre", "i_block", "j_block").sortWithinPartitions("centre", "i_block", "j_block", "node")
    exact = Fraction(threshold)
    links = materialize(map_in_arrow(tables, _verify(exact, least_matches(float(exact), tolerance)), _LINKS), "jaccard-links")
    free(met, texts)
    counts = links.groupBy("node").agg(F.sum("n_links").alias("n_links"), F.sum("n_linked_docs").alias("n_linked_docs"))
    roots = components(links.select(F.col("node").alias("src"), F.col("root").alias("dst")))
    firsts = roots.join(classes.select("node", "doc_id", "sha"), "node").groupBy("root").agg(_first("node").alias("first"))
    groups = roots.join(firsts, "root").select("node", F.col("first.doc_id").alias("group_id"), F.col("first.node").alias("leader"))
    per_class = classes.drop("bands").join(counts, "node", "left").join(groups, "node", "left")
    return features, per_class.select(
        "key", "doc_id", "sha", "class_size", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_linked_docs", F.lit(0)).alias("n_linked_docs"),
        F.when(F.col("leader").isNull(), F.col("doc_id")).otherwise(F.col("group_id")).alias("group_id"), (F.coalesce("leader", "node") == F.col("node")).alias("leads"),
    )


def join(documents: DataFrame, threshold: str = "0.8", tolerance: float = 1e-6, block_texts: int = 1024, block_shingles: int = 1_000_000, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, class_id, class_size, n_links, n_linked_docs, group_id: a row per row of `documents`.

    A class is the rows whose texts have the same set of five-word shingles, whatever their ids; class_id
    is its least doc_id, class_size the number of its rows; n_links counts the other classes whose sets
    have a Jaccard similarity of `threshold` or more, n_linked_docs the rows in them; group_id is the
    least doc_id that chains of links and copies reach. Ids decide nothing else: different texts under
    one id are different classes, rows with null ids are copies and links like others, and class_id or
    group_id is null only where no row of the class or group has an id.

    A null, empty or wordless text has no shingles: it is a class and group of its own row's id. A
    text of one to four words is one shingle. An empty table gives no rows; other columns are ignored.

    At similarity 0.8 a pair misses every one of 42 bands of 6 values with probability 3e-6; pruning
    loses at most about `tolerance` of the pairs a step. Meetings of more than `block_texts` texts or
    `block_shingles` shingles are split into pairs of blocks."""
    features, per_class = _resolve(documents, threshold, tolerance, block_texts, block_shingles, id_column, text_column)
    of_class = per_class.select("key", F.col("doc_id").alias("class_id"), "class_size", "n_links", "n_linked_docs", "group_id")
    own = features.filter("n_shingles > 0").select("doc_id", "key").join(of_class, "key").drop("key")
    none = lambda n: F.lit(n).cast("long")
    empty = features.filter("n_shingles = 0").select("doc_id", F.col("doc_id").alias("class_id"), none(1).alias("class_size"), none(0).alias("n_links"), none(0).alias("n_linked_docs"), F.col("doc_id").alias("group_id"))
    return own.unionByName(empty)


def keep_one(documents: DataFrame, threshold: str = "0.8", tolerance: float = 1e-6, block_texts: int = 1024, block_shingles: int = 1_000_000) -> DataFrame:
    """One row of `documents` (doc_id, text and others) of each group of copies and near copies: that with
    the least doc_id, or in a group without ids the least digest of its text; of rows that repeat it one.
    Wordless texts are no copies of each other, so their rows all stay."""
    features, per_class = _resolve(documents, threshold, tolerance, block_texts, block_shingles, "doc_id", "text")
    keys = ["doc_id", "sha"]
    many = features.filter("n_shingles > 0").groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("m_id"), F.col("sha").alias("m_sha"), F.lit(True).alias("many"))
    leaders = per_class.filter("leads").select(*keys).join(many, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("sha") == F.col("m_sha")), "left")
    kept = leaders.select(*keys, F.coalesce("many", F.lit(False)).alias("many")).unionByName(features.filter("n_shingles = 0").select(*keys, F.lit(False).alias("many")).distinct())
    kept = materialize(kept.select(F.col("doc_id").alias("k_id"), F.col("sha").alias("k_sha"), "many"), "jaccard-kept")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), _sha(F.col("text")).alias("sha"), F.struct("*").alias("row"))
    both = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("sha") == F.col("k_sha")))
    return both.filter("not many").select("row.*").unionByName(both.filter("many").dropDuplicates(keys).select("row.*"))
