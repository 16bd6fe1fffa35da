"""Alignment of two tokenizers over the same texts.

Both encode the bytes of a blank and the text. Every byte carries a label: nothing, an end of an A token, of
a B token, or of both; a regular expression over the label string finds the spans up to each byte with
both, and the labels counted in a span are the tokens of its group. Tokens of a group are linked, each of A
with each of B, and id pairs are weighed by the number of texts that hold them linked.

The corpus-wide part moves one row per distinct pair of a block of texts, not per text: a narrow pass
writes each text's pairs as numbers into its block's dictionary, dictionaries are summed up and joined
with the sums, and blocks meet their resolved dictionaries again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.batches import map_in_arrow
from lodestone.llm.bpe import Encoder
from lodestone.llm.textbytes import expand, text_buffer
from lodestone.scratch import materialize

A_END, B_END, BOTH = 1, 2, 3
SPAN = re.compile(rb"[^\x03]*\x03")
#: Links of a group from which its repeated ids are counted before they are paired.
WIDE = 4096
_WRITTEN = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, block long, pairs array<int>, weights array<long>, dictionary array<long>, held array<long>"
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class PlainEncoder(Encoder):
    """The byte-level encoder, to which the strings of control tokens are plain text."""

    def _special(self, data: np.ndarray, own: np.ndarray) -> None:
        return None


class Pieces:
    """A sentencepiece model and the bytes of its pieces."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        names = [self.model.id_to_piece(i) for i in range(self.size)]
        pieces = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.piece_size = np.array([len(p) for p in pieces], np.int64)
        self.piece_at = np.concatenate(([0], np.cumsum(self.piece_size)))[:-1]
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and the number of each."""
        found = self.model.encode(texts, num_threads=1) if texts else []
        n = np.array([len(x) for x in found], np.int64)
        return np.fromiter(chain.from_iterable(found), np.int64, int(n.sum())), n


@lru_cache(2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


@lru_cache(1)
def _digits(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Decimal digits of numbers, each before one separator byte: starts, sizes and bytes."""
    texts = [b"%d," % i for i in range(size)]
    n = np.array([len(t) for t in texts], np.int64)
    return np.concatenate(([0], np.cumsum(n)))[:-1], n, np.frombuffer(b"".join(texts), np.uint8)


def spans(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ends of the groups of two token sequences over the same bytes, and their bounds in A's and in B's tokens.

    a_end, b_end: ascending byte ends; both sequences end at the same byte."""
    if not len(a_end):
        return np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64)
    labels = np.zeros(int(a_end[-1]), np.uint8)
    labels[a_end - 1] = A_END
    labels[b_end - 1] |= B_END
    ends = np.fromiter((m.end() for m in SPAN.finditer(labels.tobytes())), np.int64)
    n_a, n_b = (np.cumsum((labels & side) > 0)[ends - 1] for side in (A_END, B_END))
    return ends, np.concatenate(([0], n_a)), np.concatenate(([0], n_b))


def linked(a_ids: np.ndarray, b_ids: np.ndarray, in_a: np.ndarray, in_b: np.ndarray, row: np.ndarray, keys: int, b_size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct linked id pairs of each row: rows, pairs (A id * b_size + B id) and numbers of links, by row, then pair.

    in_a, in_b: the groups' bounds in the tokens; row: each group's row; keys: a number above every pair."""
    n_a, n_b = np.diff(in_a), np.diff(in_b)
    wide = n_a * n_b > WIDE
    group = np.repeat(np.arange(len(n_a)), n_a)
    times = np.where(wide, 0, n_b)[group]
    code = row[np.repeat(group, times)] * keys + np.repeat(a_ids * b_size, times) + b_ids[expand(in_b[:-1][group], times)]
    code, weight = np.unique(code, return_counts=True)
    if wide.any():
        codes, weights = [code], [weight]
        for g in np.flatnonzero(wide).tolist():
            a, times_a = np.unique(a_ids[in_a[g] : in_a[g + 1]], return_counts=True)
            b, times_b = np.unique(b_ids[in_b[g] : in_b[g + 1]], return_counts=True)
            codes.append(row[g] * keys + (a[:, None] * b_size + b).ravel())
            weights.append((times_a[:, None] * times_b).ravel())
        code, at = np.unique(np.concatenate(codes), return_inverse=True)
        weight = np.zeros(len(code), np.int64)
        np.add.at(weight, at, np.concatenate(weights))
    return code // keys, code % keys, weight.astype(np.int64)


def _equal_rows(data: np.ndarray, offs: np.ndarray, joined: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of each row, whether its bytes in `data` and `joined` are equal; both by offsets."""
    if np.array_equal(offs, ends) and np.array_equal(data, joined):
        return np.ones(len(offs) - 1, bool)
    return np.array([np.array_equal(data[a:b], joined[c:d]) for a, b, c, d in zip(offs[:-1], offs[1:], ends[:-1], ends[1:], strict=True)], bool)


def written_groups(a_ids: np.ndarray, b_ids: np.ndarray, in_a: np.ndarray, in_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The groups as bytes, `a1,a2|b1;` each, and the byte end of each group."""
    total = len(a_ids) + len(b_ids)
    number, mark = np.empty(total, np.int64), np.full(total, ord(","), np.uint8)
    number[np.arange(len(a_ids)) + np.repeat(in_b[:-1], np.diff(in_a))] = a_ids
    number[np.arange(len(b_ids)) + np.repeat(in_a[1:], np.diff(in_b))] = b_ids
    mark[in_a[1:] - 1 + in_b[:-1]] = ord("|")
    mark[in_a[1:] + in_b[1:] - 1] = ord(";")
    at, size, digits = _digits(max(int(number.max(initial=0)) + 1, 1 << 16))
    out = digits[expand(at[number], size[number])]
    ends = np.cumsum(size[number])
    out[ends - 1] = mark
    return out, ends[in_a[1:] + in_b[1:] - 1]


def _block(encoder: PlainEncoder, model: Pieces, data: np.ndarray, offs: np.ndarray, a_ids: np.ndarray, a_cut: np.ndarray) -> tuple:
    """Columns of a few rows, and their pairs: (n_a, n_b, n_groups, n_links, digests, (rows, pairs, weights))."""
    rows = len(offs) - 1
    size = np.diff(offs)
    full = np.flatnonzero(size)
    raw = data.tobytes()
    b_ids, b_n = np.zeros(0, np.int64), np.zeros(rows, np.int64)
    b_ids, b_n[full] = model.encode([raw[offs[i] + 1 : offs[i + 1]].decode() for i in full.tolist()])
    b_end = np.concatenate(([0], np.cumsum(model.piece_size[b_ids])))
    b_bytes = model.bytes[expand(model.piece_at[b_ids], model.piece_size[b_ids])]
    a_n = np.diff(a_cut)
    a_bytes = encoder.vocab.decode_bytes(a_ids)
    a_end = np.concatenate(([0], np.cumsum(encoder.vocab.piece_size[a_ids])))
    good = (size > 0) & _equal_rows(data, offs, a_bytes, a_end[a_cut]) & _equal_rows(data, offs, b_bytes, b_end[np.concatenate(([0], np.cumsum(b_n)))])
    a_ids, b_ids = a_ids[np.repeat(good, a_n)].astype(np.int64), b_ids[np.repeat(good, b_n)]
    n_a, n_b, size = np.where(good, a_n, 0), np.where(good, b_n, 0), np.where(good, size, 0)
    ends, in_a, in_b = spans(np.cumsum(encoder.vocab.piece_size[a_ids]), np.cumsum(model.piece_size[b_ids]))
    limits = np.concatenate(([0], np.searchsorted(ends, np.cumsum(size), "right")))
    links = np.concatenate(([0], np.cumsum(np.diff(in_a) * np.diff(in_b))))
    text, text_end = written_groups(a_ids, b_ids, in_a, in_b)
    text, text_end = text.tobytes(), np.concatenate(([0], text_end))
    digests = [hashlib.sha256(text[text_end[i] : text_end[j] - 1]).hexdigest() if j > i else "" for i, j in zip(limits[:-1], limits[1:], strict=True)]
    groups = np.diff(limits)
    pairs = linked(a_ids, b_ids, in_a, in_b, np.repeat(np.arange(rows), groups), encoder.vocab.size * model.size, model.size)
    return n_a, n_b, groups, links[limits[1:]] - links[limits[:-1]], digests, pairs


def _write(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, model = PlainEncoder(path_a), pieces(path_b)
        task = TaskContext.get().partitionId() << 32
        schema = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("block", pa.int64()), ("pairs", pa.list_(pa.int32())), ("weights", pa.list_(pa.int64())), ("dictionary", pa.list_(pa.int64())), ("held", pa.list_(pa.int64()))])
        for number, batch in enumerate(batches):
            buf, offs = text_buffer(batch.column(1))
            parts = []
            for a, b, ids, cut, _ in encoder.encode(buf, offs):
                parts.append((a, *_block(encoder, model, buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a], ids, cut)))
            if not parts:
                continue
            first, n_a, n_b, groups, links, digests, pairs = zip(*parts, strict=True)
            row = np.concatenate([p[0] + a for a, p in zip(first, pairs, strict=True)])
            dictionary, code = np.unique(np.concatenate([p[1] for p in pairs]), return_inverse=True)
            limits = pa.array(np.searchsorted(row, np.arange(len(batch) + 1)), pa.int32())
            block, none = task + number, pa.array([None] * len(batch), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), *(pa.array(np.concatenate(x), pa.int64()) for x in (n_a, n_b, groups, links)), pa.array(list(chain(*digests)), pa.string()), pa.array([block] * len(batch), pa.int64()),
                    pa.ListArray.from_arrays(limits, pa.array(code.astype(np.int32))), pa.ListArray.from_arrays(limits, pa.array(np.concatenate([p[2] for p in pairs]))), none, none,
                ],
                schema=schema,
            )
            own = {"block": block, "dictionary": dictionary, "held": np.bincount(code, minlength=len(dictionary))}
            yield pa.RecordBatch.from_arrays([pa.array([own.get(f.name)], f.type) for f in schema], schema=schema)

    return run


def _resolve(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """Sums over the links of each text of a block; counts: position in the block's dictionary, texts that hold the pair, whether its A id has no better."""
    docs = docs.combine_chunks()
    at = counts["pos"].to_numpy()
    held, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    held[at], best[at] = counts["n"].to_numpy(), counts["best"].to_numpy()
    columns = {}
    lists = [docs[name].combine_chunks() for name in ("pairs", "weights")]
    pairs, weights = (x.flatten().to_numpy() if len(x) else np.zeros(0, np.int64) for x in lists)
    size = np.array(lists[0].value_lengths().to_pylist(), np.int64)
    limits = np.concatenate(([0], np.cumsum(size)))
    for name, value in (("n_best", best), ("count_sum", held)):
        sums = np.concatenate(([0], np.cumsum(value[pairs] * weights)))
        columns[name] = pa.array(sums[limits[1:]] - sums[limits[:-1]], pa.int64())
    return pa.table({name: columns.get(name) if name in columns else docs[name] for name in (f.split()[0] for f in ALIGNED.split(", "))})


def align(documents: DataFrame, path_a: str, path_b: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """`ALIGNED`: tokens, groups and links of every whole text under a byte-level BPE file (A) and a sentencepiece model (B).

    A pair's count is the number of rows that hold it linked; `n_best` counts the links whose pair has its A id's
    highest count (ties included), `count_sum` adds the counts of all links. `groups_sha256` digests the groups written as
    `a1,a2|b1;a3|b2,b3`. A text that is null, empty, or not spelt exactly by either tokenizer has no tokens: zeros and an
    empty digest. Rows that repeat are each counted, ids may be null, other columns are ignored, an empty table gives no rows.
    A text is worked on in one task, in memory that grows with it; what meets afterwards is at most a block of texts (4 MB, or
    one longer text). The only broadcast has a row per id of A."""
    text = F.when(F.length(text_column) > 0, F.concat(F.lit(" "), F.col(text_column)))
    rows = documents.select(F.col(id_column).cast("long").alias("doc_id"), text.alias("text"))
    written = materialize(map_in_arrow(rows, _write(path_a, path_b), _WRITTEN), "alignment")
    entries = written.filter("dictionary IS NOT NULL").select(F.col("block").alias("part"), F.posexplode(F.arrays_zip("dictionary", "held")).alias("pos", "entry")).select("part", "pos", F.col("entry.dictionary").alias("pair"), F.col("entry.held").alias("held"))
    counts = materialize(entries.groupBy("pair").agg(F.sum("held").alias("n")), "alignment-counts")
    a_id = F.expr(f"pair div {pieces(path_b).size}").alias("a")
    top = counts.groupBy(a_id).agg(F.max("n").alias("top"))  # a row per id of A's vocabulary at most
    ranked = counts.withColumn("a", a_id).join(F.broadcast(top), "a").select("pair", "n", (F.col("n") == F.col("top")).cast("int").alias("best"))
    resolved = entries.drop("held").join(ranked, "pair").select("part", "pos", "n", "best")
    texts = written.filter("dictionary IS NULL").drop("dictionary", "held")
    return texts.groupBy("block").cogroup(resolved.groupBy("part")).applyInArrow(_resolve, ALIGNED)
