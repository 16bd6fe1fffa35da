"""Token counts of flat, unindexed token files by separator scan.

A token file is a bare sequence of unsigned 16-bit big-endian ids; each document ends in the
end-of-document id. `write` makes such files, of a bounded number of bytes whatever the documents'
lengths: a task's tokens are one stream that is cut into chunks, and chunks fill files, so a long
document runs on over chunks and files. (Spark's text sink writes the bytes as they are and supplies
each chunk's last byte as its line end, so chunks end at a byte that equals the separator's low one.)

`count` cuts files into blocks, searches each block for separators with numpy, finishes the documents
that lie inside it, and stitches those that cross block or file bounds by a prefix sum over the
blocks' separator counts. The pieces are written once, so files are read once.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.batches import map_in_arrow
from lodestone.llm.bpe import Encoder
from lodestone.llm.textbytes import text_buffer
from lodestone.scratch import materialize

#: A document may open with ids beyond the vocabulary that spell its 64-bit number: five base-8192 digits. The id
#: after those stands for a separator's string inside a text, so that a document has one separator.
TAG_DIGITS, TAG_BITS = 5, 13
TAG_BASE = 1 << TAG_BITS
_PIECES = "stream string, file long, block long, piece long, whole boolean, n_tokens long, tags array<int>, separators long"


def _documents(path: str, end_id: int, size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
    """The bytes of consecutive documents, a block of texts at a time."""
    encoder = Encoder(path)
    for batch in batches:
        buf, offs = text_buffer(batch.column(1))
        null = np.asarray(batch.column(0).is_null())
        numbers = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
        for a, b, ids, bounds, _ in encoder.encode(buf, offs):
            ids = np.where(ids == end_id, size + TAG_BASE, ids)
            tags = size + (numbers[a:b, None] >> (TAG_BITS * np.arange(TAG_DIGITS)[::-1]) & (TAG_BASE - 1))
            n_tags = np.where(null[a:b], 0, TAG_DIGITS)
            at = np.concatenate(([0], np.cumsum(np.diff(bounds) + n_tags + 1)))
            out = np.empty(int(at[-1]), ">u2")
            where = np.ones(len(out), bool)
            tagged = ~null[a:b]
            place = (at[:-1][tagged, None] + np.arange(TAG_DIGITS)).ravel()
            out[place], where[place] = tags[tagged].ravel(), False
            out[at[1:] - 1], where[at[1:] - 1] = end_id, False
            out[where] = ids
            yield out.tobytes()


def _chunks(path: str, end_id: int, size: int, chunk_bytes: int):
    mark = bytes([end_id & 0xFF])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of about `chunk_bytes`, each but for a last byte, the mark, that the sink writes."""
        rest = bytearray()
        for raw in _documents(path, end_id, size, batches):
            rest += raw
            while len(rest) >= chunk_bytes:
                cut = rest.rfind(mark, 0, chunk_bytes)
                if cut < 0 and (cut := rest.find(mark, chunk_bytes)) < 0:
                    break
                yield pa.RecordBatch.from_arrays([pa.array([bytes(rest[:cut])], pa.binary())], ["value"])
                del rest[: cut + 1]
        if rest:  # it ends in a separator
            yield pa.RecordBatch.from_arrays([pa.array([bytes(rest[:-1])], pa.binary())], ["value"])

    return run


def write(documents: DataFrame, path: str, vocabulary_path: str, end_id: int, vocabulary_size: int, chunk_bytes: int = 4 << 20, chunks_per_file: int = 16) -> str:
    """Write token files of `documents` (doc_id, text) under `path` and return it: every row, null text as a
    document without tokens, and a document without a tag where the id is null. Other columns are ignored.

    The separator's low byte must be ASCII and ids, tags included, must fit 16 bits."""
    if end_id & 0xFF >= 0x80 or vocabulary_size + TAG_BASE + 1 > 1 << 16:
        raise ValueError("ids do not fit the file format")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = map_in_arrow(docs, _chunks(vocabulary_path, end_id, vocabulary_size, chunk_bytes), "value binary")
    rows.select(F.col("value").cast("string").alias("value")).write.option("lineSep", chr(end_id & 0xFF)).option("compression", "gzip").option("maxRecordsPerFile", chunks_per_file).text(path)
    return path


def scan_block(tokens: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces between the separators of a block; the last has none at its end."""
    at = np.flatnonzero(tokens == end_id)
    return np.concatenate(([0], at + 1)), np.concatenate((at, [len(tokens)]))


def _scan(end_id: int, size: int, block_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                stream, rest, block = zlib.decompressobj(31), b"", 0
                data, at, step = memoryview(content.as_buffer()), 0, 1 << 20
                while True:
                    raw, ended = bytearray(rest), at >= len(data)
                    while len(raw) < 2 * block_tokens and at < len(data):
                        raw += stream.decompress(data[at : at + step])
                        at += step
                        ended = at >= len(data)
                    cut = len(raw) if ended else min(len(raw), 2 * block_tokens)
                    rest, whole = bytes(raw[cut:]), raw[:cut]
                    if cut:
                        yield _pieces(name, block, np.frombuffer(bytes(whole), ">u2"), end_id, size)
                        block += 1
                    if ended and not rest:
                        break

    return run


def _pieces(name: str, block: int, tokens: np.ndarray, end_id: int, size: int) -> pa.RecordBatch:
    start, end = scan_block(tokens, end_id)
    tag = (tokens >= size) & (tokens < size + TAG_BASE)
    n_tags = np.concatenate(([0], np.cumsum(tag)))
    spelled = tokens[tag].astype(np.int32) - size
    n, last = len(start), len(start) - 1
    counts = (end - start) - (n_tags[end] - n_tags[start])
    whole = np.ones(n, bool)
    whole[0] = whole[last] = False  # these may go on in the blocks beside
    tags = pa.ListArray.from_arrays(pa.array(np.append(n_tags[start], n_tags[end[-1]]), pa.int32()), pa.array(spelled, pa.int32()))
    named = re.fullmatch(r"(.*)-c(\d+)\..*", name.rsplit("/", 1)[-1])  # the sink's part and file numbers
    stream, file = (named[1], int(named[2])) if named else (name, 0)
    return pa.RecordBatch.from_arrays(
        [pa.array([stream] * n), pa.array(np.full(n, file), pa.int64()), pa.array(np.full(n, block), pa.int64()), pa.array(np.arange(n), pa.int64()), pa.array(whole), pa.array(counts, pa.int64()), tags, pa.array(np.full(n, last), pa.int64())],
        ["stream", "file", "block", "piece", "whole", "n_tokens", "tags", "separators"],
    )


def count(spark: SparkSession, path: str, end_id: int, vocabulary_size: int, block_tokens: int = 1 << 20) -> DataFrame:
    """stream, position (from 0), n_tokens, doc_id (null without a tag): a row per document of the files
    under `path`. The files of one writing task, in order of their numbers, are one stream; its last
    document may lack its separator; an empty file has none.

    A document's position is the number of separators before it: those of the stream's earlier blocks, by
    a prefix sum over one row a block, plus those before it in its own."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    pieces = materialize(map_in_arrow(files.select("path", "content"), _scan(end_id, vocabulary_size, block_tokens), _PIECES), "token-pieces")
    blocks = pieces.filter("piece = 0").select("stream", "file", "block", "separators")
    before = F.sum("separators").over(Window.partitionBy("stream").orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = blocks.select("stream", "file", "block", F.coalesce(before, F.lit(0)).alias("before"))
    placed = pieces.join(offsets, ["stream", "file", "block"]).withColumn("position", F.col("before") + F.col("piece"))
    number = F.when(F.size("tags") == TAG_DIGITS, F.aggregate("tags", F.lit(0).cast("long"), lambda x, t: F.shiftleft(x, TAG_BITS).bitwiseOR(t.cast("long"))))
    inner = placed.filter("whole").select("stream", "position", "n_tokens", number.alias("doc_id"))
    edge = placed.filter("not whole").groupBy("stream", "position").agg(F.sum("n_tokens").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("file", "block", "tags"))).alias("parts"), F.max(F.col("piece") < F.col("separators")).alias("ended"))
    edge = edge.withColumn("tags", F.flatten("parts.tags")).filter("ended or n_tokens > 0 or size(tags) > 0")
    return inner.unionByName(edge.select("stream", "position", "n_tokens", number.alias("doc_id")))
