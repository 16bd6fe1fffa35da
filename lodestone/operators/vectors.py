"""Nearest vectors by cosine of a stated query set, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.ranking import top_per_group
from lodestone.scratch import materialize

_BEST = "query_id long, vec_id long, score double"


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _search(k: int, digits: int):
    def best(ids: np.ndarray, rows: np.ndarray, asked: np.ndarray, queries: np.ndarray) -> Iterator[pa.RecordBatch]:
        scores = np.round(queries @ rows.T, digits)
        for q in range(len(asked)):
            near = np.lexsort((ids, -scores[q]))[:k]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(near), asked[q])), pa.array(ids[near]), pa.array(scores[q][near])], ["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by block, size and kind: a block's vectors (kind 0), then the queries."""
        key, parts, held = None, [], None
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)] if keys else []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                ids, v = batch.column(3).slice(a, b - a).to_numpy(zero_copy_only=False), _matrix(batch.column(4).slice(a, b - a))
                v = v / np.sqrt((v * v).sum(1, keepdims=True))
                if keys[a][:2] != key:
                    key, parts, held = keys[a][:2], [], None
                if keys[a][2] == 0:
                    parts.append((ids, v))
                    continue
                if parts:
                    held, parts = (np.concatenate([i for i, _ in parts]), np.concatenate([x for _, x in parts])), []
                if held is not None:
                    for at in range(0, len(ids), 256):
                        yield from best(*held, ids[at : at + 256], v[at : at + 256])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int, rows_per_block: int = 16384, digits: int = 9) -> DataFrame:
    """(query_id, vec_id, score): the k vectors with the highest cosine of each query, scores rounded to `digits`,
    ties to the smaller id. `vectors` has (vec_id, embedding), `queries` (query_id, q).

    Vectors are dealt into blocks once; every block meets the whole query set, which is copied to each (a stated
    set against all rows), and only k rows a query leave a block. Vectors of another size than a query's, null
    or zero ones and those with null components take no part."""
    usable = lambda c: (F.size(c) > 0) & F.forall(c, lambda x: x.isNotNull()) & F.exists(c, lambda x: x != 0)
    v = vectors.select(F.col("vec_id").cast("long").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v")).filter(usable("v"))
    held = materialize(v.withColumn("deal", F.xxhash64("id", F.monotonically_increasing_id())), "vectors")
    n = max(1, -(-held.count() // rows_per_block))
    q = queries.select(F.col("query_id").cast("long").alias("id"), F.transform("q", lambda x: x.cast("double")).alias("v")).filter(usable("v"))
    rows = held.select(F.pmod("deal", F.lit(n)).cast("int").alias("block"), F.size("v").alias("dim"), F.lit(0).alias("kind"), "id", "v")
    asked = q.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"), F.size("v").alias("dim"), F.lit(1).alias("kind"), "id", "v")
    met = rows.unionByName(asked).repartitionById(n, "block").sortWithinPartitions("block", "dim", "kind", "id")
    return top_per_group(met.mapInArrow(_search(k, digits), _BEST), ["query_id"], k, F.desc("score"), "vec_id")
