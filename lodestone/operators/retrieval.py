"""Full-text, term-vector and dense retrieval over all queries at once, and reranking.

Queries are rows (query_id, ...). Every channel returns (query_id, doc_id, score); scores are rounded
where they are compared, so that ties are stable.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.ranking import keep_best, top_per_group
from lodestone.scratch import materialize

K1, B = 1.2, 0.75
_TEXTS_A_TASK = 16384


def dealt(hits: DataFrame, texts: int, key: str) -> DataFrame:
    """Hits dealt by text into tasks of so many texts of an index of `texts` that what a task sums or sorts stays small; Spark would
    go by the bytes of a shuffle, and keys and scores take few."""
    return hits.repartition(max(1, -(-texts // _TEXTS_A_TASK)), key)


def bm25(hits: DataFrame, size: tuple[int, float], queries: DataFrame, key: str = "doc_id", k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, key, score) of every text that has a query term, over an index's `hits` of those terms and its `size`.

    `queries` has a row for each distinct (query_id, term). Statistics cover all texts; only the rows
    of query terms are scored, so the shuffle is of hits."""
    n, mean = size
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(mean)))
    weighed = materialize(queries.join(df, "term"), "weighed")  # so that Spark knows its size, and hits need not be shuffled by term
    parts = hits.join(weighed, "term").select("query_id", key, part.alias("part"))
    return dealt(parts, n, key).groupBy("query_id", key).agg(F.sum("part").alias("score"))


def tf_cosine(hits: DataFrame, texts: int, queries: DataFrame, key: str = "doc_id") -> DataFrame:
    """(query_id, key, score): cosine of term counts over `hits` of an index of so many texts; `queries` has (query_id, term, tf)."""
    q_norms = queries.groupBy("query_id").agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("qn"))
    q = queries.join(q_norms, "query_id").select("query_id", "term", (F.col("tf") / F.col("qn")).alias("w"))
    parts = hits.join(q, "term").select("query_id", key, (F.col("tf") * F.col("w")).alias("part"), "norm")
    return dealt(parts, texts, key).groupBy("query_id", key).agg((F.sum("part") / F.first("norm")).alias("score"))


def best_k(scored: DataFrame, k: int, item: str = "doc_id") -> DataFrame:
    """Each query's k best, scores rounded to nine digits, ties to the smaller item."""
    return top_per_group(scored.withColumn("score", F.round("score", 9)), ["query_id"], k, F.desc("score"), item)


def hybrid(channels: dict[str, tuple[DataFrame, float]], k: int, item: str = "doc_id") -> DataFrame:
    """Channels' hits, each score times its boost; the best of an item stays, and the k best of a query."""
    parts = [df.select("query_id", item, (F.col("score") * boost).alias("score"), F.lit(name).alias("channel")) for name, (df, boost) in channels.items()]
    merged = keep_best(reduce(DataFrame.unionByName, parts).withColumn("score", F.round("score", 9)), ["query_id", item], F.desc("score"), "channel")
    return top_per_group(merged, ["query_id"], k, F.desc("score"), item)


def rerank(hits: DataFrame, components: dict[str, Column], k: int, item: str = "doc_id") -> DataFrame:
    """Hits with their component columns and `final`, the sum of base score and components."""
    out = hits.select("*", *(c.alias(name) for name, c in components.items()))
    total = reduce(lambda a, b: a + b, (F.col(n) for n in components), F.col("score"))
    return top_per_group(out.withColumn("final", F.round(total, 6)), ["query_id"], k, F.desc("final"), item)


def expand_synonyms(queries: DataFrame, synonyms: dict[str, list[str]], text: str = "question") -> DataFrame:
    """(query_id, variant): the question itself and the synonyms of each key that it contains."""
    found = F.flatten(F.array(*(F.when(F.contains(F.lower(text), F.lit(k)), F.array(*map(F.lit, v))).otherwise(F.array().cast("array<string>")) for k, v in synonyms.items())))
    return queries.select("query_id", F.explode(F.array_distinct(F.concat(F.array(F.lower(text)), found))).alias("variant"))
