"""Set operations over rows and arrays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hits(sources: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """(kind, title, score) of several sources: name -> (rows, title column, score column)."""
    parts = [df.select(F.lit(kind).alias("kind"), F.col(title).alias("title"), F.col(score).cast("double").alias("score")) for kind, (df, title, score) in sources.items()]
    return reduce(DataFrame.unionByName, parts)


def ordered_union(a: Column, b: Column) -> Column:
    """Both arrays' items in order of first appearance."""
    return F.array_distinct(F.concat(a, b))


def is_subset(a: Column | str, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def both_ways(edges: DataFrame) -> DataFrame:
    """Every edge seen from either end."""
    out = edges.select(F.col("src").alias("node"), "relation", F.col("dst").alias("other"), F.lit("out").alias("direction"))
    return out.unionByName(edges.select(F.col("dst").alias("node"), "relation", F.col("src").alias("other"), F.lit("in").alias("direction")))
