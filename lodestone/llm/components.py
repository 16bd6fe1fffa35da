"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.scratch import free, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("least"))
    far = both.filter("dst > src").join(least, "src")
    return far.select(F.col("dst").alias("src"), F.col("least").alias("dst")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    least = down.groupBy("src").agg(F.min("dst").alias("least"))
    moved = down.join(least, "src").filter("dst <> least").select(F.col("dst").alias("src"), F.col("least").alias("dst"))
    return moved.unionByName(least.select("src", F.col("least").alias("dst"))).distinct()


def components(edges: DataFrame, max_steps: int = 60) -> DataFrame:
    """node, root: the least node that each node of `edges` (src, dst longs) is connected with.

    Nothing but two numbers a step reaches the driver; each step is written to the shared folder.
    Self-loops and nulls are ignored; nodes without an edge are not in the result."""
    now = materialize(edges.filter("src <> dst").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).distinct(), "edges")
    mark = None
    for _ in range(max_steps):
        n, h = now.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if n == 0 or (n, h) == mark:
            break
        mark = (n, h)
        before, now = now, materialize(_small_star(_large_star(now)), "edges")
        free(before)
    else:
        raise RuntimeError(f"no fixed point after {max_steps} steps")
    found = now.select(F.col("src").alias("node"), F.col("dst").alias("root"))
    return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
