"""Keep-best, quotas, round-robin, sharding and carried values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.operators.joins import last_known, spread
from lodestone.scratch import materialize


def keep_best(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key in an order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def top_per_group(df: DataFrame, keys: list[str], k: int, *order: Column | str) -> DataFrame:
    """At most k rows of each key; Spark limits each task's rows of a key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= k).drop("__n")


def merge_hits(hits: DataFrame, keys: list[str], score: str, channel: str, filled: list[str]) -> DataFrame:
    """One row a key: the highest score, all channels in order and joined (null without any), and of each of `filled` the
    value of the best-scored row that has one, ties to the smaller value."""
    first = lambda c: F.struct((~F.isnan(F.col(score).cast("double"))).alias("number"), (-F.col(score)).alias("worse"), F.col(c).alias("value"))
    best = lambda c: F.min(F.when(F.col(c).isNotNull() & F.col(score).isNotNull(), first(c)))["value"].alias(c)
    channels = F.when(F.count(channel) > 0, F.array_join(F.array_sort(F.collect_set(channel)), ",")).alias("channels")
    return hits.groupBy(*keys).agg(F.max(score).alias(score), channels, *map(best, filled))


def inject(hits: DataFrame, injected: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Hits with injected ones put in where they score higher."""
    return keep_best(hits.unionByName(injected), keys, F.desc(score))


def round_robin(df: DataFrame, group: str, order: list[str], k: int) -> DataFrame:
    """k rows, the first of every group before the second of any; groups in order of their key. No group keeps more than k rows."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("turn", F.row_number().over(w)).filter(F.col("turn") <= k).orderBy("turn", group).limit(k)


def shards(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """`shard` from 1 to n: contiguous runs in an order, the first ones a row longer where n does not divide.

    Positions come from a count per range partition and a prefix sum over those few counts, so no task
    sees all rows. Places within partitions are written once, so that counts and rows agree whatever is run again."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = ranged.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
    placed = materialize(placed, "shards")
    counts = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    total = counts.agg(F.sum("__n").alias("__total"))
    both = placed.join(F.broadcast(before.drop("__n")), "__part").crossJoin(F.broadcast(total))  # a row a partition, and one row
    at, size, rest = F.col("__before") + F.col("__at"), F.floor(F.col("__total") / n), F.col("__total") % n
    long = rest * (size + 1)
    shard = F.when(at < long, F.floor(at / (size + 1))).otherwise(rest + F.floor((at - long) / F.greatest(size, F.lit(1)))) + 1
    return both.withColumn("shard", shard.cast("int")).drop("__part", "__at", "__before", "__total")


def diversify(df: DataFrame, code: str, position: str) -> DataFrame:
    """Whether a row is not the first of its code (`__rest`), by a grouped minimum; positions are unique."""
    firsts = df.groupBy(F.col(code).alias("__code")).agg(F.min(position).alias("__first"))
    joined = df.join(firsts, F.col(code).eqNullSafe(F.col("__code")))
    return joined.withColumn("__rest", (F.col(position) != F.col("__first")).cast("int")).drop("__code", "__first")


def carried(df: DataFrame, group: str, order: list[str], value: Column, alias: str) -> DataFrame:
    """The last non-null value so far in each group (groups without a key are left unfilled). A group may hold any share of
    the rows: ranges are filled on their own, and one row a range and group carries on."""
    return last_known(spread(df.withColumn("__value", value), group, *order), group, order, "__value", alias).drop("__value", "__part")


def fill_from_later(df: DataFrame, keys: list[str], order: str, filled: list[str]) -> DataFrame:
    """One row a key; each field is the first non-empty one in order."""
    first = lambda c: F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(order))).alias(c)
    return df.groupBy(*keys).agg(*map(first, filled))
