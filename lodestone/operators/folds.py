"""Folds over ordered layers: inheritance of limits from general to special profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def layers_of(customer: DataFrame, nation: DataFrame) -> DataFrame:
    """(leaf, profile_id): each customer's own profile, its nation's and its region's."""
    named = customer.select(F.concat(F.lit("C"), "c_custkey").alias("leaf"), "c_nationkey").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    layers = F.array(F.col("leaf"), F.concat(F.lit("N"), F.col("n_nationkey")), F.concat(F.lit("R"), F.col("n_regionkey")))
    return named.select("leaf", F.explode(layers).alias("profile_id"))


def effective_limits(layers: DataFrame, limits: DataFrame) -> DataFrame:
    """Each leaf's effective maximum: layers are applied from low to high priority, and one that would
    loosen the limit so far is refused and marks a conflict. Columns leaf, effective, nearest (the
    last layer's own value) and conflict (the last layer's value was refused)."""
    rows = layers.join(limits, "profile_id").groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("priority", "value_numeric"))).alias("steps"))
    kind = "struct<effective: decimal(18,2), nearest: decimal(18,2), conflict: boolean>"
    start = F.lit(None).cast(kind)

    def step(acc, x):
        looser = acc["effective"].isNotNull() & (x["value_numeric"] > acc["effective"])
        return F.struct(F.when(looser, acc["effective"]).otherwise(x["value_numeric"]).alias("effective"), x["value_numeric"].alias("nearest"), F.coalesce(looser, F.lit(False)).alias("conflict")).cast(kind)

    return rows.select("leaf", F.aggregate("steps", start, step).alias("r")).select("leaf", "r.*")
