"""Aggregation shapes: rates, dominant states, ordered texts, signatures and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import rank_of


def rate(condition: Column, digits: int = 6) -> Column:
    """The share of rows that meet a condition; 0 of no rows."""
    return F.round(F.coalesce(F.count_if(condition) / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)), digits)


def known_rate(flag: str, digits: int = 6) -> Column:
    """The share of true among rows where the flag is known; null if none is."""
    return F.round(F.count_if(F.col(flag)) / F.nullif(F.count(flag), F.lit(0)), digits)


def mean_number(c: str, digits: int = 6) -> Column:
    """The mean of what reads as a number; 0 if nothing does."""
    return F.round(F.coalesce(F.avg(F.col(c).try_cast("double")), F.lit(0.0)), digits)


def joined(c: str, separator: str = ",") -> Column:
    """Values joined in order; null if there are none."""
    values = F.array_sort(F.collect_list(c))
    return F.when(F.size(values) > 0, F.array_join(values, separator))


def dominant(c: str, order: list[str]) -> Column:
    """Of a group's values the first by a fixed precedence."""
    return F.min_by(c, rank_of(c, order))


def signature(*columns: str) -> Column:
    """An order-insensitive signature of a table: the sum of its rows' hashes."""
    return F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))


def histogram(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of each key."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def levels(df: DataFrame, sets: list[list[str]], *aggregates: Column) -> DataFrame:
    """GROUPING SETS: keys that a level lacks are null."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    return df.groupingSets([[F.col(k) for k in s] for s in sets], *map(F.col, keys)).agg(*aggregates)


def weighted(parts: dict[str, float]) -> Column:
    """The weighted sum of columns, nulls as 0."""
    out = F.lit(0.0)
    for c, w in parts.items():
        out = out + F.coalesce(F.col(c), F.lit(0.0)) * w
    return out


def gate(score: Column, cuts: list[tuple[float, str]], otherwise: str) -> Column:
    """The label of the first cut that the score reaches."""
    out = F.when(F.lit(False), F.lit(otherwise))
    for cut, label in cuts:
        out = out.when(score >= cut, F.lit(label))
    return out.otherwise(F.lit(otherwise))


def issues(**conditions: Column) -> Column:
    """The names of the conditions that hold, joined in the order given."""
    return F.array_join(F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in conditions.items()))), ",")
