"""Predicates and filter idioms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def not_equal_or_null(c: str, value: object) -> Column:
    """c IS NULL OR c <> value."""
    return ~F.col(c).eqNullSafe(F.lit(value))


def visible(c: str, hidden: list[str]) -> Column:
    """COALESCE(c, '') NOT IN (...)."""
    return ~F.coalesce(F.col(c), F.lit("")).isin(hidden)


def like_folded(c: str, part: str) -> Column:
    """Contains, whatever the ASCII case; % and _ in `part` are themselves."""
    return F.contains(F.lower(c), F.lit(part.lower()))


def contained_in(c: str, whole: str) -> Column:
    """The column's value occurs in a given text."""
    return F.contains(F.lit(whole), F.col(c))


def where_given(df: DataFrame, **values: object) -> DataFrame:
    """Equality filters for those values that are not None."""
    given = [F.col(k) == v for k, v in values.items() if v is not None]
    return df.filter(reduce(lambda a, b: a & b, given)) if given else df


def in_range(df: DataFrame, c: str, low: object = None, high: object = None) -> DataFrame:
    """Inclusive bounds, either of which may be absent."""
    if low is not None:
        df = df.filter(F.col(c) >= low)
    return df.filter(F.col(c) <= high) if high is not None else df


def selective_fragments(df: DataFrame, text: str, fragments: list[str], most: int) -> DataFrame:
    """(fragment, n) of the fragments that at least one and at most `most` rows contain: one scan."""
    low = F.lower(text)
    hits = df.select(F.explode(F.filter(F.array(*map(F.lit, fragments)), lambda f: F.contains(low, f))).alias("fragment"))
    return hits.groupBy("fragment").agg(F.count("*").alias("n")).filter(F.col("n") <= most)


def matching_or_all(df: DataFrame, keys: list[str], hit: str) -> DataFrame:
    """Each key's matching rows, or all its rows if none matches."""
    any_hit = df.groupBy(*(F.col(k).alias(f"__{k}") for k in keys)).agg(F.max(hit).alias("__any"))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys))
    return df.join(any_hit, same).filter(F.col(hit) | ~F.col("__any")).select(*df.columns)


def allowed_by_intent(df: DataFrame, kind: str, intents: dict[str, list[str]], intent: str) -> DataFrame:
    """Rows of the kinds that an intent allows; all rows for an unknown intent."""
    return df.filter(F.col(kind).isin(intents[intent])) if intent in intents else df


def noise(c: str, patterns: list[str], shortest: int) -> Column:
    """Boilerplate by pattern, or too short."""
    return F.lower(c).rlike("|".join(patterns)) | (F.length(c) < shortest)


def publishable(c: str, blocked: list[str]) -> Column:
    """A term fit to be shown: 2 to 50 characters, no leading digit, no colon, not blocked."""
    return F.length(c).between(2, 50) & ~F.col(c).rlike("^[0-9]") & ~F.contains(F.col(c), F.lit(":")) & ~F.col(c).isin(blocked)


def valid_topic(c: str) -> Column:
    return F.length(c).between(4, 30) & F.col(c).rlike("^[A-Z ]+$") & (F.size(F.split(c, " ")) <= 3)


def listing(df: DataFrame, limit: int, *order: Column | str) -> DataFrame:
    """The first rows in an order; the limit is held to 1..200."""
    return df.orderBy(*order).limit(min(max(limit, 1), 200))


def any_in_group(c: Column, *keys: str) -> Column:
    """Whether a condition holds anywhere in the row's group."""
    return F.max(c).over(Window.partitionBy(*keys))
