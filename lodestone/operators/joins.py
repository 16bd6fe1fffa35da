"""Join shapes beyond the plain equi-join, all as hash-partitionable plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.scratch import materialize


def dangling(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Rows of `left` whose non-null key has no row in `right`."""
    keys = right.select(F.col(right_key).alias("__key"))
    return left.filter(F.col(left_key).isNotNull()).join(keys, F.col(left_key) == F.col("__key"), "left_anti")


def with_flag(left: DataFrame, right: DataFrame, left_key: str, right_key: str, flag: str) -> DataFrame:
    """`left` and whether its key has a row in `right`; never multiplies rows."""
    keys = right.select(F.col(right_key).alias("__key")).filter(F.col("__key").isNotNull()).distinct().withColumn("__hit", F.lit(True))
    return left.join(keys, F.col(left_key) == F.col("__key"), "left").withColumn(flag, F.coalesce("__hit", F.lit(False))).drop("__key", "__hit")


def names_with_aliases(df: DataFrame, key: str, name: str, aliases: str) -> DataFrame:
    """(key, name_key): the canonical name and each alias in small letters, for an equi-join by name."""
    canonical = df.select(key, F.lower(name).alias("name_key"))
    return canonical.unionByName(df.select(key, F.explode_outer(aliases).alias("a")).select(key, F.lower("a").alias("name_key"))).filter("name_key is not null").distinct()


def containing(texts: DataFrame, text_key: str, text: str, terms: DataFrame, term: str) -> DataFrame:
    """(text_key, term) where the text contains the term as a run of whole tokens.

    A term meets the texts that have its rarest token, by an equi-join, and the run is verified once for each
    such pair; so common words bring no pairs together, and no pair that shares nothing is formed."""
    words = lambda c: F.regexp_extract_all(F.lower(F.col(c)), F.lit(r"[a-z0-9./-]+"), F.lit(0))
    line = lambda c: F.concat(F.lit(" "), F.array_join(c, " "), F.lit(" "))
    t = terms.select(F.col(term).alias("__term"), words(term).alias("__run")).filter(F.size("__run") > 0).distinct()
    own = t.select("__term", line("__run").alias("__line"), F.explode(F.array_distinct("__run")).alias("__token"))
    split = texts.select(text_key, words(text).alias("__w"))  # on its own, so that a text is split once
    each = split.select(text_key, F.explode(F.array_distinct("__w")).alias("__token"))
    counts = each.select("__token").join(own.select("__token").distinct(), "__token", "left_semi").groupBy("__token").agg(F.count("*").alias("__n"))
    ranked = own.join(counts, "__token", "left").withColumn("__n", F.coalesce("__n", F.lit(0)))
    rarest = ranked.groupBy("__term", "__line").agg(F.min(F.struct("__n", "__token")).alias("__a")).filter("__a.__n > 0")
    met = each.join(rarest.select("__term", "__line", F.col("__a.__token").alias("__token")), "__token").drop("__token")
    found = met.join(split.select(text_key, line("__w").alias("__text")), text_key).filter(F.contains("__text", F.col("__line")))
    return found.select(text_key, F.col("__term").alias(term)).distinct()


def substrings(texts: DataFrame, text_key: str, text: str, terms: DataFrame, term: str) -> DataFrame:
    """(text_key, term) where the text contains the term anywhere, for short texts (questions, names, titles).

    Terms meet the stretches of each distinct text that are as long as some term, by an equi-join on the whole
    of them. So every pair that is formed is a hit: rows grow with the texts and hits alone, whatever terms share."""
    t = terms.select(F.col(term).alias("__term")).filter("__term <> ''").distinct()
    sizes = t.agg(F.collect_set(F.length("__term")).alias("__sizes"))  # one row, a number for each length of terms
    rows = texts.select(text_key, F.col(text).alias("__text")).filter("__text <> ''")
    each = rows.select("__text").distinct().crossJoin(F.broadcast(sizes)).select("__text", F.explode("__sizes").alias("__size")).filter(F.length("__text") >= F.col("__size"))
    starts = F.sequence(F.lit(1), F.length("__text") - F.col("__size") + 1)
    stretches = each.select("__text", F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring("__text", i, F.col("__size"))))).alias("__term"))
    return rows.join(stretches.join(t, "__term"), "__text").select(text_key, F.col("__term").alias(term)).distinct()


def proximity(left: DataFrame, right: DataFrame, group: str, left_at: str, right_at: str, distance: int) -> DataFrame:
    """Pairs of rows of one group whose integer positions differ by `distance` at most.

    Positions are cut into buckets of the distance's width; each right row is copied to its bucket and
    both beside it, which makes the range an equi-join."""
    width = max(distance, 1)
    near = right.withColumn("__bucket", F.explode(F.array(*(F.floor(F.col(right_at) / width) + d for d in (-1, 0, 1)))))
    own = left.withColumn("__bucket", F.floor(F.col(left_at) / width))
    return own.join(near, [group, "__bucket"]).filter(F.abs(F.col(left_at) - F.col(right_at)) <= distance).drop("__bucket")


def spread(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Rows dealt into ranges of (key, order), with the number of their range; written once, so that a task that is
    run again finds the same ranges. A key of any size is spread over as many ranges as it fills."""
    return materialize(rows.repartitionByRange(key, *order).withColumn("__part", F.spark_partition_id()), "ranges")


def last_known(placed: DataFrame, key: str, order: list[str], value: str, alias: str, ahead: bool = False) -> DataFrame:
    """`placed` with the last non-null value of the key at or before each row (`ahead`: the first at or after it).

    Ranges are filled on their own, and what a key carries into a range is the last value of its earlier ranges:
    one row for each range and key, in a window of a key's ranges."""
    turned = [F.desc(o) if ahead else F.asc(o) for o in order]
    own = F.last(value, True).over(Window.partitionBy("__part", key).orderBy(*turned).rowsBetween(Window.unboundedPreceding, 0))
    end = (F.min_by if ahead else F.max_by)(value, F.when(F.col(value).isNotNull(), F.struct(*order)))
    ends = placed.groupBy("__part", key).agg(end.alias("__end"))
    before = Window.partitionBy(key).orderBy(F.desc("__part") if ahead else F.asc("__part")).rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.withColumn("__carry", F.last("__end", True).over(before)).filter("__carry is not null").select(F.col("__part").alias("__p"), F.col(key).alias("__k"), "__carry")
    filled = placed.withColumn(alias, own).join(carry, (F.col("__part") == F.col("__p")) & (F.col(key) == F.col("__k")), "left")
    return filled.withColumn(alias, F.coalesce(alias, "__carry")).drop("__p", "__k", "__carry")


def nearest(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, value: str, alias: str) -> DataFrame:
    """`left` and the value of the right row of its key with the nearest position; ties to the smaller
    position, then value. Both sides are merged into one sorted stream per key and filled from
    either end, range by range, so nothing is paired up and a key may hold any share of the rows; rows of keys
    that `right` lacks, and null keys, get null."""
    r = right.filter(F.col(key).isNotNull()).select(F.col(key), F.col(right_at).alias("__at"), F.struct(F.col(right_at).alias("p"), F.col(value).alias("v")).alias("__r"), F.lit(0).alias("__left"))
    r = r.groupBy(key, "__at", "__left").agg(F.min("__r").alias("__r"))
    own = left.withColumn("__at", F.col(left_at)).withColumn("__left", F.lit(1))
    placed = spread(own.unionByName(r, allowMissingColumns=True), key, "__at", "__left")
    back = last_known(placed, key, ["__at", "__left"], "__r", "__b")
    found = last_known(back, key, ["__at", "__left"], "__r", "__a", ahead=True).filter("__left = 1")
    gap = lambda c: F.abs(F.col("__at") - F.col(f"{c}.p"))
    pick = F.when(F.col("__a").isNull() | (gap("__b") <= gap("__a")), F.col("__b.v")).otherwise(F.col("__a.v"))
    return found.withColumn(alias, F.when(F.col("__b").isNull(), F.col("__a.v")).otherwise(pick)).drop("__at", "__left", "__r", "__a", "__b", "__part")


def as_of(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, value: str, alias: str, strict: bool = False) -> DataFrame:
    """`left` and the value of its key's latest right row not after it (before it if `strict`), null for null keys.
    As in `nearest`, a key may hold any share of the rows."""
    r = right.filter(F.col(key).isNotNull()).select(F.col(key), F.col(right_time).alias("__at"), F.struct(F.col(value).alias("v")).alias("__v"), F.lit(1 if strict else 0).alias("__order"))
    r = r.groupBy(key, "__at", "__order").agg(F.max("__v").alias("__v"))
    own = left.withColumn("__at", F.col(left_time)).withColumn("__order", F.lit(0 if strict else 1)).withColumn("__left", F.lit(True))
    placed = spread(own.unionByName(r, allowMissingColumns=True), key, "__at", "__order")
    found = last_known(placed, key, ["__at", "__order"], "__v", "__found").filter("__left")
    return found.withColumn(alias, F.col("__found.v")).drop("__at", "__v", "__order", "__left", "__found", "__part")


def compared(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, old_value, new_value, change): added, removed, changed or unchanged, null-safe."""
    a = old.select(F.col(key), F.col(value).alias("old_value"), F.lit(True).alias("__old"))
    b = new.select(F.col(key), F.col(value).alias("new_value"), F.lit(True).alias("__new"))
    change = (
        F.when(F.col("__old").isNull(), "added")
        .when(F.col("__new").isNull(), "removed")
        .when(F.col("old_value").eqNullSafe(F.col("new_value")), "unchanged")
        .otherwise("changed")
    )
    return a.join(b, key, "full_outer").select(key, "old_value", "new_value", change.alias("change"))


def overlapping(rows: DataFrame, key: str, item: str, a: str = "a", b: str = "b", most: int = 64) -> DataFrame:
    """(a, b, shared) of two keys, a the smaller, that have an item in common, and how many they share.

    Each key's items travel with it, and of the meetings of a pair that by its least shared item counts, so that pairs leave the join
    as they are: they outnumber the rows by far, and none is shuffled. Items are hashed to 64 bits: where one bit is common and
    not that of two items on both sides, one item is shared, and the items need not be compared. Keys of over `most` items
    would be copied too often; their meetings are summed by pair."""
    x = rows.select(F.col(key).alias("__key"), F.col(item).alias("__item")).filter("__key IS NOT NULL AND __item IS NOT NULL").distinct()
    sizes = materialize(x.groupBy("__key").agg(F.count("*").alias("__n")), "sizes")
    small = sizes.filter(F.col("__n") <= most).select("__key")
    listed = x.join(small, "__key", "left_semi").withColumn("__bit", F.pmod(F.xxhash64("__item"), F.lit(64)).cast("int")).groupBy("__key")
    listed = listed.agg(F.sort_array(F.collect_list("__item")).alias("__items"), F.sort_array(F.collect_list("__bit")).alias("__bits"))
    mask = lambda bits: F.aggregate(bits, F.lit(0).cast("long"), lambda m, i: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    twice = F.filter("__bits", lambda x, i: (i > 0) & (F.get("__bits", i - 1) == x))
    listed = materialize(listed.select("__key", "__items", mask("__bits").alias("__mask"), mask(twice).alias("__twice"), F.explode("__items").alias("__item")), "listed")
    left, right = (listed.withColumnsRenamed({"__key": n, "__items": f"__{n}", "__mask": f"__{n}m", "__twice": f"__{n}t"}) for n in (a, b))
    common = F.col(f"__{a}m").bitwiseAND(F.col(f"__{b}m"))
    single = (F.bit_count(common) == 1) & (common.bitwiseAND(F.col(f"__{a}t")).bitwiseAND(F.col(f"__{b}t")) == 0)
    both = F.array_intersect(f"__{a}", f"__{b}")
    pairs = left.join(right, "__item").filter((F.col(a) < F.col(b)) & F.when(single, True).otherwise(both[0] == F.col("__item")))
    pairs = pairs.select(a, b, F.when(single, 1).otherwise(F.size(both)).cast("long").alias("shared"))
    large = sizes.filter(F.col("__n") > most).select("__key").withColumn("__large", F.lit(True))
    if large.isEmpty():
        return pairs
    marked = x.join(large, "__key", "left").withColumn("__large", F.col("__large").isNotNull())
    left, right = (marked.withColumnsRenamed({"__key": n, "__large": f"__{n}"}) for n in (a, b))
    met = left.join(right, "__item").filter((F.col(a) < F.col(b)) & (F.col(f"__{a}") | F.col(f"__{b}")))
    return pairs.unionByName(met.groupBy(a, b).agg(F.count("*").alias("shared")))


def either(*conditions: Column) -> Column:
    """A disjunction in which null counts as false."""
    out = F.lit(False)
    for c in conditions:
        out = out | F.coalesce(c, F.lit(False))
    return out
