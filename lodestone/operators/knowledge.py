"""Documents to evidence, facts, entities and coverage, over all documents at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def typed_lines(lines: DataFrame, text: str) -> DataFrame:
    """Lines with `kind`: heading, list, table, code or text."""
    c = F.col(text)
    kind = F.when(c.rlike("^#{1,6} "), "heading").when(c.rlike(r"^([-*+]|[0-9]+[.)]) "), "list").when(F.contains(c, F.lit("|")), "table").when(c.rlike("^(    |\t)"), "code").otherwise("text")
    return lines.withColumn("kind", kind)


def without_repeats(lines: DataFrame, doc: str, line_no: str, text: str) -> DataFrame:
    """The first of each document's equal lines, numbered anew from 1."""
    first = F.row_number().over(Window.partitionBy(doc, text).orderBy(line_no)) == 1
    kept = lines.withColumn("__first", first).filter("__first").drop("__first")
    return kept.withColumn("position", F.row_number().over(Window.partitionBy(doc).orderBy(line_no)))


def merged_wraps(lines: DataFrame, doc: str, line_no: str, text: str) -> DataFrame:
    """(doc, block, n_lines, body): a line that does not end a sentence goes on in the next."""
    w = Window.partitionBy(doc).orderBy(line_no)
    begins = F.coalesce(F.lag(text).over(w).rlike(r"[.!?:;]$"), F.lit(True))
    numbered = lines.withColumn("__b", begins.cast("int")).withColumn("block", F.sum("__b").over(w))
    parts = F.array_sort(F.collect_list(F.struct(line_no, text)))
    return numbered.groupBy(doc, "block").agg(F.count("*").alias("n_lines"), F.array_join(F.transform(parts, lambda x: x[text]), " ").alias("body"))


def flagged(rows: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """`flags`, the names of the conditions that hold, and `risk` by their number: low, medium, high."""
    names = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in flags.items())))
    out = rows.withColumn("__f", names)
    risk = F.when(F.size("__f") >= 2, "high").when(F.size("__f") == 1, "medium").otherwise("low")
    return out.withColumn("flags", F.array_join("__f", ",")).withColumn("risk", risk).drop("__f")


def facts(rules: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Facts of all rules (fact_type added), repeats dropped."""
    return reduce(DataFrame.unionByName, (df.select(F.lit(kind).alias("fact_type"), *keys) for kind, df in rules.items())).distinct()


def entities(mentions: DataFrame, name: str, kind: str, confidence: str, alias: str) -> DataFrame:
    """One entity for each folded name and kind: highest confidence, number of aliases, mentions."""
    return mentions.groupBy(F.lower(F.trim(name)).alias("name"), kind).agg(F.max(confidence).alias("confidence"), F.countDistinct(alias).alias("aliases"), F.count("*").alias("mentions"))


def coverage(units: DataFrame, evidence: DataFrame, tests: DataFrame, key: str) -> DataFrame:
    """Each unit's status: u0 nothing, u1 evidence, u2 tests alone, u3 both."""
    e, s = evidence.select(key).distinct().withColumn("__e", F.lit(True)), tests.select(key).distinct().withColumn("__t", F.lit(True))
    both = units.join(e, key, "left").join(s, key, "left")
    status = F.when(F.col("__e") & F.col("__t"), "u3").when(F.col("__t"), "u2").when(F.col("__e"), "u1").otherwise("u0")
    return both.withColumn("status", status).drop("__e", "__t")


def backfill(facts_: DataFrame, units: DataFrame, doc: str, page: str, unit: str) -> DataFrame:
    """Facts with the unit of their page, else their document's first."""
    same = units.groupBy(doc, page).agg(F.min(unit).alias("__same"))
    first = units.groupBy(doc).agg(F.min(unit).alias("__first"))
    return facts_.join(same, [doc, page], "left").join(first, doc, "left").withColumn(unit, F.coalesce("__same", "__first")).drop("__same", "__first")


def scope_change(old: Column, new: Column) -> Column:
    """new_scope, done, improved (fewer pages, whichever they are), expanded (others among no fewer) or still_open of two sets of pages."""
    return (
        F.when((F.size(old) == 0) & (F.size(new) > 0), "new_scope").when((F.size(old) > 0) & (F.size(new) == 0), "done")
        .when(F.size(new) < F.size(old), "improved").when(F.size(F.array_except(new, old)) > 0, "expanded").otherwise("still_open")
    )


def acceptance(metrics: DataFrame, checks: dict[str, tuple[Column, str]]) -> DataFrame:
    """(check_name, status) of a one-row table of metrics: passed, or the severity given."""
    rows = F.array(*(F.struct(F.lit(n).alias("check_name"), F.when(ok, F.lit("passed")).otherwise(F.lit(bad)).alias("status")) for n, (ok, bad) in checks.items()))
    return metrics.select(F.inline(rows))
