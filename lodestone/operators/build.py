"""The document build: parse, quality, evidence, facts, entities, graph, coverage and acceptance of all documents at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import share_of
from lodestone.operators import knowledge as W
from lodestone.scratch import materialize

#: Stages and how far along each is, in percent.
STAGES = (("parse", 15), ("quality", 30), ("evidence", 45), ("facts", 60), ("entities", 72), ("wiki", 84), ("graph", 94), ("coverage", 98), ("ingestion_acceptance", 99))
PAGE_LINES, LEAST_EVIDENCE = 40, 12


def parsed(documents: DataFrame) -> DataFrame:
    """(doc_id, line_no, page_no, text, kind): the lines that are not blank, each a block of a page of PAGE_LINES lines."""
    lines = documents.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "line"))
    blocks = lines.select("doc_id", (F.col("at") + 1).cast("long").alias("line_no"), (F.floor(F.col("at") / PAGE_LINES) + 1).alias("page_no"), F.trim("line").alias("text")).filter("text <> ''")
    return W.typed_lines(blocks, "text")


def page_quality(blocks: DataFrame) -> DataFrame:
    """(doc_id, page_no, blocks, flags, risk): pages with little text, many symbols, or one block alone."""
    per = blocks.groupBy("doc_id", "page_no").agg(F.count("*").alias("blocks"), F.sum(F.length("text")).alias("chars"), F.sum(F.length("text") * share_of("text", r"^A-Za-z0-9\s")).alias("__symbols"))
    return W.flagged(per, {"thin": F.col("chars") < 60, "symbols": F.col("__symbols") / F.col("chars") > 0.3, "single": F.col("blocks") == 1}).drop("__symbols")


def found_facts(evidence: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(fact_type, doc_id, line_no) of every rule that a piece of evidence meets."""
    kinds = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())))
    return evidence.select("doc_id", "line_no", "text", F.explode(kinds).alias("fact_type"))


def build(documents: DataFrame, rules: dict[str, Column], entity: Column) -> DataFrame:
    """doc_id, pages, blocks, score, evidence, facts, entities, edges, coverage, status of every document.

    `rules` says over a line's `text` which facts it states, and `entity` what it names (null for nothing). Blocks
    are written once, all stages are aggregates of them by document, and a document without text fails."""
    blocks = materialize(parsed(documents), "build-blocks")
    quality = page_quality(blocks).groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum("blocks").alias("blocks"), F.count_if(F.col("risk") == "high").alias("__high"), F.count_if(F.col("risk") == "medium").alias("__medium"))
    evidence = blocks.filter(F.length("text") >= LEAST_EVIDENCE)
    facts = found_facts(evidence, rules)
    per_fact = facts.groupBy("doc_id").agg(F.count("*").alias("facts"), F.countDistinct("line_no").alias("__covered"))
    edges = facts.withColumn("entity", entity).filter("entity is not null").groupBy("doc_id").agg(F.countDistinct("entity").alias("entities"), F.countDistinct("entity", "fact_type").alias("edges"))
    per_evidence = evidence.groupBy("doc_id").agg(F.count("*").alias("evidence"))
    rows = documents.select("doc_id").distinct()
    for part in (quality, per_evidence, per_fact, edges):
        rows = rows.join(part, "doc_id", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    score = F.when(n("pages") == 0, 0.0).otherwise(F.round(1 - (0.5 * n("__high") + 0.2 * n("__medium")) / n("pages"), 6))
    covered = F.when(n("evidence") == 0, 0.0).otherwise(F.round(n("__covered") / n("evidence"), 6))
    status = F.when(n("evidence") == 0, "failed").when((score < 0.6) | (n("facts") == 0), "warn").otherwise("passed")
    return rows.select("doc_id", n("pages").alias("pages"), n("blocks").alias("blocks"), score.alias("score"), n("evidence").alias("evidence"), n("facts").alias("facts"), n("entities").alias("entities"), n("edges").alias("edges"), covered.alias("coverage"), status.alias("status"))
