"""Facts of all documents with the evidence that carries them.

Candidates of a text are arrays of one expression each; a document's metadata are the first of their kind on its
opening pages, a unit's fact takes the evidence of its page or of the nearest page, and of equal facts, told
by their canonical JSON, the first in reading order stays. Every choice is a grouped minimum over one key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import rules
from lodestone.functions.text import collapse, stable_id
from lodestone.operators import joins

# Pages on which metadata are sought, base confidences, and lines that are no title.
METADATA_PAGES = 3
BASE, BASE_DEFINITION = 0.9, 0.8
DEFINITIONS = ("term_definition", "concept_definition")
NO_TITLE = r"^(\||#|---|注:|NOTE|ICS|CCS)|^\d{4}[/_-]|^\d+[/\\]\d+$|^(?i:page)\s+\d+|发布|实施|国家标准"
NO_COMPACT_TITLE = r"^(ICS|CCS|GB/T|GB|ISO|IEC|\d{4}-\d{2}-\d{2})"
PROJECT_CODE = r"([A-Z]{2,}(?:-[A-Z0-9]+){2,}(?:-V\d[\d.]*)?)"
REPLACES = r"代替\s+([A-Z]{1,4}/?[A-Z]*\s*[\d.\-—]+)"
INCLUDES = r"(?is)V2X.+?包括([^。]+)"


def canonical(**fields: Column) -> Column:
    """JSON with sorted keys."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))))


def _fact(kind: str, predicate: str, payload: Column) -> Column:
    return F.struct(F.lit(kind).alias("fact_type"), F.lit(predicate).alias("predicate"), payload.alias("payload"))


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")


def headings(evidence: DataFrame) -> DataFrame:
    """Candidates of marked (`## title`) and numbered (`3.1 title`) headings; of equal titles of a text the first."""
    rows = evidence.select("doc_id", "evidence_id", "page_no", F.posexplode(_lines(F.col("text"))).alias("item", "line"))
    marked = F.startswith("line", F.lit("#"))
    level = F.length(F.regexp_extract("line", "^(#+)", 1))
    number = F.regexp_extract("line", r"^(\d+(?:\.\d+){0,4})\s+(.+)$", 1)
    title = F.trim(F.when(marked, F.regexp_replace("line", "^#+", "")).when(number != "", F.regexp_extract("line", r"^(\d+(?:\.\d+){0,4})\s+(.+)$", 2)))
    found = rows.select("*", title.alias("title"), F.when(marked, level).otherwise(0).alias("level"), F.when(~marked, number).alias("number")).filter("title <> ''")
    first = found.groupBy("doc_id", "evidence_id", "page_no", "title").agg(F.min(F.struct("item", "level", "number")).alias("m"))
    payload = F.when(F.col("m.number").isNull(), canonical(title=collapse("title"), heading_level=F.col("m.level"))).otherwise(canonical(title=collapse("title"), heading_level=F.col("m.level"), section_number=F.col("m.number")))
    return first.select("doc_id", "evidence_id", "page_no", F.col("m.item").alias("item"), _fact("section_heading", "has_section", payload).alias("fact"))


def type_relations(evidence: DataFrame) -> DataFrame:
    """Candidates of the kinds that a text says V2X includes."""
    inner = F.regexp_extract("text", INCLUDES, 1)
    items = F.array_distinct(F.filter(F.transform(F.split(inner, "[、,，；;]"), lambda x: F.trim(F.regexp_replace(x, "(?s)等.*$", ""))), lambda x: x != ""))
    rows = evidence.filter(inner != "").select("doc_id", "evidence_id", "page_no", F.posexplode(items).alias("item", "value"))
    payload = canonical(subject=F.lit("V2X"), item=collapse("value"))
    return rows.select("doc_id", "evidence_id", "page_no", "item", _fact("comparison_relation", "includes_type", payload).alias("fact"))


def metadata(evidence: DataFrame) -> DataFrame:
    """The first title, code, dates and replaced standard of each document on its opening pages."""
    text, lines = F.col("text"), _lines(F.col("text"))
    marked = F.get(F.filter(lines, lambda x: F.startswith(x, F.lit("# "))), F.lit(0))
    plain = F.get(F.filter(lines, lambda x: (F.length(x) >= 4) & ~x.rlike(NO_TITLE) & ~F.regexp_replace(x, r"\s+", "").rlike(NO_COMPACT_TITLE)), F.lit(0))
    title = F.when(marked.isNotNull(), F.trim(F.substring(marked, 3, 1 << 30))).otherwise(F.substring(F.regexp_replace(plain, r"\s{2,}", " "), 1, 120))
    dates = rules.cover_dates(text)
    some = lambda c: F.nullif(c, F.lit(""))
    values = [
        ("document_title", "title", title), ("document_standard", "standard_code", some(F.regexp_extract(F.substring(text, 1, 500), PROJECT_CODE, 1))),
        ("document_lifecycle", "publication_date", dates["published"]), ("document_lifecycle", "effective_date", F.coalesce(dates["effective"], dates["published"])),
        ("document_versioning", "replaces_standard", some(F.trim(F.regexp_extract(text, REPLACES, 1)))),
    ]
    each = F.array(*(F.when(v.isNotNull(), _fact(kind, predicate, canonical(value=collapse(v)))) for kind, predicate, v in values))
    rows = evidence.filter(F.col("page_no") <= METADATA_PAGES).select("doc_id", "evidence_id", "page_no", F.posexplode(each).alias("item", "fact")).filter("fact IS NOT NULL")
    first = rows.groupBy("doc_id", F.col("fact.fact_type").alias("t"), F.col("fact.predicate").alias("p")).agg(F.min(F.struct("page_no", "evidence_id", "item", "fact")).alias("m"))
    return first.select("doc_id", "m.evidence_id", "m.page_no", "m.item", "m.fact")


def unit_evidence(units: DataFrame, evidence: DataFrame) -> DataFrame:
    """`units` (doc_id, page_no, ...) with `evidence_id` and `evidence_page`: the page's last evidence, or else the first of the nearest
    page, ties to the earlier; units of documents without evidence are left out."""
    pages = evidence.groupBy("doc_id", F.col("page_no").alias("p")).agg(F.max("evidence_id").alias("last"), F.min("evidence_id").alias("first"))
    near = pages.select("doc_id", "p", F.struct(F.col("p").alias("page"), "first", "last").alias("near"))
    found = joins.nearest(units, near, "doc_id", "page_no", "p", "near", "near").filter("near IS NOT NULL")
    own = F.col("near.page") == F.col("page_no")
    return found.withColumn("evidence_id", F.when(own, F.col("near.last")).otherwise(F.col("near.first"))).withColumn("evidence_page", F.col("near.page")).drop("near")


def build(evidence: DataFrame, units: DataFrame) -> DataFrame:
    """(fact_id, doc_id, fact_type, predicate, payload, page_no, evidence_id, risk_level, confidence, support_type).

    evidence: doc_id, evidence_id, page_no, confidence, risk_level, text; evidence ids are unique. units: doc_id, unit_no, page_no,
    fact_type, predicate, payload (canonical JSON), base. Equal facts of a document are told by type, predicate and payload; metadata
    come first, then texts in the order of pages, then units. Null texts carry nothing."""
    rank = lambda df, n: df.select("doc_id", "fact.*", F.struct(F.lit(n).alias("rank"), F.col("page_no").cast("long").alias("a"), F.col("evidence_id").cast("long").alias("b"), F.col("item").cast("long").alias("c")).alias("place"), "evidence_id", F.lit(None).cast("double").alias("base"))
    linked = unit_evidence(units, evidence).select(
        "doc_id", "fact_type", "predicate", "payload", F.struct(F.lit(3).alias("rank"), F.col("unit_no").cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("c")).alias("place"), "evidence_id", F.col("base").cast("double").alias("base")
    )
    # In a text all headings come before its relations.
    texts = rank(headings(evidence), 1).unionByName(rank(type_relations(evidence).withColumn("item", F.col("item") + (1 << 30)), 1))
    every = reduce(DataFrame.unionByName, [rank(metadata(evidence), 0), texts, linked])
    first = every.groupBy("doc_id", "fact_type", "predicate", "payload").agg(F.min(F.struct("place", "evidence_id", "base")).alias("m"))
    rows = first.select("doc_id", "fact_type", "predicate", "payload", F.col("m.place.rank").alias("rank"), "m.evidence_id", "m.base")
    of = evidence.select("evidence_id", "page_no", "risk_level", F.col("confidence").alias("__c"))
    base = F.coalesce("base", F.when(F.col("fact_type").isin(*DEFINITIONS), BASE_DEFINITION).otherwise(BASE))
    confidence = F.round(F.greatest(F.lit(0.1), F.least(F.lit(1.0), (base + F.col("__c")) / 2)), 3)
    return rows.join(of, "evidence_id").select(
        stable_id("FACT-", "doc_id", "fact_type", "predicate", "payload").alias("fact_id"), "doc_id", "fact_type", "predicate", "payload", "page_no", "evidence_id", "risk_level",
        confidence.alias("confidence"), F.when(F.col("rank") == 3, "derived").otherwise("direct").alias("support_type"),
    )
