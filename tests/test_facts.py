"""Facts and their evidence: what comes first, what is nearest, what is equal."""

import json

from lodestone.operators import facts


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, evidence_id long, page_no long, confidence double, risk_level string, text string")


NONE = "doc_id long, unit_no long, page_no long, fact_type string, predicate string, payload string, base double"


def test_metadata_are_the_first_of_their_kind_on_opening_pages(spark):
    evidence = frame(spark, [(1, 11, 1, 0.5, "low", "NOTE x\nA title  here\n2021-08-20发布 2022-03-01实施"), (1, 12, 2, 1.0, "low", "# Marked\n代替 GB/T 18487.1—2015"), (1, 13, 4, 1.0, "low", "AB-CD-EF-V1")])
    got = {(r["fact_type"], r["predicate"]): (json.loads(r["payload"])["value"], r["evidence_id"], r["confidence"]) for r in facts.build(evidence, spark.createDataFrame([], NONE)).collect() if "value" in json.loads(r["payload"])}
    assert got == {
        ("document_title", "title"): ("A title here", 11, 0.7), ("document_lifecycle", "publication_date"): ("2021-08-20", 11, 0.7), ("document_lifecycle", "effective_date"): ("2022-03-01", 11, 0.7),
        ("document_versioning", "replaces_standard"): ("GB/T 18487.1—2015", 12, 0.95),
    }


def test_equal_facts_keep_the_first_and_documents_stay_apart(spark):
    evidence = frame(spark, [(1, 11, 5, 0.5, "low", "## Scope\n1.2 Scope\n1.2 Other"), (1, 12, 4, 0.5, "high", "## Scope"), (2, 21, 9, 0.5, "low", "## Scope"), (3, 31, 9, 0.5, "low", None)])
    got = sorted((r["doc_id"], r["payload"], r["evidence_id"]) for r in facts.build(evidence, spark.createDataFrame([], NONE)).collect() if r["fact_type"] == "section_heading")
    scope = '{"heading_level":2,"title":"Scope"}'
    assert got == [(1, '{"heading_level":0,"section_number":"1.2","title":"Other"}', 11), (1, scope, 12), (2, scope, 21)]


def test_units_take_the_evidence_of_their_page_or_the_nearest(spark):
    evidence = frame(spark, [(1, 11, 2, 0.5, "low", ""), (1, 12, 2, 0.9, "low", ""), (1, 13, 6, 0.5, "low", "")])
    units = spark.createDataFrame([(1, n, p, "requirement", "states", f'{{"value":{n}}}', 0.7) for n, p in enumerate([2, 4, 5, 9, -3])] + [(2, 9, 1, "requirement", "states", "{}", 0.7), (1, 7, 9, "requirement", "states", '{"value":0}', 0.7)], NONE)
    got = {json.loads(r["payload"])["value"]: (r["evidence_id"], r["support_type"], r["confidence"]) for r in facts.build(evidence, units).collect() if r["fact_type"] == "requirement"}
    assert got == {0: (12, "derived", 0.8), 1: (11, "derived", 0.6), 2: (13, "derived", 0.6), 3: (13, "derived", 0.6), 4: (11, "derived", 0.6)}
