"""standards' facts, topics, envelopes, candidates and an appended log."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import catalogue as C
from lodestone.plans.plan_h_rules import pick, quoted
from lodestone.plans.registry import query
from lodestone.plans.views import Tables
from lodestone.scratch import scratch_path

_FACT = {"fact_id": "concat('F', p_partkey)", "doc_id": "p_size", "fact_type": pick("p_partkey", "'document_standard'", "'document_lifecycle'", "'document_versioning'", "'term_definition'"), "value": pick("p_size", "'GB/T 18487.1-2015'", "'gbt 18487.1'", "'ISO 14229-1'", "'GB/T 18487.10'", "NULL")}


@query(
    "i22_standard_facts",
    f"""WITH f AS (SELECT {', '.join(f'{e} AS {n}' for n, e in _FACT.items())} FROM part), m AS (SELECT 1 AS query_id, fact_id, doc_id FROM f WHERE fact_type = 'document_standard' AND doc_id % 5 IN (0, 1) UNION ALL SELECT 2, fact_id, doc_id FROM f WHERE fact_type = 'document_standard' AND doc_id % 5 = 2)
    SELECT query_id, fact_id FROM m UNION SELECT m.query_id, f.fact_id FROM f JOIN m ON f.doc_id = m.doc_id WHERE fact_type IN ('document_lifecycle', 'document_versioning')""",
)
def i22(t: Tables) -> DataFrame:
    asked = t.spark.createDataFrame([(1, "GBT 18487.1"), (2, "iso 14229"), (3, None), (4, "GB/T 1")], "query_id int, code string")
    return C.standard_context(t.part.selectExpr(*(f"{e} AS {n}" for n, e in _FACT.items())), asked)


_TOPICS = [(1, ["GERMANY", "ger"]), (2, ["customer 000000012", "00001"]), (3, ["united"]), (4, ["no such thing"])]
_COMPACT = r"upper(regexp_replace({}, '[\s\-_+/·:：;；,，.。()（）]+', '', 'g'))"


def _points(term: str) -> str:
    import re

    flat = re.sub(r"[\s\-_+/·:：;；,，.。()（）]+", "", term).upper()
    c = _COMPACT.format("canonical_name")
    return f"CASE WHEN canonical_name = {quoted(term)} OR {c} = {quoted(flat)} THEN 6.0 WHEN contains(upper(canonical_name), {quoted(term.upper())}) THEN 3.0 WHEN contains({c}, {quoted(flat)}) THEN 2.5 ELSE 0 END"


@query(
    "i30_topic_resolution",
    "WITH s AS (" + " UNION ALL ".join(f"SELECT {i} AS query_id, entity_id, canonical_name, CAST({' + '.join(map(_points, terms))} AS DOUBLE) AS score FROM v_entities" for i, terms in _TOPICS) + """), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, canonical_name, entity_id) AS n, max(score) OVER (PARTITION BY query_id) AS top FROM s WHERE score > 0)
    SELECT query_id, entity_id, canonical_name, score, CAST(CASE WHEN top >= 9 THEN 0.95 WHEN top >= 6 THEN 0.82 WHEN top >= 3 THEN 0.55 ELSE 0.35 END AS DOUBLE) AS confidence FROM r WHERE n <= 8""",
)
def i30(t: Tables) -> DataFrame:
    return C.topic_entities(t.v_entities, _TOPICS).select("query_id", "entity_id", "canonical_name", "score", "confidence")


@query(
    "i32_subgraph_envelope",
    """WITH i AS (SELECT user_id, CASE event_type WHEN 'view' THEN 'fact' WHEN 'click' THEN 'edge' WHEN 'purchase' THEN 'wiki' ELSE 'other' END AS kind, value AS rank, event_id AS id FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY user_id, kind ORDER BY rank, id) AS n FROM i)
    SELECT user_id, count(*) FILTER (kind = 'fact') AS fact_count, count(*) FILTER (kind = 'edge') AS edge_count, count(*) FILTER (kind = 'wiki') AS wiki_count, coalesce(string_agg(id::VARCHAR, ',' ORDER BY rank, id) FILTER (kind = 'fact' AND n <= 8), '') AS fact_ids, coalesce(string_agg(id::VARCHAR, ',' ORDER BY rank, id) FILTER (kind = 'edge' AND n <= 3), '') AS edge_ids, coalesce(string_agg(id::VARCHAR, ',' ORDER BY rank, id) FILTER (kind = 'wiki' AND n <= 2), '') AS wiki_ids FROM n GROUP BY 1""",
)
def i32(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "fact").when(F.col("event_type") == "click", "edge").when(F.col("event_type") == "purchase", "wiki").otherwise("other")
    items = t.events.select("user_id", kind.alias("kind"), F.col("value").alias("rank"), F.col("event_id").alias("id"))
    return C.envelopes(items, "user_id", {"fact": 8, "edge": 3, "wiki": 2})


_SAID = f"concat({pick('p_partkey', quoted('输出纹波应不超过'), quoted('Efficiency '), quoted('the unit must hold '), quoted('plain '), quoted('sleep current ≤ '))}, {pick('p_size', 'CAST(p_size AS STRING)', quoted('some'), quoted('5'))}, {pick('p_partkey', quoted(' mV'), quoted(' %'), quoted(' V'), quoted(' A'), quoted('毫安'))}, '。 ; next line')"


@query(
    "l11_candidates",
    f"""WITH r AS (SELECT p_partkey, {pick('p_size', "'E'", 'NULL')} AS evidence, regexp_split_to_array({_SAID}, '[\\n。；;]+')[1] AS sentence, p_partkey % 5 AS k, CASE p_size % 3 WHEN 0 THEN p_size WHEN 2 THEN 5 END AS value FROM part)
    SELECT p_partkey, 1 AS place, sentence, CASE k WHEN 0 THEN 'REQATOM-DCDC-OUTPUT-RIPPLE' WHEN 1 THEN 'REQATOM-DCDC-EFFICIENCY' WHEN 4 THEN 'REQATOM-DCDC-SLEEP-CURRENT' END AS atom_id, CASE WHEN k IN (0, 4) THEN '<=' END AS operator, CAST(value AS DOUBLE) AS value,
      CASE WHEN value IS NOT NULL THEN CASE k WHEN 0 THEN 'mV' WHEN 1 THEN '%' WHEN 2 THEN 'V' ELSE 'mA' END END AS unit, round(CAST(least(0.95, 0.45 + CASE WHEN k IN (0, 1, 4) THEN 0.25 ELSE 0 END + CASE WHEN value IS NOT NULL THEN 0.25 ELSE 0 END + CASE WHEN evidence IS NOT NULL THEN 0.1 ELSE 0 END) AS DOUBLE), 3) AS confidence
    FROM r WHERE k IN (0, 1, 4) OR (k = 2 AND value IS NOT NULL)""",
)
def l11(t: Tables) -> DataFrame:
    rows = t.part.selectExpr("p_partkey", f"{_SAID} AS text", f"{pick('p_size', quoted('E'), 'NULL')} AS evidence")
    return C.requirement_candidates(rows, "p_partkey", "text", "evidence")


@query("m06_run_log", "SELECT suite_id, code_version, count(*) AS runs, count(*) FILTER (passed = 1) AS passed, max(started_at) AS last_run FROM v_runs GROUP BY 1, 2")
def m06(t: Tables) -> DataFrame:
    """Runs are appended in two batches, each with its summary as a struct, and read back as one log."""
    path = scratch_path(t.spark, "runs")
    rows = t.v_runs.select("suite_id", "code_version", "started_at", F.struct(F.col("passed").alias("passed"), F.col("score").alias("score")).alias("summary"), "run_id")
    for part in (0, 1):
        rows.filter(F.pmod("run_id", F.lit(2)) == part).write.mode("append").parquet(path)
    log = t.spark.read.schema(rows.schema).parquet(path)
    return log.groupBy("suite_id", "code_version").agg(F.count("*").alias("runs"), F.count_if(F.col("summary.passed") == 1).alias("passed"), F.max("started_at").alias("last_run"))
