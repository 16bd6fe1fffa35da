"""Edges of an answer, relation checks, prefixes, identifiers, pages, sentences, dashboard."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import rules as R
from lodestone.operators import graph as G
from lodestone.operators import handlers as H
from lodestone.plans.plan_h_rules import pick, quoted
from lodestone.plans.registry import query
from lodestone.plans.views import Tables

_EDGE = {"src": "concat('S', l_suppkey)", "relation": "l_returnflag", "dst": "concat('P', l_partkey)", "fact_id": "l_orderkey", "doc_id": "l_partkey % 97", "confidence": "l_discount"}


@query(
    "j16_answer_subgraph",
    f"""WITH e AS (SELECT DISTINCT {', '.join(f'{e} AS {n}' for n, e in _EDGE.items())} FROM lineitem), s AS (SELECT *, fact_id IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 450000) AS supported FROM e)
    SELECT src, relation, dst, fact_id, supported FROM (SELECT *, row_number() OVER (ORDER BY supported DESC, confidence DESC, src, dst, relation, fact_id) AS n FROM s WHERE supported OR doc_id IN (3, 5)) WHERE n <= 50""",
)
def j16(t: Tables) -> DataFrame:
    edges = t.lineitem.selectExpr(*(f"{e} AS {n}" for n, e in _EDGE.items())).distinct()
    documents = t.spark.createDataFrame([(3,), (5,)], "doc_id long")
    return G.aligned(edges, t.orders.filter("o_totalprice > 450000").select(F.col("o_orderkey").alias("fact_id")), documents, 50).select("src", "relation", "dst", "fact_id", "supported")


@query(
    "j19_relation_consistency",
    """SELECT a.entity_type AS src_type, e.relation, b.entity_type AS dst_type, count(*) AS n, CASE WHEN a.entity_type IS NULL OR b.entity_type IS NULL THEN 'unknown' WHEN e.relation = 'part_of' OR (e.relation = 'located_in' AND a.entity_type = 'customer') THEN 'consistent' ELSE 'mismatch' END AS status
    FROM v_edges e LEFT JOIN v_entities a ON e.src = a.entity_id LEFT JOIN v_entities b ON e.dst = b.entity_id GROUP BY ALL""",
)
def j19(t: Tables) -> DataFrame:
    return G.relation_checks(t.v_edges, t.v_entities, "entity_id", "entity_type", [("nation", "part_of", "region"), ("customer", "located_in", "nation")])


@query(
    "j22_prefix_backoff",
    """WITH w AS (SELECT p_partkey, p_type || substr(p_name, 1, 3) AS w FROM part), n AS (SELECT DISTINCT concat(substr(p_type, 1, 4), p_brand) AS n FROM part), m AS (SELECT p_partkey, k, substr(w, 1, CAST(k AS INTEGER)) AS prefix FROM (SELECT p_partkey, w, unnest(generate_series(2, length(w))) AS k FROM w)),
    c AS (SELECT p_partkey, m.prefix, count(n) AS hits FROM (SELECT DISTINCT p_partkey, prefix FROM m) m JOIN n ON starts_with(n, m.prefix) GROUP BY 1, 2) SELECT p_partkey, arg_max(prefix, length(prefix)) AS prefix, arg_max(hits, length(prefix)) AS hits FROM c GROUP BY 1""",
)
def j22(t: Tables) -> DataFrame:
    words = t.part.select("p_partkey", F.concat("p_type", F.substring("p_name", 1, 3)).alias("w"))
    return H.longest_prefixes(words, "p_partkey", "w", t.part.select(F.concat(F.substring("p_type", 1, 4), "p_brand").alias("n")), "n")


@query("j23_identifier_points", "WITH n AS (SELECT p_partkey, lower(concat('service_', p_type, '_', p_name)) AS s FROM part), p AS (SELECT p_partkey, CASE WHEN contains(s, 'service_economy') THEN 15 ELSE 0 END + CASE WHEN contains(s, 'ring') THEN 4 ELSE 0 END + CASE WHEN contains(s, 'widget') THEN 6 ELSE 0 END AS p FROM n) SELECT p_partkey, CAST(CASE WHEN p >= 5 THEN p ELSE 0 END AS INTEGER) AS points FROM p")
def j23(t: Tables) -> DataFrame:
    name = F.concat(F.lit("service_"), "p_type", F.lit("_"), "p_name")
    return t.part.select("p_partkey", R.identifier_points("what is Service_Economy of a ring, widget and ab", name).cast("int").alias("points"))


@query(
    "k15_entity_pages",
    """WITH f AS (SELECT DISTINCT s_suppkey, CASE WHEN l_returnflag = 'R' THEN 'requirement' WHEN l_returnflag = 'A' THEN 'definition' ELSE 'other' END AS kind, l_orderkey AS rank, concat('order ', l_orderkey) AS text FROM supplier JOIN lineitem ON s_suppkey = l_suppkey),
    t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s_suppkey, kind ORDER BY rank, text) AS n FROM f) WHERE n <= 5 AND kind <> 'other'), b AS (SELECT s_suppkey, kind, string_agg('- ' || text, chr(10) ORDER BY rank, text) AS body FROM t GROUP BY 1, 2),
    p AS (SELECT s_suppkey, string_agg(CASE kind WHEN 'definition' THEN '## Definitions' ELSE '## Requirements' END || chr(10) || body, chr(10) ORDER BY kind) AS sections FROM b GROUP BY 1)
    SELECT s.s_suppkey, concat_ws(chr(10), '# ' || s_name, 'type: supplier', sections) AS page FROM supplier s LEFT JOIN p ON s.s_suppkey = p.s_suppkey WHERE s.s_suppkey % 6 <> 0""",
)
def k15(t: Tables) -> DataFrame:
    entities = t.supplier.select("s_suppkey", F.col("s_name").alias("name"), F.lit("supplier").alias("entity_type"), F.when(F.col("s_suppkey") % 6 == 0, "stale").otherwise("ready").alias("status"))
    kind = F.when(F.col("l_returnflag") == "R", "requirement").when(F.col("l_returnflag") == "A", "definition").otherwise("other")
    facts = t.lineitem.select(F.col("l_suppkey").alias("s_suppkey"), kind.alias("fact_type"), F.col("l_orderkey").alias("rank"), F.concat(F.lit("order "), "l_orderkey").alias("text"))
    return H.entity_pages(entities, facts, "s_suppkey", {"definition": "Definitions", "requirement": "Requirements"}, 5)


_SAID = f"concat(p_name, ' must hold; ', p_type, '。', {pick('p_partkey', quoted('电压不得超过 5 V'), quoted('no rule'), quoted('It SHALL stop；  '), quoted(''))}, chr(10), ' end ')"


@query("o02_rows_to_rows", f"SELECT p_partkey, s FROM (SELECT p_partkey, unnest([concat(p_name, ' must hold'), {pick('p_partkey', quoted('电压不得超过 5 V'), 'NULL', quoted('It SHALL stop'), 'NULL')}]) AS s FROM part) WHERE s IS NOT NULL")
def o02(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.explode(R.requirement_sentences(F.expr(_SAID))).alias("s"))


@query("q02_document_dashboard", "SELECT d.doc_id, (SELECT count(*) FROM v_evidence e WHERE e.doc_id = d.doc_id) AS evidence, (SELECT count(*) FROM labels l WHERE l.doc_id = d.doc_id) AS labels, (SELECT count(*) FROM v_evidence e WHERE e.doc_id = d.doc_id AND contains(e.normalized_text, 'icense')) AS facts FROM documents d")
def q02(t: Tables) -> DataFrame:
    return H.dashboard(t.documents, {"evidence": t.v_evidence, "labels": t.labels, "facts": t.v_evidence.filter(F.contains("normalized_text", F.lit("icense")))}, "doc_id")


_CANDIDATE = "CASE (s_suppkey + s_nationkey) % 4 WHEN 0 THEN s_name WHEN 1 THEN concat('in ', n_name, ': ', s_name) WHEN 2 THEN 'nothing known' ELSE concat(n_name, ' only') END"
_ASKED = "CASE n_nationkey % 5 WHEN 4 THEN 'what is new?' ELSE concat('who delivers from ', lower(n_name), '?') END"


@query(
    "j20_loss_report",
    f"""WITH q AS (SELECT n_nationkey AS question_id, lower({_ASKED}) AS t FROM nation), c AS (SELECT (s_nationkey + 3) % 25 AS question_id, s_suppkey AS candidate_id, lower({_CANDIDATE}) AS t FROM supplier JOIN nation ON n_nationkey = s_nationkey),
    a AS (SELECT DISTINCT question_id, entity_type FROM q JOIN v_entities ON contains(t, lower(canonical_name))), k AS (SELECT question_id, string_agg(entity_type, ',' ORDER BY entity_type) AS classes FROM a GROUP BY 1),
    m AS (SELECT DISTINCT c.question_id, candidate_id, entity_type FROM c JOIN v_entities ON contains(t, lower(canonical_name))),
    w AS (SELECT candidate_id, bool_or(a.entity_type IS NOT NULL) AS own, bool_or(a.entity_type IS NULL) AS other FROM m LEFT JOIN a ON a.question_id = m.question_id AND a.entity_type = m.entity_type GROUP BY 1),
    p AS (SELECT question_id, count(*) AS total, count(*) FILTER (other AND NOT own) AS dropped, count(*) FILTER (own IS NULL) AS lost FROM c LEFT JOIN w USING (candidate_id) GROUP BY 1)
    SELECT question_id, classes, coalesce(total, 0) AS total, CASE WHEN total IS NULL OR classes IS NULL THEN 0 ELSE dropped END AS dropped, coalesce(total, 0) - CASE WHEN total IS NULL OR classes IS NULL THEN 0 ELSE dropped END AS kept,
      CASE WHEN total IS NULL OR classes IS NULL THEN 0 ELSE lost END AS lost, CASE WHEN total IS NULL THEN 'no_candidates' WHEN classes IS NULL THEN 'query_has_no_known_entity_class' ELSE 'projected' END AS reason
    FROM q LEFT JOIN k USING (question_id) LEFT JOIN p USING (question_id)""",
)
def j20(t: Tables) -> DataFrame:
    """Suppliers as candidates of the questions about nations; names of all entities as surfaces of their types."""
    questions = t.nation.selectExpr("n_nationkey AS question_id", f"{_ASKED} AS question")
    candidates = t.supplier.join(t.nation, F.col("n_nationkey") == F.col("s_nationkey")).selectExpr("(s_nationkey + 3) % 25 AS question_id", "s_suppkey AS candidate_id", f"{_CANDIDATE} AS text")
    return G.type_report(questions, candidates, t.v_entities.select(F.col("canonical_name").alias("surface"), F.col("entity_type").alias("class_id")))
