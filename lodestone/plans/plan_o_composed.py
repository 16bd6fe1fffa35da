"""Operators that put others together."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import build as B
from lodestone.operators import handlers as H
from lodestone.operators import ranking, reranking
from lodestone.plans import plan_i_rerank as P
from lodestone.plans.plan_h_rules import pick, quoted
from lodestone.plans.registry import query
from lodestone.plans.views import Tables

_RULES = {"license": "contains(text, 'icense')", "contact": "contains(text, '@')", "table": "contains(text, '|')", "shout": "contains(text, '!!')"}
_ENTITY = r"lower(nullif(regexp_extract(text, '[A-Za-z]{4,}', 0), ''))"


@query(
    "k01_document_build",
    f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
    b AS (SELECT doc_id, line_no, (line_no - 1) // 40 + 1 AS page_no, trim(line) AS text FROM l WHERE trim(line) <> ''),
    p AS (SELECT doc_id, page_no, count(*) AS blocks, sum(length(text)) AS chars, sum(length(text) - length(regexp_replace(text, '[^A-Za-z0-9\\s]', '', 'g'))) AS symbols FROM b GROUP BY 1, 2),
    f AS (SELECT *, CAST(chars < 60 AS INTEGER) + CAST(symbols / chars > 0.3 AS INTEGER) + CAST(blocks = 1 AS INTEGER) AS flags FROM p),
    q AS (SELECT doc_id, count(*) AS pages, sum(blocks) AS blocks, count(*) FILTER (flags >= 2) AS high, count(*) FILTER (flags = 1) AS medium FROM f GROUP BY 1),
    e AS (SELECT * FROM b WHERE length(text) >= 12), x AS (SELECT e.*, k.kind FROM e, (VALUES {', '.join(f"('{k}')" for k in _RULES)}) k(kind) WHERE CASE k.kind {' '.join(f"WHEN '{k}' THEN {c}" for k, c in _RULES.items())} END),
    g AS (SELECT doc_id, count(*) AS facts, count(DISTINCT line_no) AS covered, count(DISTINCT {_ENTITY}) AS entities, count(DISTINCT {_ENTITY} || kind) AS edges FROM x GROUP BY 1), v AS (SELECT doc_id, count(*) AS evidence FROM e GROUP BY 1),
    r AS (SELECT d.doc_id, coalesce(pages, 0) AS pages, CAST(coalesce(blocks, 0) AS BIGINT) AS blocks, CASE WHEN pages IS NULL THEN 0 ELSE round(1 - (0.5 * high + 0.2 * medium) / pages, 6) END AS score, coalesce(evidence, 0) AS evidence, coalesce(facts, 0) AS facts, coalesce(entities, 0) AS entities, coalesce(edges, 0) AS edges,
      CASE WHEN evidence IS NULL THEN 0 ELSE round(coalesce(covered, 0) / evidence, 6) END AS coverage FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN q USING (doc_id) LEFT JOIN v USING (doc_id) LEFT JOIN g USING (doc_id))
    SELECT doc_id, pages, blocks, CAST(score AS DOUBLE) AS score, evidence, facts, entities, edges, CAST(coverage AS DOUBLE) AS coverage, CASE WHEN evidence = 0 THEN 'failed' WHEN score < 0.6 OR facts = 0 THEN 'warn' ELSE 'passed' END AS status FROM r""",
)
def k01(t: Tables) -> DataFrame:
    has = lambda w: F.contains("text", F.lit(w))
    rules = {"license": has("icense"), "contact": has("@"), "table": has("|"), "shout": has("!!")}
    return B.build(t.documents, rules, F.lower(F.nullif(F.regexp_extract("text", "[A-Za-z]{4,}", 0), F.lit(""))))


_EAV = {
    "entity": "concat('E', p_size)", "attribute_name": pick("p_partkey", "'充电电压上限'", "'工作温度范围'", "'title'", "'service_x'", "'电压'", "'输出电流'", "'供电电压源'"),
    "value_text": pick("p_partkey", "''", "p_name", "NULL"), "value_num": "CAST(p_partkey % 90 AS INTEGER)", "value_unit": pick("p_partkey", "'V'", "NULL"),
}
_EAV_ROWS = "SELECT DISTINCT " + ", ".join(f"{e} AS {n}" for n, e in _EAV.items()) + " FROM part"


def _points(q: str) -> str:
    import re

    return " + ".join(f"CAST(contains(attribute_name, '{c}') AS INTEGER)" for w in re.findall("[一-鿿]{2,8}", q) for c in w)


_SHOWN = "attribute_name || coalesce(CASE WHEN value_text <> '' THEN ' = ' || value_text WHEN value_unit IS NOT NULL THEN ' = ' || value_num || ' ' || value_unit END, '')"


@query(
    "j21_attribute_answers",
    f"""WITH a AS ({_EAV_ROWS}), s AS (SELECT *, {_SHOWN} AS shown FROM a WHERE attribute_name <> 'title' AND NOT starts_with(attribute_name, 'service_'))
    SELECT 'list' AS kind, entity, attribute_name, CAST({_points('有哪些电压源')} AS INTEGER) AS points, shown FROM s WHERE {_points('有哪些电压源')} >= 2
    UNION ALL SELECT 'one', entity, attribute_name, points, shown FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY points DESC, attribute_name, shown) AS n FROM (SELECT *, CAST({_points('工作温度')} AS INTEGER) AS points FROM s) WHERE points > 0) WHERE n <= 1""",
)
def j21(t: Tables) -> DataFrame:
    table = t.part.selectExpr(*(f"{e} AS {n}" for n, e in _EAV.items())).distinct()
    columns = ["entity", "attribute_name", F.col("points").cast("int").alias("points"), "shown"]
    listed = H.attributes(table, "有哪些电压源").select(F.lit("list").alias("kind"), *columns)
    return listed.unionByName(H.attributes(table, "工作温度").select(F.lit("one").alias("kind"), *columns))


_CASE = {
    "case_id": "o_orderkey", "query_type": pick("o_orderkey", "'definition'", "'constraint'", "'scope'"), "expected_query_type": pick("o_custkey", "'definition'", "'constraint'", "NULL"),
    "clarification": "o_orderkey % 5 = 0", "expected_clarification": pick("o_custkey", "true", "false", "NULL", "false"), "graph_candidates": pick("o_orderkey", "0", "3", "NULL"), "expected_graph_candidates": pick("o_custkey", "1", "NULL"),
    "entity": "o_orderpriority", "expected_entity": pick("o_custkey", "'URGENT'", "''", "'LOW'", "NULL"), "expected_doc_id": pick("o_custkey", "'D1'", "NULL", "'D7'"),
}
_IDS = "concat('D', o_orderkey % 9), concat('D', o_custkey % 4), 'D8'"


@query(
    "m15_contract_cases",
    f"""WITH c AS (SELECT {', '.join(f'{e} AS {n}' for n, e in _CASE.items())}, [{_IDS}] AS ids FROM orders)
    SELECT case_id, concat_ws(',', CASE WHEN expected_query_type <> query_type THEN 'query_type_mismatch' END, CASE WHEN expected_clarification <> clarification THEN 'clarification_requirement_mismatch' END, CASE WHEN NOT clarification AND coalesce(graph_candidates, 0) < expected_graph_candidates THEN 'graph_missing' END,
      CASE WHEN expected_entity <> '' AND NOT contains(entity, expected_entity) THEN 'topic_resolution_wrong' END, CASE WHEN NOT list_contains(ids, expected_doc_id) THEN 'expected_doc_missing' END, CASE WHEN list_contains(ids, 'D3') THEN 'forbidden_result_hit' END) AS failures FROM c""",
)
def m15(t: Tables) -> DataFrame:
    ids = F.expr(f"array({_IDS})")
    cases = t.orders.selectExpr(*(f"{e} AS {n}" for n, e in _CASE.items()), "o_orderkey", "o_custkey").withColumns({"doc_ids": ids, "result_ids": ids, "forbidden_ids": F.array(F.lit("D3"))})
    return H.contract_failures(cases).select("case_id", F.array_join("failures", ",").alias("failures"))


@query(
    "l15_rendered_answers",
    """WITH s AS (SELECT c_custkey, x.priority, x.layer, x.text, x.effect FROM customer, (VALUES (500, 'project', 1), (100, 'base', 2), (200, 'customer', 3)) v(priority, layer, k), LATERAL (SELECT v.priority, v.layer, concat('U <= ', CAST(c_nationkey + v.k AS VARCHAR)) AS text, CASE WHEN v.k = 2 THEN 'baseline' ELSE 'override' END AS effect) x WHERE (c_custkey + v.k) % 4 <> 0)
    SELECT c_custkey, concat_ws(chr(10), '最终有效需求：' || coalesce(any_value(c_mktsegment), ''), '项目：' || c_custkey, '冲突状态：none', '证据状态：', '解析路径：' || chr(10) || string_agg('- ' || layer || ': ' || text || ' (' || effect || ')', chr(10) ORDER BY priority, layer)) AS answer FROM customer LEFT JOIN s USING (c_custkey) GROUP BY c_custkey""",
)
def l15(t: Tables) -> DataFrame:
    layers = F.array(*(F.struct(F.lit(p).alias("priority"), F.lit(n).alias("layer"), F.lit(k).alias("k")) for p, n, k in ((500, "project", 1), (100, "base", 2), (200, "customer", 3))))
    steps = t.customer.select("c_custkey", "c_nationkey", F.inline(layers)).filter((F.col("c_custkey") + F.col("k")) % 4 != 0)
    steps = steps.select("c_custkey", "priority", "layer", F.concat(F.lit("U <= "), (F.col("c_nationkey") + F.col("k")).cast("string")).alias("text"), F.when(F.col("k") == 2, "baseline").otherwise("override").alias("effect"))
    effective = t.customer.select("c_custkey", F.col("c_mktsegment").alias("text"), F.lit("none").alias("conflict"), F.lit(None).cast("string").alias("verification"))
    return H.rendered(effective, steps, "c_custkey")


@query("o01_row_helpers", "SELECT query_id, count(*) AS n, round(sum(lexical), 6) AS lexical, round(sum(alignment), 6) AS alignment FROM (" + P.per_question(lambda q: P._rounded(q, "lexical", "alignment")) + ") GROUP BY 1")
def o01(t: Tables) -> DataFrame:
    """Row-level helpers are columns: their sums come from one pass."""
    parts = reranking.components()
    rows = P.candidates(t).select("query_id", F.round(parts["lexical"], 6).alias("lexical"), F.round(parts["alignment"], 6).alias("alignment"))
    return rows.groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.sum("lexical"), 6).alias("lexical"), F.round(F.sum("alignment"), 6).alias("alignment"))


@query("o03_ordered_folds", "SELECT user_id, event_id, last_value(CASE WHEN event_type IN ('signup', 'purchase') THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS state FROM events")
def o03(t: Tables) -> DataFrame:
    """A fold whose state is the last mark seen is a window."""
    mark = F.when(F.col("event_type").isin("signup", "purchase"), F.col("event_type"))
    return ranking.carried(t.events, "user_id", ["ts", "event_id"], mark, "state").select("user_id", "event_id", "state")


_ASKED = pick("p_partkey", "'CP PWM 9V 是什么意思'", "'控制导引的时序'", "'时序如何'", "'检测点 1 的电压'", "'充电有哪些要求'", "'OBC 是什么意思'", "p_name", "'PWM 9V'")


@query("o05_rule_fallbacks", "SELECT p_partkey, " + pick("p_partkey", *(quoted(x) for x in ("signal_state_explanation,parameter_meaning,table_lookup", "timing_lookup,process_lookup,state_transition_lookup", "general_search", "parameter_meaning,parameter_value,table_lookup", "requirement_lookup,constraint_lookup", "term_definition,definition", "general_search", "general_search"))) + " AS intents, " + pick("p_partkey", *(quoted(x) for x in ("explain_state_meaning", "process_or_timing", "freeform", "parameter_explanation", "requirement_set", "definition", "freeform", "freeform"))) + " AS shape FROM part")
def o05(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", H.expansion(F.expr(_ASKED)).alias("x")).select("p_partkey", F.array_join("x.intents", ",").alias("intents"), F.col("x.shape").alias("shape"))
