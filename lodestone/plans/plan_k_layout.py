"""Structure, scopes, quality and evaluation rules."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import evaluation as E
from lodestone.operators import layout as L
from lodestone.plans.plan_h_rules import pick, quoted
from lodestone.plans.plan_m_evaluation import M01_SQL, m01
from lodestone.plans.registry import query
from lodestone.plans.views import Tables

_NL = "chr(10)"
_BLOCK = f"concat('intro ', p_name, {_NL}, {_NL}, {_NL}, {_NL}, {pick('p_partkey', quoted('4.2 head'), quoted('附录 A x'), quoted('plain'))}, {_NL}, '## mark', {_NL}, ' ', {_NL}, 'body', {_NL}, '<TABLE><tr><td>', {_NL}, {_NL}, 'c</td></tr></TABLE>', {_NL}, '# end')"


@query(
    "k03_segments",
    f"""SELECT p_partkey, unnest([1, 2, 3, 4, 5, 6]) AS place, unnest(['paragraph', CASE WHEN p_partkey % 3 = 2 THEN 'paragraph' ELSE 'heading' END, 'heading', 'paragraph', 'table', 'heading']) AS type,
    unnest(['intro ' || p_name, {pick('p_partkey', quoted('4.2 head'), quoted('附录 A x'), quoted('plain'))}, '## mark', 'body', '<TABLE><tr><td>' || chr(10) || chr(10) || 'c</td></tr></TABLE>', '# end']) AS text FROM part""",
)
def k03(t: Tables) -> DataFrame:
    return L.segments(t.part.selectExpr("p_partkey", f"{_BLOCK} AS text"), "p_partkey", "text")


_HEADS = (("heading", "## 4.2.1 要求", 2, "4.2.1"), ("heading", "总则", 2, None), ("paragraph", "5.1 试验方法", 2, "5.1"), ("paragraph", "附录 B 图", 1, None), ("paragraph", "正文没有编号", None, None), ("heading", "3 术语", 1, "3"), ("paragraph", "  ", None, None), ("heading", "####### B.2 深", 6, "B.2"))
_BLOCKS = {"doc_id": "p_size", "page_no": "p_partkey % 5", "reading_order": "p_partkey % 3", "block_id": "p_partkey", "type": pick("p_partkey", *(quoted(a) for a, *_ in _HEADS)), "text": pick("p_partkey", *(quoted(b) for _, b, *_ in _HEADS))}


@query(
    "k04_sections",
    f"""WITH b AS (SELECT {', '.join(f'{e} AS {n}' for n, e in _BLOCKS.items())}, {pick('p_partkey', *('NULL' if v is None else str(v) for _, _, v, _ in _HEADS))} AS level, {pick('p_partkey', *('NULL' if v is None else quoted(v) for *_, v in _HEADS))} AS section_number FROM part)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_no, reading_order, block_id) AS INTEGER) AS place, block_id, trim(text) AS title, CAST(level AS INTEGER) AS level, section_number FROM b WHERE level IS NOT NULL""",
)
def k04(t: Tables) -> DataFrame:
    return L.sections(t.part.selectExpr(*(f"{e} AS {n}" for n, e in _BLOCKS.items())))


_TITLE, _ROW = pick("p_partkey", "'表 A.1 CP 参数'", "'车辆插头 检测点1'", "NULL", "'cc2 控制导引'"), pick("p_size", "'CC1 等效电阻'", "'充电机 r4c'''", "'电压'", "'检测点2 CP'", "''")


def _tags(where: str) -> str:
    return f"array_to_string(list_filter([{quoted(*L.SIGNALS, *L.PLACES)}], lambda x: {where}), ',')"


@query(
    "k12_parameter_scope",
    f"""WITH r AS (SELECT p_partkey, upper(coalesce({_TITLE}, '')) AS t, upper({_ROW}) AS r FROM part), g AS (SELECT *, {_tags('contains(r, x) OR contains(t, x)')} AS tags, {_tags('contains(r, x)')} AS in_row, {_tags('NOT contains(r, x) AND contains(t, x)')} AS in_table FROM r)
    SELECT p_partkey, tags, in_row, in_table, CASE WHEN regexp_matches(tags, 'CC1|CC2') THEN 'cc' WHEN regexp_matches(tags, '(^|,)CP(,|$)') THEN 'cp' ELSE 'general' END AS loop_scope, CASE WHEN in_row <> '' THEN 'row' WHEN in_table <> '' THEN 'table' ELSE 'none' END AS confidence FROM g""",
)
def k12(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", L.parameter_scope(F.lit(None).cast("string"), F.expr(_TITLE), F.expr(_ROW)).alias("s"))
    text = lambda c, n: F.array_join(f"s.{c}", ",").alias(n)
    return rows.select("p_partkey", text("focus_tags", "tags"), text("row_focus_tags", "in_row"), text("table_focus_tags", "in_table"), F.col("s.loop_scope").alias("loop_scope"), F.col("s.scope_confidence").alias("confidence"))


_NAMED = pick("s_suppkey", "s_name", "'12 PUBLIC'", "'Base  Practices'", "'过程参考模型 x'", "concat('--- Page ', s_suppkey)", "s_name", "s_name", "'vda QMC'")


@query(
    "k14_entity_quarantine",
    f"""WITH e AS (SELECT concat('S', s_suppkey) AS id, {_NAMED} AS name FROM supplier), b AS (SELECT id FROM e WHERE substr(id, 2)::BIGINT % 8 IN (1, 2, 3, 4, 7))
    SELECT 'entities' AS part, count(*) FILTER (id IN (SELECT id FROM b)) AS changed, count(*) AS n FROM e
    UNION ALL SELECT 'facts', count(*) FILTER (concat('S', l_suppkey) IN (SELECT id FROM b)), count(*) FROM lineitem
    UNION ALL SELECT 'edges', (SELECT count(*) FROM v_edges) - count(*), count(*) FROM v_edges WHERE src NOT IN (SELECT id FROM b) AND dst NOT IN (SELECT id FROM b)""",
)
def k14(t: Tables) -> DataFrame:
    entities = t.supplier.selectExpr("concat('S', s_suppkey) AS entity_id", f"{_NAMED} AS canonical_name", "'ready' AS entity_status")
    facts = t.lineitem.selectExpr("concat('S', l_suppkey) AS subject_id", "concat('P', l_partkey) AS object_id")
    e, f, g = L.quarantined(entities, facts, t.v_edges)
    count = lambda df, name, changed: df.agg(changed.alias("changed"), F.count("*").alias("n")).select(F.lit(name).alias("part"), "changed", "n")
    before = t.v_edges.agg(F.count("*").alias("before"))
    left = g.agg(F.count("*").alias("n")).crossJoin(before).select(F.lit("edges").alias("part"), (F.col("before") - F.col("n")).alias("changed"), "n")  # one row each
    return count(e, "entities", F.count_if(F.col("entity_status") == "stale")).unionByName(count(f, "facts", F.count_if(F.col("subject_id").isNull()))).unionByName(left)


@query("k18_unit_links", "SELECT DISTINCT l_orderkey, x.kind, x.id FROM lineitem, LATERAL (VALUES ('fact', CAST(l_partkey AS VARCHAR)), ('evidence', CAST(l_suppkey AS VARCHAR)), ('evidence', CASE WHEN l_linenumber > 2 THEN ' ' ELSE l_returnflag END)) x(kind, id) WHERE trim(x.id) <> ''")
def k18(t: Tables) -> DataFrame:
    units = t.lineitem.select("l_orderkey", F.array("l_partkey", F.lit(None)).alias("facts"), F.array(F.col("l_suppkey").cast("string"), F.when(F.col("l_linenumber") > 2, " ").otherwise(F.col("l_returnflag"))).alias("evidence"))
    return L.linked_units(units, "l_orderkey", {"fact": "facts", "evidence": "evidence"})


_SECTIONS = (("4.1 绝缘电阻要求", 2), ("4.2 温度范围", 2), ("1 范围", 1), ("第3页", 2), ("B.2 车辆和接口锁止", 2), ("参考文献", 2), ("7 x", 2))


@query("k28_missing_sections", f"SELECT c_custkey, {pick('c_custkey', *(quoted(a) for a, _ in _SECTIONS))} AS title FROM customer WHERE c_custkey % 7 IN (0, 1, 4) AND NOT CASE c_nationkey % 4 WHEN 0 THEN c_custkey % 7 = 0 WHEN 1 THEN c_custkey % 7 IN (1, 4) WHEN 2 THEN false ELSE c_custkey % 7 = 4 END")
def k28(t: Tables) -> DataFrame:
    source = t.customer.selectExpr("c_custkey", f"{pick('c_custkey', *(quoted(a) for a, _ in _SECTIONS))} AS title", f"{pick('c_custkey', *(str(b) for _, b in _SECTIONS))} AS level")
    compiled = t.customer.selectExpr("c_custkey", f"{pick('c_nationkey', quoted('## 绝缘 电阻 测量'), quoted('工作 温度范围 与 接口锁止功能'), quoted('空'), quoted('车辆和接口锁止'))} AS text")
    return L.missing_sections(source, compiled, "c_custkey", "title", "level")


_TERM = f"concat({pick('p_partkey', quoted('控制导引'), quoted('充电 导引'), quoted('Charge Pump'), quoted('charge pump'), 'p_name')}, {pick('p_size', quoted('; CP'), quoted('; CC'), quoted(''))})"
_ENTITY = f"concat('entity ', p_size % 4, {pick('p_partkey', quoted(' (CP)'), quoted(''), quoted('; OBC'))})"


@query(
    "i43_ambiguity",
    rf"""WITH a AS (SELECT nullif(regexp_extract({_TERM}, ';\s*([A-Z]{{2,6}})\s*$', 1), '') AS acronym, trim(regexp_replace({_TERM}, ';\s*[A-Z]{{2,6}}\s*$', '')) AS label FROM part
      UNION ALL SELECT CASE p_partkey % 3 WHEN 0 THEN 'CP' WHEN 2 THEN 'OBC' END, concat('entity ', p_size % 4) FROM part),
    o AS (SELECT acronym, regexp_replace(lower(label), '\s+', '', 'g') AS k, min(label) AS label FROM a WHERE acronym IS NOT NULL AND label <> '' GROUP BY 1, 2)
    SELECT acronym, count(*) AS senses, array_to_string(list_slice(list_sort(list(label)), 1, 5), ';') AS labels FROM o GROUP BY 1 HAVING count(*) >= 2""",
)
def i43(t: Tables) -> DataFrame:
    return L.senses(t.part.selectExpr(f"{_TERM} AS term", "'' AS definition"), t.part.selectExpr(f"{_ENTITY} AS canonical_name"))


_ROUTED = {
    "'CP 9V PWM'": ("CP 9V PWM", "CP", "PWM", "控制导引", "检测点 1", "检测点1", "是否输出 PWM", "9", "9V", "9 V", "表 A.4", "电压状态", "充电过程状态"), "'控制时序'": ("控制时序", "控制时序表", "状态转换", "表 A.7", "交流充电控制时序表"),
    "' OBC '": ("OBC",), "'控制导引 检测点 1'": ("控制导引 检测点 1", "控制导引", "检测点 1", "检测点1"), "'-12.5 v'": ("-12.5 v", "-12.5", "-12.5V", "-12.5 V"),
}


@query("i16_routing_terms", "SELECT p_partkey, " + pick("p_partkey", *(quoted("|".join(v)) for v in _ROUTED.values())) + " AS terms FROM part")
def i16(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.array_join(L.routing_terms(F.expr(pick("p_partkey", *_ROUTED))), "|").alias("terms"))


@query("d19_metric_summary", f"WITH q AS ({M01_SQL}) SELECT lang, count(*) AS cases, round(avg(recall_at_5), 6) AS recall_at_5, round(avg(recall_at_10), 6) AS recall_at_10, round(avg(mrr), 6) AS mrr, round(avg(CAST(negatives > 0 AS INTEGER)), 6) AS negative_rate, count(*) FILTER (attribution <> 'ok') AS failures FROM q JOIN documents ON case_id = doc_id GROUP BY 1")
def d19(t: Tables) -> DataFrame:
    return E.quality_summary(m01(t).join(t.documents.select(F.col("doc_id").alias("case_id"), "lang"), "case_id"), ["lang"])


_FAILED = {
    "case_id": "o_orderkey", "reason": pick("o_custkey", "'Shape of it'", "''", "'graph path'", "'source_unit gone'", "'LLM said'", "'rerank low'", "'a miss'", "NULL", "'parse error'"), "attribution": pick("o_orderkey", "NULL", "'ok'", "'forbidden_content'", "'citation_missing'", "''"),
    "noisy": "o_orderkey % 13 = 1", "graph_candidates": "o_custkey % 4", "expects_graph": "o_orderkey % 3 = 0", "topic_confidence": pick("o_custkey", "0.5", "1.0", "NULL", "0.0", "0.3"), "assert_mode": pick("o_custkey", "'context_contains'", "'answer_contains'"), "retrieved": "o_orderkey % 4",
    "answer": pick("o_orderkey", "'x'", "''"),
}


@query(
    "m09_failure_typing",
    f"""WITH f AS (SELECT {', '.join(f'{e} AS {n}' for n, e in _FAILED.items())} FROM orders), r AS (SELECT *, lower(coalesce(reason, '')) AS why FROM f)
    SELECT case_id, CASE WHEN attribution = 'forbidden_content' THEN 'llm_generation_wrong' WHEN attribution = 'citation_missing' THEN 'citation_missing' WHEN contains(why, 'shape') THEN 'evidence_shape_wrong' WHEN noisy THEN 'entity_quality_pollution' WHEN graph_candidates = 0 AND expects_graph THEN 'graph_not_engaged' WHEN topic_confidence <= 0 THEN 'topic_resolution_wrong'
      {' '.join(f"WHEN regexp_matches(why, '{p}') THEN '{k}'" for p, k in E.REASONS)} WHEN assert_mode = 'context_contains' AND retrieved = 0 THEN 'retrieval_miss' WHEN assert_mode <> 'context_contains' AND answer <> '' THEN 'answer_policy_wrong' ELSE 'unknown' END AS failure FROM r""",
)
def m09(t: Tables) -> DataFrame:
    return E.failure_types(t.orders.selectExpr(*(f"{e} AS {n}" for n, e in _FAILED.items()))).select("case_id", "failure")


_CANDIDATE = {
    "id": "o_orderkey", "query": pick("o_custkey", "'q'", "' '", "'q'", "'q'", "NULL"), "signals": "o_orderkey % 6", "tier": pick("o_orderkey", "'golden_active'", "'draft'", "'corpus_eval'", "'blocked'", "'draft'"), "origin": pick("o_custkey", "'unit'", "'eval_failure'", "'ontology_gap'", "'unit'"), "expects": pick("o_orderkey", "true", "false", "NULL"),
}


@query(
    "m12_activation",
    f"""WITH c AS (SELECT {', '.join(f'{e} AS {n}' for n, e in _CANDIDATE.items())} FROM orders), r AS (SELECT id, tier, concat_ws(',', CASE WHEN trim(coalesce(query, '')) = '' THEN 'missing_query' END, CASE WHEN signals = 0 THEN 'missing_assertion_signal' END, CASE WHEN tier = 'blocked' THEN 'candidate_tier_blocked' END, CASE WHEN tier = 'corpus_eval' THEN 'corpus_eval_requires_review' END,
      CASE WHEN origin = 'eval_failure' AND NOT coalesce(expects, false) THEN 'eval_failure_missing_stable_expected_contract' END, CASE WHEN origin = 'ontology_gap' THEN 'ontology_gap_generation_not_implemented' END) AS reasons FROM c)
    SELECT id, reasons, CASE WHEN regexp_matches(reasons, 'missing|blocked|not_implemented') THEN 'blocked' WHEN reasons <> '' THEN 'review_required' WHEN tier = 'golden_active' THEN 'active' ELSE 'ready' END AS readiness FROM r""",
)
def m12(t: Tables) -> DataFrame:
    rows = E.activation(t.orders.selectExpr(*(f"{e} AS {n}" for n, e in _CANDIDATE.items())))
    return rows.select("id", F.array_join("reasons", ",").alias("reasons"), "readiness")


@query("m17_stale_golden", "WITH u AS (SELECT user_id, max(ts) AS updated FROM events WHERE event_type = 'purchase' GROUP BY 1) SELECT user_id, count(*) AS total, count(*) FILTER (ts < updated) AS stale FROM events LEFT JOIN u USING (user_id) WHERE event_type = 'view' GROUP BY 1")
def m17(t: Tables) -> DataFrame:
    updates = t.events.filter("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("updated"))
    return E.stale_cases(t.events.filter("event_type = 'view'").select("user_id", "ts"), updates, "user_id", "ts", "updated")


@query("m19_feedback_hotspots", "SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean FROM events WHERE value < 20 GROUP BY 1 HAVING count(*) >= 3")
def m19(t: Tables) -> DataFrame:
    return E.hotspots(t.events, "user_id", "value", 3, 20.0)


@query(
    "m23_compared_runs",
    """WITH o AS (SELECT o_orderkey, o_orderpriority, o_totalprice > 100000 AS ok FROM orders WHERE o_orderkey % 5 <> 0), n AS (SELECT o_orderkey, o_orderpriority, o_custkey % 3 <> 0 AS ok FROM orders WHERE o_orderkey % 7 <> 0),
    b AS (SELECT coalesce(o.o_orderpriority, n.o_orderpriority) AS o_orderpriority, coalesce(o.ok, false) AS a, coalesce(n.ok, false) AS b FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey)
    SELECT o_orderpriority, count(*) AS questions, count(*) FILTER (a) AS old_passed, count(*) FILTER (b) AS new_passed, count(*) FILTER (NOT a AND b) AS gained, count(*) FILTER (a AND NOT b) AS lost FROM b GROUP BY 1""",
)
def m23(t: Tables) -> DataFrame:
    old = t.orders.filter("o_orderkey % 5 <> 0").select("o_orderkey", "o_orderpriority", (F.col("o_totalprice") > 100_000).alias("ok"))
    new = t.orders.filter("o_orderkey % 7 <> 0").select("o_orderkey", "o_orderpriority", (F.col("o_custkey") % 3 != 0).alias("ok"))
    return E.compared_answers(old, new, "o_orderkey", "o_orderpriority", "ok")
