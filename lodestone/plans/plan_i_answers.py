"""Injections, topics, ranked facts, answers and an evaluation run."""

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import answers as A
from lodestone.operators import evaluation as E
from lodestone.operators import retrieval as R
from lodestone.plans import plan_i_rerank as P
from lodestone.plans import plan_i_retrieval as Q
from lodestone.plans.plan_h_rules import pick, quoted
from lodestone.plans.plan_i_rerank import QUESTIONS, has, norm, plain, points
from lodestone.plans.registry import query
from lodestone.plans.views import Tables

_MORE = {
    "confidence": "CAST(p_partkey % 10 AS DOUBLE) / 10", "entity_id": pick(P._C, "'E'", "NULL"), "predicate": pick(P._A, "'publication_date'", "'effective_date'"),
    "page_kind": pick(P._B, "'term'", "'process'", "'parameter'", "'constraint'", "'parameter_group'", "'comparison'"),
    "kind_of_fact": pick(P._C, "'term_definition'", "'process_fact'", "'document_standard'", "'document_lifecycle'", "'parameter_value'", "'requirement'", "'document_versioning'", "'comparison_relation'", "NULL"),
}
_BASE = {**P.CANDIDATE, "page_type": _MORE["page_kind"], "fact_type": _MORE["kind_of_fact"], **{k: _MORE[k] for k in ("confidence", "entity_id", "predicate")}}
#: Payloads with the fields that answers are made of.
_BASE["payload"] = f"""concat('{{"title":"', {P._HEAD}, '","term":"', p_name, '","definition":"', {pick(P._B, "'装置'", "''", "'电路'")}, '","value":"', {pick(P._A, "'GB/T 18487.1'", "'2015-12-28'", "''")}, '","parameter":"', {P._PARAMETER}, '","nominal":"', {pick(P._C, "'12'", "''")}, '","unit":"', {P._UNIT}, '","step_text":"', {pick(P._B, "'按照图连接试验 过压'", "''")}, '","content":"', {pick(P._A, "'应不超过 5 A'", "''")}, '","relation":"', {pick(P._B, "'V2G 不同于 V2L'", "''")}, '","scope_type":"', {pick(P._C, "'index'", "''", "'overview'")}, '"}}')"""
_ROWS = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in _BASE.items()) + " FROM part"


def candidates(t: Tables) -> DataFrame:
    asked = t.spark.createDataFrame(QUESTIONS, P._Q)
    return t.part.selectExpr(*(f"{e} AS {n}" for n, e in _BASE.items())).join(F.broadcast(asked), "query_id")  # ten rows


def per_question(select, where=lambda q: "true") -> str:
    return " UNION ALL ".join(f"SELECT query_id, result_id, {select(q)} FROM c WHERE query_id = {q[0]} AND {where(q)}" for q in QUESTIONS)


def best(sql: str, k: int, order: str) -> str:
    return f"SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS n FROM ({sql})) WHERE n <= {k}"


# ---- variants and injections ---------------------------------------------------------------------

_VARIANTS = "SELECT n_nationkey AS query_id, lower(concat(n_name, ' license password')) AS variant FROM nation UNION SELECT n_nationkey, s FROM nation, (VALUES ('copyright'), ('apache'), ('secret')) v(s)"


@query("i06_query_variants", _VARIANTS)
def i06(t: Tables) -> DataFrame:
    asked = t.nation.select(F.col("n_nationkey").alias("query_id"), F.concat("n_name", F.lit(" license password")).alias("question"))
    return R.expand_synonyms(asked, Q._SYN)


def _words(q: tuple) -> str:
    return " ".join([q[2], q[3], q[4], *q[5], *q[7]])


def _tests(q: tuple) -> str:
    said = _words(q)
    needs = ["试验"] + [w for w in ("过压", "欠压", "输入", "输出") if w in said]
    own = " AND ".join(f"contains(payload, {quoted(w)})" for w in needs)
    if re.search(r"\bOBC\b|车载充电机|on-?board charger", said, re.I):
        own += f" AND ({' OR '.join(f'contains(payload, {quoted(w)})' for w in ('车载充电机', '电动汽车用传导式车载充电机'))})"
    return f"fact_type = 'process_fact' AND {own}" if q[1] == "test_method_lookup" else "false"


def _page(q: tuple) -> str:
    rules = {p: v for (k, p), v in A.WIKI.items() if k == q[1]}
    bonus = f"CASE page_type WHEN '-' THEN 0 {' '.join(f'WHEN {quoted(p)} THEN {v}' for p, v in rules.items())} ELSE {0.18 if q[1] == 'definition' else 0.88} END"
    topic = [x for x in [q[4], q[3], *q[5]] if x]
    fits = f" + CASE WHEN title IN ({quoted(*topic)}) THEN 0.4 WHEN {' OR '.join(f'contains(title, {quoted(x)})' for x in topic)} THEN 0.2 ELSE 0 END" if q[1] == "constraint" else ""
    return f"round(CAST({bonus}{fits} AS DOUBLE), 6) AS score"


def _titled(q: tuple) -> str:
    terms = [x.strip() for x in [q[3], *q[5], *q[7], *q[6]] if x.strip()][:10]
    return f"result_type = 'wiki' AND ({' OR '.join(f'contains(lower(title), {quoted(x.lower())})' for x in terms)})" if q[1] in A.WIKI_ASKED else "false"


_INJECT_TESTS = best(per_question(lambda q: "confidence", _tests), 10, "confidence DESC, result_id")
_INJECT_WIKI = best(per_question(_page, _titled), 10, "score DESC, result_id")


@query("i20_test_methods", f"WITH c AS ({_ROWS}) SELECT query_id, result_id, CAST(5.2 AS DOUBLE) AS score FROM ({_INJECT_TESTS})")
def i20(t: Tables) -> DataFrame:
    return A.test_methods(candidates(t), 10).select("query_id", "result_id", "score")


@query("i21_wiki_pages", f"WITH c AS ({_ROWS}) {_INJECT_WIKI}")
def i21(t: Tables) -> DataFrame:
    return A.wiki_pages(candidates(t), 10).select("query_id", "result_id", "score")


def _topic(q: tuple) -> str:
    kind, terms = q[1], [x for x in [q[4], q[3], *q[5]] if x]
    symbols = [x.upper() for x in terms if re.fullmatch(r"[A-Z]{1,4}\d*", x.upper())]
    same, part = f"title IN ({quoted(*terms)})", f"({' OR '.join(f'contains(title, {quoted(x)})' for x in terms)})"
    symbol = f"upper(title) IN ({quoted(*symbols)})" if symbols else "false"
    suited = {"constraint": "page_type = 'constraint'", "comparison": "page_type = 'comparison'", "timing_lookup": "page_type = 'process'", "definition": "page_type IN ('term', 'concept')"}.get(kind, "false")
    is_p = "true" if kind == "parameter_lookup" else "false"
    total = points((same, 4), (part, 2), (f"{suited} OR ({is_p} AND page_type = 'parameter_group')", 2), (f"{is_p} AND page_type = 'parameter'", 4), (f"{is_p} AND page_type = 'term' AND {symbol}", 5), (f"{is_p} AND page_type = 'term' AND NOT {symbol} AND {part}", 2), (f"{is_p} AND {symbol} AND entity_id IS NOT NULL", 2))
    priority = f"CASE WHEN {suited} OR ({is_p} AND (page_type = 'parameter' OR (page_type = 'term' AND {symbol}) OR ({symbol} AND entity_id IS NOT NULL))) THEN 0 WHEN {is_p} AND (page_type = 'parameter_group' OR (page_type = 'term' AND {part})) THEN 1 ELSE 2 END"
    return f"title, CAST({total} AS INTEGER) AS points, CAST({priority} AS INTEGER) AS priority"


@query("i31_topic_objects", f"WITH c AS ({_ROWS}) " + best(f"SELECT * FROM ({per_question(_topic)}) WHERE points > 0 AND title <> ''", 8, "priority, points DESC, title, result_id"))
def i31(t: Tables) -> DataFrame:
    return A.topic_objects(candidates(t)).select("query_id", "result_id", "title", "points", "priority")


# ---- facts and answers ---------------------------------------------------------------------------


def _fact(q: tuple) -> str:
    kind, said = A.INTENTS.get(q[1], "general"), q[2]
    cjk = lambda n: re.findall(f"[一-鿿]{{{n},}}", said.lower())
    file = "least(0.3 * (" + (" + ".join(f"CAST({has(norm('coalesce(filename, %s)' % quoted(chr(32).strip())), w)} AS INTEGER)" for w in dict.fromkeys(cjk(3))) or "0") + "), 1.0)"
    typed = lambda rules, other: "CASE " + " ".join(f"WHEN fact_type IN ({quoted(*k)}) THEN {v}" for k, v in rules.items()) + f" ELSE {other} END"
    title = "lower(json_extract_string(payload, '$.title'))"
    any_ = lambda *ws: has("payload", *ws)
    rx = lambda asked, there: f"regexp_matches(payload, '{there}')" if re.search(asked, said) else "false"
    front = any_("前言", "前    言", "目 次", "目次")
    if kind == "definition":
        total = typed({("term_definition",): 4.0}, file)
    elif kind == "standard":
        total = typed({("document_standard", "document_versioning", "document_lifecycle"): 3.0, ("term_definition",): 0.5}, file) + " + " + points(("fact_type = 'document_standard' AND json_extract_string(payload, '$.value') = 'GB/T 18487.1'", 2.0))
    elif kind == "parameter":
        words = [w for w in re.findall("[一-鿿]{2,}|[a-z0-9]+", said.lower()) if len(w) >= 2]
        named = has(title, *words)
        total = typed({("parameter_value",): 4.0, ("requirement",): 1.2}, file) + " + " + points(
            (any_("目 次", "前    言", "前言"), -5.0), (rx("阻值|电阻|欧姆|Ω", "(?i)Ω|电阻|阻值|R[0-9]+"), 3.0), (rx(r"(?i)\bCC\b|CC1|CC2", "(?i)CC1|CC2"), 2.5), (rx(r"检测点\s*\d", r"检测点\s*\d"), 2.0), (any_("控制导引", "导引电路"), 1.0),
            (rx("效率|功率", "效率|功率|85"), 3.5), (named, 4.0), (f"NOT {named} AND fact_type = 'requirement' AND length({title}) > 4", -2.0),
        )
    elif kind == "process":
        scope = "json_extract_string(payload, '$.scope_type') IN ('index', 'preface')"
        timing = f"({any_('表 A.7', '控制时序', '状态转换')})" if re.search("时序|流程|状态转换|控制时序|握手|预充|启动|停止|停机", said) else "false"
        total = typed({("process_fact",): 4.0, ("requirement",): 1.0}, file) + " + " + points((scope, -10.0), (front, -10.0), (timing, 5.0), (any_("时序", "状态", "握手", "预充", "停机", "控制时序说明"), 2.0), (any_("控制导引", "检测点", "CP"), 1.2), (has(title, *cjk(2)), 3.0))
    elif kind == "constraint":
        total = typed({("comparison_relation",): 4.6, ("term_definition",): 2.0}, 0.6) + " + " + points((has("upper(payload)", "V2X", "V2G", "V2V", "V2B", "V2H"), 1.2))
    else:
        scope = "json_extract_string(payload, '$.scope_type') IN ('index', 'preface', 'overview')"
        total = typed({("term_definition",): 1.0, ("requirement",): 2.0}, file) + " + " + points((scope, -5.0), (has(title, *cjk(2)), 5.0), ("fact_type = 'parameter_value'" if re.search("阻值|参数|电阻|CC", said) else "false", 3.0))
    wanted = f"fact_type IN ({quoted(*A.INTENT_FACTS[kind])})" if kind in A.INTENT_FACTS else "true"
    return f"{quoted(q[1])} AS query_type, payload, fact_type, predicate, snippet, confidence, {wanted} AS wanted, round(CAST({total} AS DOUBLE) + confidence, 6) AS points"


_FACTS = f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY wanted DESC, points DESC, confidence DESC, result_id) AS place FROM ({per_question(_fact)}) WHERE fact_type IS NOT NULL"


@query("i37_ranked_facts", f"WITH c AS ({_ROWS}) SELECT query_id, result_id, wanted, points, CAST(place AS INTEGER) AS place FROM ({_FACTS})")
def i37(t: Tables) -> DataFrame:
    return A.ranked_facts(candidates(t)).select("query_id", "result_id", "wanted", "points", "place")


def _at(n: str) -> str:
    return f"nullif(json_extract_string(payload, '$.{n}'), '')"


def _pick(value: str, kinds: str) -> str:
    return f"arg_min({value}, place) FILTER (fact_type IN ({kinds}) AND {value} IS NOT NULL)"


_ANSWERS = f"""b AS (SELECT query_id, query_type, {_pick(f"{_at('term')} || ': ' || {_at('definition')}", "'term_definition'")} AS meaning, {_pick(f"{_at('parameter')} || ' = ' || {_at('nominal')} || coalesce(' ' || {_at('unit')}, '')", "'parameter_value'")} AS amount,
  {_pick(f"coalesce({_at('step_text')}, {_at('title')})", "'process_fact'")} AS step, {_pick(_at('value'), "'document_standard'")} AS standard, arg_min({_at('value')}, place) FILTER (fact_type = 'document_lifecycle' AND predicate = 'publication_date' AND {_at('value')} IS NOT NULL) AS published,
  arg_min({_at('value')}, place) FILTER (fact_type = 'document_lifecycle' AND predicate = 'effective_date' AND {_at('value')} IS NOT NULL) AS effective, {_pick(_at('value'), "'document_versioning'")} AS replaced, {_pick(_at('content'), "'requirement'")} AS requirement,
  {_pick(_at('relation'), "'comparison_relation'")} AS comparison, arg_min({_at('title')}, place) AS title FROM f GROUP BY 1, 2),
a AS (SELECT query_id, CASE query_type WHEN 'definition' THEN meaning WHEN 'parameter_lookup' THEN amount WHEN 'lifecycle_lookup' THEN step WHEN 'timing_lookup' THEN step WHEN 'test_method_lookup' THEN step WHEN 'comparison' THEN comparison
  WHEN 'standard_lookup' THEN nullif(concat_ws('，', '标准号是 ' || standard, '发布日期是 ' || published, '实施日期是 ' || effective, '代替标准是 ' || replaced), '') || '。' END AS own, query_type, requirement, title FROM b)
SELECT query_id, CASE WHEN own IS NOT NULL THEN CASE query_type WHEN 'parameter_lookup' THEN 'parameter_value' WHEN 'lifecycle_lookup' THEN 'process' WHEN 'timing_lookup' THEN 'process' WHEN 'test_method_lookup' THEN 'process' ELSE query_type END WHEN requirement IS NOT NULL THEN 'requirement' ELSE 'title' END AS mode,
  coalesce(own, requirement, '最相关的结构化结果是章节《' || title || '。') AS answer FROM a"""


@query("i40_direct_answers", f"WITH c AS ({_ROWS}), f AS ({_FACTS}), {_ANSWERS}")
def i40(t: Tables) -> DataFrame:
    ranked = A.ranked_facts(candidates(t))
    said = candidates(t).filter("result_type <> 'fact'").select("query_id", F.lit(1).alias("place"), "snippet")
    return A.direct_answers(ranked, said)


_CHUNK_QUESTIONS = [(i, q) for i, _, q, *_ in QUESTIONS] + [(20, "CP"), (21, "PE"), (22, "V2")]
_CHUNK = f"concat({P._HEAD}, {pick(P._C, quoted(' +Vcc 12.00'), quoted(' 保护接地 PE '), quoted(' 检测点1 CP电压'), quoted(' V2'))})"


def _chunk_sql(i: int, q: str) -> str:
    short = [w for w in re.findall(r"[A-Za-z0-9][A-Za-z0-9./\-]*[A-Za-z0-9]|[A-Za-z]{2,}", q) if len(w) == 2]
    patterns = [p for w in short for p in A.ABBREVIATIONS.get(w.lower(), (w,))][:15]
    weight = lambda p: 10 if len(p) >= 3 and re.search("[一-鿿]", p) else 1
    cjk = "".join(re.findall("[一-鿿]", q))
    own = [(p, 100) for p in A.HEAVY] + [(p, weight(p)) for p in patterns] + [(g, 5) for g in dict.fromkeys(cjk[k : k + n] for n in (2, 3) for k in range(len(cjk) - n + 1))]
    return f"SELECT {i} AS query_id, p_partkey, {' + '.join(f'CASE WHEN contains(text, {quoted(p)}) THEN {n} ELSE 0 END' for p, n in own)} AS points FROM k"


@query("i42_wiki_chunks", f"WITH k AS (SELECT p_partkey, concat({_CHUNK}, ' ', p_name) AS text FROM part) " + best(f"SELECT * FROM ({' UNION ALL '.join(_chunk_sql(i, q) for i, q in _CHUNK_QUESTIONS)}) WHERE points > 0", 8, "points DESC, p_partkey"))
def i42(t: Tables) -> DataFrame:
    chunks = t.part.selectExpr("p_partkey", f"{_CHUNK} AS body", "p_name AS title")
    return A.wiki_answers(chunks, _CHUNK_QUESTIONS, "title", "body", "p_partkey")


# ---- the whole way -------------------------------------------------------------------------------


def _total(q: tuple) -> str:
    own = P.one(q)
    return f"round({' + '.join(f'CAST({own[n]} AS DOUBLE)' for n in ('base', *P.K.BONUSES))} - {' - '.join(f'CAST({own[n]} AS DOUBLE)' for n in P.K.PENALTIES)}, 6) AS final, result_type"


_MERGED = f"""w AS ({_INJECT_WIKI.replace('n <= 10', 'n <= 20')}), x AS ({_INJECT_TESTS.replace('n <= 10', 'n <= 20')}),
m1 AS ({best('SELECT c.query_id, c.result_id, CAST(greatest(c.score, coalesce(w.score, c.score)) AS DOUBLE) AS score FROM c LEFT JOIN w ON c.query_id = w.query_id AND c.result_id = w.result_id', 80, 'score DESC, result_id')}),
m2 AS ({best('SELECT query_id, result_id, CAST(5.2 AS DOUBLE) AS score FROM x UNION ALL SELECT query_id, result_id, score FROM m1 WHERE (query_id, result_id) NOT IN (SELECT (query_id, result_id) FROM x)', 80, 'score DESC, result_id')}),
d AS (SELECT c.* EXCLUDE (score), m2.score FROM c JOIN m2 ON c.query_id = m2.query_id AND c.result_id = m2.result_id)"""


@query(
    "i36_query_context",
    f"WITH c AS ({_ROWS}), {_MERGED}, r AS ({best(' UNION ALL '.join(f'SELECT query_id, result_id, {_total(q)} FROM d WHERE query_id = {q[0]}' for q in QUESTIONS), 20, 'final DESC, result_id')}), e AS (SELECT c.* FROM c JOIN r ON c.query_id = r.query_id AND c.result_id = r.result_id), "
    + f"f AS (SELECT * FROM ({_FACTS.replace('FROM c WHERE', 'FROM e WHERE')}) WHERE place <= 12), {_ANSWERS.replace(chr(10) + 'SELECT query_id, CASE WHEN own', ', z AS (SELECT query_id, CASE WHEN own')}), "
    + "g AS (SELECT query_id, count(*) AS candidates, count(*) FILTER (result_type = 'fact') AS facts, max(final) AS final, arg_max(result_id, {'final': final, 'result_id': result_id}) AS best FROM r GROUP BY 1) SELECT g.query_id, candidates, facts, best, final, mode, answer FROM g LEFT JOIN z ON g.query_id = z.query_id",
)
def i36(t: Tables) -> DataFrame:
    return A.context(candidates(t)).select("query_id", "candidates", "facts", "best", "final", "mode", "answer")


_CASES = "(VALUES (1, 'license', 'must'), (1, 'password', 'negative'), (2, 'general public license', 'must'), (2, 'version', 'must'), (3, 'all rights reserved', 'must'), (4, 'schein', 'must'), (5, 'mail', 'must'), (5, 'order', 'must')) v(case_id, anchor, kind)"


@query(
    "m14_retrieval_run",
    f"""WITH {Q._BM25}, h AS (SELECT query_id AS case_id, n AS rank, lower(regexp_replace(text, '\\s+', '', 'g')) AS text FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS n FROM (SELECT query_id, doc_id, round(score, 9) AS score FROM bm)) x JOIN documents d ON x.doc_id = d.doc_id WHERE n <= 10),
    r AS (SELECT a.case_id, a.anchor, a.kind, min(h.rank) FILTER (contains(h.text, replace(a.anchor, ' ', '')) OR (kind = 'must' AND contains(anchor, ' ') AND list_bool_and(list_transform(string_split(anchor, ' '), lambda t: contains(h.text, t))))) AS rank FROM (SELECT * FROM {_CASES}) a LEFT JOIN h ON a.case_id = h.case_id GROUP BY 1, 2, 3)
    SELECT case_id, count(*) FILTER (kind = 'must') AS must, count(*) FILTER (kind = 'must' AND rank IS NOT NULL) AS found, min(rank) FILTER (kind = 'must') AS best_rank, round(count(*) FILTER (kind = 'must' AND rank <= 5) / count(*) FILTER (kind = 'must'), 6) AS recall_at_5, count(*) FILTER (kind = 'negative' AND rank IS NOT NULL) AS negatives FROM r GROUP BY 1""",
)
def m14(t: Tables) -> DataFrame:
    """All cases are asked at once, and their hits held against the anchors."""
    q = Q.asked(t)
    index = Q.searchable(t)
    hits = R.best_k(R.bm25(index.hits(q), index.size, q.select("query_id", "term")), 10)
    anchors = t.spark.createDataFrame([(1, "license", "must"), (1, "password", "negative"), (2, "general public license", "must"), (2, "version", "must"), (3, "all rights reserved", "must"), (4, "schein", "must"), (5, "mail", "must"), (5, "order", "must")], "case_id int, anchor string, kind string")
    return E.retrieval_run(hits, t.documents, anchors).select("case_id", "must", "found", "best_rank", "recall_at_5", "negatives")
