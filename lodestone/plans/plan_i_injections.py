"""Direct hits, ranked evidence, quality and safety of answers."""

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import answers as A
from lodestone.operators import injections as I
from lodestone.operators.reranking import PRACTICE
from lodestone.plans import plan_i_answers as N
from lodestone.plans import plan_i_rerank as P
from lodestone.plans.plan_h_rules import pick, quoted
from lodestone.plans.plan_i_answers import best
from lodestone.plans.plan_i_rerank import QUESTIONS, has, points
from lodestone.plans.registry import query
from lodestone.plans.views import Tables

_COLUMNS = {**P.CANDIDATE, "confidence": N._MORE["confidence"]}
_ROWS = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in _COLUMNS.items()) + " FROM part"


def candidates(t: Tables) -> DataFrame:
    asked = t.spark.createDataFrame(QUESTIONS, P._Q)
    return t.part.selectExpr(*(f"{e} AS {n}" for n, e in _COLUMNS.items())).join(F.broadcast(asked), "query_id")  # ten rows


def union(select, where) -> str:
    return " UNION ALL ".join(f"SELECT query_id, result_id, {select(q)} FROM c WHERE query_id = {q[0]} AND ({where(q)})" for q in QUESTIONS)


def _pieces(s: str) -> list[str]:
    c = "".join(re.findall("[一-鿿]", s))
    return [c[i : i + 2] for i in range(len(c) - 1)]


def _variants(q: tuple) -> list[str]:
    said = " ".join([q[2], q[3], q[4], *q[5], *q[6], *q[7]])
    return ["输入过压", "输入过、欠压", "交流输入过、欠压", "过压保护试验"] * ("输入过压" in said) + ["车载充电机", "电动汽车用传导式车载充电机", "on-board charger"] * bool(re.search(r"\bOBC\b|车载充电机|on-?board charger", said, re.I))


def _terms(q: tuple) -> list[str]:
    return [x for x in dict.fromkeys([*q[5], *_variants(q), *q[6], q[3], *(p for m in q[5] for p in _pieces(m))]) if x][:6]


def _key(s: str) -> str:
    s = re.sub(r"[_/\\]", "", s.lower().replace("—", "-")).replace("gb t", "gbt").replace("qc t", "qct")
    return re.sub(r"\s+", "", s)


_FLAT = r"regexp_replace(replace(replace(regexp_replace(replace(lower(payload), '—', '-'), '[_/\\]', '', 'g'), 'gb t', 'gbt'), 'qc t', 'qct'), '\s+', '', 'g')"


def _like(*terms: str) -> str:
    return " OR ".join(f"contains(lower(payload), {quoted(t.lower())})" for t in terms) or "false"


def _direct(q: tuple) -> str:
    kind, practice = q[1], f"regexp_matches(payload, '{PRACTICE}')"
    tests = f"({has(_FLAT, '试验', '测试', '测量', '检测')} AND {has(_FLAT, '试验方法及步骤', '按照图', '接好试验电路', '调节', '测量', '观察')})"
    typed = "0"
    if kind in ("lifecycle_lookup", "timing_lookup"):
        process = f"CASE WHEN {practice} THEN 1.25 ELSE 0.5 END" if kind == "lifecycle_lookup" else "1.25"
        typed = f"CASE fact_type WHEN 'process_fact' THEN {process} WHEN 'table_requirement' THEN 0.85 WHEN 'section_heading' THEN 0.65 ELSE 0 END"
    elif kind == "test_method_lookup":
        typed = f"CASE fact_type WHEN 'process_fact' THEN CASE WHEN {tests} THEN 1.9 ELSE 1.15 END WHEN 'section_heading' THEN 0.25 ELSE 0 END"
    found = "CASE " + " ".join(f"WHEN {_like(t)} THEN CASE WHEN {has(_FLAT, _key(t))} THEN 0.35 ELSE 0 END" for t in _terms(q)) + " END"
    variants = " + ".join(f"CASE WHEN {has(_FLAT, _key(v))} THEN 0.25 ELSE 0 END" for v in _variants(q)) or "0"
    return f"round(CAST(greatest(0.85, confidence) + {typed} + {found} + {variants} + CASE WHEN regexp_matches(payload, '{I.CODE}') THEN 0.25 ELSE 0 END AS DOUBLE), 6) AS score"


_DIRECT = best(union(_direct, lambda q: f"fact_type IN ({quoted(*I.DIRECT)}) AND ({_like(*_terms(q))})"), 40, "score DESC, result_id")


@query("i12_direct_facts", f"WITH c AS ({_ROWS}) {_DIRECT}")
def i12(t: Tables) -> DataFrame:
    return I.facts(candidates(t), 40).select("query_id", "result_id", "score")


_NAMED = r"list_distinct(regexp_extract_all(upper({}), '\b((?:SYS|SWE|SUP|MAN|HWE|VAL|REU|PIM)\.\d+)\.BP\d+\b', 1))"


@query(
    "i14_process_siblings",
    f"""WITH c AS ({_ROWS}), h AS ({_DIRECT}), b AS ({best('SELECT * FROM h', 12, 'score DESC, result_id')}),
    s AS (SELECT query_id, code, max(score) AS score, min(result_id) AS first FROM (SELECT b.query_id, b.score, b.result_id, unnest({_NAMED.format('c.snippet')}) AS code FROM b JOIN c ON b.query_id = c.query_id AND b.result_id = c.result_id) GROUP BY 1, 2),
    w AS (SELECT query_id, code FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, code) AS k FROM s) WHERE k <= 3),
    m AS (SELECT DISTINCT x.query_id, x.result_id, round(CAST(greatest(0.85, confidence) + CASE fact_type WHEN 'process_fact' THEN 1.45 ELSE 1.36 END + CASE WHEN regexp_matches(payload, '[一-鿿]') THEN 0.2 ELSE 0 END AS DOUBLE), 6) AS score
      FROM (SELECT *, unnest({_NAMED.format('payload')}) AS code FROM c WHERE fact_type IN ('process_fact', 'table_requirement')) x JOIN w ON x.query_id = w.query_id AND x.code = w.code)
    SELECT query_id, result_id, max(score) AS score FROM (SELECT query_id, result_id, score FROM h UNION ALL SELECT * FROM m) GROUP BY 1, 2""",
)
def i14(t: Tables) -> DataFrame:
    rows = candidates(t)
    return I.siblings(I.facts(rows, 40), rows).select("query_id", "result_id", "score")


_WITH_VALUES = {**N._BASE, "payload": N._BASE["payload"].replace("'GB/T 18487.1'", "concat('gbt 18487.', p_size % 3, '-', 2000 + p_size)").replace("'\",\"term\":\"', p_name", f"'\",\"term\":\"', {pick(P._A, quoted('**控制导引电路**'), quoted('关于控制导引电路的说明'), 'p_name')}")}
_VALUE_ROWS = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in _WITH_VALUES.items()) + " FROM part"


def with_values(t: Tables) -> DataFrame:
    asked = t.spark.createDataFrame(QUESTIONS, P._Q)
    return t.part.selectExpr(*(f"{e} AS {n}" for n, e in _WITH_VALUES.items())).join(F.broadcast(asked), "query_id")  # ten rows


_OWN = r"regexp_replace(replace(replace(replace(replace(upper(json_extract_string(payload, '$.value')), 'GBT', 'GB/T'), 'GB T', 'GB/T'), 'QC T', 'QC/T'), '-', '—'), '\s+', '', 'g')"


@query("i17_exact_standards", f"WITH c AS ({_VALUE_ROWS}) SELECT query_id, result_id, CAST(greatest(0.99, confidence) AS DOUBLE) AS score FROM c WHERE query_id = 1 AND fact_type = 'document_standard' AND ({_OWN} = 'GB/T18487.1' OR starts_with({_OWN}, 'GB/T18487.1—'))")
def i17(t: Tables) -> DataFrame:
    return I.standards(with_values(t)).select("query_id", "result_id", "score")


_PLAIN = "trim(replace(json_extract_string(payload, '$.term'), '*', ''))"


@query(
    "i18_term_definitions",
    f"WITH c AS ({_VALUE_ROWS}) "
    + best(f"SELECT query_id, result_id, CAST(CASE WHEN starts_with({_PLAIN}, '控制导引电路') THEN 3.6 WHEN contains({_PLAIN}, '控制导引电路') AND length({_PLAIN}) <= 40 THEN 3.2 ELSE 2.6 END AS DOUBLE) AS score FROM c WHERE query_id = 0 AND fact_type = 'term_definition' AND contains(payload, '控制导引电路')", 30, "score DESC, result_id"),
)
def i18(t: Tables) -> DataFrame:
    return I.definitions(with_values(t), 30).select("query_id", "result_id", "score")


def _needs(q: tuple) -> tuple[str, str]:
    terms = [x for x in dict.fromkeys([q[4].strip(), q[3].strip(), *(m.strip() for m in q[5])]) if len(x) >= 2 and x.lower() not in I.GENERIC]
    every = list(dict.fromkeys(terms + [w for x in terms for w in re.findall("[一-鿿]{2,4}", x) + re.findall("[A-Z]{2,6}", x)]))[:6]
    n = "(" + (" + ".join(f"CAST(contains(payload, {quoted(p)}) AS INTEGER)" for p in dict.fromkeys(p for x in terms for p in _pieces(x))) or "0") + ")"
    titled = " OR ".join(f"contains(lower(coalesce(filename, '')), {quoted(x.lower())})" for x in terms)
    return f"CAST(CASE WHEN {_like(*every)} THEN CASE WHEN {titled} THEN 2.5 ELSE 2.2 END ELSE round(1.5 + 0.2 * {n}, 6) END AS DOUBLE) AS score", f"fact_type IN ('requirement', 'threshold', 'table_requirement') AND ({_like(*every)} OR {n} >= 2)"


@query("i19_requirements", f"WITH c AS ({_ROWS}) " + best(union(lambda q: _needs(q)[0], lambda q: _needs(q)[1] if q[1] in ("constraint", "parameter_lookup") else "false"), 30, "score DESC, result_id"))
def i19(t: Tables) -> DataFrame:
    return I.requirements(candidates(t), 30).select("query_id", "result_id", "score")


_EVIDENCE = {"query_id": "CAST(p_partkey % 10 AS INTEGER)", "line": "p_partkey", "confidence": N._MORE["confidence"], "snippet": f"concat({pick(P._B, quoted('## '), quoted('<table> '), quoted('| '), quoted(''), quoted('前言 '), quoted('DOI: 10.1/x '))}, {P._HEAD}, {pick(P._C, quoted(' 2015-12-28 实施'), quoted(' 检测点 1'), quoted(' 适用于充电电流有什么'), quoted(' blue rin'))})"}
_EV_ROWS = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in _EVIDENCE.items()) + " FROM part"


def _evidence(q: tuple) -> str:
    kind = A.INTENTS.get(q[1], "general")
    any_ = lambda *ws: has("snippet", *ws)
    table, front, head = "contains(lower(snippet), '<table')", any_("目 次", "前    言", "前言"), any_("##")
    own = {
        "definition": [(f"{head} AND {any_(' control pilot ', '控制导引电路', '定义', '术语')}", 2.5), (head, 0.5)],
        "standard": [(r"regexp_matches(snippet, '\d{4}-\d{2}-\d{2}\s*(发布|实施)')", 1.5), (r"regexp_matches(snippet, '\bGB/T\b')", 1.0)],
        "parameter": [(f"{table} OR {any_('|')}", 1.5), (r"regexp_matches(snippet, '(?i)Ω|电阻|阻值|R\d+|检测点\s*\d|CC1|CC2')", 1.6), (front, -2.0)],
        "process": [(f"{table} OR {any_('|')}", 1.3), ("regexp_matches(snippet, '时序|状态|握手|预充|停机|检测点|控制导引')", 1.8), (front, -2.2)],
    }.get(kind, [(table, -1.2), (head, 0.6), (any_("定义", "范围", "适用于"), 0.4)])
    opening = re.sub("[？?]", "", q[2])[:8]
    return f"round(CAST({points(*own, (any_('DOI:'), -2.5), (any_(opening), 0.8))} AS DOUBLE), 6) + confidence AS points"


@query("i38_ranked_evidence", f"WITH c AS ({_EV_ROWS}) SELECT query_id, line, round(points, 6) AS points FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY points DESC, confidence DESC, line) AS n FROM ({' UNION ALL '.join(f'SELECT query_id, line, confidence, {_evidence(q)} FROM c WHERE query_id = {q[0]}' for q in QUESTIONS)})) WHERE n <= 20")
def i38(t: Tables) -> DataFrame:
    from lodestone.operators.ranking import top_per_group

    asked = t.spark.createDataFrame(QUESTIONS, P._Q)
    rows = t.part.selectExpr(*(f"{e} AS {n}" for n, e in _EVIDENCE.items())).join(F.broadcast(asked), "query_id")  # ten rows
    ranked = top_per_group(rows.withColumn("points", I.evidence_points() + F.col("confidence")), ["query_id"], 20, F.desc("points"), F.desc("confidence"), "line")
    return ranked.select("query_id", "line", F.round("points", 6).alias("points"))


_ANSWER = {
    "case_id": "o_orderkey", "answer": pick("o_orderkey", "'plain answer'", "'a&nbsp;b'", "'see <br> here'", "'cost $x$ and **bold**'", "'完。。'", "concat('电', chr(10), '压')", "'50'"),
    "target_doc_present": "o_custkey % 7 <> 0", "expected_present": "o_custkey % 5 <> 0", "forbidden": "o_orderkey % 11 - 9", "mode": pick("o_custkey", "'definition'", "'constraint'"), "expected_mode": pick("o_orderkey", "'Definition'", "NULL", "''"),
    "shape": pick("o_custkey", "'term_definition'", "'requirement'", "NULL"), "expected_shape": pick("o_orderkey", "NULL", "'requirement'"), "fallback": pick("o_custkey", "NULL", "''", "''", "'timeout'"), "gated": "o_orderkey % 2 = 0",
    "sufficient": pick("o_custkey", "true", "false", "NULL"), "cited": "o_orderkey % 3 <> 1",
}


@query(
    "m02_answer_quality",
    f"""WITH c AS (SELECT {', '.join(f'{e} AS {n}' for n, e in _ANSWER.items())} FROM orders), a AS (SELECT *, CASE o % 7 WHEN 1 THEN 'html_entity_nbsp' WHEN 2 THEN 'raw_html_tag' WHEN 3 THEN 'latex_math_delimiter,markdown_bold_marker' WHEN 4 THEN 'duplicate_period' WHEN 5 THEN 'hard_wrapped_cjk_line' ELSE '' END AS artifacts FROM (SELECT *, case_id AS o FROM c))
    SELECT case_id, artifacts, CASE WHEN NOT target_doc_present THEN 'target_doc_missing' WHEN artifacts <> '' THEN 'answer_render_artifact' WHEN forbidden > 0 THEN 'forbidden_content' WHEN NOT expected_present THEN 'expected_answer_missing' WHEN coalesce(expected_mode, '') <> '' AND lower(expected_mode) <> mode THEN 'answer_mode_wrong'
      WHEN coalesce(expected_shape, '') <> '' AND lower(shape) <> expected_shape THEN 'evidence_shape_wrong' WHEN coalesce(fallback, '') <> '' THEN 'fallback_answer' WHEN gated AND NOT coalesce(sufficient, true) THEN 'evidence_not_sufficient' WHEN NOT cited THEN 'citation_missing' ELSE 'ok' END AS attribution FROM a""",
)
def m02(t: Tables) -> DataFrame:
    out = I.answer_attribution(t.orders.selectExpr(*(f"{e} AS {n}" for n, e in _ANSWER.items())))
    return out.select("case_id", F.array_join("artifacts", ",").alias("artifacts"), "attribution")


_SAID = pick("o_orderkey", "'电压应不超过十二伏'", "'Not found here'", "'12 V'", "''", "'控制导引电路的电压状态'")
_CITED = pick("o_custkey", "''", "'GB/T 18487.1—2023'", "'充电接口的电压应不超过规定值，参见本文件第五章第二节的表格与说明，以及附录中的试验方法和要求，并应满足相关标准的全部条款规定'", "'短'")


@query(
    "m03_answer_safety",
    f"""WITH c AS (SELECT o_orderkey, {_SAID} AS answer, {_CITED} AS said, concat('D', o_custkey % 3) AS doc, {pick('o_orderkey', "'D1'", "''", "NULL")} AS preferred FROM orders), k AS (SELECT *, o_orderkey % 5 IN (0, 4) AS claim FROM c)
    SELECT o_orderkey, CASE WHEN o_orderkey % 5 IN (1, 3) THEN 'degraded_or_refusal_answer' WHEN claim AND said = '' THEN 'substantive_claim_no_supporting_evidence' WHEN starts_with(said, 'GB/T') THEN 'citation_only_title_or_header_blocks' WHEN claim AND coalesce(preferred, '') <> '' AND doc <> preferred THEN 'citation_doc_mismatch_with_preferred_doc' WHEN said <> '' THEN 'cited_substantive_evidence' ELSE 'non_substantive_answer' END AS reason FROM k""",
)
def m03(t: Tables) -> DataFrame:
    cited = F.array(F.struct(F.concat(F.lit("D"), (F.col("o_custkey") % 3).cast("string")).alias("doc_id"), F.expr(_CITED).alias("text")))
    rows = t.orders.select("o_orderkey", F.expr(_SAID).alias("answer"), F.expr(pick("o_orderkey", "'D1'", "''", "NULL")).alias("preferred_doc"), cited.alias("cited"))
    return I.safety(rows).select("o_orderkey", "reason")
