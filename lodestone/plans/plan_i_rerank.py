"""The explained rerank, evidence shapes and the judge over candidates of ten questions.

Candidates are made of the table `part` by expressions that Spark and DuckDB read alike. Oracles are
written question by question: what a question says is worked out here in plain Python, and only what
concerns candidates is SQL.
"""

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import rules as R
from lodestone.operators import reranking as K
from lodestone.operators import shapes as S
from lodestone.plans.plan_h_rules import pick, quoted
from lodestone.plans.registry import query
from lodestone.plans.views import Tables

_Q = "query_id int, query_type string, question string, normalized_query string, target_topic string, must_terms array<string>, should_terms array<string>, aliases array<string>, protected_terms array<string>, anchor_terms array<string>"
QUESTIONS = [
    (0, "definition", "控制导引电路是什么", "控制导引电路", "控制导引电路", ["控制导引电路"], ["导引电路", "control pilot"], [], [], []),
    (1, "standard_lookup", "GB/T 18487.1 的实施日期", "GB/T 18487.1", "GB/T 18487.1", ["GB/T—18487.1", "GB/T 18487.1"], ["2015"], [], [], []),
    (2, "lifecycle_lookup", "SWE.1 软件架构分析有哪些活动", "软件架构分析", "软件架构分析", ["SWE.1"], ["架构"], [], [], []),
    (3, "timing_lookup", "控制时序的状态转换", "状态转换", "状态", ["时序"], ["控制时序"], [], [], []),
    (4, "test_method_lookup", "OBC 输入过压怎么测", "OBC 输入过压", "输入过压", ["OBC"], ["过压"], ["车载充电机"], ["OBC"], []),
    (5, "parameter_lookup", "表 A.4 中 CC1 的等效电阻 R2 是多少", "CC1 等效电阻", "等效电阻", ["CC1", "表 A.4"], ["电阻"], [], ["R2"], ["表 A.4", "CC1", "等效电阻", "R2"]),
    (6, "parameter_lookup", "PWM 9V 检测点 1 电压对应什么状态", "检测点 1 电压", "检测点 1", ["PWM"], ["电压"], [], [], ["PWM", "电压"]),
    (7, "constraint", "充电电流有什么要求", "充电电流", "充电电流", ["充电电流"], ["要求"], [], [], []),
    (8, "comparison", "CP 与 CC 的占空比", "占空比", "占空比", ["CP", "CC"], ["占空比"], [], [], []),
    (9, "general_search", "blue ring license", "blue ring", "blue ring", ["blue"], ["ring"], [], [], []),
]

_A, _B, _C = "(p_partkey * 7 + p_size * 3)", "(p_partkey + p_size * 5)", "(CAST(floor(p_partkey / 10) AS BIGINT) + p_size)"
_HEAD = pick(_A, "'控制导引电路'", "'OBC 车载充电机'", "'表 A.4 检测点 1 的电压状态'", "'SWE.1.BP2 软件架构分析'", "'输入过压试验 测量 调节'", "'充电电流 要求'", "'前言'", "p_name", "'逆变器 保护'", "'控制时序 状态转换'", "'GB/T 18487.1 定义'")
_PARAMETER = pick(_B, "'等效电阻^a'", "'电压（V）'", "'占空比'", "'CC1'", "''")
_SYMBOL = pick(_A, "'R2'", "'CP'", "'CC1'", "'PWM'", "'I'", "''")
_TABLE = pick(_C, "'表 A.4'", "'表 A.7'", "''", "'表 B . 2'")
_TAGS = pick(_B, "'\"CC1\"'", "'\"检测点 1\",\"x\"'", "''", "'\"PWM\"'")
_UNIT = pick(_B, "'Ω'", "'V'", "'%'")

#: Columns of a candidate, by name.
CANDIDATE = {
    "query_id": "CAST(p_partkey % 10 AS INTEGER)",
    "result_id": "concat('P', p_partkey)",
    "score": "CAST(p_size AS DOUBLE) / 64",
    "result_type": pick(_C, "'fact'", "'fact'", "'wiki'", "'fact'", "'evidence'", "'fact'", "'document'"),
    "snippet": f"concat({_HEAD}, ' ', p_name, ' ', {_SYMBOL})",
    "fact_type": pick(_B, "'term_definition'", "'parameter_value'", "'table_requirement'", "'process_fact'", "'transition_fact'", "'requirement'", "'threshold'", "'section_heading'", "'document_abstract'", "'parameter_value'", "NULL"),
    "payload": f"""concat('{{"title":"', {_HEAD}, '","parameter":"', {_PARAMETER}, '","symbol":"', {_SYMBOL}, '","object":"', {pick(_A, "'车辆'", "''", "'状态'")}, '","unit":"', {_UNIT}, '","table_title":"', {_TABLE}, '","row_focus_tags":[', {_TAGS}, '],"text":"', p_name, ' ', {pick(_C, "'PWM 标称值'", "'基本实践'", "'shall 12V'", "'试验方法及步骤 施加'", "'状态 9V'")}, '"}}')""",
    "page_type": pick(_B, "'term'", "'process'", "'document'", "'constraint'", "NULL"),
    "title": _HEAD,
    "filename": pick(_C, "'GB/T 18487.1-2015 控制导引.pdf'", "'OBC manual.pdf'", "concat(p_type, '.pdf')", "NULL", "'blue ring.md'"),
    "overall_score": pick(_A, "0.4", "1.5", "NULL"),
    "high_risk_pages": "p_size % 9",
    "blocked_pages": "p_partkey % 4",
    "routing_priority": pick(_B, "0.5", "NULL", "1.0"),
    "relation": pick(_C, "'defines_term'", "'has_parameter_topic'", "NULL", "'has_requirement'", "'mentions'"),
    "trust": pick(_A, "'strong'", "'weak'", "NULL"),
}
_ROWS = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in CANDIDATE.items()) + " FROM part"


def candidates(t: Tables) -> DataFrame:
    """Each candidate with its question's columns; ten questions are a small side."""
    asked = t.spark.createDataFrame(QUESTIONS, _Q)
    parts = t.part.repartition("p_partkey")  # a small file is few tasks, but what is scored of a row is much
    return parts.selectExpr(*(f"{e} AS {n}" for n, e in CANDIDATE.items())).join(F.broadcast(asked), "query_id")  # ten rows


# ---- plain forms of what a question says, and SQL about candidates --------------------------------


def plain(s: str) -> str:
    return re.sub(r"[_/\s]+", "", s.lower().replace("—", "-"))


def norm(c: str) -> str:
    return rf"regexp_replace(replace(lower({c}), '—', '-'), '[_/\s]+', '', 'g')"


def flat(c: str) -> str:
    return rf"regexp_replace(lower({c}), '\s+', '', 'g')"


def has(text: str, *terms: str) -> str:
    """SQL: whether a text has one of the terms (given normalised)."""
    own = [f"coalesce(contains({text}, {quoted(x)}), false)" for x in terms if x]
    return "(" + (" OR ".join(own) or "false") + ")"


def points(*parts: tuple[str, float]) -> str:
    return "(" + " + ".join(f"CASE WHEN {c} THEN {v} ELSE 0 END" for c, v in parts) + ")"


def tables_of(s: str) -> set[str]:
    return {re.sub(r"[表\s]", "", x.replace("．", ".")) for x in re.findall(r"表\s*[A-Z]\s*[.．]\s*\d+", s.upper())}


def tables_sql(c: str) -> str:
    return rf"list_transform(regexp_extract_all(upper({c}), '表\s*[A-Z]\s*[.．]\s*\d+'), lambda x: regexp_replace(replace(x, '．', '.'), '[表\s]', '', 'g'))"


def field(name: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(trim(json_extract_string(payload, '$.{name}')), '\^[A-Za-z0-9]+', '', 'g'), '[（(][^)）]*[)）]', '', 'g'), ' *:：;；,，')"


def fields_sql(question: str, upper_only: bool = False) -> dict[str, str]:
    asked, acronyms = plain(question), re.findall(r"(?<![A-Za-z0-9])([A-Z]{2,})(?![A-Za-z0-9])", question)

    def named(c: str) -> str:
        k = norm(c)
        return rf"({k} <> '' AND {k} NOT IN ({quoted(*K.GENERIC)}) AND NOT regexp_full_match({k}, '[a-z0-9+\-/''_.]{{1,2}}') AND contains({quoted(asked)}, {k}))"

    words = sorted({w for n in range(1, 13) for i in range(len(question) - n + 1) if re.fullmatch(r"[A-Za-z0-9]+", w := question[i : i + n]) and not re.match(r"[A-Za-z0-9]", question[i + n : i + n + 1]) and not re.match(r"[A-Za-z0-9]", question[i - 1 : i] if i else "")})
    alone = f"(length({field('symbol')}) >= 2 AND lower({field('symbol')}) IN ({quoted(*[w.lower() for w in words] or ['-'])}))"
    symbol = alone if upper_only or not acronyms else f"(length({field('symbol')}) >= 2 AND CASE WHEN regexp_full_match({field('symbol')}, '[A-Za-z]{{2,}}') THEN {field('symbol')} IN ({quoted(*acronyms)}) ELSE {alone} END)"
    cc = bool(re.search(r"(?<![A-Z0-9])CC(?![A-Z0-9])", question.upper()))
    known = {"CC1": plain("CC1") in asked or cc, "检测点 1": plain("检测点 1") in asked, "x": False, "PWM": bool(re.search(r"(?<![A-Z0-9])PWM(?![A-Z0-9])", question.upper())) or "pwm" in asked}
    hit = [t for t, ok in known.items() if ok]
    tag = f"len(list_intersect(CAST(json_extract(payload, '$.row_focus_tags') AS VARCHAR[]), [{quoted(*hit)}])) > 0" if hit else "false"
    return {"parameter": named(field("parameter")), "symbol": symbol, "object": named(field("object")), "row": f"({tag})"}


def one(q: tuple) -> dict[str, str]:
    """SQL of the thirteen components for one question."""
    _, kind, question, normal, target, must, should, aliases, protected, anchor = q
    text, said = norm("snippet"), " ".join([question, normal, target, " ".join(must), " ".join(protected)])
    exact = has(text, plain(normal))
    lexical = " + ".join(f"CASE WHEN {has(text, plain(x))} THEN {0.08 if x in must else 0.04} ELSE 0 END" for x in must + should)
    align = f"CASE result_type {' '.join(f'WHEN {quoted(r)} THEN {v}' for r, v in K.ALIGNMENT[kind].items())} ELSE 0 END" if kind in K.ALIGNMENT else "0"
    about, body = bool(re.search(K.CHARGER_ASKED, said)), norm("payload")
    right, wrong = has(text, *map(plain, K.CHARGER)), has(text, *map(plain, K.INVERTER))
    file = norm("coalesce(filename, '')")
    requested = tables_of(" ".join([question, normal, target, *must, *should, *aliases]))
    there = tables_sql("payload")
    match = f"(len(list_intersect({there}, [{quoted(*requested)}])) > 0)" if requested else "false"
    mismatch = f"(len({there}) > 0 AND NOT {match})" if requested else "false"
    f = fields_sql(said)
    direct = f"({f['parameter']} OR {f['symbol']} OR {f['row']})"
    matched = "(" + (" + ".join(f"CAST({has(body, plain(a))} AS INTEGER)" for a in anchor) or "0") + ")"
    resist = rf"CASE WHEN regexp_matches(payload, '(?i)电阻|阻值|等效电阻|Ω|欧姆|ohm|resistance') OR {field('unit')} = 'Ω' OR regexp_matches({field('symbol')}, '(?i)^R\d') THEN 0.72 ELSE -0.85 END" if re.search(K.RESISTANCE_ASKED, said) else "0"
    value = points(("true", 0.38), (match, 0.95), (mismatch, -1.05), (f["parameter"], 1.15), (f["symbol"], 1.05), (f["row"], 0.45), (f["object"], 0.45), (f"{'true' if requested else 'false'} AND {f['object']} AND NOT {direct}", -0.18))
    value += f" + CASE WHEN {matched} > 0 AND NOT {direct} THEN least(0.35, 0.12 * {matched}) ELSE 0 END"
    table = points((match, 0.55), (mismatch, -0.85)) + f" + CASE WHEN {matched} > 0 THEN least(0.5, 0.18 * {matched}) ELSE 0 END"
    focus = [has(body, *map(plain, ws)) for w, ws in K.FOCUS if w in question]
    focus = f"least(0.56, {points(*((c, 0.28) for c in focus))})" if focus else "0"
    t = plain(target)
    names = [t, t.replace("测试", "验证"), t.replace("验证", "测试"), t.replace("过程域", ""), t.replace("过程", "")]
    named, practice, life = has(body, *names), rf"regexp_matches(payload, '{K.PRACTICE}')", kind == "lifecycle_lookup"
    flat_practice = f"regexp_matches({body}, '{K.PRACTICE[:-2]}([^0-9A-Za-z_一-鿿]|$)')"  # a letter of any script after the number goes on with the word
    if kind == "parameter_lookup":
        fact = f"CASE fact_type WHEN 'parameter_value' THEN {value} + {resist} WHEN 'table_requirement' THEN {table} + {resist} WHEN 'term_definition' THEN CASE WHEN {matched} > 0 THEN 0.08 ELSE -0.12 END WHEN 'process_fact' THEN -0.18 WHEN 'transition_fact' THEN -0.18 WHEN 'section_heading' THEN -0.18 ELSE 0 END"
    else:
        special = ""
        if kind in ("lifecycle_lookup", "timing_lookup"):
            process = f"CASE WHEN {practice} THEN 0.55 + {focus} ELSE -0.18 END" if life else "0.55"
            special = f"WHEN 'process_fact' THEN {process} WHEN 'table_requirement' THEN CASE WHEN {flat_practice} THEN 0.62 + {focus} WHEN {named} THEN 0.3 ELSE 0.05 END WHEN 'section_heading' THEN CASE WHEN {named} THEN 0.22 ELSE -0.12 END WHEN 'transition_fact' THEN {-0.12 if life else 0.35}"
        if kind == "test_method_lookup":
            wanted = [plain(x) for x in [normal, target, *must, *should, *aliases]] + [plain(x) for x in (("输入过、欠压", "交流输入过、欠压", "过压保护试验") if "输入过压" in normal + target else ())]
            tests = points(("true", 0.35), (f"{has(body, '试验', '测试', '测量', '检测')} AND {has(body, '试验方法及步骤', '按照图', '接好试验电路', '调节', '测量', '观察')}", 0.65), (has(body, *wanted), 0.45))
            special = f"WHEN 'process_fact' THEN {tests} WHEN 'requirement' THEN -0.08 WHEN 'threshold' THEN -0.08 WHEN 'table_requirement' THEN -0.08 WHEN 'section_heading' THEN 0.08"
        fact = f"CASE fact_type {special} WHEN 'term_definition' THEN 0.45 WHEN 'document_abstract' THEN 0.18 WHEN 'section_heading' THEN CASE WHEN {norm('title')} = {quoted(t)} THEN 0.12 ELSE -0.24 END WHEN 'requirement' THEN -0.28 WHEN 'threshold' THEN -0.28 WHEN 'table_requirement' THEN -0.28 WHEN 'parameter_value' THEN -0.28 WHEN 'process_fact' THEN -0.28 WHEN 'transition_fact' THEN -0.28 ELSE 0 END"
    page = f"CASE page_type WHEN 'term' THEN 0.28 WHEN 'document' THEN 0.08 WHEN 'process' THEN CASE WHEN {has(norm('title'), t)} THEN -0.08 ELSE -0.24 END WHEN 'constraint' THEN CASE WHEN {has(norm('title'), t)} THEN -0.08 ELSE -0.24 END ELSE 0 END"
    subtype = f"CASE result_type WHEN 'fact' THEN {fact} WHEN 'wiki' THEN {page} ELSE 0 END" if kind in ("definition", "lifecycle_lookup", "timing_lookup", "test_method_lookup", "parameter_lookup") else "0"
    return {
        "base": "score", "lexical": lexical, "exact_match": f"CASE WHEN {exact} THEN 0.18 ELSE 0 END",
        "standard_match": f"CASE WHEN {has(text, *map(plain, must))} THEN 0.22 ELSE 0 END" if kind in ("standard_lookup", "lifecycle_lookup") else "0",
        "term_match": f"CASE WHEN {exact} THEN 0.2 ELSE 0 END" if kind == "definition" else "0",
        "object_anchor": f"CASE WHEN {right} THEN 1.0 WHEN {has(file, *map(plain, K.CHARGER))} THEN 0.2 ELSE 0 END" if about else "0",
        "alignment": align, "subtype": subtype,
        "document_title": f"CASE WHEN {has(file, plain(normal))} THEN 0.12 WHEN {has(file, *map(plain, must))} THEN 0.08 ELSE 0 END",
        "routing": "coalesce(routing_priority, 0) * 0.08", "quality": "coalesce(least(overall_score * 0.05, 0.05), 0)",
        "risk": "least(high_risk_pages * 0.01 + blocked_pages * 0.05, 0.2)", "object_anchor_penalty": f"CASE WHEN {wrong} AND NOT {right} THEN 1.35 ELSE 0 END" if about and "逆变" not in said else "0",
    }


def per_question(select) -> str:
    """SQL: the union over questions of `select(question)` with a WHERE of its own."""
    return f"WITH c AS ({_ROWS}) " + " UNION ALL ".join(f"SELECT {select(q)} FROM c WHERE query_id = {q[0]}" for q in QUESTIONS)


def _rounded(q: tuple, *names: str) -> str:
    own = one(q)
    return "query_id, result_id, " + ", ".join(f"round(CAST({own[n]} AS DOUBLE), 6) AS {n}" for n in names)


def _some(t: Tables, *names: str) -> DataFrame:
    parts = K.components()
    return candidates(t).select("query_id", "result_id", *(F.round(parts[n].cast("double"), 6).alias(n) for n in names))


@query("i25_term_components", per_question(lambda q: _rounded(q, "lexical", "exact_match", "standard_match", "term_match")))
def i25(t: Tables) -> DataFrame:
    return _some(t, "lexical", "exact_match", "standard_match", "term_match")


@query("i26_alignment_matrix", per_question(lambda q: _rounded(q, "alignment", "routing")))
def i26(t: Tables) -> DataFrame:
    return _some(t, "alignment", "routing")


@query("i27_subtype_bonus", per_question(lambda q: _rounded(q, "subtype")))
def i27(t: Tables) -> DataFrame:
    return _some(t, "subtype")


@query("i28_object_anchor", per_question(lambda q: _rounded(q, "object_anchor", "object_anchor_penalty")))
def i28(t: Tables) -> DataFrame:
    return _some(t, "object_anchor", "object_anchor_penalty")


@query("i29_document_bonus", per_question(lambda q: _rounded(q, "document_title", "quality", "risk")))
def i29(t: Tables) -> DataFrame:
    return _some(t, "document_title", "quality", "risk")


def _final(q: tuple) -> str:
    own = one(q)
    total = " + ".join(f"CAST({own[n]} AS DOUBLE)" for n in ("base", *K.BONUSES)) + " - " + " - ".join(f"CAST({own[n]} AS DOUBLE)" for n in K.PENALTIES)
    return f"query_id, result_id, round({total}, 6) AS final"


@query("i24_thirteen_components", f"SELECT query_id, result_id, final FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, result_id) AS n FROM ({per_question(_final)})) WHERE n <= 20")
def i24(t: Tables) -> DataFrame:
    return K.rerank(candidates(t), 20).select("query_id", "result_id", "final")


# ---- shapes ------------------------------------------------------------------------------------


def asks(q: str) -> dict[str, bool]:
    signal, timing, test = bool(re.search("PWM", q, re.I) and re.search(r"[+-]?\d+(?:\.\d+)?\s*V", q, re.I)), bool(re.search(S.TIMING_ASKED, q)), bool(re.search(S.TEST_ASKED, q))
    process = bool(re.search(rf"\b(?:{R.PROCESSES})\.\d+\b", q, re.I) or (re.search(S.TOPIC_ASKED, q) and re.search(S.ACTIVITY_ASKED, q)))
    parameter = not test and bool(re.search(S.PARAMETER_ASKED, q))
    term = not (signal or timing or process or parameter) and bool(re.search(S.TERM_ASKED, q))
    return dict(zip(S.SHAPES, (signal, timing, process, test, parameter, term, not (test or parameter or process) and bool(re.search(S.REQUIREMENT_ASKED, q))), strict=True))


def tokens_of(q: str) -> list[str]:
    out = ["控制导引" if w.upper() == "CP" else w.upper() for w in re.findall(r"(?<![A-Za-z0-9.])([A-Z]{2,8}\d*)(?![A-Za-z0-9.])", q, re.I)] + re.findall(r"(检测点\s*\d+|[A-Z]{1,8}阻值|[A-Z]{1,8}占空比)", q, re.I)
    return [re.sub(r"\s+", "", x.lower()) for x in dict.fromkeys(out)][:8]


def anchors_of(q: str) -> list[str]:
    out = []
    for p in (r"([+-]?\d+(?:\.\d+)?\s*V)", r"(?<![A-Za-z0-9.])([A-Z]{2,6}\d*)(?![A-Za-z0-9.])", r"(检测点\s*\d+)", r"(表\s*[A-Z]\s*[.．]\s*\d+|表\s*\d+(?:\.\d+)*)"):
        out += [{"OBC": "车载充电机", "CP": "控制导引"}.get(x.upper(), x) for x in re.findall(p, q, re.I)]
    a = asks(q)
    out += ["PWM"] * bool(re.search("PWM", q, re.I)) + ["控制导引"] * bool(re.search(r"(?<!\w)CP(?!\w)|控制导引", q, re.I)) + ["状态", "电压"] * a["signal_state_table"] + ["时序", "控制时序", "状态转换"] * a["timing_table"]
    return list(dict.fromkeys(out))[:16]


def value_sql(question: str) -> str:
    f, requested = fields_sql(question, upper_only=True), tables_of(question)
    there = tables_sql("json_extract_string(payload, '$.table_title')")
    match = f"(len(list_intersect({there}, [{quoted(*requested)}])) > 0)" if requested else "false"
    mismatch = f"(len({there}) > 0 AND NOT {match})" if requested else "false"
    direct = f"({f['parameter']} OR {f['symbol']} OR {f['row']})"
    return f"greatest(0, {points(('true', 0.75), (match, 0.45), (mismatch, -0.6), (f['parameter'], 1.1), (f['symbol'], 0.9), (f['row'], 0.45), (f['object'], 0.35), (f'coalesce(relation, {quoted(chr(32).strip())}) IN ({quoted(*S.PARAMETER_RELATIONS)}) AND {direct}', 0.25))})"


def shape_sql(question: str) -> dict[str, tuple[str, str]]:
    """SQL (is it, its score) of each shape of a candidate whose text is `payload`."""
    s, ok = flat("payload"), f"NOT {has(flat('payload'), '前言', '目次', '目录')}"
    volts = re.search(r"([+-]?\d+(?:\.\d+)?)\s*V", question, re.I)
    plain_state = f"({has(s, 'pwm')} AND {has(s, '电压')} AND {has(s, '状态')})"
    exact = f"({plain_state} AND {has(s, volts[1])} AND {has(s, '检测点1', '表a.4')})" if volts else "false"
    named = has(s, *tokens_of(question)) if tokens_of(question) else "true"
    codes = {f"{a.upper()}.{b}" for a, b in re.findall(rf"\b({R.PROCESSES})\.(\d+)\b", question, re.I)}
    same = f"len(list_intersect(regexp_extract_all(upper(payload), '\\b(?:{R.PROCESSES})\\.\\d+\\b'), [{quoted(*codes)}])) > 0" if codes else "true"
    process = f"({ok} AND regexp_matches(payload, '(?i)\\b(?:{R.PROCESSES})\\.\\d+\\.BP\\s*\\d+\\b') AND {has(s, *S.PRACTICE_WORDS)} AND {same})"
    topics = [has(s, *v) for k, v in S.OVERVOLTAGE.items() if k in question]
    charger = has(s, *(x.lower().replace(" ", "") for x in K.CHARGER)) if re.search(K.CHARGER_ASKED, question) else "true"
    test = f"({ok} AND {has(s, *S.TEST_WORDS)} AND {has(s, *S.STEP_WORDS)} AND {' OR '.join(topics) or 'true'} AND {charger})"
    timing = f"({ok} AND {has(s, '表a.7', '控制时序', '状态转换')} AND {has(s, '时序', '状态')})"
    parameter, term, need = (f"({ok} AND {named} AND {has(s, *words)})" for words in (S.PARAMETER_WORDS, S.TERM_WORDS, S.REQUIREMENT_WORDS))
    kind, link = "coalesce(fact_type, '')", "coalesce(relation, '')"
    return {
        "signal_state_table": (exact, f"(CASE WHEN {exact} THEN 1.8 WHEN {plain_state} THEN 0.9 ELSE 0 END + CASE WHEN {has('payload', '表 A.4', '检测点 1 的电压状态')} THEN 0.9 ELSE 0 END + CASE WHEN {has('payload', '表 A.7')} THEN 0.15 ELSE 0 END)"),
        "timing_table": (timing, f"CASE WHEN {timing} THEN 1.9 ELSE 0 END"),
        "process_activity": (process, f"CASE WHEN {process} THEN 1.35 ELSE 0 END"),
        "test_method": (test, f"CASE WHEN {test} THEN {points(('true', 1.35), (kind + ' = ' + quoted('process_fact'), 0.45), (has(s, '试验方法及步骤'), 0.25))} ELSE 0 END"),
        "parameter_definition": (parameter, f"CASE WHEN NOT {parameter} THEN 0 WHEN {kind} = 'parameter_value' THEN {value_sql(question)} WHEN {link} IN ({quoted(*S.PARAMETER_RELATIONS)}) THEN 1.45 WHEN {kind} = 'table_requirement' THEN 1.05 ELSE 0.7 END"),
        "term_definition": (term, f"CASE WHEN NOT {term} THEN 0 WHEN {link} = 'defines_term' THEN 1.4 WHEN {kind} = 'term_definition' THEN 1.05 ELSE 0.65 END"),
        "requirement": (need, f"CASE WHEN NOT {need} THEN 0 WHEN {kind} IN ('requirement', 'table_requirement') THEN 1.25 WHEN contains({link}, 'requirement') THEN 1.0 ELSE 0.65 END"),
    }


def shape_candidates(t: Tables) -> DataFrame:
    return candidates(t).withColumn("blob", F.col("payload"))


@query("i34_evidence_shapes", per_question(lambda q: "query_id, result_id, " + ", ".join(f"round(CAST({v} AS DOUBLE), 6) AS {s}" for s, (_, v) in shape_sql(q[2]).items())))
def i34(t: Tables) -> DataFrame:
    own = S.scores(F.col("question"), F.col("blob"), F.col("fact_type"), F.col("relation"))
    return shape_candidates(t).select("query_id", "result_id", *(F.round(c.cast("double"), 6).alias(s) for s, c in own.items()))


@query("i35_parameter_shape", per_question(lambda q: f"query_id, result_id, round(CAST({value_sql(q[2])} AS DOUBLE), 6) AS score"))
def i35(t: Tables) -> DataFrame:
    return shape_candidates(t).select("query_id", "result_id", F.round(S.parameter_value(F.col("question"), F.coalesce("relation", F.lit(""))), 6).alias("score"))


def _judged_one(q: tuple) -> str:
    """SQL of the judgement of one question's candidates."""
    i, kind, question = q[:3]
    a, contract, anchors, each = asks(question), S.CONTRACTS.get(kind, ()), anchors_of(question), shape_sql(question)
    accepted = ("term_definition",) if kind == "definition" and not a["parameter_definition"] else contract
    on = [s for s in S.SHAPES if a[s] or s in contract]
    hit = {x: has(flat("payload"), re.sub(r"\s+", "", x.lower())) for x in anchors}
    total = " + ".join([f"0.22 * CAST({h} AS INTEGER)" for h in hit.values()] + [each[s][1] for s in on] + ["CASE WHEN kind = 'fact' AND coalesce(trust, '') = 'strong' THEN 1.05 ELSE 0 END", "CASE WHEN kind = 'fact' AND coalesce(fact_type, '') = 'table_requirement' THEN 0.18 ELSE 0 END"])
    needs_hit = ("test_method", "parameter_definition", "term_definition", "requirement")
    columns = [f"{h} AS a{k}" for k, h in enumerate(hit.values())]
    for s in S.SHAPES:
        live = f"({each[s][1]}) > 0" if s in on else "false"
        columns += [f"({live}) AS h_{s}", (f"(({live}) AND {each[s][0]})" if s in needs_hit and s in on else each[s][0] if s in on else "false") + f" AS s_{s}"]
    rows = f"SELECT *, row_number() OVER (ORDER BY points DESC, kind, result_id) AS place FROM (SELECT kind, result_id, round(CAST({total} AS DOUBLE), 6) AS points, {', '.join(columns)} FROM k WHERE query_id = {i} AND NOT {has(flat('payload'), '前言', '目次', '目录')})"
    best, live = "place <= 5", "place <= 5 AND points > 0"
    found = "[" + ", ".join(f"CASE WHEN coalesce(bool_or(a{k}) FILTER ({live}), false) THEN {quoted(x)} END" for k, x in enumerate(anchors)) + "]"
    counts = ", ".join(f"count(*) FILTER ({live} AND h_{s}) AS n_{s}, count(*) FILTER (h_{s}) AS c_{s}, coalesce(bool_or(s_{s}) FILTER ({best}), false) AS d_{s}" for s in S.SHAPES)
    per = f"SELECT max(points) AS top_score, list_filter({found}, lambda x: x IS NOT NULL) AS found, {counts} FROM ({rows})"
    order = "list_sort(list_filter([" + ", ".join(f"CASE WHEN n_{s} > 0 THEN {{'n': -n_{s}, 's': {quoted(s)}}} END" for s in S.SHAPES) + "], lambda x: x IS NOT NULL))"
    shape = f"coalesce(list_filter({order}, lambda x: x.s IN ({quoted(*accepted or ['-'])}))[1].s, {order}[1].s)"
    shaped = " OR ".join(f"d_{s}" for s in accepted) or " AND ".join(f"d_{s}" for s in on) or "true"
    missing = f"len([{quoted(*anchors)}]) - len(found)" if anchors else "0"
    insists = bool(contract) and kind not in S.OPTIONAL
    enough = f"top_score >= 1.1 AND {missing} <= {len(anchors) // 3} AND ({shaped})" + (f" AND coalesce(shape IN ({quoted(*accepted)}), false)" if insists else "")
    implied = [s for s in S.SHAPES if a[s]]
    if not contract:
        why = "'contract_not_defined'"
    elif implied and not set(implied) & set(contract):
        why = "'contract_query_type_wrong'"
    else:
        why = f"CASE WHEN shape IN ({quoted(*contract)}) THEN 'contract_matched' WHEN {' OR '.join(f'c_{s} > 0' for s in contract)} THEN 'contract_rerank_suppressed_shape' WHEN {' OR '.join(f'c_{s} > 0' for s in S.SHAPES)} THEN 'contract_wrong_shape' ELSE 'contract_parse_gap' END"
    lost = f"array_to_string(list_sort(list_filter([{quoted(*anchors)}], lambda x: NOT list_contains(found, x))), ',')" if anchors else "''"
    return f"SELECT {i} AS query_id, top_score, array_to_string(list_sort(found), ',') AS found, {lost} AS missing, shape, {enough} AS sufficient, round(least(0.95, greatest(0, top_score / 1.8)), 3) AS confidence, {why} AS diagnosis FROM (SELECT *, {shape} AS shape FROM ({per}))"


@query("i33_evidence_judge", f"WITH c AS ({_ROWS}), k AS (SELECT *, CASE WHEN result_type = 'fact' THEN 'fact' ELSE 'evidence' END AS kind FROM c) " + " UNION ALL ".join(_judged_one(q) for q in QUESTIONS))
def i33(t: Tables) -> DataFrame:
    rows = shape_candidates(t).withColumn("kind", F.when(F.col("result_type") == "fact", "fact").otherwise("evidence")).withColumn("item_id", F.col("result_id"))
    out = S.judged(rows)
    return out.select("query_id", "top_score", F.array_join("found", ",").alias("found"), F.array_join("missing", ",").alias("missing"), "shape", "sufficient", "confidence", "diagnosis")
