"""Direct hits: facts that a question's own terms, codes and standards find, beside what channels retrieve.

Rows carry their question's columns, as in `lodestone.operators.reranking`; each function returns hits
(query_id, result_id, score, channel and the rows' own columns).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import rules as R
from lodestone.operators import answers as A
from lodestone.operators import reranking as K
from lodestone.operators.ranking import keep_best, top_per_group

# Kinds of facts that terms find directly, codes that are no acronym of a term, and what a process is called.
DIRECT = ("requirement", "table_requirement", "threshold", "parameter_value", "process_fact", "transition_fact", "section_heading")
NO_ACRONYM = ("GB", "GBT", "ISO", "IEC", "QC")
GENERIC = ("requirement", "requirements", "shall", "要求")
CODE = r"(?i)\b(?:SYS|SWE|SUP|MAN|HWE|VAL|REU|PIM)\.\d+\b"
STANDARD = r"(?i)(?:GB/T|GBT|GB|ISO/IEC|ISO|IEC|QC/T|QCT|QC)\s*[\d.]+(?:[.\-—:]\d+)*"


def _like(text: Column, term: Column) -> Column:
    """Whether a text has a term, whatever the case of ASCII letters."""
    return F.contains(F.lower(text), F.lower(term))


def fragments(term: Column) -> Column:
    """The pairs of neighbouring CJK characters of a term, gaps removed."""
    s = F.regexp_replace(term, "[^一-鿿]", "")
    return F.when(F.length(s) >= 2, F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.substring(s, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def _filled(terms: Column) -> Column:
    return F.array_distinct(F.filter(terms, lambda t: F.coalesce(t, F.lit("")) != ""))


def test_variants() -> Column:
    """Other names of what a question for a test method names."""
    said = F.concat_ws(" ", "question", "normalized_query", "target_topic", F.array_join("must_terms", " "), F.array_join("should_terms", " "), F.array_join("aliases", " "))
    names = lambda c, *words: F.when(c, F.array(*map(F.lit, words))).otherwise(F.array().cast("array<string>"))
    return F.concat(names(F.contains(said, F.lit("输入过压")), "输入过压", "输入过、欠压", "交流输入过、欠压", "过压保护试验"), names(said.rlike(r"(?i)\bOBC\b|车载充电机|on-?board charger"), "车载充电机", "电动汽车用传导式车载充电机", "on-board charger"))


def search_terms(most: int = 6) -> Column:
    """The first terms of a question: those that must be there, other names, those that should, the question itself, and
    pieces of the first."""
    pieces = F.flatten(F.transform("must_terms", fragments))
    return F.slice(_filled(F.concat("must_terms", test_variants(), "should_terms", F.array("normalized_query"), pieces)), 1, most)


def direct_score(term: Column) -> Column:
    """What a fact's confidence, type, words and codes say to a question whose term found it."""
    kind, fact, blob = F.col("query_type"), F.col("fact_type"), F.coalesce("payload", F.lit(""))
    flat = R.blob_key(blob)
    practice = blob.rlike(K.PRACTICE)
    is_test = A._any(flat, ("试验", "测试", "测量", "检测")) & A._any(flat, ("试验方法及步骤", "按照图", "接好试验电路", "调节", "测量", "观察"))
    process = F.when(fact == "process_fact", F.when((kind == "lifecycle_lookup") & ~practice, 0.5).otherwise(1.25)).when(fact == "table_requirement", 0.85).when(fact == "section_heading", 0.65).otherwise(0.0)
    activity = F.when(fact.isin("table_requirement", "section_heading"), 0.9).when(fact == "process_fact", 0.65).otherwise(0.0)
    test = F.when(fact == "process_fact", F.when(is_test, 1.9).otherwise(1.15)).when(fact == "section_heading", 0.25).otherwise(0.0)
    typed = F.when(kind.isin("lifecycle_lookup", "timing_lookup"), process).when((kind == "definition") & F.col("question").rlike("过程域|过程|活动|任务|步骤"), activity).when(kind == "test_method_lookup", test).otherwise(0.0)
    key = R.blob_key(term)
    variants = F.size(F.filter(test_variants(), lambda v: F.contains(flat, R.blob_key(v)))) * 0.25
    return F.round(F.greatest(F.lit(0.85), F.coalesce("confidence", F.lit(0.0))) + typed + F.when((key != "") & F.contains(flat, key), 0.35).otherwise(0.0) + variants + F.when(blob.rlike(CODE), 0.25).otherwise(0.0), 6)


def facts(candidates: DataFrame, k: int) -> DataFrame:
    """The k best facts of each question that have one of its search terms, scored by the first that they have."""
    found = F.filter(search_terms(), lambda t: _like(F.col("payload"), t))
    rows = candidates.filter(F.col("fact_type").isin(*DIRECT)).withColumn("__terms", found).filter(F.size("__terms") > 0)
    rows = rows.withColumn("score", direct_score(F.get("__terms", 0))).withColumn("channel", F.lit("facts")).drop("__terms")
    return top_per_group(rows, ["query_id"], k, F.desc("score"), "result_id")


def siblings(hits: DataFrame, candidates: DataFrame, top: int = 12, codes: int = 3) -> DataFrame:
    """Facts of the processes whose practices a question's `top` best hits name (its first `codes` processes): found by an
    equi-join on the process code; better of a hit and a sibling stays."""
    best = top_per_group(hits, ["query_id"], top, F.desc("score"), "result_id")
    named = lambda c: F.array_distinct(F.transform(F.regexp_extract_all(F.upper(c), F.lit(r"\b((?:SYS|SWE|SUP|MAN|HWE|VAL|REU|PIM)\.\d+)\.BP\d+\b"), F.lit(1)), lambda x: x))
    seen = best.select("query_id", "score", "result_id", F.posexplode(named(F.col("snippet"))).alias("at", "code")).groupBy("query_id", "code").agg(F.max("score").alias("score"), F.min("result_id").alias("first"))
    wanted = top_per_group(seen, ["query_id"], codes, F.desc("score"), "first", "code").select("query_id", "code")
    rows = candidates.filter(F.col("fact_type").isin("process_fact", "table_requirement")).withColumn("code", F.explode(named(F.col("payload"))))
    score = F.greatest(F.lit(0.85), F.coalesce("confidence", F.lit(0.0))) + F.when(F.col("fact_type") == "process_fact", 1.45).otherwise(1.36) + F.when(F.col("payload").rlike("[一-鿿]"), 0.2).otherwise(0.0)
    more = rows.join(wanted, ["query_id", "code"]).select("query_id", "result_id", F.round(score, 6).alias("score")).distinct()
    return keep_best(hits.select("query_id", "result_id", "score").unionByName(more), ["query_id", "result_id"], F.desc("score"))


def standards(candidates: DataFrame) -> DataFrame:
    """Facts that are the standard a question names, with or without its year: 0.99 at least."""
    asked, own = R.standard_code(F.regexp_extract("question", STANDARD, 0)), R.standard_code(F.coalesce(F.get_json_object("payload", "$.value"), F.lit("")))
    fits = (asked != "") & ((own == asked) | F.startswith(own, F.concat(asked, F.lit("—"))))
    rows = candidates.filter((F.col("fact_type") == "document_standard") & fits)
    return rows.withColumn("score", F.greatest(F.lit(0.99), F.coalesce("confidence", F.lit(0.0)))).withColumn("channel", F.lit("exact_standard"))


def definitions(candidates: DataFrame, k: int) -> DataFrame:
    """Definitions for a question for one: by acronym 2.4 (3.6 for the connection of CC), else by the term's place in the
    defined name: 3.6 at its start, 3.2 in a short name, 3.0 in a long one, 2.6 elsewhere."""
    names = _filled(F.concat(F.array("target_topic", "normalized_query"), "must_terms", "protected_terms"))
    short = F.array_distinct(F.filter(F.transform(names, lambda t: F.upper(F.trim(t))), lambda t: t.rlike("^[A-Z]{2,6}$") & ~t.isin(*NO_ACRONYM)))
    blob, term = F.col("payload"), F.coalesce(F.get_json_object("payload", "$.term"), F.lit(""))
    hit = lambda a: F.contains(blob, F.concat(F.lit("; "), a)) | F.contains(blob, F.concat(F.lit("；"), a))
    by_acronym = F.filter(F.slice(short, 1, 4), hit)
    plain = F.trim(F.replace(term, F.lit("*"), F.lit("")))
    tier = lambda t: F.when(F.startswith(plain, t), 3.6).when(F.contains(term, t) & (F.length(plain) <= 40), 3.2).when(F.contains(term, t), 3.0).otherwise(2.6)
    by_term = F.filter(F.slice(names, 1, 6), lambda t: _like(blob, t))
    acronym = F.when(F.array_contains(by_acronym, "CC") & F.contains(blob, F.lit("连接确认")), 3.6).otherwise(2.4)
    score = F.when((F.size(short) > 0) & (F.size(by_acronym) > 0), acronym).when((F.size(short) == 0) & (F.size(by_term) > 0), tier(F.get(by_term, 0)))
    rows = candidates.filter((F.col("query_type") == "definition") & F.col("fact_type").isin("term_definition", "concept_definition")).withColumn("score", score).filter("score is not null")
    return top_per_group(rows.withColumn("channel", F.lit("direct_term_definition")), ["query_id"], k, F.desc("score"), "result_id")


def requirements(candidates: DataFrame, k: int) -> DataFrame:
    """Requirements for a question about limits or parameters: 2.2 with a whole term or keyword (0.3 more if the file's name has
    a term), else 1.5 and 0.2 for each pair of characters of its terms, two at least."""
    terms = F.filter(_filled(F.transform(F.concat(F.array("target_topic", "normalized_query"), "must_terms"), lambda t: F.trim(t))), lambda t: (F.length(t) >= 2) & ~F.lower(t).isin(*GENERIC))
    words = F.flatten(F.transform(terms, lambda t: F.concat(F.regexp_extract_all(t, F.lit("[一-鿿]{2,4}"), F.lit(0)), F.regexp_extract_all(t, F.lit("[A-Z]{2,6}"), F.lit(0)))))
    every = F.slice(F.array_distinct(F.concat(terms, words)), 1, 6)
    pieces = F.array_distinct(F.flatten(F.transform(terms, fragments)))
    blob, file = F.col("payload"), F.lower(F.coalesce("filename", F.lit("")))
    whole = F.exists(every, lambda t: _like(blob, t))
    titled = F.exists(terms, lambda t: F.contains(file, F.lower(t)))
    n = F.size(F.filter(pieces, lambda p: F.contains(blob, p)))
    score = F.when(whole, F.when(titled, 2.5).otherwise(2.2)).when(n >= 2, F.round(1.5 + 0.2 * n, 6))
    rows = candidates.filter(F.col("query_type").isin("constraint", "parameter_lookup") & F.col("fact_type").isin("requirement", "threshold", "table_requirement")).withColumn("score", score).filter("score is not null")
    return top_per_group(rows.withColumn("channel", F.lit("direct_requirement")), ["query_id"], k, F.desc("score"), "result_id")


def evidence_points(text: str = "snippet") -> Column:
    """What a piece of evidence says to the question's intent: tables, dates, terms, states; prefaces and metadata of journals
    count against it, the question's own opening for it. Its confidence is not included."""
    s, p, any_ = F.col(text), K._points, A._any
    table = F.contains(F.lower(s), F.lit("<table"))
    front = any_(s, ("目 次", "前    言", "前言"))
    low, cjk, latin = F.lower(s), F.length(F.regexp_replace(s, "[^一-鿿]", "")), F.regexp_count(s, F.lit("[A-Za-z]{4,}"))
    journal = any_(low, ("doi:", "doi :", "keywords", "published online", "hans pub", "hanspub")) | s.rlike(r"[一-鿿]{2,8},\s*\d{4},\s*\d+\(\d+\)\s*,\s*\d+") | ((cjk < 20) & (latin >= 8) & (F.length(s) > 100))
    heading = F.contains(s, F.lit("##"))
    own = A.intent()
    by = (
        F.when(own == "definition", p((heading & any_(s, (" control pilot ", "控制导引电路", "定义", "术语")), 2.5), (heading, 0.5)))
        .when(own == "standard", p((s.rlike(r"\d{4}-\d{2}-\d{2}\s*(?:发布|实施)"), 1.5), (s.rlike(r"\bGB/T\b"), 1.0)))
        .when(own == "parameter", p((table | F.contains(s, F.lit("|")), 1.5), (s.rlike(r"(?i)Ω|电阻|阻值|R\d+|检测点\s*\d|CC1|CC2"), 1.6), (front, -2.0)))
        .when(own == "process", p((table | F.contains(s, F.lit("|")), 1.3), (s.rlike("时序|状态|握手|预充|停机|检测点|控制导引"), 1.8), (front, -2.2)))
        .otherwise(p((table, -1.2), (heading, 0.6), (any_(s, ("定义", "范围", "适用于")), 0.4)))
    )
    opening = F.substring(F.regexp_replace("question", "[？?]", ""), 1, 8)
    return F.round(by + p((journal, -2.5), ((F.col("question") != "") & F.contains(s, opening), 0.8)), 6)


# ---- safety and quality of answers ---------------------------------------------------------------

# Marks of an answer that was not rendered, by name, and phrases of answers that are none.
ARTIFACTS = {
    "html_entity_nbsp": r"(?i)&nbsp;|&#160;|&ensp;|&emsp;", "raw_html_tag": r"(?i)<br\s*/?>|</?(?:p|div|span|table|tr|td|th)\b[^>]*>", "latex_math_delimiter": r"\$[^$]{1,120}\$", "latex_escape_percent": r"\\%",
    "markdown_bold_marker": r"\*\*[^*]{1,120}\*\*", "duplicate_semicolon": "；；|;;", "duplicate_period": "。。", "hard_wrapped_cjk_line": r"[一-鿿]\s*\n\s*[一-鿿]",
}
DEGRADED = ("当前候选证据不足以给出确定性答案", "知识库中未找到", "未找到", "无法回答", "无法给出", "insufficient evidence", "not found")


def artifacts(c: Column) -> Column:
    """The marks that an answer still has, by name."""
    return F.array_compact(F.array(*(F.when(c.rlike(p), F.lit(n)) for n, p in ARTIFACTS.items())))


def answer_attribution(rows: DataFrame) -> DataFrame:
    """Rows (answer, target_doc_present, expected_present, forbidden, mode, expected_mode, shape, expected_shape, fallback, gated, sufficient,
    cited) with `artifacts`, `attribution`, the first thing that is wrong, and `passed`."""
    differs = lambda a, b: F.coalesce((F.col(b) != "") & (F.lower(a) != F.lower(b)), F.lit(False))
    rows = rows.withColumn("artifacts", artifacts(F.coalesce("answer", F.lit(""))))
    why = (
        F.when(~F.col("target_doc_present"), "target_doc_missing").when(F.size("artifacts") > 0, "answer_render_artifact").when(F.col("forbidden") > 0, "forbidden_content").when(~F.col("expected_present"), "expected_answer_missing")
        .when(differs("mode", "expected_mode"), "answer_mode_wrong").when(differs("shape", "expected_shape"), "evidence_shape_wrong").when(F.coalesce("fallback", F.lit("")) != "", "fallback_answer")
        .when(F.col("gated") & ~F.coalesce("sufficient", F.lit(True)), "evidence_not_sufficient").when(~F.col("cited"), "citation_missing").otherwise("ok")
    )
    return rows.withColumn("attribution", why).withColumn("passed", F.col("attribution") == "ok")


def is_title_block(c: Column) -> Column:
    """A short piece that names a standard or its body, or an academic header."""
    s = F.trim(c)
    return ((s != "") & (F.length(s) <= 60) & s.rlike(r"(?i)GB/?T?\s*\d|ISO\s*\d|国家标准|目\s*次|前\s*言")) | s.rlike(r"(?i)doi:|published online|keywords")


def safety(rows: DataFrame) -> DataFrame:
    """Rows (answer, preferred_doc, cited: array of struct doc_id, text) with `reason` and the flags that it raises.

    Refusals are safe; a claim of six CJK characters or more needs evidence that is no title block and is of the answer's
    document."""
    a = F.coalesce("answer", F.lit(""))
    degraded = (F.trim(a) == "") | A._any(F.lower(a), DEGRADED)
    claim = F.length(F.regexp_replace(a, "[^一-鿿]", "")) >= 6
    texts = F.filter(F.transform("cited", lambda x: F.coalesce(x["text"], F.lit(""))), lambda t: t != "")
    docs = F.filter(F.transform("cited", lambda x: x["doc_id"]), lambda d: F.coalesce(d, F.lit("")) != "")
    why = (
        F.when(degraded, "degraded_or_refusal_answer").when(claim & (F.size(texts) == 0), "substantive_claim_no_supporting_evidence")
        .when((F.size(texts) > 0) & F.forall(texts, is_title_block), "citation_only_title_or_header_blocks")
        .when(claim & (F.coalesce("preferred_doc", F.lit("")) != "") & (F.size(docs) > 0) & ~F.array_contains(docs, F.col("preferred_doc")), "citation_doc_mismatch_with_preferred_doc")
        .when(F.size(texts) > 0, "cited_substantive_evidence").otherwise("non_substantive_answer")
    )
    out = rows.withColumn("reason", why)
    is_ = lambda *names: F.col("reason").isin(*names)
    return out.withColumns({"citation_correct": is_("cited_substantive_evidence", "non_substantive_answer"), "unsupported_claim": is_("substantive_claim_no_supporting_evidence"), "title_block_citation": is_("citation_only_title_or_header_blocks"), "degraded_answer": is_("degraded_or_refusal_answer")})
