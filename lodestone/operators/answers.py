"""From candidates to answers: injections, topics, facts ranked by intent, direct answers.

Rows carry their question's columns beside their own, as in `lodestone.operators.reranking`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import rules as R
from lodestone.operators import reranking as K
from lodestone.operators.ranking import keep_best, top_per_group

# The kinds of facts that an intent wants, and the intent of a kind of question.
INTENT_FACTS = {
    "definition": ("term_definition", "concept_definition", "document_abstract"),
    "parameter": ("parameter_value", "table_requirement", "threshold", "requirement", "process_fact", "transition_fact"),
    "constraint": ("requirement", "threshold", "parameter_value", "table_requirement"),
    "process": ("process_fact", "transition_fact", "table_requirement"),
    "standard": ("document_standard", "document_lifecycle", "document_versioning"),
    "comparison": ("comparison_relation", "term_definition", "concept_definition"),
}
INTENTS = {
    "definition": "definition", "parameter_lookup": "parameter", "parameter_meaning": "parameter", "constraint": "constraint", "lifecycle_lookup": "process", "timing_lookup": "process",
    "test_method_lookup": "process", "standard_lookup": "standard", "comparison": "comparison",
}

# What a wiki page's type adds for a kind of question, and what is added without such a rule.
WIKI = {
    ("timing_lookup", "process"): 1.08, ("parameter_lookup", "parameter_group"): 1.08, ("parameter_lookup", "parameter"): 1.16, ("definition", "term"): 1.02, ("definition", "concept"): 1.02,
    ("definition", "document"): 1.02, ("comparison", "term"): 1.0, ("comparison", "concept"): 1.0, ("comparison", "comparison"): 1.08, ("constraint", "constraint"): 1.08,
    ("constraint", "term"): 0.96, ("constraint", "process"): 0.96, ("constraint", "parameter_group"): 0.96,
}
WIKI_ASKED, WIKI_BASE, WIKI_DEFINITION = ("definition", "parameter_lookup", "timing_lookup", "comparison", "constraint"), 0.88, 0.18
NO_ANSWER = "没有找到足够的结构化结果。"


def _any(c: Column, words) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(c, F.lit(w)) for w in words))


def _words() -> Column:
    return F.concat_ws(" ", "question", "normalized_query", "target_topic", F.array_join("must_terms", " "), F.array_join("aliases", " "))


# ---- injections --------------------------------------------------------------------------------


def test_methods(candidates: DataFrame, k: int) -> DataFrame:
    """Facts that answer a question for a test method outright, scored 5.2: processes that name a test and the voltage
    faults, sides and object that the question names; k a question, by confidence."""
    asked, there = _words(), F.col("payload")
    needs = reduce(lambda a, b: a & b, (~F.contains(asked, F.lit(w)) | F.contains(there, F.lit(w)) for w in ("过压", "欠压", "输入", "输出")), F.contains(there, F.lit("试验")))
    charger = ~asked.rlike(r"(?i)\bOBC\b|车载充电机|on-?board charger") | _any(there, ("车载充电机", "电动汽车用传导式车载充电机"))
    hits = candidates.filter((F.col("query_type") == "test_method_lookup") & (F.col("fact_type") == "process_fact") & needs & charger)
    return top_per_group(hits, ["query_id"], k, F.desc("confidence"), "result_id").withColumn("score", F.lit(5.2)).withColumn("channel", F.lit("direct_test_method"))


def wiki_pages(candidates: DataFrame, k: int) -> DataFrame:
    """Wiki pages whose title has one of the question's first ten terms, scored by page type and, for limits, by how
    well the title fits the topic; k a question."""
    kind, page, title = F.col("query_type"), F.col("page_type"), F.trim(F.coalesce("title", F.lit("")))
    terms = F.slice(F.filter(F.transform(F.concat(F.array("normalized_query"), "must_terms", "aliases", "should_terms"), lambda t: F.trim(t)), lambda t: t != ""), 1, 10)
    found = F.exists(terms, lambda t: F.contains(F.lower(F.col("title")), F.lower(t)))
    table = F.create_map(*(F.lit(x) for (q, p), v in WIKI.items() for x in (f"{q}|{p}", v)))
    bonus = F.coalesce(table[F.concat_ws("|", kind, page)], F.when(kind == "definition", WIKI_DEFINITION).otherwise(WIKI_BASE))
    topic = F.filter(F.concat(F.array("target_topic", "normalized_query"), "must_terms"), lambda t: F.coalesce(t, F.lit("")) != "")
    fits = F.when(F.array_contains(topic, title), 0.4).when(F.exists(topic, lambda t: F.contains(title, t)), 0.2).otherwise(0.0)
    hits = candidates.filter((F.col("result_type") == "wiki") & kind.isin(*WIKI_ASKED) & found)
    hits = hits.withColumn("score", F.round(bonus + F.when(kind == "constraint", fits).otherwise(0.0), 6)).withColumn("channel", F.lit("direct_wiki"))
    return top_per_group(hits, ["query_id"], k, F.desc("score"), "result_id")


def injected(hits: DataFrame, extra: DataFrame, k: int, force: bool = False) -> DataFrame:
    """Hits (query_id, result_id, score, channel) with others put in: of one result the higher score stays, or with
    `force` the injected one; k a question by score."""
    both = hits.withColumn("__extra", F.lit(0)).unionByName(extra.withColumn("__extra", F.lit(1)))
    order = (F.desc("__extra"),) if force else (F.desc("score"), "__extra")
    return top_per_group(keep_best(both, ["query_id", "result_id"], *order).drop("__extra"), ["query_id"], k, F.desc("score"), "result_id")


def topic_objects(candidates: DataFrame, k: int = 8) -> DataFrame:
    """Pages that are what a question is about: (priority, points) of title and type, best first, k a question."""
    kind, page, title = F.col("query_type"), F.col("page_type"), F.trim(F.coalesce("title", F.lit("")))
    terms = F.filter(F.concat(F.array("target_topic", "normalized_query"), "must_terms"), lambda t: F.coalesce(t, F.lit("")) != "")
    symbols = F.filter(F.transform(terms, lambda t: F.upper(t)), lambda t: t.rlike(r"^[A-Z]{1,4}\d*$"))
    same, part, symbol = F.array_contains(terms, title), F.exists(terms, lambda t: F.contains(title, t)), F.array_contains(symbols, F.upper(title))
    suited = reduce(lambda a, b: a | b, ((kind == q) & page.isin(*p) for q, p in (("constraint", ("constraint",)), ("comparison", ("comparison",)), ("timing_lookup", ("process",)), ("definition", ("term", "concept")))))
    parameter = kind == "parameter_lookup"
    group, own, term = parameter & (page == "parameter_group"), parameter & (page == "parameter"), parameter & (page == "term")
    points = K._points((same, 4), (part, 2), (suited | group, 2), (own, 4), (term & symbol, 5), (term & ~symbol & part, 2), (parameter & symbol & F.col("entity_id").isNotNull(), 2))
    priority = F.when(suited | own | (term & symbol) | (parameter & symbol & F.col("entity_id").isNotNull()), 0).when(group | (term & part), 1).otherwise(2)
    rows = candidates.filter(title != "").withColumn("points", points.cast("int")).withColumn("priority", priority).filter("points > 0")
    return top_per_group(rows, ["query_id"], k, "priority", F.desc("points"), "title", "result_id")


# ---- facts -------------------------------------------------------------------------------------


def intent() -> Column:
    table = F.create_map(*(F.lit(x) for pair in INTENTS.items() for x in pair))
    return F.coalesce(table[F.col("query_type")], F.lit("general"))


def _typed(rules: dict[tuple[str, ...], float]) -> Column:
    return F.coalesce(*(F.when(F.col("fact_type").isin(*k), F.lit(v)) for k, v in rules.items()))


def fact_points() -> Column:
    """What a fact's type, title and words say for its question's intent."""
    q, blob = F.col("question"), F.coalesce("payload", F.lit(""))
    at = lambda *names: F.lower(F.coalesce(*(R.some(F.get_json_object("payload", f"$.{n}")) for n in names), F.lit("")))
    scope = F.coalesce(F.get_json_object("payload", "$.scope_type"), F.lit(""))
    both = lambda asked, there: q.rlike(asked) & blob.rlike(there)
    p = K._points
    cjk = lambda n: F.regexp_extract_all(F.lower(q), F.lit(f"[一-鿿]{{{n},}}"), F.lit(0))
    in_title = lambda title, words: F.exists(words, lambda w: F.contains(title, w))
    file = F.size(F.filter(F.array_distinct(cjk(3)), lambda w: F.contains(K.norm(F.coalesce("filename", F.lit(""))), w)))
    base = F.least(0.3 * file, F.lit(1.0))
    index_table = (F.col("fact_type") == "table_requirement") & _any(F.concat(at("title"), at("table_title")), ("序号", "标准编号", "标准名称", "起始实施日期", "附件"))
    front = _any(blob, ("前言", "前    言", "目 次", "目次"))
    definition = F.coalesce(_typed({("term_definition", "concept_definition"): 4.0, ("document_abstract",): 3.0, ("section_heading",): 1.5}), base)
    standard = F.coalesce(_typed({("document_standard", "document_versioning", "document_lifecycle"): 3.0, ("term_definition", "concept_definition"): 0.5}), base)
    asked_code = R.standard_code(F.regexp_extract(q, r"(?i)(?:GB/T|GBT|GB|ISO/IEC|ISO|IEC|QC/T|QCT|QC)\s*[\d.]+(?:[.\-—:]\d+)*", 0))
    value = R.standard_code(F.coalesce(F.get_json_object("payload", "$.value"), F.lit("")))
    standard = standard + p(((F.col("fact_type") == "document_standard") & (value != "") & (value == asked_code), 2.0))
    named = in_title(at("title", "topic", "subject"), F.filter(F.regexp_extract_all(F.lower(q), F.lit("[一-鿿]{2,}|[a-z0-9]+"), F.lit(0)), lambda w: F.length(w) >= 2))
    parameter = F.coalesce(_typed({("parameter_value",): 4.0, ("table_requirement",): 2.8, ("threshold",): 1.6, ("requirement",): 1.2}), base) + p(
        (_any(blob, ("目 次", "前    言", "前言")), -5.0), (index_table, -8.0), (both("阻值|电阻|欧姆|Ω", r"(?i)Ω|电阻|阻值|R\d+"), 3.0), (both(r"(?i)\bCC\b|CC1|CC2", r"(?i)\bCC\b|CC1|CC2"), 2.5),
        (both(r"检测点\s*\d", r"检测点\s*\d"), 2.0), (blob.rlike("控制导引|导引电路"), 1.0), (both("效率|功率", "效率|功率|85"), 3.5), (both("绝缘电阻|绝缘强度", "绝缘电阻|绝缘强度|绝缘|MΩ"), 4.0),
        (named, 4.0), (~named & (F.col("fact_type") == "requirement") & (F.length(at("title", "topic", "subject")) > 4), -2.0),
    )
    process = F.coalesce(_typed({("transition_fact",): 4.2, ("process_fact",): 4.0, ("table_requirement",): 2.0, ("requirement",): 1.0}), base) + p(
        (scope.isin("index", "preface"), -10.0), (front, -10.0), (q.rlike("时序|流程|状态转换|控制时序|握手|预充|启动|停止|停机") & _any(blob, ("表 A.7", "控制时序", "状态转换")), 5.0),
        (_any(blob, ("时序", "状态", "握手", "预充", "停机", "控制时序说明")), 2.0), (_any(blob, ("控制导引", "检测点", "CP")), 1.2), (in_title(at("title", "process_name"), cjk(2)), 3.0),
    )
    kind = F.coalesce(_typed({("comparison_relation",): 4.6, ("term_definition", "concept_definition"): 2.0}), F.lit(0.6))
    constraint = kind + p((_any(F.upper(blob), ("V2X", "V2G", "V2V", "V2B", "V2H")), 1.2))
    general = F.coalesce(_typed({("term_definition", "concept_definition"): 1.0, ("requirement",): 2.0, ("threshold",): 1.8}), base) + p(
        (scope.isin("index", "preface", "overview"), -5.0), (in_title(at("title", "topic", "subject"), cjk(2)), 5.0), (q.rlike(r"表\s*\d+") & (F.col("fact_type") == "table_requirement"), 3.0),
        (q.rlike("字段|表头|参数") & (F.col("fact_type") == "table_requirement"), 2.0), (q.rlike("阻值|参数|电阻|CC") & (F.col("fact_type") == "parameter_value"), 3.0),
    )
    own = intent()
    return F.when(own == "definition", definition).when(own == "standard", standard).when(own == "parameter", parameter).when(own == "process", process).when(own == "constraint", constraint).otherwise(general)


def ranked_facts(candidates: DataFrame, k: int | None = None) -> DataFrame:
    """Facts with `points` (their confidence included), `wanted` by the intent, and `place` from 1: wanted kinds
    first, then points, then confidence. All facts stay, or k a question."""
    wanted = reduce(lambda a, b: a | b, ((intent() == i) & F.col("fact_type").isin(*kinds) for i, kinds in INTENT_FACTS.items())) | ~intent().isin(*INTENT_FACTS)
    rows = candidates.filter("fact_type is not null").withColumn("confidence", F.coalesce("confidence", F.lit(0.0))).withColumn("wanted", F.coalesce(wanted, F.lit(False)))
    rows = rows.withColumn("points", F.round(fact_points() + F.col("confidence"), 6))
    order = (F.desc("wanted"), F.desc("points"), F.desc("confidence"), "result_id")
    rows = rows if k is None else top_per_group(rows, ["query_id"], k, *order)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))


# ---- answers -----------------------------------------------------------------------------------


def direct_answers(facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """query_id, mode, answer: what a question's ranked facts (place, payload, fact_type, predicate) say by the policy of its
    kind, else the best fact's title or value, else the first evidence (query_id, place, snippet), else that there is none.

    Each policy is an ordered choice over facts, so one aggregate a question holds them all."""
    at = lambda n: R.some(F.get_json_object("payload", f"$.{n}"))
    first = lambda value, when: F.min_by(value, F.when(when & value.isNotNull(), F.col("place")))
    kind, is_ = F.col("query_type"), lambda *t: F.col("fact_type").isin(*t)
    meaning = F.when(is_("term_definition", "concept_definition"), F.concat(at("term"), F.lit(": "), at("definition"))).when(is_("document_abstract"), F.substring(at("value"), 1, 240))
    amount = F.concat(F.coalesce(at("parameter"), at("symbol")), F.lit(" = "), at("nominal"), F.coalesce(F.concat(F.lit(" "), at("unit")), F.lit("")))
    step = F.coalesce(at("step_text"), at("title"))
    best = facts.groupBy("query_id", "query_type").agg(
        first(meaning, is_("term_definition", "concept_definition", "document_abstract")).alias("meaning"),
        first(amount, is_("parameter_value")).alias("amount"),
        first(step, is_("process_fact", "transition_fact")).alias("step"),
        first(at("value"), is_("document_standard")).alias("standard"),
        first(at("value"), is_("document_lifecycle") & (F.col("predicate") == "publication_date")).alias("published"),
        first(at("value"), is_("document_lifecycle") & (F.col("predicate") == "effective_date")).alias("effective"),
        first(at("value"), is_("document_versioning")).alias("replaced"),
        first(F.coalesce(at("content"), at("threshold")), is_("requirement", "threshold")).alias("requirement"),
        first(at("relation"), is_("comparison_relation")).alias("comparison"),
        F.min_by(at("title"), "place").alias("title"), F.min_by(at("value"), "place").alias("value"),
    )
    said = evidence.groupBy("query_id").agg(F.min_by("snippet", "place").alias("snippet"))
    rows = best.join(said, "query_id", "full_outer")
    dates = F.array_compact(F.array(*(F.concat(F.lit(f"{name}是 "), F.col(c)) for name, c in (("标准号", "standard"), ("发布日期", "published"), ("实施日期", "effective"), ("代替标准", "replaced")))))
    choices = [
        ("definition", F.when(kind == "definition", F.col("meaning"))),
        ("parameter_value", F.when(kind.isin("parameter_lookup", "parameter_meaning"), F.col("amount"))),
        ("process", F.when(kind.isin("lifecycle_lookup", "timing_lookup", "test_method_lookup"), F.col("step"))),
        ("standard_lookup", F.when((kind == "standard_lookup") & (F.size(dates) > 0), F.concat(F.array_join(dates, "，"), F.lit("。")))),
        ("comparison", F.when(kind == "comparison", F.col("comparison"))),
        ("requirement", F.col("requirement")),
        ("title", F.concat(F.lit("最相关的结构化结果是章节《"), F.col("title"), F.lit("。"))),
        ("value", F.concat(F.lit("最相关的结构化结果是 "), F.col("value"), F.lit("。"))),
        ("evidence", F.col("snippet")),
    ]
    mode = F.coalesce(*(F.when(c.isNotNull(), F.lit(n)) for n, c in choices), F.lit("none"))
    return rows.select("query_id", mode.alias("mode"), F.coalesce(*(c for _, c in choices), F.lit(NO_ANSWER)).alias("answer"))


# ---- wiki chunks -------------------------------------------------------------------------------

# What a short abbreviation is looked for by, and patterns that weigh most.
ABBREVIATIONS = {
    "cp": ("CP电压", "CP信号", "CP ", " CP", "CP幅值", "+Vcc", "-Vcc", "控制导引", "检测点1", "PWM信号", "状态0", "状态1"), "cc": ("CC信号", "连接确认", "检测点3", "CC ", " CC", "CC1", "CC2"),
    "pe": ("PE ", " PE", "保护接地", "PE导体", "PE线"),
}
HEAVY = ("+Vcc", "-Vcc", "12.00", "11.40", "12.60")


def grams(question: str) -> list[str]:
    """The 2- and 3-grams of a question's CJK characters, gaps removed."""
    cjk = [c for c in question.lower() if "一" <= c <= "鿿"]
    return list(dict.fromkeys("".join(cjk[i : i + n]) for n in (2, 3) for i in range(len(cjk) - n + 1)))


def chunk_points(question: str, title: str, body: str, scope: Column | None = None) -> Column:
    """A chunk's points for a stated question: 100 for each heavy pattern, 10 and 1 for an abbreviation's wordy and plain ones,
    5 for each gram, 500 in the scope."""
    import re

    text = F.concat_ws(" ", F.coalesce(body, F.lit("")), F.coalesce(title, F.lit("")))
    short = [t for t in re.findall(r"[A-Za-z0-9][A-Za-z0-9./\-]*[A-Za-z0-9]|[A-Za-z]{2,}", question) if len(t) == 2]
    patterns = [p for t in short for p in ABBREVIATIONS.get(t.lower(), (t,))][:15]
    wordy = {p for p in patterns if len(p) >= 3 and re.search("[一-鿿]", p)}
    parts = [(p, 100) for p in HEAVY] + [(p, 10) for p in sorted(wordy)] + [(p, 1) for p in patterns if p not in wordy] + [(g, 5) for g in grams(question)]
    total = reduce(lambda a, b: a + b, (F.when(F.contains(text, F.lit(p)), n).otherwise(0) for p, n in parts), F.lit(0))
    return total + F.when(scope, 500).otherwise(0) if scope is not None else total


def wiki_answers(chunks: DataFrame, questions: list[tuple[int, str]], title: str, body: str, item: str, k: int = 8) -> DataFrame:
    """(query_id, item, points): the chunks that have a gram or pattern of each stated question, best first, k a question.
    Questions are literals of one pass over the chunks."""
    each = F.filter(F.array(*(F.struct(F.lit(i).alias("query_id"), chunk_points(q, title, body).alias("points")) for i, q in questions)), lambda x: x["points"] > 0)
    return top_per_group(chunks.select(item, F.inline(each)), ["query_id"], k, F.desc("points"), item)


# ---- the whole way -------------------------------------------------------------------------------


def context(candidates: DataFrame, k: int = 20, facts: int = 12) -> DataFrame:
    """One row a question: its best candidates after injections and rerank, ranked facts, judgement, answer and confidence.

    Candidates of all questions go through one plan: test methods and wiki pages are injected, the thirteen components
    rerank them, facts are ranked by intent, the judge decides whether they suffice, and the policy answers."""
    from lodestone.operators import shapes as S

    plain = candidates.withColumn("channel", F.lit("structured"))
    keys = ["query_id", "result_id", "score", "channel"]
    merged = injected(injected(plain.select(*keys), wiki_pages(candidates, k).select(*keys), 4 * k), test_methods(candidates, k).select(*keys), 4 * k, force=True)
    best = K.rerank(candidates.drop("score").join(merged, ["query_id", "result_id"]), k)
    ranked = ranked_facts(best, facts)
    said = best.filter("result_type <> 'fact'").withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("final"), "result_id")))
    answer = direct_answers(ranked, said)
    judged = S.judged(best.withColumn("blob", F.col("payload")).withColumn("kind", F.when(F.col("result_type") == "fact", "fact").otherwise("evidence")).withColumn("item_id", F.col("result_id")))
    found = best.groupBy("query_id").agg(F.count("*").alias("candidates"), F.count_if(F.col("result_type") == "fact").alias("facts"), F.max_by("result_id", F.struct("final", "result_id")).alias("best"), F.max("final").alias("final"))
    return found.join(judged.select("query_id", "shape", "sufficient", "diagnosis"), "query_id", "left").join(answer, "query_id", "left")
