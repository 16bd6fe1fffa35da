"""The explained rerank: thirteen components of a candidate's score as one projection.

Candidates are rows that carry their question's columns (query_type, question, normalized_query,
target_topic, must_terms, should_terms, aliases, protected_terms, anchor_terms) and their own
(score, result_type, snippet, fact_type, payload, page_type, title, filename, overall_score,
high_risk_pages, blocked_pages, routing_priority). Nothing is looked up row by row: what a component
needs is joined before, and missing rows are nulls that count as nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import rules as R
from lodestone.functions.text import literal_map
from lodestone.operators.ranking import top_per_group

# How well a kind of result suits a kind of question.
ALIGNMENT = {
    "definition": {"fact": 0.24, "wiki": 0.16, "evidence": 0.08, "document": 0.03},
    "standard_lookup": {"document": 0.24, "fact": 0.2, "wiki": 0.16, "evidence": 0.06},
    "lifecycle_lookup": {"document": 0.24, "fact": 0.2, "wiki": 0.14, "evidence": 0.06},
    "timing_lookup": {"fact": 0.26, "evidence": 0.2, "document": 0.06, "wiki": 0.04},
    "test_method_lookup": {"fact": 0.34, "evidence": 0.22, "wiki": 0.05, "document": -0.08},
    "parameter_lookup": {"fact": 0.28, "evidence": 0.18, "wiki": 0.06, "document": -0.08},
    "section_lookup": {"fact": 0.22, "evidence": 0.16, "document": 0.14, "wiki": 0.04},
    "scope": {"evidence": 0.18, "fact": 0.12, "document": 0.1, "wiki": 0.05},
    "constraint": {"fact": 0.16, "evidence": 0.14, "document": 0.08, "wiki": 0.04},
    "general_search": {"evidence": 0.14, "fact": 0.1, "wiki": 0.08, "document": 0.05},
}

# Names that are no parameter, what the on-board charger is called and what it is not.
GENERIC = ("参数", "定义", "是什么", "什么意思", "控制导引", "控制导引电路", "电路", "表", "table")
CHARGER = ("OBC", "车载充电机", "电动汽车用传导式车载充电机", "on-board charger", "onboard charger")
INVERTER = ("汽车电源逆变器", "逆变器", "逆变")
CHARGER_ASKED = r"(?i)(?<![A-Za-z0-9])OBC(?![A-Za-z0-9])|车载充电机|on-?board charger"
RESISTANCE_ASKED = r"(?i)电阻|阻值|等效电阻|欧姆|Ω|ohm|resistance"
PRACTICE = r"(?i)\b(?:SYS|SWE|SUP|MAN|HWE|VAL|REU|PIM)\.\d+\.BP\d+\b"

# What a question about a process is after, and the words by which a payload shows it.
FOCUS = (("分析", ("分析", "analyze")), ("设计", ("设计", "specify", "architecturaldesign", "architecture")), ("定义", ("定义", "specify")), ("集成", ("集成", "integrat")), ("验证", ("验证", "verify", "verification")), ("测试", ("测试", "test")))

BONUSES = ("lexical", "exact_match", "standard_match", "term_match", "object_anchor", "alignment", "subtype", "document_title", "routing", "quality")
PENALTIES = ("risk", "object_anchor_penalty")


def norm(c: Column | str) -> Column:
    """Lower case, long dashes as hyphens, without underscores, slashes and blanks."""
    s = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.translate(F.lower(s), "—", "-"), r"[_/\s]+", "")


def has(text: Column, term: Column) -> Column:
    """Whether a normalised text has a term that is not empty."""
    key = norm(term)
    return F.coalesce((key != "") & F.contains(text, key), F.lit(False))


def has_any(text: Column, terms: Column | tuple[str, ...]) -> Column:
    """Whether a normalised text has one of an array's terms, or of fixed ones."""
    if isinstance(terms, tuple):
        return reduce(lambda a, b: a | b, (F.coalesce(F.contains(text, norm(F.lit(t))), F.lit(False)) for t in terms))
    return F.coalesce(F.exists(terms, lambda t: has(text, t)), F.lit(False))


def _asked(*columns: str) -> Column:
    """The question's columns as one text; arrays are joined."""
    arrays = {"must_terms", "should_terms", "aliases", "protected_terms"}
    return F.concat_ws(" ", *(F.array_join(c, " ") if c in arrays else F.col(c) for c in columns))


_FOCUSED = ("question", "normalized_query", "target_topic", "must_terms", "protected_terms")


# ---- lexical -----------------------------------------------------------------------------------


def lexical() -> Column:
    """0.08 for each term that must be there, 0.04 for each that should, if the snippet has it."""
    text = norm("snippet")
    each = F.transform(F.concat("must_terms", "should_terms"), lambda t: F.when(has(text, t), F.when(F.array_contains("must_terms", t), 0.08).otherwise(0.04)).otherwise(0.0))
    return F.aggregate(each, F.lit(0.0), lambda a, x: a + x)


def exact_match() -> Column:
    return F.when(has(norm("snippet"), F.col("normalized_query")), 0.18).otherwise(0.0)


def standard_match() -> Column:
    return F.when(F.col("query_type").isin("standard_lookup", "lifecycle_lookup") & has_any(norm("snippet"), F.col("must_terms")), 0.22).otherwise(0.0)


def term_match() -> Column:
    return F.when((F.col("query_type") == "definition") & has(norm("snippet"), F.col("normalized_query")), 0.2).otherwise(0.0)


def alignment() -> Column:
    table = literal_map({f"{q}|{r}": v for q, row in ALIGNMENT.items() for r, v in row.items()})
    return F.coalesce(table[F.concat_ws("|", "query_type", "result_type")], F.lit(0.0))


# ---- subtypes ----------------------------------------------------------------------------------


def cleaned(c: Column) -> Column:
    """A field of a table without footnote marks, brackets and loose punctuation."""
    s = F.regexp_replace(F.regexp_replace(F.trim(c), r"\^[A-Za-z0-9]+", ""), "[（(][^)）]*[)）]", "")
    return F.btrim(s, F.lit(" *:：;；,，"))


def names_field(asked: Column, value: Column) -> Column:
    """Whether a normalised question names a field's value: no generic name, more than two plain characters."""
    key = norm(value)
    fit = (key != "") & ~key.isin(*GENERIC) & ~key.rlike(r"^[a-z0-9+\-/'_.]{1,2}$")
    return F.coalesce(fit & F.contains(asked, key), F.lit(False))


def names_tag(question: Column, tags: Column) -> Column:
    """Whether a question names one of a row's tags, signal names as words of their own."""
    asked, upper = norm(question), F.upper(question)
    word = lambda x: F.rlike(upper, F.concat(F.lit("(?<![A-Z0-9])"), x, F.lit("(?![A-Z0-9])")))

    def one(tag: Column) -> Column:
        t = cleaned(tag)
        signal, key = F.upper(t), norm(t)
        plain = (F.length(key) > 1) & F.contains(asked, key)
        return (t != "") & ~key.isin(*GENERIC) & (F.when(signal.isin("CP", "CC", "PE", "PWM"), word(signal)).otherwise(F.lit(False)) | F.when(signal.rlike(r"^CC\d$"), word(F.lit("CC"))).otherwise(F.lit(False)) | plain)

    return F.coalesce(F.exists(tags, one), F.lit(False))


def _field(name: str) -> Column:
    return cleaned(F.coalesce(F.get_json_object("payload", f"$.{name}"), F.lit("")))


def _tags(*names: str) -> Column:
    return F.coalesce(*(F.from_json(F.get_json_object("payload", f"$.{n}"), "array<string>") for n in names), F.array().cast("array<string>"))


def parameter_fields(question: Column) -> dict[str, Column]:
    """Which fields of a parameter's payload a question names."""
    return {
        "parameter": names_field(norm(question), _field("parameter")),
        "symbol": R.has_symbol(question, _field("symbol")),
        "object": names_field(norm(question), _field("object")),
        "row_focus": names_tag(question, _tags("row_focus_tags", "focus_tags")),
        "table_focus": names_tag(question, _tags("table_focus_tags")),
    }


def tables_meet(asked: Column, there: Column) -> tuple[Column, Column]:
    """(match, mismatch) of the tables that two texts name; neither if one names none."""
    a, b = R.table_numbers(asked), R.table_numbers(there)
    both = (F.size(a) > 0) & (F.size(b) > 0)
    same = F.coalesce(F.arrays_overlap(a, b), F.lit(False))
    return both & same, both & ~same


def _points(*parts: tuple[Column, float]) -> Column:
    return reduce(lambda a, b: a + b, (F.when(c, v).otherwise(0.0) for c, v in parts))


def resistance_intent() -> Column:
    """For a question about resistance 0.72 if the payload has one, else -0.85."""
    fit = F.col("payload").rlike(r"(?i)电阻|阻值|等效电阻|Ω|\\\\Omega|欧姆|ohm|resistance") | _field("unit").isin("Ω", "\\Omega") | _field("symbol").rlike(r"(?i)^R\d")
    return F.when(_asked(*_FOCUSED).rlike(RESISTANCE_ASKED), F.when(F.coalesce(fit, F.lit(False)), 0.72).otherwise(-0.85)).otherwise(0.0)


def parameter_subtype() -> Column:
    """What a fact's type and fields say to a question about parameters."""
    question, text = _asked(*_FOCUSED), norm("payload")
    match, mismatch = tables_meet(_asked("question", "normalized_query", "target_topic", "must_terms", "should_terms", "aliases"), F.col("payload"))
    asked_table = F.size(R.table_numbers(_asked("question", "normalized_query", "target_topic", "must_terms", "should_terms", "aliases"))) > 0
    matched = F.size(F.filter("anchor_terms", lambda t: F.contains(text, norm(t))))
    f = parameter_fields(question)
    direct = f["parameter"] | f["symbol"] | f["row_focus"]
    value = _points((F.lit(True), 0.38), (match, 0.95), (mismatch, -1.05), (f["parameter"], 1.15), (f["symbol"], 1.05), (f["row_focus"], 0.45), (f["object"], 0.45), (f["table_focus"], 0.12), (asked_table & (f["object"] | f["table_focus"]) & ~direct, -0.18))
    value = value + F.when((matched > 0) & ~direct, F.least(F.lit(0.35), 0.12 * matched)).otherwise(0.0)
    table = _points((match, 0.55), (mismatch, -0.85)) + F.when(matched > 0, F.least(F.lit(0.5), 0.18 * matched)).otherwise(0.0)
    kind = F.col("fact_type")
    out = (
        F.when(kind == "parameter_value", value + resistance_intent()).when(kind == "table_requirement", table + resistance_intent())
        .when(kind.isin("term_definition", "concept_definition"), F.when(matched > 0, 0.08).otherwise(-0.12)).when(kind.isin("process_fact", "transition_fact", "section_heading"), -0.18).otherwise(0.0)
    )
    return F.when(F.coalesce(text, F.lit("")) == "", 0.0).otherwise(out)


def _focus(question: Column, payload: Column) -> Column:
    """At most 0.56: 0.28 for each thing a question is after that the payload shows."""
    parts = [F.contains(question, F.lit(word)) & has_any(payload, words) for word, words in FOCUS]
    return F.least(F.lit(0.56), _points(*((p, 0.28) for p in parts)))


def _process_named(target: Column, payload: Column) -> Column:
    """Whether a payload has the target, test and verification being one and "process" no part of the name."""
    swap = lambda c, a, b: F.replace(c, F.lit(a), F.lit(b))
    names = [target, swap(target, "测试", "验证"), swap(target, "验证", "测试"), swap(target, "过程域", ""), swap(target, "过程", "")]
    names += [swap(swap(n, "集成测试", "集成"), "集成验证", "集成") for n in names]
    return F.coalesce((target != "") & reduce(lambda a, b: a | b, ((n != "") & F.contains(payload, n) for n in names)), F.lit(False))


def _tests_named(payload: Column) -> Column:
    terms = F.concat(F.array("normalized_query", "target_topic"), "must_terms", "should_terms", "aliases")
    terms = F.filter(terms, lambda t: F.coalesce(F.trim(t), F.lit("")) != "")
    overvoltage = F.exists(terms, lambda t: F.contains(t, F.lit("输入过压"))) & has_any(payload, ("输入过、欠压", "交流输入过、欠压", "过压保护试验"))
    return F.coalesce(F.exists(terms, lambda t: F.contains(payload, norm(t))), F.lit(False)) | F.coalesce(overvoltage, F.lit(False))


def _is_test(payload: Column) -> Column:
    return has_any(payload, ("试验", "测试", "测量", "检测")) & has_any(payload, ("试验方法及步骤", "按照图", "接好试验电路", "调节", "测量", "观察"))


def fact_subtype() -> Column:
    """What a fact's type says to the kind of question."""
    kind, asked, text = F.col("fact_type"), F.col("query_type"), norm(F.coalesce("payload", F.lit("")))
    target = norm(F.coalesce(R.some(F.col("target_topic")), R.some(F.col("normalized_query")), F.lit("")))
    question = F.coalesce(R.some(F.col("question")), R.some(F.col("normalized_query")), F.col("target_topic"), F.lit(""))
    practice, life = F.coalesce(F.col("payload").rlike(PRACTICE), F.lit(False)), asked == "lifecycle_lookup"
    focus, named = _focus(question, text), _process_named(target, text)
    process = (
        F.when(kind == "process_fact", F.when(life & ~practice, -0.18).when(life, 0.55 + focus).otherwise(0.55))
        .when(kind == "table_requirement", F.when(text.rlike(PRACTICE), 0.62 + focus).when(named, 0.3).otherwise(0.05))
        .when(kind == "section_heading", F.when(named, 0.22).otherwise(-0.12))
        .when(kind == "transition_fact", F.when(life, -0.12).otherwise(0.35))
    )
    test = (
        F.when(kind == "process_fact", _points((F.lit(True), 0.35), (_is_test(text), 0.65), (_tests_named(text), 0.45)))
        .when(kind.isin("requirement", "threshold", "table_requirement"), -0.08).when(kind == "section_heading", 0.08)
    )
    titled = (target != "") & F.contains(text, F.concat(F.lit('"title":"'), target, F.lit('"')))
    other = (
        F.when(kind.isin("term_definition", "concept_definition"), 0.45).when(kind == "document_abstract", 0.18).when(kind == "section_heading", F.when(titled, 0.12).otherwise(-0.24))
        .when(kind.isin("requirement", "threshold", "table_requirement", "parameter_value", "process_fact", "transition_fact"), -0.28).otherwise(0.0)
    )
    special = F.when(asked.isin("lifecycle_lookup", "timing_lookup"), process).when(asked == "test_method_lookup", test)
    return F.when(kind.isNull(), 0.0).when(asked == "parameter_lookup", parameter_subtype()).otherwise(F.coalesce(special, other))


def wiki_subtype() -> Column:
    page = F.col("page_type")
    target = norm(F.coalesce(R.some(F.col("target_topic")), R.some(F.col("normalized_query")), F.lit("")))
    near = (target != "") & F.coalesce(F.contains(norm("title"), target), F.lit(False))
    return F.when(page.isin("term", "concept"), 0.28).when(page == "document", 0.08).when(page.isin("parameter_group", "process", "constraint", "comparison"), F.when(near, -0.08).otherwise(-0.24)).otherwise(0.0)


def subtype() -> Column:
    """0 for questions of other kinds than definitions, processes, times, tests and parameters."""
    of = F.when(F.col("result_type") == "fact", fact_subtype()).when(F.col("result_type") == "wiki", wiki_subtype()).otherwise(0.0)
    return F.when(F.col("query_type").isin("definition", "lifecycle_lookup", "timing_lookup", "test_method_lookup", "parameter_lookup"), of).otherwise(0.0)


# ---- object, document, quality -----------------------------------------------------------------


def object_anchor() -> tuple[Column, Column]:
    """(bonus, penalty) of a candidate for a question about the on-board charger: 1 if the snippet names it, 0.2 if
    only the file does; 1.35 off for one that names an inverter instead, unless the question does."""
    asked = _asked(*_FOCUSED)
    about, inverter = asked.rlike(CHARGER_ASKED), F.contains(asked, F.lit("逆变"))
    text, file = norm("snippet"), norm(F.coalesce("filename", F.lit("")))
    right, named, wrong = has_any(text, CHARGER), has_any(file, CHARGER), has_any(text, INVERTER)
    return F.when(about & right, 1.0).when(about & named, 0.2).otherwise(0.0), F.when(about & ~inverter & wrong & ~right, 1.35).otherwise(0.0)


def document_title() -> Column:
    file = norm("filename")
    return F.when(has(file, F.col("normalized_query")), 0.12).when(has_any(file, F.col("must_terms")), 0.08).otherwise(0.0)


def quality() -> Column:
    return F.coalesce(F.least(F.col("overall_score") * 0.05, F.lit(0.05)), F.lit(0.0))


def risk() -> Column:
    part = lambda c, w: F.coalesce(F.col(c), F.lit(0)) * w
    return F.least(part("high_risk_pages", 0.01) + part("blocked_pages", 0.05), F.lit(0.2))


def components() -> dict[str, Column]:
    """The thirteen components, the base score among them, by name."""
    bonus, penalty = object_anchor()
    return {
        "base": F.coalesce("score", F.lit(0.0)), "lexical": lexical(), "exact_match": exact_match(), "standard_match": standard_match(), "term_match": term_match(),
        "object_anchor": bonus, "alignment": alignment(), "subtype": subtype(), "document_title": document_title(),
        "routing": F.coalesce("routing_priority", F.lit(0.0)) * 0.08, "quality": quality(), "risk": risk(), "object_anchor_penalty": penalty,
    }


def explained(candidates: DataFrame) -> DataFrame:
    """Candidates with `final` and `rerank`, a struct of its components, each rounded to six digits."""
    parts = candidates.select("*", F.struct(*(c.cast("double").alias(n) for n, c in components().items())).alias("__parts"))
    total = F.col("__parts.base") + reduce(lambda a, b: a + b, (F.col(f"__parts.{n}") for n in BONUSES)) - reduce(lambda a, b: a + b, (F.col(f"__parts.{n}") for n in PENALTIES))
    rounded = F.struct(*(F.round(f"__parts.{n}", 6).alias(n) for n in ("base", *BONUSES, *PENALTIES)))
    return parts.withColumn("final", F.round(total, 6)).withColumn("rerank", rounded).drop("__parts")


def rerank(candidates: DataFrame, k: int, item: str = "result_id") -> DataFrame:
    """Each question's k best candidates with their explanation, ties to the smaller item."""
    return top_per_group(explained(candidates), ["query_id"], k, F.desc("final"), item)
