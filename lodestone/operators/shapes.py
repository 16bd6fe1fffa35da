"""Evidence shapes: what a question asks for, what a candidate is, and whether the best ones suffice.

Questions are text columns; candidates are their text (`blob`), fact_type, relation, trust and payload.
Each shape has a detector over questions, a score over candidates and a test whether a candidate
settles it; a contract names the shapes that a kind of question accepts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import rules as R
from lodestone.operators import reranking as K

# The shapes in order, and those that each kind of question accepts; the kinds in OPTIONAL do not insist.
SHAPES = ("signal_state_table", "timing_table", "process_activity", "test_method", "parameter_definition", "term_definition", "requirement")
CONTRACTS = {
    "test_method_lookup": ("test_method",),
    "timing_lookup": ("timing_table",),
    "lifecycle_lookup": ("process_activity",),
    "parameter_lookup": ("parameter_definition", "signal_state_table"),
    "parameter_meaning": ("parameter_definition", "signal_state_table"),
    "signal_state_lookup": ("signal_state_table",),
    "definition": ("term_definition", "parameter_definition"),
    "general_search": ("term_definition", "parameter_definition", "process_activity", "timing_table", "signal_state_table"),
    "comparison": ("parameter_definition", "signal_state_table"),
    "constraint": ("parameter_definition", "process_activity", "requirement"),
    "standard_lookup": ("term_definition",),
}
OPTIONAL = ("general_search", "standard_lookup")

# The words by which questions and candidates show a shape.
TIMING_ASKED = "时序|流程|状态转换|控制时序|握手|预充|启动|停止|停机"
TOPIC_ASKED = r"(?i)过程域|过程|软件架构|系统集成|系统架构|需求分析|测试|验证|ASPICE|Automotive\s*SPICE"
ACTIVITY_ASKED = r"(?i)活动|任务|实践|基本实践|BP\d*|有哪些|要做|是什么|做什么|process\s+domain|base\s+practice|activity|activities"
TEST_ASKED = "怎么测|如何测|怎样测|怎么测试|如何测试|怎样测试|试验方法|测试方法|检测方法|测量方法"
PARAMETER_ASKED = "(?i)阻值|电阻|电压|电流|占空比|PWM|检测点|参数"
REQUIREMENT_ASKED = "(?i)要求|规定|应当|应|shall|requirement|requirements"
TERM_ASKED = "是什么|定义|含义|什么意思|表示什么|解释"
PRACTICE_WORDS = ("step_text", "process_name", "基本实践", "basepractice", "practice", "活动")
TEST_WORDS, STEP_WORDS = ("试验", "测试", "测量", "检测"), ("试验方法及步骤", "按照图", "接好试验电路", "调节", "测量", "观察", "施加")
PARAMETER_WORDS = ("参数", "标称值", "最小值", "最大值", "等效电阻", "占空比", "电压", "电流", "定义")
TERM_WORDS = ("term_definition", "defines_term", "定义", "功能", "表示", "是指")
REQUIREMENT_WORDS = ("requirement", "table_requirement", "shall", "规定", "要求", "应", "不得", "必须")
OVERVOLTAGE = {"输入过压": ("输入过压", "输入过、欠压", "交流输入过、欠压", "直流输入过、欠压"), "输出过压": ("输出过压", "输出过压保护")}
PARAMETER_RELATIONS = ("has_parameter_topic", "has_parameter_group")


def flat(c: Column) -> Column:
    """Lower case without blanks."""
    return F.regexp_replace(F.lower(c), r"\s+", "")


def _any(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))


# ---- questions ---------------------------------------------------------------------------------


def asks(q: Column) -> dict[str, Column]:
    """Which shapes a question's words imply, by name."""
    signal = q.rlike("(?i)PWM") & q.rlike(r"(?i)[+-]?\d+(?:\.\d+)?\s*V")
    timing, test = q.rlike(TIMING_ASKED), q.rlike(TEST_ASKED)
    process = q.rlike(rf"(?i)\b(?:{R.PROCESSES})\.\d+\b") | (q.rlike(TOPIC_ASKED) & q.rlike(ACTIVITY_ASKED))
    parameter = ~test & q.rlike(PARAMETER_ASKED)
    out = {
        "signal_state_table": signal, "timing_table": timing, "process_activity": process, "test_method": test, "parameter_definition": parameter,
        "term_definition": ~signal & ~timing & ~process & ~parameter & q.rlike(TERM_ASKED), "requirement": ~test & ~parameter & ~process & q.rlike(REQUIREMENT_ASKED),
    }
    return {name: F.coalesce(c, F.lit(False)) for name, c in out.items()}


def implied(q: Column) -> Column:
    """The shapes that a question implies, in order."""
    found = asks(q)
    return F.array_compact(F.array(*(F.when(found[s], F.lit(s)) for s in SHAPES)))


def allowed(query_type: Column, q: Column) -> Column:
    """The shapes that a question's kind accepts; a definition takes parameters only if it asks for one."""
    table = F.create_map(*(x for k, v in CONTRACTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    shapes = F.coalesce(table[query_type], F.array().cast("array<string>"))
    return F.when((query_type == "definition") & ~asks(q)["parameter_definition"], F.array(F.lit("term_definition"))).otherwise(shapes)


def insists(query_type: Column) -> Column:
    return F.coalesce(query_type.isin(*(k for k in CONTRACTS if k not in OPTIONAL)), F.lit(False))


def active(query_type: Column, q: Column) -> dict[str, Column]:
    """Whether each shape is scored: the question implies it, or its kind accepts it."""
    found, names = asks(q), F.coalesce(F.create_map(*(x for k, v in CONTRACTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))[query_type], F.array().cast("array<string>"))
    return {s: found[s] | F.array_contains(names, s) for s in SHAPES}


def question_tokens(q: Column) -> Column:
    """At most eight tokens that a candidate for a question must have one of, flat: acronyms (CP by its name), test
    points and named resistances and duty cycles."""
    words = F.transform(F.regexp_extract_all(q, F.lit(r"(?i)(?<![A-Za-z0-9.])([A-Z]{2,8}\d*)(?![A-Za-z0-9.])"), F.lit(1)), F.upper)
    words = F.transform(words, lambda w: F.when(w == "CP", "控制导引").otherwise(w))
    named = F.regexp_extract_all(q, F.lit(r"(?i)(检测点\s*\d+|[A-Z]{1,8}阻值|[A-Z]{1,8}占空比)"), F.lit(1))
    return F.transform(F.slice(F.array_distinct(F.concat(words, named)), 1, 8), flat)


def anchors(q: Column) -> Column:
    """At most sixteen things that evidence for a question must name: voltages, acronyms, test points, tables, and
    what a signal or timing question implies."""
    found = lambda p: F.regexp_extract_all(q, F.lit(p), F.lit(1))
    every = F.concat(found(r"(?i)([+-]?\d+(?:\.\d+)?\s*V)"), found(r"(?i)(?<![A-Za-z0-9.])([A-Z]{2,6}\d*)(?![A-Za-z0-9.])"), found(r"(检测点\s*\d+)"), found(r"(?i)(表\s*[A-Z]\s*[.．]\s*\d+|表\s*\d+(?:\.\d+)*)"))
    every = F.transform(every, lambda a: F.when(F.upper(a) == "OBC", "车载充电机").when(F.upper(a) == "CP", "控制导引").otherwise(a))
    asked, none = asks(q), F.array().cast("array<string>")
    more = lambda c, *words: F.when(c, F.array(*map(F.lit, words))).otherwise(none)
    implied_ = (more(q.rlike("(?i)PWM"), "PWM"), more(q.rlike(r"(?i)\bCP\b|控制导引"), "控制导引"), more(asked["signal_state_table"], "状态", "电压"), more(asked["timing_table"], "时序", "控制时序", "状态转换"))
    return F.slice(F.array_distinct(F.concat(every, *implied_)), 1, 16)


# ---- candidates --------------------------------------------------------------------------------


def is_preface(blob: Column) -> Column:
    s = flat(blob)
    return _any(s, ("前言", "目次", "目录", '"scope_type":"preface"'))


def _named(q: Column, s: Column) -> Column:
    tokens = question_tokens(q)
    return (F.size(tokens) == 0) | F.exists(tokens, lambda t: F.contains(s, t))


def is_signal_state(q: Column, blob: Column, exact: bool = True) -> Column:
    """A row of a signal table; exact: with the question's voltage and a test point or the table's number."""
    s, volts = flat(blob), F.regexp_extract(q, r"(?i)([+-]?\d+(?:\.\d+)?)\s*V", 1)
    plain = F.contains(s, F.lit("pwm")) & F.contains(s, F.lit("电压")) & F.contains(s, F.lit("状态"))
    return plain & (volts != "") & F.contains(s, volts) & _any(s, ("检测点1", "表a.4")) if exact else plain


def is_timing(blob: Column) -> Column:
    s = flat(blob)
    return ~is_preface(blob) & _any(s, ("表a.7", "控制时序", "状态转换")) & _any(s, ("时序", "状态"))


def is_process(q: Column, blob: Column) -> Column:
    asked, there = R.process_codes(q), R.process_codes(blob)
    same = (F.size(asked) == 0) | F.arrays_overlap(asked, there)
    return ~is_preface(blob) & (F.size(R.practice_codes(blob)) > 0) & _any(flat(blob), PRACTICE_WORDS) & same


def is_test(q: Column, blob: Column) -> Column:
    s = flat(blob)
    topics = reduce(lambda a, b: a & b, (~F.contains(q, F.lit(k)) for k in OVERVOLTAGE)) | reduce(lambda a, b: a | b, (F.contains(q, F.lit(k)) & _any(s, v) for k, v in OVERVOLTAGE.items()))
    charger = ~q.rlike(K.CHARGER_ASKED) | K.has_any(s, tuple(x.replace(" ", "") for x in K.CHARGER))
    return ~is_preface(blob) & _any(s, TEST_WORDS) & _any(s, STEP_WORDS) & topics & charger


def is_parameter(q: Column, blob: Column) -> Column:
    return ~is_preface(blob) & _named(q, flat(blob)) & _any(flat(blob), PARAMETER_WORDS)


def is_term(q: Column, blob: Column) -> Column:
    return ~is_preface(blob) & _named(q, flat(blob)) & _any(flat(blob), TERM_WORDS)


def is_requirement(q: Column, blob: Column) -> Column:
    return ~is_preface(blob) & _named(q, flat(blob)) & _any(flat(blob), REQUIREMENT_WORDS)


def parameter_value(q: Column, relation: Column) -> Column:
    """The shape score of a parameter's payload: 0.75 and what of its fields the question names."""
    there = F.concat_ws(" ", *(F.coalesce(F.get_json_object("payload", f"$.{k}"), F.lit("")) for k in ("table_title", "source_caption", "table_no")))
    match, mismatch = K.tables_meet(q, there)
    symbol = K.cleaned(F.coalesce(F.get_json_object("payload", "$.symbol"), F.lit("")))
    f = K.parameter_fields(q) | {"symbol": F.coalesce((F.length(symbol) >= 2) & F.rlike(F.upper(q), F.concat(F.lit(r"(?<![A-Z0-9])\Q"), F.upper(symbol), F.lit(r"\E(?![A-Z0-9])"))), F.lit(False))}
    direct = f["parameter"] | f["symbol"] | f["row_focus"]
    total = K._points((F.lit(True), 0.75), (match, 0.45), (mismatch, -0.6), (f["parameter"], 1.1), (f["symbol"], 0.9), (f["row_focus"], 0.45), (f["object"], 0.35), (f["table_focus"], 0.1), (relation.isin(*PARAMETER_RELATIONS) & direct, 0.25))
    return F.when(F.col("payload").isNull(), 0.7).otherwise(F.greatest(F.lit(0.0), total))


def scores(q: Column, blob: Column, fact_type: Column, relation: Column) -> dict[str, Column]:
    """A candidate's score for each shape, 0 where it is none."""
    kind, link = F.coalesce(fact_type, F.lit("")), F.coalesce(relation, F.lit(""))
    signal = F.when(is_signal_state(q, blob), 1.8).when(is_signal_state(q, blob, exact=False), 0.9).otherwise(0.0)
    return {
        "signal_state_table": signal + F.when(_any(blob, ("表 A.4", "检测点 1 的电压状态")), 0.9).otherwise(0.0) + F.when(F.contains(blob, F.lit("表 A.7")), 0.15).otherwise(0.0),
        "timing_table": F.when(is_timing(blob), 1.9).otherwise(0.0),
        "process_activity": F.when(is_process(q, blob), 1.35).otherwise(0.0),
        "test_method": F.when(is_test(q, blob), K._points((F.lit(True), 1.35), (kind == "process_fact", 0.45), (F.contains(flat(blob), F.lit("试验方法及步骤")), 0.25))).otherwise(0.0),
        "parameter_definition": F.when(~is_parameter(q, blob), 0.0).when(kind == "parameter_value", parameter_value(q, link)).when(link.isin(*PARAMETER_RELATIONS), 1.45).when(kind.isin("parameter_definition", "table_requirement"), 1.05).otherwise(0.7),
        "term_definition": F.when(~is_term(q, blob), 0.0).when(link == "defines_term", 1.4).when(kind == "term_definition", 1.05).otherwise(0.65),
        "requirement": F.when(~is_requirement(q, blob), 0.0).when(kind.isin("requirement", "table_requirement"), 1.25).when(F.contains(link, F.lit("requirement")), 1.0).otherwise(0.65),
    }


def settles(q: Column, blob: Column, hits: Column) -> dict[str, Column]:
    """Whether a candidate is what a shape needs."""
    hit = lambda s: F.array_contains(hits, s)
    return {
        "signal_state_table": is_signal_state(q, blob), "timing_table": is_timing(blob), "process_activity": is_process(q, blob), "test_method": hit("test_method") & is_test(q, blob),
        "parameter_definition": hit("parameter_definition") & is_parameter(q, blob), "term_definition": hit("term_definition") & is_term(q, blob), "requirement": hit("requirement") & is_requirement(q, blob),
    }


# ---- judgement ---------------------------------------------------------------------------------


def scored(candidates: DataFrame) -> DataFrame:
    """Candidates (query_id, query_type, question, kind, item_id, blob, payload, fact_type, relation, trust) with what they
    score: 0.22 an anchor, their shapes, 1.05 for a fact on a trusted relation and 0.18 for a table row;
    prefaces and indexes are left out. `matched`, `hits` and `settled` are the anchors and shapes."""
    q, blob = F.col("question"), F.col("blob")
    on, each = active(F.col("query_type"), q), scores(q, blob, F.col("fact_type"), F.col("relation"))
    part = F.struct(*(F.when(on[s], each[s]).otherwise(0.0).alias(s) for s in SHAPES))
    rows = candidates.filter(~F.coalesce(is_preface(blob), F.lit(False))).withColumn("anchors", anchors(q)).withColumn("__s", part)
    rows = rows.withColumn("matched", F.filter("anchors", lambda a: F.contains(flat(blob), flat(a)))).withColumn("hits", F.array_compact(F.array(*(F.when(F.col(f"__s.{s}") > 0, F.lit(s)) for s in SHAPES))))
    fact = F.col("kind") == "fact"
    total = F.size("matched") * 0.22 + reduce(lambda a, b: a + b, (F.col(f"__s.{s}") for s in SHAPES))
    total = total + F.when(fact & F.coalesce(F.col("trust") == "strong", F.lit(False)), 1.05).otherwise(0.0) + F.when(fact & (F.col("fact_type") == "table_requirement"), 0.18).otherwise(0.0)
    done = settles(q, blob, F.col("hits"))
    settled = F.array_compact(F.array(*(F.when(on[s] & F.coalesce(done[s], F.lit(False)), F.lit(s)) for s in SHAPES)))
    return rows.withColumn("points", F.round(total, 6)).withColumn("settled", settled).drop("__s")


def judged(candidates: DataFrame, top: int = 5) -> DataFrame:
    """One row a question: top_score, anchors found and missing among the `top` best, best shape, whether that suffices,
    confidence and the contract's diagnosis.

    Sufficient: 1.1 points or more, at most a third of the anchors missing, an accepted shape settled (or all
    implied ones, for a kind without contract), and the best shape accepted where the contract insists."""
    rows = scored(candidates)
    w = Window.partitionBy("query_id").orderBy(F.desc("points"), "kind", "item_id")
    ranked = rows.withColumn("place", F.row_number().over(w))
    best = F.col("place") <= top
    live = best & (F.col("points") > 0)
    q, kind = F.col("question"), F.col("query_type")
    listed = lambda c, when: F.array_distinct(F.flatten(F.collect_list(F.when(when, F.col(c)))))  # noqa: E731  at most `top` arrays
    counts = [F.count_if(live & F.array_contains("hits", s)).alias(f"__n_{s}") for s in SHAPES] + [F.count_if(F.array_contains("hits", s)).alias(f"__c_{s}") for s in SHAPES]
    per = ranked.groupBy("query_id", "query_type", "question").agg(
        F.max(F.when(F.col("place") == 1, F.col("points"))).alias("top_score"), F.first("anchors").alias("anchors"), listed("matched", live).alias("found"), listed("settled", best).alias("settled"), *counts
    )
    ok = allowed(kind, q)
    order = F.array_sort(F.array(*(F.struct((-F.col(f"__n_{s}")).alias("n"), F.lit(s).alias("s")) for s in SHAPES)))
    present = F.filter(order, lambda x: x["n"] < 0)
    fit = F.filter(present, lambda x: F.array_contains("allowed", x["s"]))
    per = per.withColumn("allowed", ok).withColumn("shape", F.coalesce(F.get(fit, 0)["s"], F.get(present, 0)["s"]))
    missing = F.array_except("anchors", "found")
    active_names = F.array_compact(F.array(*(F.when(c, F.lit(s)) for s, c in active(kind, q).items())))
    shaped = F.when(F.size("allowed") > 0, F.arrays_overlap("settled", "allowed")).otherwise(F.size(F.array_except(active_names, "settled")) == 0)
    accepted = F.array_contains("allowed", F.coalesce("shape", F.lit("")))
    enough = (F.col("top_score") >= 1.1) & (F.size(missing) <= F.floor(F.size("anchors") / 3)) & F.coalesce(shaped, F.lit(False)) & (~insists(kind) | F.coalesce(accepted, F.lit(False)))
    contract = F.coalesce(F.create_map(*(x for k, v in CONTRACTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))[kind], F.array().cast("array<string>"))
    candidate = lambda: reduce(lambda a, b: a | b, ((F.col(f"__c_{s}") > 0) & F.array_contains(contract, s) for s in SHAPES))
    why = (
        F.when(F.size(contract) == 0, "contract_not_defined")
        .when((F.size(implied(q)) > 0) & ~F.arrays_overlap(implied(q), contract), "contract_query_type_wrong")
        .when(F.array_contains(contract, F.coalesce("shape", F.lit(""))), "contract_matched")
        .when(candidate(), "contract_rerank_suppressed_shape")
        .when(reduce(lambda a, b: a | b, (F.col(f"__c_{s}") > 0 for s in SHAPES)), "contract_wrong_shape")
        .otherwise("contract_parse_gap")
    )
    return per.select(
        "query_id", "top_score", F.array_sort("found").alias("found"), F.array_sort(missing).alias("missing"), "shape", enough.alias("sufficient"),
        F.round(F.least(F.lit(0.95), F.greatest(F.lit(0.0), F.col("top_score") / 1.8)), 3).alias("confidence"), why.alias("diagnosis"),
    )
