"""Structured answers over attributes of entities, contract checks of evaluation cases, and rendered requirements."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.ranking import top_per_group
from lodestone.scratch import materialize

_ROWS_A_TASK = 200_000

# How a question asks for all values of an entity.
LISTED = "有哪些|哪些|所有|全部|什么.*源"


def name_points(question: str, name: Column) -> Column:
    """How many characters of a stated question's Chinese words (2 to 8 characters) an attribute's name has."""
    words = re.findall("[一-鿿]{2,8}", question)
    total = F.lit(0)
    for word in words:
        for c in word:
            total = total + F.contains(name, F.lit(c)).cast("int")
    return total


def shown(name: str = "attribute_name", text: str = "value_text", number: str = "value_num", unit: str = "value_unit") -> Column:
    """An attribute as text: its name, and its text, or its number and unit."""
    plain = F.when(F.col(text).isNotNull() & (F.col(text) != ""), F.concat(F.lit(" = "), text)).when(F.col(number).isNotNull() & F.col(unit).isNotNull(), F.concat(F.lit(" = "), F.col(number).cast("string"), F.lit(" "), F.col(unit)))
    return F.concat(F.col(name), F.coalesce(plain, F.lit("")))


def attributes(table: DataFrame, question: str, entity: str = "entity", k: int = 1) -> DataFrame:
    """(entity, attribute_name, points, shown): what a stated question asks of every entity. A question for a list gets all
    attributes whose names have two or more of its words' characters, titles and services apart; another one the
    k best that have any."""
    points = name_points(question, F.col("attribute_name"))
    rows = table.filter((F.col("attribute_name") != "title") & ~F.startswith("attribute_name", F.lit("service_"))).withColumn("points", points).withColumn("shown", shown())
    if re.search(LISTED, question):
        return rows.filter("points >= 2").select(entity, "attribute_name", "points", "shown")
    return top_per_group(rows.filter("points > 0"), [entity], k, F.desc("points"), "attribute_name", "shown").select(entity, "attribute_name", "points", "shown")


def contract_failures(cases: DataFrame) -> DataFrame:
    """Cases with `failures`, the names of what they expect and did not get, and `passed`.

    expected_* columns that are null expect nothing; a case that was answered by a question back need not reach the graph."""
    e = lambda n: F.col(f"expected_{n}")
    top = lambda n: F.slice("result_ids", 1, n)
    checks = {
        "query_type_mismatch": e("query_type") != F.col("query_type"),
        "clarification_requirement_mismatch": e("clarification") != F.col("clarification"),
        "graph_missing": ~F.col("clarification") & (F.coalesce("graph_candidates", F.lit(0)) < e("graph_candidates")),
        "topic_resolution_wrong": (e("entity") != "") & ~F.contains(F.coalesce("entity", F.lit("")), e("entity")),
        "expected_doc_missing": ~F.array_contains(F.slice("doc_ids", 1, 5), e("doc_id")),
        "forbidden_result_hit": F.arrays_overlap(top(10), F.col("forbidden_ids")),
    }
    names = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items())))
    return cases.withColumn("failures", names).withColumn("passed", F.size("failures") == 0)


def rendered(effective: DataFrame, steps: DataFrame, key: str) -> DataFrame:
    """(key, answer): an effective requirement as text. `effective` has text, conflict and verification, `steps` (key, priority,
    layer, text, effect) the path to it, which is listed in order of priority. A path has as many steps as layers."""
    line = F.concat(F.lit("- "), "layer", F.lit(": "), "text", F.lit(" ("), "effect", F.lit(")"))
    path = steps.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("priority", "layer", line.alias("line")))), lambda x: x["line"]), "\n").alias("path"))
    rows = effective.join(path, key, "left")
    head = (("最终有效需求：", "text"), ("项目：", key), ("冲突状态：", "conflict"), ("证据状态：", "verification"))
    parts = [F.concat(F.lit(name), F.coalesce(F.col(c).cast("string"), F.lit(""))) for name, c in head]
    return rows.select(key, F.concat_ws("\n", *parts, F.when(F.col("path").isNotNull(), F.concat(F.lit("解析路径：\n"), "path"))).alias("answer"))


# The intents of a question by its words, what they are looked for by, and the shape of the answer.
EXPANSIONS = (
    (r"(?i)PWM", r"(?i)[+-]?\d+(?:\.\d+)?\s*V", True, ("signal_state_explanation", "parameter_meaning", "table_lookup"), "explain_state_meaning"),
    ("时序|流程|状态转换|控制时序|握手|预充|启动|停止|停机", "", True, ("timing_lookup", "process_lookup", "state_transition_lookup"), "process_or_timing"),
    ("(?i)阻值|电阻|电压|电流|频率|占空比|检测点", "", False, ("parameter_meaning", "parameter_value", "table_lookup"), "parameter_explanation"),
    ("有哪些要求|有什么要求|要求有哪些|要求是什么|应满足什么|应符合什么|不应超过什么|不小于什么", "", False, ("requirement_lookup", "constraint_lookup"), "requirement_set"),
    ("是什么意思|什么是|定义|含义", "", False, ("term_definition", "definition"), "definition"),
)


def expansion(question: Column) -> Column:
    """Struct intents, shape of a question by the first rule that fits; those for a pilot need one in the question."""
    pilot = question.rlike(r"(?i)(?<![A-Za-z0-9])CP(?![A-Za-z0-9])|控制导引|control pilot")
    out = None
    for first, second, of_pilot, intents, shape in EXPANSIONS:
        fits = question.rlike(first) & (question.rlike(second) if second else F.lit(True)) & (pilot if of_pilot else F.lit(True))
        value = F.struct(F.array(*map(F.lit, intents)).alias("intents"), F.lit(shape).alias("shape"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out.otherwise(F.struct(F.array(F.lit("general_search")).alias("intents"), F.lit("freeform").alias("shape")))


def longest_prefixes(words: DataFrame, key: str, word: str, names: DataFrame, name: str, least: int = 2) -> DataFrame:
    """(key, prefix, hits): for each word the longest of its prefixes, of `least` characters or more, with which any name begins,
    and how many names do. Prefixes of distinct words and names meet by an equi-join; keys meet their words afterwards, dealt
    into tasks of about as many rows, so that what a task holds does not grow with the table."""
    cut = lambda c: F.transform(F.sequence(F.lit(least), F.greatest(F.length(c), F.lit(least))), lambda n: F.substring(c, F.lit(1), n))
    own = words.filter(F.length(word) >= least).select(key, F.col(word).alias("__word"))
    there = names.filter(F.length(name) >= least).select(name).distinct().select(F.explode(cut(F.col(name))).alias("prefix")).groupBy("prefix").agg(F.count("*").alias("hits"))
    met = own.select("__word").distinct().select("__word", F.explode(cut(F.col("__word"))).alias("prefix")).join(there, "prefix")
    longest = F.max(F.struct(F.length("prefix").alias("length"), "prefix", "hits")).alias("__best")
    best = materialize(met.groupBy("__word").agg(longest), "prefixes")
    dealt = own.repartition(max(1, -(-own.count() // _ROWS_A_TASK)), key)
    return dealt.join(best, "__word").groupBy(key).agg(F.max("__best").alias("__best")).select(key, "__best.prefix", "__best.hits")


def entity_pages(entities: DataFrame, facts: DataFrame, key: str, kinds: dict[str, str], most: int = 20) -> DataFrame:
    """(key, page): a Markdown page of each ready entity (key, name, entity_type, status): title, type, and for each kind of its
    facts (key, fact_type, rank, text) a section of the `most` best; entities that are not ready have no page."""
    ready = entities.filter("status = 'ready'")
    order = F.array_position(F.array(*map(F.lit, kinds)), F.col("fact_type"))
    top = top_per_group(facts.filter(F.col("fact_type").isin(*kinds)).distinct(), [key, "fact_type"], most, "rank", "text")
    lines = top.groupBy(key, "fact_type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: F.concat(F.lit("- "), x["text"])), "\n").alias("body"))  # `most` at most
    titles = F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair))
    parts = lines.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("at"), F.concat(F.lit("## "), titles[F.col("fact_type")], F.lit("\n"), "body").alias("text")))), lambda x: x["text"]), "\n").alias("sections"))
    return ready.join(parts, key, "left").select(key, F.concat_ws("\n", F.concat(F.lit("# "), "name"), F.concat(F.lit("type: "), "entity_type"), "sections").alias("page"))


def dashboard(documents: DataFrame, parts: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, a count by name): how many rows each part has for every document; documents without any have 0."""
    out = documents.select(key).distinct()
    for name, df in parts.items():
        out = out.join(df.groupBy(key).agg(F.count("*").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out

