"""Layout and structure of documents, scopes of parameters, quality of entities, coverage of sections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import rules as R

# Names that a parameter's row or table can be about, and those that are interfaces.
SIGNALS = ("CC1", "CC2", "CP", "R1", "R2", "R3", "R4", "R4C", "R4C'", "RV", "RV'")
PLACES = ("控制导引", "检测点1", "检测点2", "检测点3", "车辆插头", "车辆插座", "充电机", "电动汽车")
INTERFACES = ("车辆插头", "车辆插座", "充电机", "电动汽车")
POINTS = ("检测点1", "检测点2", "检测点3")


def segments(blocks: DataFrame, key: str, text: str) -> DataFrame:
    """(key, place from 1, type, text): a Markdown block cut at headings, before tables and at blank lines; a segment is a
    table, a heading (marked, numbered or an annex) or a paragraph."""
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    s = strip(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n{3,}", "\n\n"))
    parts = F.split(s, r"\n(?=#{1,6}\s)|(?=<(?i:table))")
    pieces = F.flatten(F.transform(parts, lambda p: F.when(F.lower(strip(p)).startswith("<table"), F.array(strip(p))).otherwise(F.transform(F.split(strip(p), r"\n\s*\n"), strip))))
    rows = blocks.select(key, F.posexplode(F.filter(pieces, lambda p: p != "")).alias("at", "text"))
    c = F.col("text")
    kind = F.when(F.lower(c).startswith("<table"), "table").when(c.startswith("#") | c.rlike(r"^(?:附录\s*[A-ZＡ-Ｚ]|\d+(?:\.\d+){0,5}\s+\S)"), "heading").otherwise("paragraph")
    return rows.select(key, (F.col("at") + 1).alias("place"), kind.alias("type"), "text")


def sections(blocks: DataFrame) -> DataFrame:
    """Blocks (doc_id, page_no, reading_order, block_id, type, text) that are headings, in reading order, with title, level and
    section_number: marked headings by their marks, others by their number, annexes at the first level."""
    s = F.trim(F.coalesce("text", F.lit("")))
    marks = F.length(F.regexp_extract(s, "^(#*)", 1))
    plain = F.trim(F.regexp_replace(s, "^#+", ""))
    number = R.section_number(F.when(F.col("type") == "heading", plain).otherwise(s))
    found = F.when((F.col("type") == "heading") | number.isNotNull(), F.when((F.col("type") == "heading") & (marks > 0), F.least(marks, F.lit(6))).otherwise(R.section_level(number))).when(s.rlike(r"^附录\s*[A-ZＡ-Ｚ]"), F.lit(1))
    rows = blocks.withColumn("title", s).withColumn("level", found).withColumn("section_number", number).filter("title <> '' and level is not null")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no", "reading_order", "block_id"))
    return rows.select("doc_id", place.alias("place"), "block_id", "title", F.col("level").cast("int").alias("level"), "section_number")


def parameter_scope(title: Column, table_title: Column, row: Column) -> Column:
    """Struct focus_tags, row_focus_tags, table_focus_tags, loop_scope, detection_points, interface_scope, scope_confidence of a
    parameter's row: a tag is the row's if the row names it, else the table's if a title does."""
    own, table = F.upper(row), F.upper(F.concat_ws(" ", title, table_title))
    every = F.array(*map(F.lit, SIGNALS + PLACES))
    in_row = F.filter(every, lambda x: F.contains(own, x))
    in_table = F.filter(every, lambda x: ~F.contains(own, x) & F.contains(table, x))
    tags = F.filter(every, lambda x: F.contains(own, x) | F.contains(table, x))
    of = lambda names: F.filter(tags, lambda x: x.isin(*names))
    has = lambda x: F.array_contains(tags, x)
    loop = F.when(has("CC1") | has("CC2"), "cc").when(has("CP"), "cp").otherwise("general")
    sure = F.when(F.size(in_row) > 0, "row").when(F.size(in_table) > 0, "table").otherwise("none")
    return F.struct(tags.alias("focus_tags"), in_row.alias("row_focus_tags"), in_table.alias("table_focus_tags"), loop.alias("loop_scope"), of(POINTS).alias("detection_points"), of(INTERFACES).alias("interface_scope"), sure.alias("scope_confidence"))


# What page and table furniture leaves in names, by signal.
NOISE = ("page_header_public", "table_header_base_practices", "publisher_header_vda_qmc", "reference_model_entity", "raw_page_text_entity", "oversized_table_or_page_title")


def noise_signals(c: Column) -> Column:
    """The signals, sorted, that a name is furniture of a page or table."""
    s = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    upper = F.replace(F.upper(s), F.lit(" "), F.lit(""))
    n = F.length(s)
    tests = (
        F.contains(upper, F.lit("PUBLIC")) & (n <= 120), F.contains(upper, F.lit("BASEPRACTICES")) | (s == "基本实践"), F.contains(upper, F.lit("VDAQMC")) & (n <= 120),
        F.contains(s, F.lit("过程参考模型")) | F.contains(s, F.lit("Process reference model")), F.startswith(s, F.lit("--- Page")), (n > 180) & s.rlike("表|图|--- Page"),
    )
    return F.array_sort(F.array_compact(F.array(*(F.when(t, F.lit(name)) for t, name in zip(tests, NOISE, strict=True)))))


def quarantined(entities: DataFrame, facts: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, facts, edges) after the entities (entity_id, canonical_name, entity_status) with a noise signal are set stale: facts
    (subject_id, object_id) name them no more, and edges (src, dst) at them are gone."""
    marked = entities.withColumn("entity_status", F.when(F.size(noise_signals(F.col("canonical_name"))) > 0, "stale").otherwise(F.col("entity_status")))
    bad = entities.filter(F.col("entity_status") != "stale").filter(F.size(noise_signals(F.col("canonical_name"))) > 0).select(F.col("entity_id").alias("__bad")).distinct()

    def cleared(df: DataFrame, c: str) -> DataFrame:
        return df.join(bad, F.col(c) == F.col("__bad"), "left").withColumn(c, F.when(F.col("__bad").isNull(), F.col(c))).drop("__bad")

    kept = edges.join(bad, F.col("src") == F.col("__bad"), "left_anti").join(bad, F.col("dst") == F.col("__bad"), "left_anti")
    return marked, cleared(cleared(facts, "subject_id"), "object_id"), kept


def title_key(c: Column) -> Column:
    """A section's title without number, marks and blanks."""
    return F.regexp_replace(F.regexp_replace(F.trim(c), r"^(?:#+\s*)?(?:\d+(?:\.\d+)*|[A-Z]\.\d+(?:\.\d+)*)?\s*", ""), r"\s+", "")


def missing_sections(source: DataFrame, compiled: DataFrame, doc: str, title: str, level: str) -> DataFrame:
    """(doc, title): sections of a source below the first level whose title, its first four characters, and its parts of four
    characters or more the compiled text (doc, text) lacks; each key once, page marks and references apart."""
    rows = source.withColumn("__key", title_key(F.col(title))).filter((F.length("__key") >= 2) & (F.col(level) > 1) & ~F.col(title).rlike(r"^第\d+页$|参考文献"))
    one = rows.groupBy(doc, "__key").agg(F.min(title).alias(title))
    both = one.join(compiled.select(doc, F.regexp_replace("text", r"\s+", "").alias("__text")), doc, "left")
    there = F.coalesce("__text", F.lit(""))
    parts = F.filter(F.split("__key", "[的与和及、]"), lambda p: F.length(p) >= 4)
    found = F.contains(there, F.col("__key")) | ((F.length("__key") >= 4) & F.contains(there, F.substring("__key", 1, 4))) | F.exists(parts, lambda p: F.contains(there, p))
    return both.filter(~found).select(doc, title)


def senses(terms: DataFrame, entities: DataFrame) -> DataFrame:
    """(acronym, senses, labels): acronyms of terms (term, definition) and of entities' names that stand for two or more labels,
    labels told apart without case and blanks."""
    a = terms.select(R.acronym("term", "definition").alias("acronym"), F.trim(F.regexp_replace("term", r";\s*[A-Z]{2,6}\s*$", "")).alias("label"))
    b = entities.select(R.acronym("canonical_name", "canonical_name").alias("acronym"), F.trim(F.regexp_replace(F.regexp_replace("canonical_name", r";\s*[A-Z]{2,6}\s*$", ""), r"[（(]\s*[A-Z]{2,6}\s*[)）]", "")).alias("label"))
    rows = a.unionByName(b).filter("acronym is not null and label <> ''").withColumn("__key", F.regexp_replace(F.lower("label"), r"\s+", ""))
    one = rows.groupBy("acronym", "__key").agg(F.min("label").alias("label"))
    per = one.groupBy("acronym").agg(F.count("*").alias("senses"), F.array_join(F.slice(F.array_sort(F.collect_list("label")), 1, 5), ";").alias("labels"))
    return per.filter("senses >= 2")


def routing_terms(q: Column) -> Column:
    """At most 32 terms by which a question is routed: itself, its acronyms and codes, and what a pilot, timing, PWM or voltage
    implies."""
    none = F.array().cast("array<string>")
    more = lambda c, *words: F.when(c, F.array(*(w if isinstance(w, Column) else F.lit(w) for w in words))).otherwise(none)
    pilot, volts = q.rlike(r"(?i)(?<![A-Za-z0-9])CP(?![A-Za-z0-9])|控制导引"), F.regexp_extract(q, r"(?i)([+-]?\d+(?:\.\d+)?)\s*V", 1)
    signal, pwm = q.rlike("(?i)PWM") & (volts != ""), q.rlike("(?i)PWM")
    timing = q.rlike("时序|流程|状态转换|控制时序|握手|预充|启动|停止|停机")
    own = F.regexp_extract_all(q, F.lit(r"(?<![A-Za-z0-9.])([A-Z]{2,6}\d*)(?![A-Za-z0-9.])"), F.lit(1))
    parts = (
        F.array(F.trim(q)), own, more(pilot, "控制导引"), more(pilot & (signal | q.rlike(r"检测点\s*1")), "检测点 1", "检测点1"), more(timing, "控制时序", "控制时序表", "状态转换", "表 A.7", "交流充电控制时序表"), more(pwm, "PWM", "是否输出 PWM"),
        more(volts != "", volts, F.concat(volts, F.lit("V")), F.concat(volts, F.lit(" V"))), more(pwm & (volts != "") & pilot, "表 A.4", "电压状态", "充电过程状态"),
    )
    return F.slice(F.array_distinct(F.filter(F.concat(*parts), lambda x: x != "")), 1, 32)


def linked_units(units: DataFrame, unit: str, arrays: dict[str, str]) -> DataFrame:
    """(unit, kind, id): each unit's links of each array column, by kind, once; null and blank ids are none."""
    one = [units.select(unit, F.lit(kind).alias("kind"), F.explode(c).alias("id")).withColumn("id", F.col("id").cast("string")) for kind, c in arrays.items()]
    return reduce(DataFrame.unionByName, one).filter("id is not null and trim(id) <> ''").distinct()
