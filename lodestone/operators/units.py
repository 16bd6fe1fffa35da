"""Knowledge units from ordered blocks: definitions, procedures, tables and requirements.

A document's blocks are walked in order: a heading sets the heading of what follows; a block that is a
term, with a body after it, is a definition and takes the body with it; others are procedures, tables
or requirements by their text and heading. Whether a block is a term depends on it and the next block
alone, so in a run of terms every other one is a definition, and the walk becomes window functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import rules as R

# Marks of copyright notices (the strong ones do alone), and of boilerplate that is no requirement.
STRONG = ("© iso", "© iec", "© gb", "© qc", "all rights reserved", "copyright protected")
WEAK = ("reference number", "price based on", "international standard", "iso shall not be held responsible", "iec shall not be held responsible")
BOILERPLATE = (
    "iso shall not be held responsible", "iec shall not be held responsible", "attention is drawn to the possibility", "the procedures used to develop this document",
    "any trade name used in this document", "copyright protected document", "all rights reserved",
)

# Words by which blocks show what they are.
DEFINING = ("是", "指", "用于", "能够", "通过", "作为", "实现")
MODAL = ("应", "不应", "不得", "宜", "可采用", "可通过")
REQUIRING = ("应", "不应", "不得", "不超过", "不小于", "应符合", "应满足")
NO_PROCEDURE = ("前言", "规范性引用文件", "范围", "术语和定义", "要求", "检验规则", "标志、包装、运输和贮存")
TEST_HEADING = ("试验", "试验方法", "试验条件", "检查", "步骤")
ACTIONS = ("按照", "测量", "施加", "连接", "进行试验", "检查", "测试", "记录", "固定", "调节", "使用")
LAYOUT = ("PUBLIC", "BASEPRACTICES", "基本实践", "VDAQMC", "AUTOMOTIVESPICE", "AUTOMOTIVESPICE®")
INDEX_TITLES = ("标准编号", "标准名称", "起始实施日期", "被代替标准编号")


def _any(c: Column, words) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(c, F.lit(w)) for w in words))


def plain(c: Column) -> Column:
    """Text without emphasis marks around it."""
    return F.btrim(F.trim(F.regexp_replace(c, r"\*\*|__", "")), F.lit("*`_ "))


def is_copyright(c: Column) -> Column:
    low = F.lower(c)
    count = reduce(lambda a, b: a + b, (F.contains(low, F.lit(m)).cast("int") for m in STRONG + WEAK))
    return (count >= 2) | _any(low, STRONG)


def is_navigation(c: Column) -> Column:
    """Page numbers, dotted lines, running heads and the titles of front matter."""
    s = F.trim(F.regexp_replace(plain(c), r"\s+", " "))
    return (s == "") | s.rlike(r"^\d{1,3}(?:\s+\d{1,3}){0,8}$|\.{5,}|^\d+\s*\||^(?i:\d{1,3}\s+See\s*\(\d+\)\.?)$|^(?i:(?:contents|foreword|introduction)\s*(?:page)?)$")


def is_caption(c: Column) -> Column:
    return plain(c).rlike(r"^(?:表|图)\s*(?:[A-Z]\s*\.?\s*)?\d+(?:\.\d+)*(?:[—\-:：\s]|$)|^注\s*\d*\s*[:：]")


def is_practice(c: Column) -> Column:
    return plain(c).rlike(r"(?i)^[A-Z]{2,5}\.\d+\.(?:BP|GP|PA)\d+(?::|：|\s|$)")


def is_reference(c: Column) -> Column:
    return c.rlike(r"(?i)^(?:GB/T|GB|ISO|IEC|QC/T|JB/T|SJ/T)\s*[\d.]+")


def is_layout(c: Column) -> Column:
    s = F.upper(F.regexp_replace(F.trim(c), r"\s+", ""))
    return (s == "") | s.isin(*LAYOUT) | s.rlike(r"^\d{1,4}(?:PUBLIC)?$")


def is_name_list(c: Column) -> Column:
    return plain(c).rlike("^[一-鿿]{2,4}(?:[，,、]\\s*[一-鿿]{2,4}){1,5}$")


def is_section(c: Column) -> Column:
    s = plain(c)
    return s.rlike(r"^\.|^\d+(?:\.\d+){0,5}\.?\s+\S|^[A-Z]{1,5}\.\d+(?:\.\d+)*\.?\s+\S")


def is_label(c: Column) -> Column:
    """A name that can be defined: short, without clauses, list marks and modal verbs."""
    s = plain(c)
    return (F.length(s) <= 80) & ~is_layout(s) & ~s.rlike("[。；;：:]") & ~s.rlike(r"^(?:——|[-•*])|^(?i:[a-z]\))") & ~_any(s, MODAL)


def is_values(c: Column) -> Column:
    """Cells of a table rather than a sentence."""
    s = F.regexp_replace(plain(c), r"\s+", "")
    digits, cjk = F.length(F.regexp_replace(s, r"\D", "")), F.length(F.regexp_replace(s, "[^一-鿿]", ""))
    marks = F.regexp_count(s, F.lit(r"(?i)状态[IVXⅠⅡⅢ一二三]+|等级[IVXⅠⅡⅢ一二三\d]+|Hz|kHz|MHz|V|A|%|工频周期|ms|s|min"))
    n = F.greatest(F.length(s), F.lit(1))
    return (F.length(s) >= 20) & (((marks >= 3) & (digits >= 6)) | ((digits / n > 0.28) & (cjk / n < 0.45)))


def is_legend(label: Column, body: Column) -> Column:
    a, b = plain(label), plain(body)
    return a.rlike("[☆★]") | F.startswith(b, F.lit("标引序号说明")) | ((F.size(F.split(a, r"\s+")) >= 4) & _any(b, ("标引序号", "连接点", "图中")))


def is_definition(label: Column, body: Column) -> Column:
    """Whether a block is a term that the next block defines."""
    no = F.startswith(label, F.lit("#")) | is_caption(label) | is_practice(label) | is_name_list(label) | is_section(label) | ~is_label(label) | is_reference(label)
    no = no | is_caption(body) | is_practice(body) | is_legend(label, body) | is_values(body) | is_reference(body) | label.rlike(r"^<div|^<table|^\d+\.\d+$") | ~label.rlike(r"\p{L}")
    return F.coalesce((label != "") & (F.length(label) <= 120) & (F.length(body) >= 12) & _any(body, DEFINING) & ~no, F.lit(False))


def is_procedure(c: Column, heading: Column, section: Column) -> Column:
    allowed, own = ~_any(heading, NO_PROCEDURE), is_practice(c)
    no = is_caption(c) | F.startswith(c, F.lit("关键词")) | is_reference(c)
    test = _any(heading, TEST_HEADING) | F.coalesce(section.rlike(r"^5(?:\.|$)"), F.lit(False))
    return allowed & (own | (~no & test & _any(c, ACTIONS)))


def is_markdown_table(c: Column) -> Column:
    return c.rlike(r"^\|.*\n(?:[^|\n].*\n)?\s*\|\s*:?-{3,}") | c.rlike(r"^\|[^\n]*\n\s*\|[^\n]*\|\s*:?-{3,}")


def is_requirement(c: Column) -> Column:
    s = F.trim(F.regexp_replace(F.lower(plain(c)), r"\s+", " "))
    return (s != "") & ~_any(s, BOILERPLATE) & (_any(c, REQUIRING) | plain(c).rlike(r"(?i)\b(?:shall|should|must|is\s+required\s+to|are\s+required\s+to|be\s+required\s+to)\b"))


def requirement_topic(title: Column, subject: Column) -> Column:
    """What a requirement is about: its subject, else its title, without numbers and marks of annexes."""

    def of(c: Column) -> Column:
        s = F.regexp_replace(F.regexp_replace(F.trim(c), r"^\d+(?:\.\d+){0,8}\s*", ""), "[（(](?:规范性|资料性)[)）]", "")
        s = F.trim(F.element_at(F.split(s, "[。:：]", 2), 1))
        return F.when(~F.trim(c).rlike(r"(?i)^page_\d+_requirement$"), R.some(F.substring(s, 1, 120)))

    return F.coalesce(of(subject), of(title))


def extract(blocks: DataFrame) -> DataFrame:
    """doc_id, page_no, place (from 1, in the page), unit_type, title, content, section, subject, topic, scope_type, condition,
    threshold, role, headers, rows of each unit.

    `blocks` has doc_id, page_no, place (consecutive), type (heading, table, paragraph) and text. Blank blocks and
    copyright notices give nothing. A document is walked in one task; its blocks are a document's."""
    text = F.trim(F.coalesce("text", F.lit("")))
    in_page = Window.partitionBy("doc_id", "page_no").orderBy("place")
    in_doc = Window.partitionBy("doc_id").orderBy("page_no", "place")
    rows = blocks.select("doc_id", "page_no", "place", F.coalesce("type", F.lit("paragraph")).alias("type"), text.alias("text"))
    rows = rows.withColumn("next", F.coalesce(F.lead("text").over(in_page), F.lit(""))).withColumn("before", F.coalesce(F.lag("text").over(in_page), F.lit("")))
    live = (F.col("text") != "") & ~is_copyright(F.col("text"))
    rows = rows.withColumn("live", live).withColumn("term", F.col("live") & (F.col("type") != "heading") & is_definition(F.col("text"), F.col("next")))
    # In a run of terms every other block is one; the one after it is its body.
    rows = rows.withColumn("gap", F.sum((~F.col("term")).cast("int")).over(in_page.rowsBetween(Window.unboundedPreceding, 0)))
    in_run = Window.partitionBy("doc_id", "page_no", "gap").orderBy("place")
    rows = rows.withColumn("nth", F.row_number().over(in_run) - F.when(F.first("term").over(in_run), 1).otherwise(2))
    rows = rows.withColumn("definition", F.col("term") & (F.col("nth") % 2 == 0))
    rows = rows.withColumn("taken", F.coalesce(F.lag("definition").over(in_page), F.lit(False)))
    heading = F.trim(F.regexp_replace("text", "^#+", ""))
    sets = (F.col("type") == "heading") & F.col("live") & ~F.col("taken") & ~is_navigation(heading)
    carried = F.last(F.when(sets, F.struct(heading.alias("heading"), R.first_of(heading, [r"^(\d+(?:\.\d+){0,5})\b"]).alias("section"))), True).over(in_doc.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("state", carried).withColumn("heading", F.coalesce("state.heading", F.lit(""))).withColumn("section", F.col("state.section"))
    rows = rows.filter("live and not taken and type <> 'heading'")
    c, h = F.col("text"), F.col("heading")
    kind = (
        F.when(F.col("definition"), "definition").when(is_procedure(c, h, F.col("section")), "procedure").when((F.col("type") == "table") | is_markdown_table(c), "table_requirement")
        .when(is_requirement(c) & ~is_copyright(h), "requirement")
    )
    rows = rows.withColumn("unit_type", kind).filter("unit_type is not null")
    named = {"procedure": "procedure", "table_requirement": "table", "requirement": "requirement"}
    title = F.when(F.col("unit_type") == "definition", c).otherwise(F.coalesce(R.some(h), *(F.when(F.col("unit_type") == k, F.concat(F.lit("page_"), F.col("page_no").cast("string"), F.lit(f"_{v}"))) for k, v in named.items())))
    rows = rows.withColumn("title", title).withColumn("content", F.when(F.col("unit_type") == "definition", F.col("next")).otherwise(c))
    need, table = F.col("unit_type") == "requirement", F.col("unit_type") == "table_requirement"
    caption = F.when(F.contains(R.html_cell("before"), F.lit("表")), R.html_cell("before")).otherwise(R.some(h))
    cells = F.when(table, F.when(is_markdown_table(c), R.markdown_table(c)).otherwise(R.html_table(c)))
    rows = rows.withColumn("table_title", F.when(table, caption)).withColumn("cells", cells).withColumn("subject", F.when(need, R.requirement_subject(F.col("title"), c)))
    scope = F.when(need, R.requirement_scope(F.col("title"), c, F.coalesce("section", F.lit("")))).when(table & _any(F.concat_ws(" ", "title", "table_title"), INDEX_TITLES), "index")
    about = F.concat_ws(" ", "table_title", "title", F.array_join("cells.headers", " "))
    role = (
        F.when(F.col("unit_type") == "procedure", F.when(F.col("content").rlike(r"(?i)\b(?:ACQ|SYS|SWE|SUP|MAN|HWE|VAL|REU|PIM|MLE|SPL)\.\d+\.BP\d+\b"), "process_practice").otherwise("procedure"))
        .when(table, F.when(_any(about, ("时序", "状态", "条件", "时间", "控制时序")), "timing_table").when(F.contains(about, F.lit("参数")), "parameter_table").otherwise("table_requirement"))
        .when(need, scope).otherwise("definition")
    )
    return rows.select(
        "doc_id", "page_no", "place", "unit_type", "title", "content", "section", "subject", F.when(need, requirement_topic(F.col("title"), F.col("subject"))).alias("topic"), scope.alias("scope_type"),
        F.when(need, R.requirement_condition(c)).alias("condition"), F.when(need, R.requirement_threshold(c)).alias("threshold"), role.alias("role"), F.col("cells.headers").alias("headers"), F.col("cells.rows").alias("rows"),
    )
