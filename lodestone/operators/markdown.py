"""Repair of Markdown that a vision model wrote: images, headings, tables, symbols, noise and sections.

Texts are cut into numbered lines. What depends on other lines (a table's columns, an image's number,
the section a line stands in, blank lines) is read from windows over a text's lines, the rest is
one expression a line; the lines that stay are put together again in order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Symbols and what is searched instead of them, sections and lines without use, and parts of lines to drop.
SYMBOLS = {
    "≤": "<=", "≥": ">=", "≠": "!=", "±": "+-", "×": "x", "÷": "/", "∞": "无穷大", "→": "转为", "⇒": "=>", "℃": "摄氏度", "°": "度", "′": "角分", "″": "角秒", "—": "——", "–": "-",
    "“": '"', "”": '"', "‘": "'", "’": "'", "①": "(1)", "②": "(2)", "③": "(3)", "④": "(4)", "⑤": "(5)", "⑥": "(6)", "⑦": "(7)", "⑧": "(8)", "⑨": "(9)", "⑩": "(10)",
    "⑪": "(11)", "⑫": "(12)", "⑬": "(13)", "⑭": "(14)", "⑮": "(15)", "⑯": "(16)", "⑰": "(17)", "⑱": "(18)", "⑲": "(19)", "⑳": "(20)",
    "○": "圆", "●": "实心圆", "△": "三角形", "▲": "上三角", "▽": "倒三角", "▼": "下三角", "◇": "菱形", "◆": "实心菱形", "□": "方框", "■": "实心方框", "☆": "星", "★": "实心星", "※": "参考", "〇": "零",
}
SKIPPED_TITLES = r"^(前\s*言|引\s*言|规范性引用文件)$"
DROPPED_LINES = [r"^##\s*第\d+页$", r"^\*\*图片说明[：:]\*\*", r"^-?\s*\[图\d+[：:]", r"^-?\s*---$"]
DROPPED_PARTS = [r"\$[^$]*\$", r"\$\s", r"[，,]?见[表图附][^\s，。；,]+?(?:的规定|所示|要求)?", r"ICS\s+\d+\.\d+\.\d+", r"CCS\s+[A-Z]\d+"]
IMAGE = r"!\[([^\]]*)\]\(data:image/[^;]+;base64,[A-Za-z0-9+/=]+\)"
NOISE = [r"^[….·⋮\- ]+$", r"^\d{1,3}$"]
SKIPPED_PAGES = (0, 1)
WIDEST = 6
#: Entities that are decoded; the ampersand last, so that nothing is decoded twice.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&#x27;": "'", "&nbsp;": " ", "&amp;": "&"}


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _replaced(c: Column, pairs: dict[str, str]) -> Column:
    return reduce(lambda s, p: F.replace(s, F.lit(p[0]), F.lit(p[1])), pairs.items(), c)


def without_images(lines: DataFrame) -> DataFrame:
    """Embedded images as `[alt - 见图n]`, numbered through each text."""
    alts = F.regexp_extract_all("line", F.lit(IMAGE), F.lit(1))
    rows = lines.withColumn("alts", alts).withColumn("seen", F.coalesce(F.sum(F.size("alts")).over(Window.partitionBy("doc").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    name = lambda i: F.concat(F.lit("["), F.coalesce(F.nullif(F.get("alts", i), F.lit("")), F.lit("Image")), F.lit(" - 见图"), (F.col("seen") + i + 1).cast("string"), F.lit("]"))
    built = F.array_join(F.transform(F.split("line", IMAGE, -1), lambda part, i: F.concat(part, F.when(i < F.size("alts"), name(i)).otherwise(""))), "")
    return rows.withColumn("line", F.when(F.size("alts") > 0, built).otherwise(F.col("line"))).drop("alts", "seen")


def heading(line: Column) -> Column:
    """A heading that is a section number gets the level of its depth."""
    pattern = r"^#{1,6}\s+(\d+(?:\.\d+)*)\s*$"
    number = F.regexp_extract(line, pattern, 1)
    depth = F.least(F.size(F.split(number, r"\.")) + 1, F.lit(6))
    return F.when(number != "", F.concat(F.repeat(F.lit("#"), depth), F.lit(" "), number)).otherwise(line)


def _cells(line: Column) -> Column:
    """The cells of a table row; an empty first and last one are its frame."""
    parts = F.split(line, r"\|", -1)
    rest = F.when(strip(parts[0]) == "", F.slice(parts, 2, F.size(parts))).otherwise(parts)
    rest = F.when((F.size(rest) > 0) & (strip(F.element_at(rest, -1)) == ""), F.slice(rest, 1, F.size(rest) - 1)).otherwise(rest)
    return F.transform(rest, strip)


def repaired_tables(lines: DataFrame) -> DataFrame:
    """Runs of lines with bars: rows get the columns of the first separator row (or of the longest row), short ones by empty
    cells and long ones by joining what is over; tables of more than WIDEST columns become a list of `name: value` lines.
    A single such line is no table."""
    order = Window.partitionBy("doc").orderBy("n")
    bar = F.contains("line", F.lit("|"))
    rows = lines.withColumn("bar", bar).withColumn("first", F.col("bar") & ~F.coalesce(F.lag("bar").over(order), F.lit(False)))
    rows = rows.withColumn("block", F.when(F.col("bar"), F.sum(F.col("first").cast("int")).over(order)))
    rows = rows.withColumn("line", F.when(F.col("bar"), F.replace(_replaced(F.col("line"), ENTITIES), F.lit("\\n"), F.lit(" "))).otherwise(F.col("line")))
    rows = rows.withColumn("cells", F.when(F.col("bar"), _cells(F.col("line"))))
    rows = rows.withColumn("rule", F.coalesce(F.forall("cells", lambda c: c.rlike("^:?-+:?$")), F.lit(False)))
    own = Window.partitionBy("doc", "block")
    size = F.size("cells")
    columns = F.coalesce(F.min(F.when(F.col("rule"), F.struct("n", size.alias("k")))).over(own)["k"], F.max(size).over(own))
    rows = rows.withColumn("k", columns).withColumn("height", F.count("*").over(own))
    k = F.col("k")
    long = F.concat(F.slice("cells", 1, F.greatest(k - 1, F.lit(0))), F.array(F.array_join(F.slice("cells", F.greatest(k, F.lit(1)), size), " ")))
    fitted = F.when(size < k, F.concat("cells", F.array_repeat(F.lit(""), k - size))).when((size > k) & (k > 0), long).otherwise(F.col("cells"))
    rows = rows.withColumn("cells", F.when(F.col("rule"), F.array_repeat(F.lit("---"), k)).otherwise(fitted))
    plain = F.concat(F.lit("| "), F.array_join("cells", " | "), F.lit(" |"))
    body = F.when(~F.col("rule"), F.struct("n", "cells"))
    rows = rows.withColumn("head", F.min(body).over(own)["cells"]).withColumn("rows", F.count(body).over(own)).withColumn("top", F.min("n").over(own))
    named = F.transform("cells", lambda c, i: F.when(c != "", F.concat(F.coalesce(F.nullif(F.get("head", i), F.lit("")), F.concat(F.lit("列"), (i + 1).cast("string"))), F.lit(": "), c)))
    item = F.concat(F.lit("- "), F.array_join(F.array_compact(named), "; "))
    wide = F.col("bar") & (F.col("height") >= 2) & (k > WIDEST)
    listed = ~F.col("rule") & ~((F.col("rows") > 2) & (F.col("cells") == F.col("head"))) & F.exists("cells", lambda c: c != "")
    rows = rows.withColumn("kept", F.when(wide, listed)).withColumn("any", F.max("kept").over(own))
    # A wide table of which nothing is listed leaves one empty line.
    line = F.when(wide & F.col("kept"), item).when(wide & ~F.col("any") & (F.col("n") == F.col("top")), F.lit("")).when(~wide & F.col("bar") & (F.col("height") >= 2), plain).when(~wide, F.col("line"))
    return rows.select("doc", "n", line.alias("line")).filter("line IS NOT NULL")


def without_noise(lines: DataFrame) -> DataFrame:
    """Lines that are no dot leaders, page numbers or headings without a title."""
    s = strip(F.col("line"))
    return lines.filter(~(s.rlike(NOISE[0]) | s.rlike(NOISE[1]) | F.col("line").rlike(r"^#{1,6}\s*$")))


def filtered(lines: DataFrame) -> DataFrame:
    """Lines outside of skipped sections, without useless lines and parts; runs of blank lines become one, and none opens or ends a text.

    A line is in a skipped section if, for some depth, the last heading of that depth or above is a skipped one of that depth."""
    order = Window.partitionBy("doc").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    depth = F.length(F.regexp_extract("line", r"^(#{1,6})\s+", 1))
    title = F.regexp_replace(strip(F.regexp_replace("line", "^#+", "")), r"^[A-Z]?\d*\.?\d*\s+", "")
    rows = lines.withColumn("depth", F.when(F.col("line").rlike(r"^#{1,6}\s+"), depth)).withColumn("skips", F.col("depth").isNotNull() & title.rlike(SKIPPED_TITLES))
    inside = F.lit(False)
    for d in range(1, 7):
        last = F.max(F.when(F.col("depth") <= d, F.struct("n", (F.col("skips") & (F.col("depth") == d)).alias("s")))).over(order)
        inside = inside | F.coalesce(last["s"], F.lit(False))
    rows = rows.withColumn("inside", inside).filter("NOT inside")
    s = strip(F.col("line"))
    rows = rows.filter(~reduce(lambda a, b: a | b, (s.rlike(p) for p in DROPPED_LINES)))
    rows = rows.withColumn("empty", s == "").withColumn("line", reduce(lambda c, p: F.regexp_replace(c, p, ""), DROPPED_PARTS, F.col("line"))).withColumn("blank", strip(F.col("line")) == "")
    before = F.lag("blank").over(Window.partitionBy("doc").orderBy("n"))
    rows = rows.withColumn("again", F.col("empty") & F.coalesce(before, F.lit(False))).filter("NOT again")
    text = F.when(~F.col("blank"), F.col("n"))
    whole = Window.partitionBy("doc")
    rows = rows.withColumn("from", F.min(text).over(whole)).withColumn("to", F.max(text).over(whole))
    return rows.filter("n BETWEEN from AND to").select("doc", "n", "line")


def repair(documents: DataFrame, key: str = "doc_id", text: str = "text", page: str | None = None) -> DataFrame:
    """(key, text) of every document, repaired: images, headings, tables, symbols, noise, then sections.

    Keys must be unique; a null text counts as empty, and a text of which nothing is left is empty. With a column `page`, the texts
    of SKIPPED_PAGES (cover and contents) are empty."""
    source = documents.withColumn("__text", F.coalesce(F.col(text), F.lit("")))
    kept = source if page is None else source.filter(F.coalesce(~F.col(page).isin(*SKIPPED_PAGES), F.lit(True)))
    lines = kept.select(F.col(key).alias("doc"), F.posexplode(F.split("__text", "\n", -1)).alias("n", "line"))
    lines = without_images(lines).withColumn("line", heading(F.col("line")))
    lines = repaired_tables(lines).withColumn("line", _replaced(F.col("line"), SYMBOLS))
    lines = filtered(without_noise(lines))
    whole = lines.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("__whole"))
    return documents.select(key).join(whole, F.col(key) == F.col("doc"), "left").select(key, F.coalesce("__whole", F.lit("")).alias(text))
