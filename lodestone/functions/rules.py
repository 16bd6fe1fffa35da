"""Rules of the domain as Column expressions: keys, codes, names, terms, limits, dates, tables.

Every function takes columns (or their names) and stays in the JVM. Null gives null, or an empty array
where an array is the result, unless a function says otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import col

# Full-width forms and what they are in half width (the part of NFKC that concerns widths).
WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "\u3000"
NARROW = "".join(chr(c) for c in range(0x21, 0x7F)) + " "

# The reference's compounds and keywords of long questions.
COMPOUNDS = (
    "温度范围", "工作温度", "相对湿度", "最高温度", "最低温度", "供电设备", "车载充电", "控制导引", "双向充电", "双向放电",
    "动力蓄电池", "充放电设备", "负荷供电", "室外使用", "室内使用", "正常工作", "工作温度范围", "连接确认", "能量传输",
)
KEYWORDS = (
    "温度", "湿度", "范围", "室外", "室内", "供电", "充电", "放电", "蓄电池", "负荷", "电网", "电压", "电流", "功率", "通信", "调度",
    "控制器", "接触器", "插头", "插座", "充电机",
)

# The reference's synonyms.
SYNONYMS = {
    "充电导引": ["控制导引", "控制导引电路", "充电控制导引电路"],
    "导引电路": ["控制导引电路", "充电控制导引电路"],
    "导引功能": ["控制导引功能", "control pilot function"],
    "车网互动": ["V2G", "Vehicle-to-Grid", "电动汽车与电网充放电双向互动"],
    "车网": ["V2G", "Vehicle-to-Grid"],
    "车载充电机": ["电动汽车用传导式车载充电机", "on-board charger", "OBC"],
    "OBC": ["车载充电机", "电动汽车用传导式车载充电机", "on-board charger", "onboard charger"],
    "CC": ["CC1", "CC2", "控制导引", "控制导引电路"],
    "CP": ["控制导引", "控制导引电路", "control pilot", "检测点"],
    "V2L": ["Vehicle-to-Load", "电动汽车对负荷供电", "对外放电", "放电模式"],
    "V2V": ["Vehicle-to-Vehicle", "电动汽车之间充放电", "车对车放电", "放电模式"],
    "V2G": ["Vehicle-to-Grid", "电动汽车与电网充放电双向互动", "车网互动", "并网放电"],
    "放电设备": ["discharging equipment", "充放电设备", "charging and discharging equipment"],
    "充放电设备": ["charging and discharging equipment", "放电设备", "discharging equipment"],
    "对外放电": ["V2L", "Vehicle-to-Load", "电动汽车对负荷供电"],
}

# Words that carry no meaning of their own, and the endings of a question about limits.
PARTICLES = ("的", "了", "和", "与", "或", "及", "等", "吗", "呢", "啊")
ENDINGS = ("(?:的)?(?:要求|规定)$", "(?:的)?(?:功能)$", "(?:的)?(?:时间|时长)$", "是什么$", "应满足什么$", "应符合什么$", "有哪些$", "有什么$")

# Unit names, and the header names that a table's column may contain, first match first.
UNITS = {"mv": "mV", "毫伏": "mV", "v": "V", "伏": "V", "ma": "mA", "毫安": "mA", "a": "A", "安": "A", "％": "%", "%": "%"}
HEADERS = ("参数", "时序", "符号", "单位", "标称值", "最大值", "最小值", "电路版本", "状态", "对象")

# Process groups whose numbers are codes.
PROCESSES = "SWE|SYS|SUP|MAN|ACQ|ENG|HWE|MLE|PIM|REU"

# Names of months on covers.
MONTHS = {m: f"{i:02}" for i, m in enumerate(("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"), 1)}


def some(c: Column) -> Column:
    """Null for an empty string."""
    return F.nullif(c, F.lit(""))


def first_of(c: Column, patterns: list[str], group: int = 1) -> Column:
    """What the first pattern that occurs captures, or null."""
    return F.coalesce(*(some(F.regexp_extract(c, p, group)) for p in patterns))


def words_in(c: Column | str, words: tuple[str, ...]) -> Column:
    """Those of the words that a text contains, in their order."""
    s = col(c)
    return F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(s, w))


# ---- keys --------------------------------------------------------------------------------------


def fold_width(c: Column | str) -> Column:
    return F.translate(col(c), WIDE, NARROW)


def compare_key(c: Column | str) -> Column:
    """Letters, digits and marks alone, in lower case and half width."""
    return F.regexp_replace(F.lower(fold_width(c)), r"[^\p{L}\p{N}\p{M}]+", "")


def soft_contains(a: Column | str, b: Column | str) -> Column:
    """Whether one key is part of the other; false if either is empty."""
    x, y = compare_key(a), compare_key(b)
    return F.coalesce((x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x)), F.lit(False))


def folded_equal(a: Column | str, b: Column | str) -> Column:
    """Equality whatever the width, case and blanks."""
    key = lambda c: F.lower(F.trim(F.regexp_replace(fold_width(c), r"\s+", " ")))
    return key(a) == key(b)


def blob_key(c: Column | str) -> Column:
    """A document's text as one key: no blanks, slashes or underscores; spaced standard prefixes joined."""
    s = F.regexp_replace(F.translate(F.lower(col(c)), "—", "-"), r"[_/\\]", "")
    return F.regexp_replace(F.replace(F.replace(s, F.lit("gb t"), F.lit("gbt")), F.lit("qc t"), F.lit("qct")), r"\s+", "")


def _slashed(c: Column | str, order: tuple[str, ...]) -> Column:
    full = {"GBT": "GB/T", "GB T": "GB/T", "QC T": "QC/T"}
    return reduce(lambda s, k: F.replace(s, F.lit(k), F.lit(full[k])), order, F.upper(col(c)))


def standard_code(c: Column | str) -> Column:
    """Upper case, GBT as GB/T, long dashes, no blanks."""
    return F.regexp_replace(F.translate(_slashed(c, ("GBT", "GB T", "QC T")), "-", "—"), r"\s+", "")


def standard_anchor(c: Column | str) -> Column:
    """The code's letters and digits."""
    return F.regexp_replace(_slashed(c, ("GB T", "GBT", "QC T")), "[^A-Z0-9]+", "")


def canonical_name(c: Column | str) -> Column:
    """Half width, blanks collapsed, hyphens, without a closing mark in brackets, a year from 1950 to 2099, and
    loose marks at the end."""
    s = F.trim(F.regexp_replace(F.trim(fold_width(c)), r"\s+", " "))
    s = F.translate(F.regexp_replace(s, r"\s*\([^)]{1,8}\)\s*$", ""), "–—―", "---")
    return F.regexp_replace(F.regexp_replace(s, r"(?:\s*[:-]\s*|\s+)(?:19[5-9][0-9]|20[0-9][0-9])$", ""), "[ :-]+$", "")


def table_signature(row_json: Column) -> Column:
    """An aggregate: the number of rows and sixteen hex digits that any change of a row changes, whatever the
    order of rows. Rows are summed by 60 bits of their SHA-256, so no task holds more than a number."""
    part = lambda at: F.sum(F.conv(F.substring(F.sha2(row_json, 256), at, 15), 16, 10).cast("decimal(38,0)"))
    body = F.concat_ws(":", F.coalesce(part(1), F.lit(0)).cast("string"), F.coalesce(part(16), F.lit(0)).cast("string"))
    return F.concat(F.lit("source-signature:"), F.count("*").cast("string"), F.lit(":"), F.substring(F.sha2(body, 256), 1, 16))


# ---- questions ---------------------------------------------------------------------------------


def overlap_boost(question: Column | str, text: Column | str) -> Column:
    """1 for a text that contains the question; else by the share of its CJK characters that the text has."""
    q, s = F.lower(col(question)), F.lower(col(text))
    chars = lambda c: F.array_distinct(F.split(F.regexp_replace(c, "[^一-鿿]", ""), "(?!^)"))
    own = F.filter(chars(q), lambda x: x != "")
    share = F.size(F.array_intersect(own, chars(s))) / F.size(own)
    steps = F.when(share >= 0.8, 0.9).when(share >= 0.6, 0.7).when(share >= 0.4, 0.5).when(share >= 0.2, 0.3).otherwise(0.1)
    return F.when((q == "") | (s == ""), 0.0).when(F.contains(s, q), 1.0).when(F.size(own) == 0, 0.0).otherwise(steps)


def without_particles(c: Column | str) -> Column:
    """The words that are no particle; all of them if none is left."""
    s = F.trim(col(c))
    kept = F.array_join(F.filter(F.split(s, r"\s+"), lambda w: ~w.isin(*PARTICLES) & (w != "")), " ")
    return F.when(kept == "", s).otherwise(kept)


def strip_intent(c: Column | str) -> Column:
    """What a question about limits is about: its object after "which", else the text without its endings."""
    s = F.trim(col(c))
    thing = F.trim(F.regexp_extract(s, "^(.+?)有哪些(.+)$", 2))
    out = s
    for _ in range(3):
        out = reduce(lambda x, ending: F.trim(F.regexp_replace(x, ending, "")), ENDINGS, out)
    return F.when((F.length(thing) >= 2) & ~thing.rlike("^(?:的)?(?:要求|规定|功能|是什么|应满足什么|应符合什么)$"), thing).otherwise(out)


def long_anchors(c: Column | str) -> Column:
    """At most twelve compounds and keywords of a question of eight CJK characters or more without a blank."""
    s = F.trim(col(c))
    long = (F.length(F.regexp_replace(s, "[^一-鿿]", "")) >= 8) & ~F.contains(s, F.lit(" "))
    return F.when(long, F.slice(words_in(s, COMPOUNDS + KEYWORDS), 1, 12)).otherwise(F.array().cast("array<string>"))


def synonyms(c: Column | str, table: dict[str, list[str]] = SYNONYMS) -> Column:
    """The synonyms of every key that a text contains, in the table's order."""
    s = col(c)
    return F.flatten(F.array(*(F.when(F.contains(s, F.lit(k)), F.array(*map(F.lit, v))).otherwise(F.array().cast("array<string>")) for k, v in table.items())))


def acronym(term: Column | str, definition: Column | str) -> Column:
    """The acronym after a term's last semicolon, or in brackets in its definition."""
    return F.coalesce(some(F.regexp_extract(col(term), r";\s*([A-Z]{2,6})\s*$", 1)), some(F.regexp_extract(col(definition), r"[（(]\s*([A-Z]{2,6})\s*[)）]", 1)))


def context_terms(term: Column | str, definition: Column | str) -> Column:
    """At most ten CJK words of two to six characters around a term."""
    both = F.concat_ws(" ", col(term), col(definition))
    return F.slice(F.array_distinct(F.regexp_extract_all(both, F.lit("[一-鿿]{2,6}"), F.lit(0))), 1, 10)


def has_symbol(question: Column | str, symbol: Column | str) -> Column:
    """Whether a question names a symbol of two characters or more as a word of its own. A symbol of letters must
    be one of the question's acronyms if it has any."""
    q, s = col(question), col(symbol)
    acronyms = F.regexp_extract_all(q, F.lit("(?<![A-Za-z0-9])([A-Z]{2,})(?![A-Za-z0-9])"), F.lit(1))
    alone = F.rlike(q, F.concat(F.lit(r"(?i)(?<![A-Za-z0-9])\Q"), s, F.lit(r"\E(?![A-Za-z0-9])")))
    letters = s.rlike("^[A-Za-z]{2,}$") & (F.size(acronyms) > 0)
    return F.coalesce((F.length(s) >= 2) & F.when(letters, F.array_contains(acronyms, s)).otherwise(alone), F.lit(False))


# ---- codes -------------------------------------------------------------------------------------


def _found(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def process_codes(c: Column | str) -> Column:
    """Sorted distinct codes like SWE.1."""
    return F.array_sort(F.array_distinct(_found(F.upper(col(c)), rf"\b(?:{PROCESSES})\.\d+\b")))


def practice_codes(c: Column | str) -> Column:
    """Sorted distinct codes like SWE.1.BP2."""
    found = _found(F.upper(col(c)), rf"\b(?:{PROCESSES})\.\d+\.BP\s*\d+\b")
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"\s+", ""))))


def table_numbers(c: Column | str) -> Column:
    """Sorted distinct numbers like A.4 of the tables that a text names."""
    found = _found(F.upper(col(c)), r"表\s*[A-Z]\s*[.．]\s*\d+")
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.regexp_replace(F.translate(x, "．", "."), r"[表\s]", ""))))


def voltage(c: Column | str) -> Column:
    """The first number, with its sign."""
    return some(F.regexp_extract(col(c), r"([+-]?\d+(?:\.\d+)?)\s*V?", 1))


# ---- limits and fields -------------------------------------------------------------------------


def unit_alias(c: Column | str) -> Column:
    """The unit's symbol; a name that is not known stays."""
    u = F.trim(col(c))
    known = F.create_map(*(F.lit(x) for pair in UNITS.items() for x in pair))
    return F.when(u == "", None).otherwise(F.coalesce(known[F.lower(u)], u))


def unit_text(c: Column | str) -> Column:
    """Spelled-out ohm and micro as signs, no blanks."""
    s = col(c)
    for old, new in (("\\Omega", "Ω"), ("Omega", "Ω"), ("ohm", "Ω"), ("\\mu", "μ")):
        s = F.replace(s, F.lit(old), F.lit(new))
    return F.regexp_replace(s, r"\s+", "")


def header_name(c: Column | str) -> Column:
    """A table header without formulas and footnote marks, or the known name that it contains."""
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(col(c), r"\s+", ""), r"\$[^$]+\$", ""), r"\^[abc]|[ᵃᵇᶜᵈᵉᶠᵍ]", "")
    return F.coalesce(*(F.when(F.contains(s, F.lit(h)), F.lit(h)) for h in HEADERS), s)


def numeric_limit(c: Column | str) -> Column:
    """Struct operator, value, unit and the conditions temperature, load and mode of a sentence."""
    s = col(c)
    low = F.lower(s)
    number = r"[≤≥<>＝=]*\s*(\d+(?:\.\d+)?)\s*(mv|mV|v|V|ma|mA|a|A|%|％|毫伏|伏|毫安|安)?"
    op = F.when(s.rlike("(?i)≤|<=|不大于|小于等于|不超过|以下|不得超过|不高于"), "<=").when(s.rlike("(?i)≥|>=|不低于|大于等于|不小于|以上|至少"), ">=").when(s.rlike("<|小于"), "<").when(s.rlike(">|大于"), ">")
    temperature = some(F.regexp_extract(s, r"(?i)(-?\d+(?:\.\d+)?)\s*(?:℃|°c|c)", 1))
    return F.struct(
        op.alias("operator"),
        some(F.regexp_extract(s, number, 1)).cast("double").alias("value"),
        unit_alias(F.regexp_extract(s, number, 2)).alias("unit"),
        F.concat(temperature, F.lit("C")).alias("temperature"),
        F.when(F.contains(s, F.lit("满载")) | F.contains(low, F.lit("full load")), "full_load").alias("load"),
        F.when(F.contains(s, F.lit("休眠")) | F.contains(low, F.lit("sleep")), "sleep").alias("mode"),
    )


def requirement_subject(title: Column | str, text: Column | str) -> Column:
    """The first clause of the title without its number, else of the text; page placeholders do not count."""

    def of(c: Column) -> Column:
        s = F.trim(c)
        clause = F.trim(F.element_at(F.split(F.regexp_replace(s, r"^\d+(?:\.\d+){0,5}\s*", ""), "[。:：]", 2), 1))
        return F.when(~s.rlike(r"(?i)^page_\d+_requirement$"), some(F.substring(clause, 1, 120)))

    return F.coalesce(of(col(title)), of(col(text)))


def requirement_condition(c: Column | str) -> Column:
    return F.trim(first_of(col(c), ["(在[^。；，]{4,80}?(?:情况下|条件下|状态下))", "(当[^。；，]{4,80}?(?:时|后))", "(对于[^。；，]{4,80})"]))


def requirement_threshold(c: Column | str) -> Column:
    """A worded limit, else a number with %, Hz, s or mA; numbers of four to six digits before s are no times."""
    s = col(c)
    worded = first_of(s, ["(不超过[^。；，]{1,40})", "(不小于[^。；，]{1,40})", "(小于或等于[^。；，]{1,40})", "(大于或等于[^。；，]{1,40})", "(应符合[^。；，]{1,60})", "(应满足[^。；，]{1,60})"])
    number = F.trim(some(F.regexp_extract(s, r"(±?\s*\d+(?:\.\d+)?\s*(?:%|Hz|s|mA))", 1)))
    return F.coalesce(F.trim(worded), F.when(~number.rlike(r"^\d{4,6}\s*s$"), number))


def requirement_scope(title: Column | str, text: Column | str, section: Column | str) -> Column:
    """index, preface, overview, appendix_rule, normative_requirement or general_requirement."""
    heading, s = F.concat(col(title), F.lit(" "), F.substring(col(text), 1, 120)), col(text)
    any_of = lambda words: reduce(lambda a, b: a | b, (F.contains(heading, F.lit(w)) for w in words))
    return (
        F.when(any_of(("目次", "目 次")), "index")
        .when(any_of(("前言", "前    言", "引言")), "preface")
        .when(col(title).rlike(r"^\s*1\s*范围") | F.contains(s, F.lit("适用于")) | F.contains(s, F.lit("本文件规定了")), "overview")
        .when(col(section).rlike("^[A-J]"), "appendix_rule")
        .when(any_of(("要求", "应", "不应", "不得", "保护", "锁止", "急停", "停机")), "normative_requirement")
        .otherwise("general_requirement")
    )


def section_number(c: Column | str) -> Column:
    """A leading number like 4.2.1 or B.3, or null."""
    return first_of(col(c), [r"^(\d+(?:\.\d+){0,5})\b", r"^([A-Z]\.\d+(?:\.\d+)*)\b"])


def section_level(number: Column | str) -> Column:
    """1 for a number without a dot, one more for each dot up to 6; 2 without a number."""
    n = col(number)
    dots = F.length(n) - F.length(F.replace(n, F.lit("."), F.lit("")))
    return F.when(n.isNull(), 2).otherwise(F.least(dots + 1, F.lit(6))).cast("int")


# ---- dates -------------------------------------------------------------------------------------


def cover_dates(c: Column | str) -> Column:
    """Struct published, effective (yyyy-MM-dd strings) of a cover's text, in the layouts of Chinese and ISO
    standards, labelled dates and journals."""
    s = col(c)
    flat = F.regexp_replace(s, r"\s+", " ")
    day = r"(\d{4}[-—]\d{2}[-—]\d{2})"
    plain = lambda x: F.translate(some(x), "—", "-")
    chinese = r"发布日期[：:]\s*(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日"
    part = lambda k: F.lpad(some(F.regexp_extract(s, chinese, k)), 4 if k == 1 else 2, "0")
    online = r"Published\s+Online\s+(\w+)\s+(\d{4})"
    month = F.create_map(*(F.lit(x) for pair in MONTHS.items() for x in pair))[F.regexp_extract(s, online, 1)]
    published = F.coalesce(
        plain(F.regexp_extract(s, day + r"\s*发布", 1)),
        plain(F.regexp_extract(flat, r"(?:First|Second|Third|\d+st|\d+nd|\d+rd|\d+th)\s+[Ee]dition\s*" + day, 1)),
        plain(F.regexp_extract(flat, r"(?:[Dd]ate|日期)\s*[:：]\s*" + day, 1)),
        F.concat(part(1), F.lit("-"), part(2), F.lit("-"), part(3)),
        F.concat(F.regexp_extract(s, online, 2), F.lit("-"), month, F.lit("-01")),
    )
    return F.struct(published.alias("published"), plain(F.regexp_extract(s, day + r"\s*实施", 1)).alias("effective"))


def instant(c: Column | str) -> Column:
    """A timestamp of ISO text with Z, an offset or neither (UTC); null for anything else."""
    return F.try_to_timestamp(F.trim(col(c)))


def older_than(c: Column | str, days: int, now: Column) -> Column:
    """Whether an ISO time lies more than so many days (0 at least) before `now`."""
    return instant(c) < now - F.make_interval(days=F.lit(max(0, days)))


# ---- arrays, JSON and tables -------------------------------------------------------------------


def label(c: Column | str) -> Column:
    """A label without its number and opening marks, at most 240 characters."""
    s = F.trim(F.regexp_replace(col(c), r"\s+", " "))
    s = F.regexp_replace(s, r"^\d+(?:\.\d+){0,6}\s*", "")
    return F.substring(F.trim(F.regexp_replace(s, r"^[.。:：;；,，、\-–—•·]+\s*", "")), 1, 240)


def unique_labels(c: Column | str) -> Column:
    """The distinct labels of an array that are not empty, in their first order."""
    return F.array_distinct(F.filter(F.transform(col(c), label), lambda x: x != ""))


def safe_json(c: Column | str, path: str, kind: str) -> Column:
    """A value of a JSON text by path; null for text that is no JSON."""
    whole = F.concat(F.lit("["), col(c), F.lit("]"))  # the parser would stop at the value's end and not see what follows
    return F.try_variant_get(F.try_parse_json(whole), "$[0]" + path[1:], kind)


def json_objects(c: Column | str, most: int = 8) -> Column:
    """The first flat JSON objects inside a text."""
    found = F.regexp_extract_all(col(c), F.lit(r"\{.*?\}"), F.lit(0))
    return F.slice(F.filter(found, lambda x: F.try_parse_json(x).isNotNull()), 1, most)


def html_cell(c: Column | str) -> Column:
    """Text without tags, five entities decoded, blanks collapsed."""
    s = F.regexp_replace(col(c), "<[^>]+>", " ")
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        s = F.replace(s, F.lit(entity), F.lit(plain))
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def markdown_cell(c: Column | str) -> Column:
    """A cell without formula signs, emphasis, escaped bars and tags."""
    s = F.regexp_replace(F.regexp_replace(col(c), r"<br ?/?>", "\n"), r"\$([^$]+)\$", "$1")
    s = F.regexp_replace(s, r"\*\*|__", "")
    return html_cell(F.replace(s, F.lit("\\|"), F.lit("|")))


def _table(rows: Column) -> Column:
    empty = F.array()
    return F.struct(
        F.when(F.size(rows) > 0, F.get(rows, 0)).otherwise(empty.cast("array<string>")).alias("headers"),
        F.when(F.size(rows) > 1, F.slice(rows, F.lit(2), F.size(rows))).otherwise(empty.cast("array<array<string>>")).alias("rows"),
    )


def markdown_table(c: Column | str) -> Column:
    """Struct headers, rows of the lines that open with a bar (at least two); rule lines are no rows."""
    lines = F.filter(F.transform(F.split(col(c), "\n"), lambda x: F.trim(x)), lambda x: F.startswith(x, F.lit("|")))
    head, rest = F.slice(lines, 1, 1), F.filter(F.slice(lines, F.lit(2), F.size(lines) + 1), lambda x: ~x.rlike(r"^\|?[\s:\-|]+\|?$"))
    cells = F.transform(F.concat(head, rest), lambda x: F.transform(F.split(F.regexp_replace(x, r"^\|+|\|+$", ""), r"\|"), markdown_cell))
    return _table(F.when(F.size(lines) >= 2, cells).otherwise(F.array().cast("array<array<string>>")))


def html_table(c: Column | str) -> Column:
    """Struct headers, rows of the first table rows that have cells."""
    rows = F.regexp_extract_all(col(c), F.lit("(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    cells = F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit("(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), html_cell))
    return _table(F.filter(cells, lambda r: F.size(r) > 0))


# ---- sentences and names -------------------------------------------------------------------------

# Words that make a sentence a requirement.
REQUIRING = ("应", "必须", "不得", "不应", "需", "需要", "要求", "shall", "must", "should", "require")


def requirement_sentences(c: Column | str) -> Column:
    """The sentences of a text, cut at line ends, full stops and semicolons, that state a requirement."""
    parts = F.transform(F.split(col(c), r"[\n。；;]+"), lambda p: F.btrim(p, F.lit(" \t，,。；;")))
    return F.filter(parts, lambda p: (p != "") & F.exists(F.array(*map(F.lit, REQUIRING)), lambda w: F.contains(F.lower(p), w)))


def identifier_points(question: str, name: Column) -> Column:
    """The summed length of a stated question's identifiers (four characters or more) that a name has, whatever the case; 0 under five."""
    import re

    total = F.lit(0)
    for token in dict.fromkeys(re.findall(r"[A-Za-z][A-Za-z0-9_]{3,}", question)):
        total = total + F.when(F.contains(F.lower(name), F.lit(token.lower())), len(token)).otherwise(0)
    return F.when(total >= 5, total).otherwise(0)

