"""H: the domain's rules over whole tables.

The texts are made of the tables' columns by expressions that Spark and DuckDB read alike, so that every
branch of a rule is met by many rows; each oracle states its rule in DuckDB's own functions.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import rules as R
from lodestone.functions import text as T
from lodestone.plans.registry import query
from lodestone.plans.views import Tables


def pick(n: str, *values: str) -> str:
    """SQL: one of the expressions by the remainder of `n`."""
    return f"CASE {n} % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def quoted(*values: str) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def contained(s: str, words) -> str:
    """SQL: the words that a text contains, joined by commas."""
    return f"array_to_string(list_filter([{quoted(*words)}], lambda w: contains({s}, w)), ',')"


def wide(s: str) -> str:
    return f"translate({s}, {quoted(R.WIDE)}, {quoted(R.NARROW)})"


def key(s: str) -> str:
    return rf"regexp_replace(lower({wide(s)}), '[^\p{{L}}\p{{N}}\p{{M}}]+', '', 'g')"


def html_cell(s: str) -> str:
    s = f"regexp_replace({s}, '<[^>]+>', ' ', 'g')"
    for old, new in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        s = f"replace({s}, {quoted(old)}, {quoted(new)})"
    return rf"trim(regexp_replace({s}, '\s+', ' ', 'g'))"


# ---- keys --------------------------------------------------------------------------------------


@query("h02_tokenise", "SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9./-]+|[一-鿿]+')) AS term FROM documents) GROUP BY 1, 2")
def h02(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.explode(T.tokens("text")).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


_ASKED = pick("p_partkey", "'控制导引电路'", "'电压'", "p_name", "'输出 pwm 电流'", "''")
_SAID = "concat(substr('控制导引电路电压状态输出', CAST(1 + p_size % 7 AS INTEGER), CAST(1 + p_partkey % 6 AS INTEGER)), ' ', p_name)"


@query(
    "h08_overlap_steps",
    f"""WITH r AS (SELECT p_partkey, lower({_ASKED}) AS q, lower({_SAID}) AS s FROM part),
    c AS (SELECT *, list_filter(list_distinct(string_split(regexp_replace(q, '[^一-鿿]', '', 'g'), '')), lambda x: x <> '') AS own, list_distinct(string_split(regexp_replace(s, '[^一-鿿]', '', 'g'), '')) AS sc FROM r),
    w AS (SELECT *, len(list_intersect(own, sc)) / len(own) AS share FROM c)
    SELECT p_partkey, CAST(CASE WHEN q = '' THEN 0 WHEN contains(s, q) THEN 1 WHEN len(own) = 0 THEN 0 WHEN share >= 0.8 THEN 0.9 WHEN share >= 0.6 THEN 0.7 WHEN share >= 0.4 THEN 0.5 WHEN share >= 0.2 THEN 0.3 ELSE 0.1 END AS DOUBLE) AS boost FROM w""",
)
def h08(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", R.overlap_boost(F.expr(_ASKED), F.expr(_SAID)).alias("boost"))


_SPOKEN = f"concat({pick('p_partkey', quoted('  控制 的 '), quoted('和 '), quoted(''), quoted(' 吗  呢 '))}, {pick('p_size', 'p_name', quoted('啊'), quoted(''))})"


@query(
    "h09_particle_removal",
    rf"""WITH r AS (SELECT p_partkey, trim({_SPOKEN}) AS s FROM part),
    k AS (SELECT p_partkey, s, array_to_string(list_filter(regexp_split_to_array(s, '\s+'), lambda w: w NOT IN ({quoted(*R.PARTICLES)}, '')), ' ') AS kept FROM r)
    SELECT p_partkey, CASE WHEN kept = '' THEN s ELSE kept END AS s FROM k""",
)
def h09(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", R.without_particles(F.expr(_SPOKEN)).alias("s"))


_BLOB = "concat('GB T ', p_partkey, '—', p_size, ' _a/b', chr(92), ' QC T ', p_name)"


@query("h11_blob_normaliser", rf"SELECT p_partkey, regexp_replace(replace(replace(regexp_replace(replace(lower({_BLOB}), '—', '-'), '[_/\\]', '', 'g'), 'gb t', 'gbt'), 'qc t', 'qct'), '\s+', '', 'g') AS s FROM part")
def h11(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", R.blob_key(F.expr(_BLOB)).alias("s"))


_FULL = pick("p_partkey", "'ＡＢＣ／１'", "concat('**', p_type, '__ ')", "concat(p_type, '　－ ', p_name)", "'a_b——控制 导引'")


@query("h12_compare_key", f"SELECT p_partkey, {key(_FULL)} AS s FROM part")
def h12(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", R.compare_key(F.expr(_FULL)).alias("s"))


_CODE = pick("p_partkey", "concat('gbt 18487.', p_size, '-2015')", "concat('GB T ', p_size)", "concat('ISO ', p_partkey, '-1')", "concat('QC T 29.', p_size, ' — 2014')")


def _slashed(first: str, second: str) -> str:
    return f"replace(replace(replace(upper({_CODE}), '{first}', 'GB/T'), '{second}', 'GB/T'), 'QC T', 'QC/T')"


@query("h14_standard_code", rf"SELECT p_partkey, regexp_replace(replace({_slashed('GBT', 'GB T')}, '-', '—'), '\s+', '', 'g') AS code, regexp_replace({_slashed('GB T', 'GBT')}, '[^A-Z0-9]+', '', 'g') AS anchor FROM part")
def h14(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", R.standard_code(F.expr(_CODE)).alias("code"), R.standard_anchor(F.expr(_CODE)).alias("anchor"))


_NAME = pick("p_partkey", "concat('ISO ', p_partkey, '—2013')", "concat(' ISO 14229-', p_size, ':2015(E) ')", "concat('ＩＳＯ　', p_size, ' –')", "concat(p_name, '  (英文版)')", "concat('IEC ', 1900 + p_size * 3)", "concat(p_name, ' : 1999')")


@query(
    "h15_canonical_name",
    rf"""WITH f AS (SELECT p_partkey, trim(regexp_replace(trim({wide(_NAME)}), '\s+', ' ', 'g')) AS s FROM part),
    d AS (SELECT p_partkey, translate(regexp_replace(s, '\s*\([^)]{{1,8}}\)\s*$', ''), '–—―', '---') AS s FROM f)
    SELECT p_partkey, rtrim(regexp_replace(s, '(\s*[:-]\s*|\s+)(19[5-9][0-9]|20[0-9][0-9])$', ''), ' :-') AS s FROM d""",
)
def h15(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", R.canonical_name(F.expr(_NAME)).alias("s"))


_ROW = "concat_ws('|', o_orderkey, o_custkey, o_orderstatus, o_orderpriority)"


def _bits(at: int) -> str:
    return f"CAST(sum(CAST(CAST(concat('0x', substr(sha256({_ROW}), {at}, 15)) AS BIGINT) AS HUGEINT)) AS VARCHAR)"


@query("h18_table_signature", f"SELECT o_orderstatus, concat('source-signature:', count(*), ':', substr(sha256(concat({_bits(1)}, ':', {_bits(16)})), 1, 16)) AS signature FROM orders GROUP BY 1")
def h18(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderstatus").agg(R.table_signature(F.expr(_ROW)).alias("signature"))


@query("h19_tag_strip", f"SELECT page_id, md5({html_cell('html')}) AS s FROM pages")
def h19(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.md5(R.html_cell("html")).alias("s"))


@query("h46_folded_equality", rf"SELECT p_partkey, lower(trim(regexp_replace({wide(_FULL)}, '\s+', ' ', 'g'))) = 'abc/1' AS same FROM part")
def h46(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", R.folded_equal(F.expr(_FULL), F.lit("ABC／1")).alias("same"))


@query("h47_soft_containment", f"WITH k AS (SELECT p_partkey, {key(_FULL)} AS a, {key('p_type')} AS b FROM part) SELECT p_partkey, a <> '' AND b <> '' AND (contains(a, b) OR contains(b, a)) AS near FROM k")
def h47(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", R.soft_contains(F.expr(_FULL), "p_type").alias("near"))


# ---- questions ---------------------------------------------------------------------------------

_INTENT = f"concat(p_name, {pick('p_partkey', *map(quoted, ('的要求', '功能有哪些要求', '有哪些保护动作', '有哪些要求', '的时间是什么', '应满足什么', '有什么规定', '')))})"


def _endings(s: str) -> str:
    for _ in range(3):
        for ending in R.ENDINGS:
            s = f"trim(regexp_replace({s}, '{ending}', ''))"
    return s


@query(
    "h21_suffix_strip",
    f"""WITH r AS (SELECT p_partkey, trim({_INTENT}) AS s FROM part), o AS (SELECT *, trim(regexp_extract(s, '^(.+?)有哪些(.+)$', 2)) AS thing FROM r)
    SELECT p_partkey, CASE WHEN length(thing) >= 2 AND NOT regexp_matches(thing, '^(的)?(要求|规定|功能|是什么|应满足什么|应符合什么)$') THEN thing ELSE {_endings('s')} END AS s FROM o""",
)
def h21(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", R.strip_intent(F.expr(_INTENT)).alias("s"))


_LONG = "concat(substr('室外使用的供电设备正常工作的温度范围和相对湿度由控制器通信调度', CAST(1 + p_partkey % 9 AS INTEGER), CAST(3 + p_size % 25 AS INTEGER)), " + pick("p_partkey", "''", "''", "' 电网'") + ")"


@query("h24_dictionary_anchors", f"WITH r AS (SELECT p_partkey, trim({_LONG}) AS s FROM part) SELECT p_partkey, CASE WHEN length(regexp_replace(s, '[^一-鿿]', '', 'g')) >= 8 AND NOT contains(s, ' ') THEN array_to_string(list_slice(list_filter([{quoted(*R.COMPOUNDS, *R.KEYWORDS)}], lambda w: contains(s, w)), 1, 12), ',') ELSE '' END AS anchors FROM r")
def h24(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.array_join(R.long_anchors(F.expr(_LONG)), ",").alias("anchors"))


_KNOWN = f"concat(p_name, {pick('p_partkey', *map(quoted, (' OBC 与 CP', '车网互动', '对外放电设备', 'V2G', '', ' cp')))})"


@query(
    "h25_synonyms",
    f"""WITH r AS (SELECT p_partkey, {_KNOWN} AS s FROM part), d(n, k, words) AS (VALUES {', '.join(f"({i}, {quoted(k)}, {quoted(','.join(v))})" for i, (k, v) in enumerate(R.SYNONYMS.items()))})
    SELECT p_partkey, coalesce(string_agg(words, ',' ORDER BY n), '') AS words FROM r LEFT JOIN d ON contains(s, k) GROUP BY 1""",
)
def h25(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.array_join(R.synonyms(F.expr(_KNOWN)), ",").alias("words"))


_TERM = f"concat(p_name, {pick('p_partkey', *map(quoted, ('; OBC', ';  V2G ', '; CP', '', '; ABCDEFGH')))})"
_MEANT = f"concat('控制导引电路', {pick('p_size', *map(quoted, ('（ PWM ）', '(CC) 电压状态', '', '(Pwm)')))}, p_type)"


@query(
    "h26_acronyms",
    rf"""SELECT p_partkey, coalesce(nullif(regexp_extract({_TERM}, ';\s*([A-Z]{{2,6}})\s*$', 1), ''), nullif(regexp_extract({_MEANT}, '[（(]\s*([A-Z]{{2,6}})\s*[)）]', 1), '')) AS acronym,
    array_to_string(list_slice(regexp_extract_all(concat({_TERM}, ' ', {_MEANT}), '[一-鿿]{{2,6}}'), 1, 10), ',') AS context FROM part""",
)
def h26(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", R.acronym(F.expr(_TERM), F.expr(_MEANT)).alias("acronym"), F.array_join(R.context_terms(F.expr(_TERM), F.expr(_MEANT)), ",").alias("context"))


_QUESTION = pick("p_partkey", "'what is PWM and CP1'", "'what is Pwm'", "'value of R2 here'", "'PWMX and r2'", "'x'")
_SYMBOL = pick("p_size", "'PWM'", "'R2'", "'pwm'", "'x'", "'CP1'")


@query(
    "h27_boundary_match",
    f"""WITH r AS (SELECT p_partkey, {_QUESTION} AS q, {_SYMBOL} AS s FROM part), a AS (SELECT *, list_filter(regexp_split_to_array(q, '[^A-Za-z0-9]+'), lambda w: regexp_full_match(w, '[A-Z]{{2,}}')) AS acronyms FROM r)
    SELECT p_partkey, length(s) >= 2 AND CASE WHEN regexp_full_match(s, '[A-Za-z]{{2,}}') AND len(acronyms) > 0 THEN list_contains(acronyms, s) ELSE regexp_matches(q, '(?i)(^|[^A-Za-z0-9])' || s || '([^A-Za-z0-9]|$)') END AS named FROM a""",
)
def h27(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", R.has_symbol(F.expr(_QUESTION), F.expr(_SYMBOL)).alias("named"))


_CODED = "concat('see SWE.', p_size, ' and sup.1.bp ', p_partkey % 7, ', XSWE.9, 表 A . ', p_size, ' 表b．2, -', p_partkey, '.5 V')"


@query(
    "h28_code_extraction",
    rf"""WITH r AS (SELECT p_partkey, upper({_CODED}) AS s FROM part)
    SELECT p_partkey, array_to_string(list_sort(list_distinct(regexp_extract_all(s, '\b(?:{R.PROCESSES})\.\d+\b'))), ',') AS codes,
    array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(s, '\b(?:{R.PROCESSES})\.\d+\.BP\s*\d+\b'), lambda x: regexp_replace(x, '\s+', '', 'g')))), ',') AS practices,
    array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(s, '表\s*[A-Z]\s*[.．]\s*\d+'), lambda x: regexp_replace(replace(x, '．', '.'), '[表\s]', '', 'g')))), ',') AS tables,
    regexp_extract(s, '([+-]?\d+(\.\d+)?)\s*V?', 1) AS voltage FROM r""",
)
def h28(t: Tables) -> DataFrame:
    c = F.expr(_CODED)
    joined = lambda x, name: F.array_join(x, ",").alias(name)
    return t.part.select("p_partkey", joined(R.process_codes(c), "codes"), joined(R.practice_codes(c), "practices"), joined(R.table_numbers(c), "tables"), R.voltage(c).alias("voltage"))


# ---- limits and fields -------------------------------------------------------------------------

_LIMIT = f"concat({pick('p_partkey', *map(quoted, ('电压不超过', '不低于', 'I < ', '> ', 'Full load at most ', '')))}, p_size, {pick('p_size', *map(quoted, (' mV', '毫安', '％', ' s', 'v 满载 25 ℃', ' in sleep at -40°C')))})"
_NUMBER = r"[≤≥<>＝=]*\s*(\d+(?:\.\d+)?)\s*(mv|mV|v|V|ma|mA|a|A|%|％|毫伏|伏|毫安|安)?"


@query(
    "h29_constraints",
    rf"""WITH r AS (SELECT p_partkey, {_LIMIT} AS s FROM part), u AS (SELECT *, regexp_extract(s, '{_NUMBER}', 2) AS raw FROM r)
    SELECT p_partkey, CASE WHEN regexp_matches(s, '(?i)≤|<=|不大于|小于等于|不超过|以下|不得超过|不高于') THEN '<=' WHEN regexp_matches(s, '(?i)≥|>=|不低于|大于等于|不小于|以上|至少') THEN '>=' WHEN regexp_matches(s, '<|小于') THEN '<' WHEN regexp_matches(s, '>|大于') THEN '>' END AS operator,
    TRY_CAST(regexp_extract(s, '{_NUMBER}', 1) AS DOUBLE) AS value,
    CASE WHEN raw = '' THEN NULL {' '.join(f"WHEN lower(raw) = {quoted(k)} THEN {quoted(v)}" for k, v in R.UNITS.items())} ELSE raw END AS unit,
    nullif(regexp_extract(s, '(?i)(-?\d+(?:\.\d+)?)\s*(?:℃|°c|c)', 1), '') || 'C' AS temperature, CASE WHEN contains(s, '满载') OR contains(lower(s), 'full load') THEN 'full_load' END AS load, CASE WHEN contains(s, '休眠') OR contains(lower(s), 'sleep') THEN 'sleep' END AS mode FROM u""",
)
def h29(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", R.numeric_limit(F.expr(_LIMIT)).alias("v")).select("p_partkey", "v.*")


_RANGE = pick("p_partkey", "concat(p_size, ' ± ', p_partkey % 9, ' ms')", "concat(p_size, '+/-', p_partkey % 9, '.5 V')", "concat(p_size, '..', p_size + 4, ' Hz')", "concat('-', p_size, '.25 kg')", "concat(p_size, '')", "p_name")


@query(
    "h30_range_values",
    """WITH r AS (SELECT p_partkey, p_partkey % 6 AS k, CAST(p_size AS DOUBLE) AS v, CAST(p_partkey % 9 AS DOUBLE) AS w FROM part)
    SELECT p_partkey, CASE k WHEN 0 THEN v WHEN 1 THEN v WHEN 2 THEN v + 2 WHEN 3 THEN -(v + 0.25) WHEN 4 THEN v END::DOUBLE AS nominal,
    CASE k WHEN 0 THEN v - w WHEN 1 THEN v - (w + 0.5) WHEN 2 THEN v WHEN 3 THEN -(v + 0.25) WHEN 4 THEN v END::DOUBLE AS low,
    CASE k WHEN 0 THEN v + w WHEN 1 THEN v + (w + 0.5) WHEN 2 THEN v + 4 WHEN 3 THEN -(v + 0.25) WHEN 4 THEN v END::DOUBLE AS high,
    CASE k WHEN 0 THEN 'ms' WHEN 1 THEN 'V' WHEN 2 THEN 'Hz' WHEN 3 THEN 'kg' END AS unit FROM r""",
)
def h30(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", T.range_value(F.expr(_RANGE)).alias("v")).select("p_partkey", "v.*")


_TITLE = pick("p_partkey", "'page_3_requirement'", "concat(p_size, '.', p_partkey % 9, ' 锁止要求。详见')", "'  '", "'1 范围'", "'目 次'", "concat('A.', p_size, ' 试验: 说明')")
_BODY = f"concat({pick('p_size', *map(quoted, ('在环境温度为常温的条件下，电压不超过', '当车辆插头完全连接后，时间 ', '对于交流充电接口；应符合', '本文件适用于', '电流 ± ', '© ISO 2015')))}, p_size, {pick('p_partkey', *map(quoted, ('。', ' mA', '%', ' s', ' Hz')))})"
_SECTION = pick("p_size", "'4.2'", "'A.1'", "NULL", "'K.1'")


def _clause(s: str) -> str:
    clause = rf"trim(regexp_split_to_array(regexp_replace(trim({s}), '^\d+(\.\d+){{0,5}}\s*', ''), '[。:：]')[1])"
    return rf"CASE WHEN NOT regexp_matches(trim({s}), '(?i)^page_\d+_requirement$') THEN nullif(substr({clause}, 1, 120), '') END"


def _first(s: str, *patterns: str) -> str:
    return "trim(coalesce(" + ", ".join(f"nullif(regexp_extract({s}, '{p}', 1), '')" for p in patterns) + "))"


@query(
    "h31_field_extraction",
    rf"""WITH r AS (SELECT p_partkey, {_TITLE} AS title, {_BODY} AS body, {_SECTION} AS section FROM part), h AS (SELECT *, concat(title, ' ', substr(body, 1, 120)) AS heading, trim(nullif(regexp_extract(body, '(±?\s*\d+(\.\d+)?\s*(%|Hz|s|mA))', 1), '')) AS number FROM r)
    SELECT p_partkey, coalesce({_clause('title')}, {_clause('body')}) AS subject, {_first('body', '(在[^。；，]{4,80}?(?:情况下|条件下|状态下))', '(当[^。；，]{4,80}?(?:时|后))', '(对于[^。；，]{4,80})')} AS condition,
    coalesce({_first('body', '(不超过[^。；，]{1,40})', '(不小于[^。；，]{1,40})', '(小于或等于[^。；，]{1,40})', '(大于或等于[^。；，]{1,40})', '(应符合[^。；，]{1,60})', '(应满足[^。；，]{1,60})')}, CASE WHEN NOT regexp_matches(number, '^\d{{4,6}}\s*s$') THEN number END) AS threshold,
    CASE WHEN regexp_matches(heading, '目次|目 次') THEN 'index' WHEN regexp_matches(heading, '前言|前    言|引言') THEN 'preface' WHEN regexp_matches(title, '^\s*1\s*范围') OR contains(body, '适用于') OR contains(body, '本文件规定了') THEN 'overview'
    WHEN regexp_matches(section, '^[A-J]') THEN 'appendix_rule' WHEN regexp_matches(heading, '要求|应|不应|不得|保护|锁止|急停|停机') THEN 'normative_requirement' ELSE 'general_requirement' END AS scope FROM h""",
)
def h31(t: Tables) -> DataFrame:
    title, body = F.expr(_TITLE), F.expr(_BODY)
    return t.part.select("p_partkey", R.requirement_subject(title, body).alias("subject"), R.requirement_condition(body).alias("condition"), R.requirement_threshold(body).alias("threshold"), R.requirement_scope(title, body, F.expr(_SECTION)).alias("scope"))


_HEADER = f"concat({pick('p_partkey', *map(quoted, ('参数 $x$', ' 控制时序说明', '对应状态^a', 'Nominal $v$ ^b', '标称值', 'R ᵃ', '单位')))}, {pick('p_size', quoted(''), quoted(' '))})"
_UNIT = pick("p_size", "concat('k', chr(92), 'Omega')", "'10 ohm'", "concat(chr(92), 'mu F')", "'m V'")


@query(
    "h32_unit_aliases",
    rf"""WITH r AS (SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace({_HEADER}, '\s+', '', 'g'), '\$[^$]+\$', '', 'g'), '\^[abc]|[ᵃᵇᶜᵈᵉᶠᵍ]', '', 'g') AS s, {_UNIT} AS u FROM part)
    SELECT p_partkey, CASE {' '.join(f"WHEN contains(s, '{h}') THEN '{h}'" for h in R.HEADERS)} ELSE s END AS header, regexp_replace(replace(replace(replace(replace(u, '\Omega', 'Ω'), 'Omega', 'Ω'), 'ohm', 'Ω'), '\mu', 'μ'), '\s+', '', 'g') AS unit FROM r""",
)
def h32(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", R.header_name(F.expr(_HEADER)).alias("header"), R.unit_text(F.expr(_UNIT)).alias("unit"))


_HEADING = pick("p_partkey", "concat(p_size, ' 总则')", "concat(p_size, '.', p_partkey % 5, '.1 要求')", "concat('B.', p_size, '.2 试验')", "p_name", "'1.2.3.4.5.6.7.8 deep'", "concat(p_size, 'V limit')")


@query(
    "h33_section_levels",
    rf"""WITH r AS (SELECT p_partkey, {_HEADING} AS s FROM part), n AS (SELECT p_partkey, coalesce(nullif(regexp_extract(s, '^(\d+(\.\d+){{0,5}})\b', 1), ''), nullif(regexp_extract(s, '^([A-Z]\.\d+(\.\d+)*)\b', 1), '')) AS number FROM r)
    SELECT p_partkey, number, CAST(CASE WHEN number IS NULL THEN 2 ELSE least(length(number) - length(replace(number, '.', '')) + 1, 6) END AS INTEGER) AS level FROM n""",
)
def h33(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", R.section_number(F.expr(_HEADING)).alias("number"))
    return rows.withColumn("level", R.section_level("number"))


_ON = "substr(CAST(o_orderdate AS STRING), 1, 10)"
_COVER = pick("o_orderkey", f"concat({_ON}, '发布  ', {_ON}, '实施')", f"concat('Second edition', chr(10), {_ON})", f"concat('日期: ', {_ON})", f"concat('发布日期：', substr({_ON}, 1, 4), '年', CAST(substr({_ON}, 6, 2) AS INTEGER), '月', CAST(substr({_ON}, 9, 2) AS INTEGER), '日')", f"concat('Published Online April ', substr({_ON}, 1, 4))", "'no date'", f"concat(replace({_ON}, '-', '—'), ' 实施')")


@query(
    "h34_date_extraction",
    """WITH r AS (SELECT o_orderkey, o_orderkey % 7 AS k, substr(CAST(o_orderdate AS VARCHAR), 1, 10) AS d FROM orders)
    SELECT o_orderkey, CASE WHEN k <= 3 THEN d WHEN k = 4 THEN concat(substr(d, 1, 4), '-04-01') END AS published, CASE WHEN k IN (0, 6) THEN d END AS effective FROM r""",
)
def h34(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", R.cover_dates(F.expr(_COVER)).alias("d")).select("o_orderkey", "d.*")


_TIME = pick("event_id", "concat('2024-01-0', 1 + event_id % 9, 'T12:00:00Z')", "concat('2024-01-0', 1 + event_id % 9, 'T12:00:00+02:00')", "concat(' 2024-01-1', event_id % 9, ' 01:02:03')", "'soon'", "''")


@query("h35_time_parse", f"WITH r AS (SELECT event_id, TRY_CAST(CASE WHEN event_id % 5 = 2 THEN concat(trim({_TIME}), '+00:00') ELSE {_TIME} END AS TIMESTAMPTZ) AS seen FROM events) SELECT event_id, CAST(epoch(seen) AS BIGINT) AS seconds, seen < TIMESTAMPTZ '2024-01-10 00:00:00+00:00' - INTERVAL 3 DAY AS old FROM r")
def h35(t: Tables) -> DataFrame:
    now = F.lit("2024-01-10T00:00:00Z").cast("timestamp")
    return t.events.select("event_id", F.unix_timestamp(R.instant(F.expr(_TIME))).alias("seconds"), R.older_than(F.expr(_TIME), 3, now).alias("old"))


# ---- arrays, JSON and tables -------------------------------------------------------------------

_LABELS = "array(concat('1.2 ', p_type), concat('• ', p_name), p_type, '  ', concat(p_size, '.3.', p_type), p_name)"


@query(
    "h40_unique_labels",
    rf"""WITH r AS (SELECT p_partkey, unnest([concat('1.2 ', p_type), concat('• ', p_name), p_type, '  ', concat(p_size, '.3.', p_type), p_name]) AS s, unnest([1, 2, 3, 4, 5, 6]) AS n FROM part),
    c AS (SELECT p_partkey, n, substr(trim(regexp_replace(regexp_replace(trim(regexp_replace(s, '\s+', ' ', 'g')), '^\d+(\.\d+){{0,6}}\s*', ''), '^[.。:：;；,，、\-–—•·]+\s*', '')), 1, 240) AS s FROM r),
    f AS (SELECT p_partkey, s, min(n) AS n FROM c WHERE s <> '' GROUP BY 1, 2) SELECT p_partkey, string_agg(s, ';' ORDER BY n) AS labels FROM f GROUP BY 1""",
)
def h40(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.array_join(R.unique_labels(F.expr(_LABELS)), ";").alias("labels"))


_JSON = pick("event_id", "props", "concat(props, ' and more')", "''", "'[1, 2]'")


@query("h42_json_extract", f"SELECT event_id, CASE WHEN json_valid({_JSON}) THEN TRY_CAST(json_extract_string({_JSON}, '$.k') AS INTEGER) END AS k FROM events")
def h42(t: Tables) -> DataFrame:
    return t.events.select("event_id", R.safe_json(F.expr(_JSON), "$.k", "int").alias("k"))


_LOG = "concat('log ', props, ' {broken} ', props, '{\"a\": 1}', ' end')"


@query("h44_json_scan", rf"WITH r AS (SELECT event_id, list_filter(regexp_extract_all({_LOG}, '\{{.*?\}}'), lambda x: json_valid(x)) AS found FROM events) SELECT event_id, array_to_string(list_slice(found, 1, 8), ';') AS found FROM r")
def h44(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.array_join(R.json_objects(F.expr(_LOG)), ";").alias("found"))


_MARKDOWN = "concat('intro', chr(10), ' | **name** | size |', chr(10), '|---|:--|', chr(10), '| ', p_name, '<br>$x$ | ', p_size, ' |', chr(10), '|', p_type, '|&lt;b&gt;|', chr(10))"
_HTML = "concat('<table><tr class=\"h\"><th>name</th><TH>size</TH></tr>', chr(10), '<tr></tr><tr><td><b>', p_name, '</b></td><td>', p_size, ' &amp; up</td></tr></table>')"


@query(
    "h45_tables",
    """SELECT p_partkey, 'name,size' AS m_headers, concat(p_name, ' x,', p_size, ';', p_type, ',<b>') AS m_rows, 'name,size' AS h_headers, concat(p_name, ',', p_size, ' & up') AS h_rows FROM part""",
)
def h45(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", R.markdown_table(F.expr(_MARKDOWN)).alias("m"), R.html_table(F.expr(_HTML)).alias("h"))
    flat = lambda c: F.array_join(F.transform(c, lambda r: F.array_join(r, ",")), ";")
    return rows.select("p_partkey", F.array_join("m.headers", ",").alias("m_headers"), flat("m.rows").alias("m_rows"), F.array_join("h.headers", ",").alias("h_headers"), flat("h.rows").alias("h_rows"))
