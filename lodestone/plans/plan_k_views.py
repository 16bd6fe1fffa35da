"""K: the choice among three views of every document."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import parseviews as V
from lodestone.plans.registry import query
from lodestone.plans.views import Tables

#: view_type, parser and text of each view; the second has numbered clauses and bars, the third is missing or noisy.
_VIEWS = [
    ("native_text", "plain", "text"),
    ("html", "layout_html", "replace(replace(text, '. ', concat(chr(10), '1.', CAST(doc_id % 7 AS {s}), ' ')), ', ', ' | ')"),
    ("ocr_html", "ocr", "CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN concat({upper}, chr(10), '3.1 x', chr(10), '3.1.2 y', chr(10), '4 z') WHEN 2 THEN concat('Page 3', chr(10), text, ' (continued)', chr(10), 'Page 3') ELSE concat('<table><tr><td>a</td></tr></table>', chr(10), replace(text, ' ', '   ')) END"),
]
_W = r"[A-Za-z0-9\x{4e00}-\x{9fff}]"
_N = lambda c, p: f"len(regexp_extract_all({c}, '{p}'))"
_TRIM = lambda c: f"regexp_replace({c}, '^{V.SPACE}+|{V.SPACE}+$', '', 'g')"
_CAP = lambda c: f"greatest(0, least(1, {c}))"
_UNREAD = V.UNREADABLE
_FLAGS = {
    "no_text": "total_chars = 0", "low_text_density": "total_chars < 80", "symbol_noise": "symbols > 0.38", "unreadable_text": "unread > 0.08", "low_readability": "readable < 0.35 AND total_chars > 200",
    "header_footer_noise": "noise > 0.35", "duplicate_lines": "dup > 0.35", "weak_table_structure": "density > 0.18 AND rowcol < 2",
}
_ORACLE = f"""WITH v AS ({' UNION ALL '.join(f"SELECT doc_id, {i} AS ordinal, '{k}' AS view_type, '{p}' AS parser, {t.format(s='VARCHAR', upper='upper(text)')} AS text, 1 + doc_id % 11 AS block_count FROM documents" for i, (k, p, t) in enumerate(_VIEWS))}),
a AS (SELECT *, {_TRIM("coalesce(text, '')")} AS t FROM v),
b AS (SELECT *, list_filter(list_transform(string_split_regex(t, '{V.LINE_ENDS}'), lambda x: {_TRIM('x')}), lambda x: x <> '') AS lines, regexp_replace(t, '{V.SPACE}', '', 'g') AS solid, regexp_extract_all(t, '{_W}+') AS tokens, regexp_extract_all(t, '{V.CLAUSE}', 1) AS clauses FROM a),
c AS (SELECT *, regexp_replace(solid, '{_W}', '', 'g') AS rest, list_filter(lines, lambda x: len(x) - len(replace(x, '|', '')) >= 2) AS pipes, list_filter(lines, lambda x: {_N('x', chr(92) + 's{2,}')} >= 2 AND {_N('x', _W)} >= 6) AS aligned,
  list_transform(lines, lambda x: lower(regexp_replace(x, '\\s+', ' ', 'g'))) AS plain, list_transform(clauses, lambda x: list_transform(string_split(x, '.'), lambda p: TRY_CAST(p AS DECIMAL(38,0)))) AS nums FROM b),
d AS (SELECT *, len(t) AS total_chars, len(lines) AS nl, len(nums) AS nc, greatest(len(solid), 0) AS ns, {_N('t', V.HEADING)} AS headings, {_N('lower(t)', '<table')} + {_N('t', chr(92) + '|')} AS tables, {_N('t', V.LIST)} AS lists,
  {_N('t', '(?i)<' + chr(92) + 's*tr' + chr(92) + 'b')} + len(pipes) + len(aligned) AS rowcol, coalesce(list_sum(list_transform(pipes, lambda x: len(x))), 0) + coalesce(list_sum(list_transform(aligned, lambda x: len(x))), 0) + 8 * {_N('t', '(?i)<' + chr(92) + 's*t[dh]' + chr(92) + 'b')} + 24 * {_N('t', '(?i)<' + chr(92) + 's*table' + chr(92) + 'b')} AS table_chars,
  {_N('t', '[' + chr(92) + 'x{4e00}-' + chr(92) + 'x{9fff}]{2,}')} + len(list_filter(regexp_extract_all(t, '[A-Za-z]{{3,}}'), lambda x: regexp_matches(x, '[aeiouAEIOU]'))) AS runs, {' + '.join(_N('t', p) for p in V.CONTINUED)} AS cont FROM c),
e AS (SELECT *, CASE WHEN ns > 0 THEN (ns - len(rest)) / ns ELSE 0 END AS semantic, CASE WHEN ns > 0 THEN len(rest) / ns ELSE 0 END AS symbols, CASE WHEN ns > 0 THEN {_N('rest', _UNREAD)} / ns ELSE 0 END AS unread,
  CASE WHEN len(tokens) > 0 THEN len(list_filter(tokens, lambda x: len(x) = 1)) / len(tokens) ELSE 1.0 END AS single, least(1.0, table_chars / greatest(total_chars, 1)) AS density,
  CASE WHEN nl > 0 THEN len(list_filter(plain, lambda x: len(x) <= 3 OR {' OR '.join(f"regexp_matches(x, '{p}')" for p in V.NOISE)} OR (regexp_matches(x, '{V.STANDARD}') AND len(x) < 40))) / nl ELSE 0 END AS noise, CASE WHEN nl > 0 THEN (nl - len(list_distinct(plain))) / nl ELSE 0 END AS dup,
  CASE WHEN nc >= 2 THEN len(list_filter(range(1, nc), lambda i: nums[i + 1] = nums[i] OR (len(nums[i + 1]) = len(nums[i]) AND nums[i + 1][:-2] = nums[i][:-2] AND nums[i + 1][-1] >= nums[i][-1]) OR (len(nums[i + 1]) = len(nums[i]) + 1 AND nums[i + 1][:-2] = nums[i]) OR (len(nums[i + 1]) < len(nums[i]) AND nums[i + 1][1] >= nums[i][1]))) / (nc - 1) WHEN nc = 1 THEN 1.0 ELSE 0.0 END AS clause FROM d),
f AS (SELECT *, {_CAP("semantic * 0.55 + (CASE WHEN total_chars > 0 THEN least(1.0, runs / greatest(total_chars / 120.0, 1.0)) ELSE 0 END) * 0.45 - least(0.9, symbols * 0.55 + unread * 3.0 + single * 0.22)")} AS readable FROM e),
g AS (SELECT *, {_CAP("headings * 0.08::DOUBLE + tables * 0.025::DOUBLE + lists * 0.035::DOUBLE + density * 0.22::DOUBLE + least(1.0, rowcol / 12.0) * 0.14::DOUBLE + clause * 0.18::DOUBLE + least(1.0, cont / 3.0) * 0.08::DOUBLE - noise * 0.12::DOUBLE - dup * 0.14::DOUBLE")} * greatest(0.25, readable) * greatest(0.1, 1.0 - noise * 0.75 - dup * 0.55) AS structure FROM f),
h AS (SELECT *, round({_CAP("least(1.0, total_chars / 800.0) * 0.15::DOUBLE + readable * 0.22::DOUBLE + structure * 0.5::DOUBLE + least(1.0, block_count / 8.0) * 0.07::DOUBLE + CASE view_type WHEN 'html' THEN 0.03::DOUBLE WHEN 'ocr_html' THEN 0.02::DOUBLE ELSE 0::DOUBLE END - least(0.85, symbols * 0.55 + unread * 0.8 + noise * 0.18 + dup * 0.14 + single * 0.18)")}, 6) AS score,
  concat_ws(',', {', '.join(f"CASE WHEN {w} THEN '{k}' END" for k, w in _FLAGS.items())}) AS flags, CASE WHEN trim(coalesce(text, '')) <> '' THEN 'candidate' ELSE 'unavailable' END AS status FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, status, ordinal) AS n FROM h)
SELECT doc_id, count(*) AS views, max(view_type) FILTER (n = 1) AS view_type, max(score) FILTER (n = 1) AS score, max(flags) FILTER (n = 1) AS flags, string_agg(view_type || ':' || status, ' > ' ORDER BY n) AS chain FROM r GROUP BY 1"""


@query("k06_parse_view_selection", _ORACLE)
def k06_views(t: Tables) -> DataFrame:
    documents = t.documents.withColumn("upper_text", F.when(F.expr("doc_id % 4 = 1"), T.simple_upper("text")))
    # concat_ws: DuckDB's concat passes over nulls
    views = documents.select("doc_id", F.lit(1).alias("page_no"), F.expr("1 + doc_id % 11").alias("block_count"), F.inline(F.array(*(F.struct(F.lit(i).alias("ordinal"), F.lit(k).alias("view_type"), F.lit(p).alias("parser"), F.expr(x.format(s="STRING", upper="upper_text").replace("concat(", "concat_ws('', ")).alias("text")) for i, (k, p, x) in enumerate(_VIEWS)))))
    chosen = V.selected(V.scored(views))
    chain = F.regexp_replace("chain", r":score=[0-9.]+", "")  # its scores are those of `scored`, to three digits
    return chosen.select("doc_id", (F.size(F.split("chain", " > "))).cast("long").alias("views"), "view_type", "score", "flags", chain.alias("chain"))
