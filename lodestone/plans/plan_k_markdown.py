"""K: Markdown repair over texts made of every customer's orders, a line an order."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import markdown as M
from lodestone.plans.plan_h_rules import pick
from lodestone.plans.registry import query
from lodestone.plans.views import Tables

_N = "CAST(o_custkey % 40 AS {s})"
#: A line by the order's place among its customer's orders, so that tables of several rows arise.
_LINE = pick(
    "(place + o_custkey * 5)",
    "'| 名称 | 值 |'", "'|---|:-:|'", f"concat('a | ', {_N}, ' | 3 ≤ x')", "'| 只有 |'", "'|&lt;b&gt;|\\\\n|'", "''", f"concat('## 3.1.', {_N})", "'文本 → 见表C.14所示，$ U_{{a}} $ ℃'", "'一 | 二'", "'….. · -'",
    f"concat('![', {_N}, '](data:image/png;base64,AAb+/=) x ![](data:image/gif;base64,QQ==)')", "'#### '", "'  '", "'12'", "'## 前 言'", "'正文 “引” ①'", "'### 1.2 深'", "'|a|b|c|d|e|f|g|h|'", "'|-|-|-|-|-|-|-|-|'", f"concat('|1||', {_N}, '|4|5|6|7|8|9|')",
    "'|a|b|c|d|e|f|g|h|'", "'# 2 规范性引用文件'", "'引用 GB/T 1'", "'## 第3页'", "'- ---'", "'# 范围 ICS 29.100.10'", "'正文 CCS K81 见附录。'", "'||'", "'|x|'", "'|'", "''", "''", "'### 4'",
)
_I = M.IMAGE.replace("'", "''")
_STRIP = lambda c: f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def _all(c: str, pairs: dict[str, str]) -> str:
    for a, b in pairs.items():
        c = f"replace({c}, '{a.replace(chr(39), chr(39) * 2)}', '{b.replace(chr(39), chr(39) * 2)}')"
    return c


def _drop(c: str) -> str:
    for p in M.DROPPED_PARTS:
        c = f"regexp_replace({c}, '{p}', '', 'g')"
    return c


_ORACLE = f"""WITH o AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders),
src AS (SELECT o_custkey AS doc, place AS n, {_LINE.replace("'|&lt;b&gt;|\\\\n|'", "'|&lt;b&gt;|' || chr(92) || 'n|'").format(s='VARCHAR')} AS line FROM o),
im AS (SELECT *, regexp_extract_all(line, '{_I}', 1) AS alts FROM src), i2 AS (SELECT *, coalesce(sum(len(alts)) OVER (PARTITION BY doc ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen, string_split_regex(line, '{_I}') AS parts FROM im),
i3 AS (SELECT doc, n, CASE WHEN len(alts) = 0 THEN line ELSE array_to_string(list_transform(range(1, len(parts) + 1), lambda i: parts[i] || CASE WHEN i <= len(alts) THEN '[' || coalesce(nullif(alts[i], ''), 'Image') || ' - 见图' || CAST(seen + i AS BIGINT) || ']' ELSE '' END), '') END AS line FROM i2),
h AS (SELECT doc, n, CASE WHEN regexp_matches(line, '^#{{1,6}}\\s+\\d+(\\.\\d+)*\\s*$') THEN repeat('#', least(6, 1 + len(string_split(trim(ltrim(line, '#')), '.')))) || ' ' || trim(ltrim(line, '#')) ELSE line END AS line FROM i3),
b AS (SELECT *, contains(line, '|') AS bar, n - row_number() OVER (PARTITION BY doc, contains(line, '|') ORDER BY n) AS run FROM h),
d AS (SELECT doc, n, bar, run, CASE WHEN bar THEN replace({_all('line', M.ENTITIES)}, chr(92) || 'n', ' ') ELSE line END AS line FROM b),
c1 AS (SELECT *, string_split(line, '|') AS p FROM d), c2 AS (SELECT *, CASE WHEN {_STRIP('p[1]')} = '' THEN p[2:] ELSE p END AS q FROM c1), c3 AS (SELECT *, CASE WHEN len(q) > 0 AND {_STRIP('q[-1]')} = '' THEN q[:-2] ELSE q END AS r FROM c2),
c4 AS (SELECT doc, n, bar, run, line, list_transform(r, lambda x: {_STRIP('x')}) AS cells FROM c3), c5 AS (SELECT *, bar AND len(list_filter(cells, lambda x: NOT regexp_matches(x, '^:?-+:?$'))) = 0 AS rule FROM c4),
t AS (SELECT *, count(*) OVER w AS height, coalesce(arg_min(len(cells), n) FILTER (rule) OVER w, max(len(cells)) OVER w) AS k FROM c5 WINDOW w AS (PARTITION BY doc, bar, run)),
f AS (SELECT doc, n, bar, run, line, rule, height, k, CASE WHEN rule THEN list_transform(range(k), lambda x: '---') WHEN len(cells) < k THEN cells || list_transform(range(k - len(cells)), lambda x: '') WHEN len(cells) > k AND k > 0 THEN cells[1:k - 1] || [array_to_string(cells[k:], ' ')] ELSE cells END AS cells FROM t),
g AS (SELECT *, arg_min(cells, n) FILTER (NOT rule) OVER w AS head, count(*) FILTER (NOT rule) OVER w AS body, min(n) OVER w AS top, bar AND height >= 2 AND k > {M.WIDEST} AS wide FROM f WINDOW w AS (PARTITION BY doc, bar, run)),
l AS (SELECT *, NOT rule AND NOT (body > 2 AND cells = head) AND len(list_filter(cells, lambda x: x <> '')) > 0 AS listed FROM g), m AS (SELECT *, bool_or(listed) OVER (PARTITION BY doc, bar, run) AS anyone FROM l),
v AS (SELECT doc, n, CASE WHEN wide AND listed THEN '- ' || array_to_string(list_filter(list_transform(range(1, len(cells) + 1), lambda i: CASE WHEN cells[i] <> '' THEN coalesce(nullif(head[i], ''), '列' || i) || ': ' || cells[i] END), lambda x: x IS NOT NULL), '; ')
  WHEN wide AND NOT anyone AND n = top THEN '' WHEN wide THEN NULL WHEN bar AND height >= 2 THEN '| ' || array_to_string(cells, ' | ') || ' |' ELSE line END AS line FROM m),
y AS (SELECT doc, n, {_all('line', M.SYMBOLS)} AS line FROM v WHERE line IS NOT NULL),
z AS (SELECT *, CASE WHEN regexp_matches(line, '^#{{1,6}}\\s+') THEN len(regexp_extract(line, '^(#+)', 1)) END AS depth FROM y WHERE NOT regexp_matches({_STRIP('line')}, '{M.NOISE[0]}') AND NOT regexp_matches({_STRIP('line')}, '{M.NOISE[1]}') AND NOT regexp_matches(line, '^#{{1,6}}\\s*$')),
s AS (SELECT *, depth IS NOT NULL AND regexp_matches(regexp_replace({_STRIP("regexp_replace(line, '^#+', '')")}, '^[A-Z]?\\d*\\.?\\d*\\s+', ''), '{M.SKIPPED_TITLES}') AS skips FROM z),
x AS (SELECT s.* FROM s WHERE NOT EXISTS (SELECT 1 FROM s a WHERE a.doc = s.doc AND a.skips AND a.n <= s.n AND NOT EXISTS (SELECT 1 FROM s e WHERE e.doc = s.doc AND e.n > a.n AND e.n <= s.n AND e.depth <= a.depth))),
u AS (SELECT doc, n, {_STRIP('line')} = '' AS empty, {_drop('line')} AS line FROM x WHERE NOT ({' OR '.join(f"regexp_matches({_STRIP('line')}, '{p}')" for p in M.DROPPED_LINES)})),
e1 AS (SELECT *, {_STRIP('line')} = '' AS blank FROM u), e2 AS (SELECT *, lag(blank) OVER (PARTITION BY doc ORDER BY n) AS before FROM e1),
e3 AS (SELECT *, min(n) FILTER (NOT blank) OVER w AS a, max(n) FILTER (NOT blank) OVER w AS z FROM e2 WHERE NOT (empty AND coalesce(before, false)) WINDOW w AS (PARTITION BY doc))
SELECT k.doc AS o_custkey, coalesce(string_agg(line, chr(10) ORDER BY n), '') AS text FROM (SELECT DISTINCT doc FROM src) k LEFT JOIN e3 ON e3.doc = k.doc AND n BETWEEN a AND z GROUP BY 1"""


@query("k27_markdown_repair", _ORACLE)
def k27_markdown(t: Tables) -> DataFrame:
    placed = t.orders.selectExpr("o_custkey", "o_orderkey", "row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place")
    lines = placed.select("o_custkey", "place", F.expr(_LINE.format(s="STRING")).alias("line"))
    texts = lines.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return M.repair(texts, "o_custkey")
