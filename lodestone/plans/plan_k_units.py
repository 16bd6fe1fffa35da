"""Knowledge units of blocks, their payloads and tags.

The oracle walks blocks by the same rules in SQL; texts are a few kinds whose class is stated beside them.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import units as U
from lodestone.plans.plan_h_rules import pick, quoted
from lodestone.plans.registry import query
from lodestone.plans.views import Tables

#: (type, text, what it is): t a term if a body follows, b a body, p an action (these and plain sentences are terms before a body, too), r a requirement, m a table, h a heading, x nothing.
BLOCKS = [
    ("heading", "# 4.2 保护要求", "h"), ("paragraph", "控制导引电路", "t"), ("paragraph", "通过车辆接口实现连接确认的装置", "b"), ("paragraph", "输出电压应不超过12V。", "r"),
    ("paragraph", "表 A.4 参数", "x"), ("paragraph", "SWE.1.BP2: 软件架构分析", "q"), ("paragraph", "  ", "n"), ("paragraph", "© ISO 2015 – All rights reserved", "n"),
    ("table", "<table><tr><th>参数</th><th>值</th></tr><tr><td>R2</td><td>5 &amp; 6</td></tr></table>", "m"), ("heading", "5.1 试验方法", "e"), ("paragraph", "按照图 5 连接并测量电压", "p"),
    ("paragraph", "GB/T 18487.1 定义", "x"), ("paragraph", "车载充电机", "t"), ("paragraph", "The unit shall stop within 5 s", "r"), ("heading", "12 34", "x"), ("paragraph", "能够作为电源输出的电路和装置", "t"),
    ("paragraph", "Foreword", "w"),
]
_N = "((p_partkey * 5 + p_size * 7) % 17)"
_TYPE, _TEXT = pick(_N, *(quoted(a) for a, _, _ in BLOCKS)), pick(_N, *(quoted(b) for _, b, _ in BLOCKS))
COLUMNS = {"doc_id": "CAST(floor(p_partkey / 40) AS BIGINT)", "page_no": "CAST(floor((p_partkey % 40) / 8) AS BIGINT)", "place": "p_partkey % 8 + 1", "type": _TYPE, "text": _TEXT}


def blocks(t: Tables) -> DataFrame:
    return t.part.selectExpr(*(f"{e} AS {n}" for n, e in COLUMNS.items()))


_CLASS = pick(_N, *(quoted(c) for _, _, c in BLOCKS))
# A body of twelve characters or more with a defining word: the texts of b, and that of the second kind of t.
_WALK = f"""WITH RECURSIVE r AS (SELECT {', '.join(f'{e} AS {n}' for n, e in COLUMNS.items())}, {_CLASS} AS k FROM part),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, place) AS i, lead(trim(text)) OVER (PARTITION BY doc_id, page_no ORDER BY place) AS nxt FROM r),
f AS (SELECT *, (k IN ('t', 'w', 'p', 'b') OR starts_with(text, 'The unit')) AND coalesce(nxt IN ({quoted(*(b for _, b, _ in BLOCKS if b in ('通过车辆接口实现连接确认的装置', '能够作为电源输出的电路和装置')))}), false) AS term FROM n),
w AS (SELECT f.*, false AS taken, term AS defines, CASE WHEN k IN ('h', 'e') THEN text ELSE '' END AS heading FROM f WHERE i = 1
  UNION ALL SELECT f.*, w.defines AND w.page_no = f.page_no, f.term AND NOT (w.defines AND w.page_no = f.page_no), CASE WHEN f.k IN ('h', 'e') AND NOT (w.defines AND w.page_no = f.page_no) THEN f.text ELSE w.heading END
  FROM w JOIN f ON f.doc_id = w.doc_id AND f.i = w.i + 1),
u AS (SELECT *, CASE WHEN defines THEN 'definition' WHEN k IN ('q') AND heading <> '# 4.2 保护要求' THEN 'procedure' WHEN k IN ('p', 'b') AND heading = '5.1 试验方法' THEN 'procedure' WHEN k = 'm' THEN 'table_requirement' WHEN k = 'r' THEN 'requirement' END AS unit_type,
  CASE heading WHEN '# 4.2 保护要求' THEN '4.2 保护要求' ELSE heading END AS h FROM w WHERE NOT taken)
SELECT doc_id, page_no, place, unit_type, CASE WHEN unit_type = 'definition' THEN trim(text) WHEN h <> '' THEN h ELSE concat('page_', page_no, CASE unit_type WHEN 'table_requirement' THEN '_table' ELSE concat('_', unit_type) END) END AS title,
  CASE WHEN unit_type = 'definition' THEN nxt ELSE trim(text) END AS content, nullif(regexp_extract(h, '^([0-9.]+)', 1), '') AS section FROM u WHERE unit_type IS NOT NULL"""


@query("k09_knowledge_units", _WALK)
def k09(t: Tables) -> DataFrame:
    return U.extract(blocks(t)).select("doc_id", "page_no", "place", "unit_type", "title", "content", "section")


@query(
    "k11_unit_payloads",
    f"""WITH k AS ({_WALK}) SELECT doc_id, page_no, place, unit_type,
    CASE WHEN unit_type = 'requirement' THEN CASE WHEN starts_with(title, 'page_') THEN regexp_split_to_array(content, '[。:：]')[1] ELSE regexp_replace(title, '^[0-9.]+\\s*', '') END END AS subject,
    CASE WHEN unit_type = 'requirement' AND content = '输出电压应不超过12V。' THEN '不超过12V' WHEN unit_type = 'requirement' THEN '5 s' END AS threshold,
    CASE unit_type WHEN 'procedure' THEN CASE WHEN starts_with(content, 'SWE') THEN 'process_practice' ELSE 'procedure' END WHEN 'table_requirement' THEN 'parameter_table' WHEN 'definition' THEN 'definition'
      ELSE CASE WHEN regexp_matches(concat(title, ' ', content), '要求|应|保护') THEN 'normative_requirement' ELSE 'general_requirement' END END AS role, CASE WHEN unit_type = 'table_requirement' THEN '参数,值/R2,5 & 6' END AS cells FROM k""",
)
def k11(t: Tables) -> DataFrame:
    cells = F.concat(F.array_join("headers", ","), F.lit("/"), F.array_join(F.transform("rows", lambda r: F.array_join(r, ",")), "/"))
    return U.extract(blocks(t)).select("doc_id", "page_no", "place", "unit_type", "subject", "threshold", "role", cells.alias("cells"))
