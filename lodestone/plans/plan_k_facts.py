"""K: facts with their evidence, from the lines of all documents and the order lines as knowledge units."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import facts as X
from lodestone.plans.plan_h_rules import pick
from lodestone.plans.registry import query
from lodestone.plans.views import Tables

_T = "normalized_text"
_DAY = "concat('202', CAST(doc_id % 10 AS {s}), '-0', CAST(1 + doc_id % 9 AS {s}), '-1', CAST(doc_id % 9 AS {s}))"
#: What a line says, by its document and place; chr(10) parts the lines of a text.
_TEXT = pick(
    "(doc_id * 3 + line_no * 7)", _T, f"concat('# Title of ', {_T})", f"concat('3.', CAST(line_no AS {{s}}), ' scope', chr(10), '## scope', chr(10), {_T})", f"concat({_DAY}, ' 发布', chr(10), {_DAY}, ' 实施')", "'V2X 包括V2V、V2G；V2H等形式。'",
    "concat('2024/05', chr(10), '1/148', chr(10), 'GB/T 18487.1', chr(10), 'A plain  title')", "'代替 GB/T 18487.1—2015 and VAVE-CCU-SW-REQ-V3.0'", f"concat('## scope', chr(10), '1.2 ', {_T})", "'#'", f"concat('Second edition', chr(10), {_DAY})", "CAST(NULL AS {s})",
)
_EVIDENCE = {"doc_id": "doc_id", "evidence_id": "doc_id * 100000 + line_no", "page_no": "1 + (line_no - 1) * 2", "confidence": "CAST(line_no % 11 AS DOUBLE) / 10", "risk_level": pick("line_no", "'low'", "'high'"), "text": _TEXT}
# An order line is a unit of the document of its part; pages run past those that have evidence.
_UNITS = {"doc_id": "l_partkey", "unit_no": "l_orderkey * 10 + l_linenumber", "page_no": "l_suppkey % 40", "fact_type": pick("l_linenumber", "'requirement'", "'term_definition'", "'parameter'"), "predicate": "'states'", "value": "l_quantity", "base": "CASE WHEN l_linenumber = 2 THEN 0.95 ELSE 0.7 END"}
_J = lambda **f: "CAST(json_object(" + ", ".join(f"'{k}', {f[k]}" for k in sorted(f)) + ") AS VARCHAR)"
_CLEAN = lambda c: f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"
_D = r"(\d{4}[-—]\d{2}[-—]\d{2})"
_META = [
    ("document_title", "title", f"CASE WHEN len(marked) > 0 THEN trim(substr(marked[1], 3)) ELSE left(regexp_replace(plain[1], '\\s{{2,}}', ' ', 'g'), 120) END"),
    ("document_standard", "standard_code", f"nullif(regexp_extract(left(text, 500), '{X.PROJECT_CODE}', 1), '')"), ("document_lifecycle", "publication_date", "pub"), ("document_lifecycle", "effective_date", "coalesce(eff, pub)"),
    ("document_versioning", "replaces_standard", f"nullif(trim(regexp_extract(text, '{X.REPLACES}', 1)), '')"),
]
_ORACLE = f"""WITH e AS (SELECT {', '.join(f"{x.format(s='VARCHAR') if n == 'text' else x} AS {n}" for n, x in _EVIDENCE.items())} FROM v_evidence),
ln AS (SELECT *, list_filter(list_transform(string_split_regex(text, '\\r?\\n'), lambda x: trim(x)), lambda x: x <> '') AS lines FROM e),
hx AS (SELECT doc_id, evidence_id, page_no, unnest(lines) AS line, unnest(range(len(lines))) AS item FROM ln),
hy AS (SELECT *, CASE WHEN line LIKE '#%' THEN trim(ltrim(line, '#')) ELSE trim(regexp_extract(line, '^(\\d+(?:\\.\\d+){{0,4}})\\s+(.+)$', 2)) END AS title, CASE WHEN line LIKE '#%' THEN len(line) - len(ltrim(line, '#')) ELSE 0 END AS level, CASE WHEN line NOT LIKE '#%' THEN regexp_extract(line, '^(\\d+(?:\\.\\d+){{0,4}})\\s+(.+)$', 1) END AS number FROM hx),
hz AS (SELECT *, row_number() OVER (PARTITION BY evidence_id, title ORDER BY item) AS k FROM hy WHERE title <> ''),
h AS (SELECT doc_id, evidence_id, page_no, item, 'section_heading' AS fact_type, 'has_section' AS predicate, CASE WHEN number IS NULL THEN {_J(title=_CLEAN('title'), heading_level='level')} ELSE {_J(title=_CLEAN('title'), heading_level='level', section_number='number')} END AS payload FROM hz WHERE k = 1),
rx AS (SELECT doc_id, evidence_id, page_no, list_transform(string_split_regex(regexp_extract(text, '{X.INCLUDES}', 1), '[、,，；;]'), lambda x: trim(regexp_replace(x, '(?s)等.*$', ''))) AS parts FROM e),
r AS (SELECT DISTINCT doc_id, evidence_id, page_no, (1 << 30) AS item, 'comparison_relation' AS fact_type, 'includes_type' AS predicate, {_J(subject="'V2X'", item=_CLEAN('value'))} AS payload FROM (SELECT *, unnest(parts) AS value FROM rx) WHERE value <> ''),
mx AS (SELECT *, list_filter(lines, lambda x: x LIKE '# %') AS marked, list_filter(lines, lambda x: len(x) >= 4 AND NOT regexp_matches(x, '{X.NO_TITLE}') AND NOT regexp_matches(regexp_replace(x, '\\s+', '', 'g'), '{X.NO_COMPACT_TITLE}')) AS plain,
  replace(coalesce(nullif(regexp_extract(text, '{_D}\\s*发布', 1), ''), nullif(regexp_extract(regexp_replace(text, '\\s+', ' ', 'g'), '(?:First|Second|Third|\\d+st|\\d+nd|\\d+rd|\\d+th)\\s+[Ee]dition\\s*{_D}', 1), ''), nullif(regexp_extract(regexp_replace(text, '\\s+', ' ', 'g'), '(?:[Dd]ate|日期)\\s*[:：]\\s*{_D}', 1), '')), '—', '-') AS pub,
  replace(nullif(regexp_extract(text, '{_D}\\s*实施', 1), ''), '—', '-') AS eff FROM ln WHERE page_no <= {X.METADATA_PAGES}),
my AS ({' UNION ALL '.join(f"SELECT doc_id, evidence_id, page_no, {i} AS item, '{k}' AS fact_type, '{p}' AS predicate, {v.replace('{{', '{').replace('}}', '}')} AS value FROM mx" for i, (k, p, v) in enumerate(_META))}),
m AS (SELECT doc_id, evidence_id, page_no, item, fact_type, predicate, {_J(value=_CLEAN('value'))} AS payload FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, fact_type, predicate ORDER BY page_no, evidence_id) AS k FROM my WHERE value IS NOT NULL) WHERE k = 1),
pg AS (SELECT doc_id, page_no AS p, max(evidence_id) AS last, min(evidence_id) AS first FROM e GROUP BY 1, 2),
u AS (SELECT {', '.join(f"{x} AS {n}" for n, x in _UNITS.items())} FROM lineitem),
ul AS (SELECT u.*, arg_min(struct_pack(p := p, f := first, l := last), abs(p - page_no) * 1000000 + p) AS near FROM u JOIN pg USING (doc_id) GROUP BY ALL),
f AS (SELECT 0 AS rank, page_no AS a, evidence_id AS b, item AS c, doc_id, fact_type, predicate, payload, evidence_id, NULL::DOUBLE AS base FROM m
  UNION ALL SELECT 1, page_no, evidence_id, item, doc_id, fact_type, predicate, payload, evidence_id, NULL FROM h UNION ALL SELECT 1, page_no, evidence_id, item, doc_id, fact_type, predicate, payload, evidence_id, NULL FROM r
  UNION ALL SELECT 3, unit_no, 0, 0, doc_id, fact_type, predicate, {_J(value='CAST(value AS INTEGER)')}, CASE WHEN near.p = page_no THEN near.l ELSE near.f END, base FROM ul),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, fact_type, predicate, payload ORDER BY rank, a, b, c) AS k FROM f)
SELECT 'FACT-' || upper(substr(sha1(concat_ws('|', o.doc_id, fact_type, predicate, payload)), 1, 12)) AS fact_id, o.doc_id, fact_type, predicate, payload, e.page_no, o.evidence_id, risk_level,
  round(greatest(0.1, least(1.0, (coalesce(base, CASE WHEN fact_type = 'term_definition' THEN 0.8 ELSE 0.9 END)::DOUBLE + confidence) / 2)), 3) AS confidence, CASE rank WHEN 3 THEN 'derived' ELSE 'direct' END AS support_type
FROM o JOIN e ON e.evidence_id = o.evidence_id WHERE k = 1"""


@query("k10_facts_with_evidence", _ORACLE)
def k10_facts(t: Tables) -> DataFrame:
    evidence = t.v_evidence.selectExpr(*(f"{x.format(s='STRING') if n == 'text' else x} AS {n}" for n, x in _EVIDENCE.items()))
    units = t.lineitem.selectExpr(*(f"{x} AS {n}" for n, x in _UNITS.items())).withColumn("payload", X.canonical(value=F.col("value").cast("int")))
    return X.build(evidence, units)
