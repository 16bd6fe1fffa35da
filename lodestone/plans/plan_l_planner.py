"""L: the planner of requirement questions, over questions of every kind made of the parts table."""

from pyspark.sql import DataFrame

from lodestone.operators import planner as P
from lodestone.plans.plan_h_rules import pick, quoted
from lodestone.plans.registry import query
from lodestone.plans.views import Tables

# Projects are customers, customers are nations; ids are of one width, codes are not, so that some names lie in others.
_PROJECTS = "SELECT concat('PROJ-', lpad(CAST(c_custkey AS {s}), 6, '0')) AS project_id, concat('cust-', lpad(CAST(c_nationkey AS {s}), 2, '0')) AS customer_id, concat('DC-P', CAST(c_custkey AS {s})) AS project_code, c_name AS project_name FROM {customer}"
_CUSTOMERS = "SELECT concat('cust-', lpad(CAST(n_nationkey AS {s}), 2, '0')) AS customer_id, n_name AS customer_name, concat('kk', translate(CAST(n_nationkey AS {s}), '0123456789', 'abcdefghij'), 'k') AS customer_code FROM {nation} WHERE n_nationkey % 7 <> 6"
_PROFILES = "SELECT concat('PRF-', CAST(s_suppkey AS {s})) AS profile_id, concat('cust-', lpad(CAST(s_nationkey AS {s}), 2, '0')) AS customer_id, s_suppkey % 3 AS updated_at FROM {supplier} WHERE s_nationkey % 5 <> 1"
_ATOM = [("REQATOM-DCDC-OUTPUT-RIPPLE", "Output voltage ripple", "V_ripple"), ("REQATOM-DCDC-EFFICIENCY", "Full load efficiency", "eta"), ("REQATOM-DCDC-SLEEP-CURRENT", "Quiescent current", "I_sleep")]
_VARIANTS = (
    "SELECT concat('VAR-', CAST(s_suppkey AS {s})) AS variant_id, concat('cust-', lpad(CAST(s_nationkey AS {s}), 2, '0')) AS customer_id, "
    + pick("s_suppkey", *(f"'{a[0]}'" for a in _ATOM))
    + " AS atom_id, s_suppkey % 4 AS priority, s_suppkey % 5 AS updated_at FROM {supplier} WHERE s_nationkey % 4 <> 2"
)
_P = "concat('PROJ-', lpad(CAST(1 + p_partkey * 7 % 1600 AS {s}), 6, '0'))"
_C = "concat('CUST-', lpad(CAST(p_size % 25 AS {s}), 2, '0'))"
_N = "CAST(p_partkey % 90 AS {s})"
_K = "concat('KK', translate(CAST(p_size % 25 AS {s}), '0123456789', 'abcdefghij'), 'k')"
_QUESTION = pick(
    "p_partkey",
    f"concat({_P}, ' 的输出纹波要求是多少')", f"concat(' ', {_P}, ' 效率 的差异')", f"concat('工程变更 ECO-a.', {_N}, ' 状态')", f"concat({_P}, ' 能否进入 PV 门禁')", "'release gate readiness SOP'",
    f"concat({_P}, ' 需求基线 漂移')", f"concat('requirement package ', {_P})", "'候选需求，待归类'", f"concat({_C}, ' 休眠电流 改成 ≤ ', {_N}, ' mA 影响哪些项目')", f"concat({_C}, ' ripple 影响范围')",
    f"concat('改成 ', {_N}, 'mV')", f"concat({_P}, ' 是否满足 eta compliance')", "'需要审批 review'", f"concat({_P}, ' 冲突／缺证据')", f"concat('P ', {_N}, ' 项目 相对 不同')", f"concat({_P}, ' hello')", "'hello'", f"concat({_K}, ' 满载效率 改成 abc')",
    f"concat({_K}, ' sleep current 调整为 0.5毫安')", f"concat('PROJ-000001 ', {_P}, ' 效率')", f"concat('dc-p', {_N}, ' quiescent current')", f"concat('P', {_N}, ' 风险')", "'合规'", f"concat('P-', {_N}, ' full load efficiency')", "CAST(NULL AS {s})", "''", f"concat({_K}, ' 纹波 impact')", f"concat('NATION_', {_N}, ' 效率 变更影响')",
)
_TABLES = ("customer", "nation", "supplier", "part")
_SOURCES = {"questions": f"SELECT p_partkey AS question_id, {_QUESTION} AS question FROM {{part}}", "projects": _PROJECTS, "customers": _CUSTOMERS, "profiles": _PROFILES, "variants": _VARIANTS}
_ANY = lambda words: "(" + " OR ".join(f"contains(q, '{w}')" for w in words) + ")"
_NAME = """{0}_n AS (SELECT question_id, min({1}) AS id, count(DISTINCT {1}) AS n FROM q JOIN {2} ON contains(q, name) GROUP BY 1)"""
_NUM, _CHG = P._NUMBER, P._CHANGED
_RULES = [
    (_ANY(P.ECO), "requirement_eco", "pae", 0.76, None), (f"{_ANY(P.GATE)} AND {_ANY(P.GATE_ASKED)} AND p IS NULL", None, "", 0.6, "gate_project"), (f"{_ANY(P.GATE)} AND {_ANY(P.GATE_ASKED)}", "requirement_release_gate", "pas", 0.84, None),
    (_ANY(P.BASELINE), "requirement_baseline", "pa", 0.78, None), (_ANY(P.PACKAGES), "requirement_import_packages", "pa", 0.74, None), (_ANY(P.CANDIDATES), "requirement_candidates", "pa", 0.78, None),
    (f"{_ANY(P.IMPACT)} AND a IS NULL", None, "", 0.6, "impact_atom"), (f"{_ANY(P.IMPACT)} AND c IS NULL", None, "a", 0.6, "impact_customer"), (f"{_ANY(P.IMPACT)} AND v IS NULL", None, "a", 0.6, "impact_variant"),
    (f"{_ANY(P.IMPACT)} AND x IS NULL", None, "av", 0.6, "impact_value"), (_ANY(P.IMPACT), "requirement_impact", "avx", 0.82, None), (f"{_ANY(P.COMPLIANCE)} AND p IS NULL", None, "a", 0.6, "compliance_project"), (_ANY(P.COMPLIANCE), "requirement_compliance", "pa", 0.85, None),
    (_ANY(P.REVIEW), "requirement_review", "p", 0.78, None), (f"{_ANY(P.CONFLICT)} AND p IS NULL", None, "", 0.6, "conflict_project"), (_ANY(P.CONFLICT), "requirement_conflict_scan", "p", 0.8, None),
    (f"{_ANY(P.DIFF)} AND p IS NULL", None, "", 0.6, "diff_project"), (f"{_ANY(P.DIFF)} AND b IS NULL", None, "p", 0.6, "diff_profile"), (_ANY(P.DIFF), "requirement_diff", "pb", 0.85, None),
    ("p IS NULL", None, "a", 0.5, "project"), ("a IS NULL", None, "p", 0.5, "atom"), ("true", "requirement_effective", "pa", 0.9, None),
]
_WHICH = "CASE " + " ".join(f"WHEN {w} THEN {i}" for i, (w, *_) in enumerate(_RULES)) + " END"
_OF = lambda k: "CASE rule " + " ".join(f"WHEN {i} THEN {v}" for i, r in enumerate(_RULES) if (v := k(r)) is not None) + " END"
_HAS = lambda slot: "rule IN (" + ", ".join(str(i) for i, r in enumerate(_RULES) if slot in r[2]) + ")"
_ORACLE = f"""WITH {', '.join(f"{n} AS ({s.format(s='VARCHAR', **{x: x for x in _TABLES})})" for n, s in _SOURCES.items())},
atoms AS (SELECT * FROM (VALUES {', '.join('(' + quoted(*a) + ')' for a in _ATOM)}) t(atom_id, canonical_name, parameter_name)),
alias AS (SELECT * FROM (VALUES {', '.join(f"('{k}', '{w}')" for k, ws in P.ATOM_ALIASES.items() for w in ws)}) t(atom_id, name)),
q AS (SELECT question_id, translate(lower(trim(question)), '／，', '/,') AS q FROM questions),
pn AS (SELECT project_id, lower(unnest([project_id, project_code, project_name])) AS name FROM projects),
an AS (SELECT atom_id, lower(unnest([atom_id, canonical_name, parameter_name])) AS name FROM atoms UNION SELECT * FROM alias),
cn AS (SELECT customer_id, lower(unnest([customer_id, customer_name, customer_code])) AS name FROM customers),
{_NAME.format('p', 'project_id', 'pn')}, {_NAME.format('a', 'atom_id', 'an')}, {_NAME.format('c', 'customer_id', 'cn')},
sh AS (SELECT DISTINCT question_id, 'p' || unnest(regexp_extract_all(q, 'p\\s*[-_]?\\s*(\\d+)', 1)) AS short FROM q),
en AS (SELECT DISTINCT project_id, regexp_extract(unnest([lower(project_id), lower(project_code)]), '-(p\\d+)$', 1) AS short FROM projects),
sn AS (SELECT question_id, min(project_id) AS id, count(DISTINCT project_id) AS n FROM sh JOIN en USING (short) GROUP BY 1),
base AS (SELECT customer_id, profile_id FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY updated_at DESC, profile_id) AS k FROM profiles) WHERE k = 1),
var AS (SELECT customer_id, atom_id, variant_id FROM (SELECT *, row_number() OVER (PARTITION BY customer_id, atom_id ORDER BY priority, updated_at DESC, variant_id) AS k FROM variants) WHERE k = 1),
s AS (SELECT question_id, q, CASE WHEN p_n.n IS NULL THEN CASE WHEN sn.n = 1 THEN sn.id END WHEN p_n.n = 1 THEN p_n.id END AS p, CASE WHEN a_n.n = 1 THEN a_n.id END AS a, CASE WHEN c_n.n = 1 THEN c_n.id END AS c
  FROM q LEFT JOIN p_n USING (question_id) LEFT JOIN sn USING (question_id) LEFT JOIN a_n USING (question_id) LEFT JOIN c_n USING (question_id)),
n AS (SELECT s.*, base.profile_id AS b, var.variant_id AS v, regexp_matches(q, '{_CHG}') AS stated, regexp_extract_all(q, '{_NUM}', 1) AS xs, regexp_extract_all(q, '{_NUM}', 2) AS us
  FROM s LEFT JOIN projects ON project_id = p LEFT JOIN base USING (customer_id) LEFT JOIN var ON var.customer_id = c AND var.atom_id = a),
w AS (SELECT *, CAST(CASE WHEN stated THEN regexp_extract(q, '{_CHG}', 1) ELSE xs[-1] END AS DOUBLE) AS x, CASE WHEN stated THEN regexp_extract(q, '{_CHG}', 2) ELSE us[-1] END AS u FROM n),
d AS (SELECT *, {_WHICH} AS rule FROM w)
SELECT question_id, {_OF(lambda r: f"'{r[1] or 'clarification_required'}'")} AS intent, CASE WHEN {_HAS('p')} THEN p END AS project_id, CASE WHEN {_HAS('a')} THEN a END AS atom_id, CASE WHEN {_HAS('b')} THEN b END AS base_profile_id,
  CASE WHEN {_HAS('v')} THEN v END AS variant_id, CASE WHEN {_HAS('x')} THEN x END AS proposed_value, CASE WHEN {_HAS('x')} THEN CASE u {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in P.UNITS.items())} WHEN '' THEN NULL ELSE u END END AS proposed_unit,
  CASE WHEN {_HAS('s')} THEN CASE WHEN contains(q, 'sop') THEN 'SOP' WHEN contains(q, 'pv') THEN 'PV' ELSE 'DV' END END AS release_stage, CASE WHEN {_HAS('e')} THEN nullif(upper(regexp_extract(q, 'eco-[a-z0-9_.-]+')), '') END AS eco_id,
  CAST({_OF(lambda r: r[3])} AS DOUBLE) AS confidence, {_OF(lambda r: r[4] and f"'{P.REASONS[r[4]]}'")} AS reason FROM d"""


@query("l14_intent_planner", _ORACLE)
def l14_planner(t: Tables) -> DataFrame:
    made = {n: t.spark.sql(s.format(s="STRING", **{x: f"{{{x}}}" for x in _TABLES}), **{x: getattr(t, x) for x in _TABLES if f"{{{x}}}" in s}) for n, s in _SOURCES.items()}
    return P.plan(made["questions"], made["projects"], t.spark.createDataFrame(_ATOM, "atom_id string, canonical_name string, parameter_name string"), made["customers"], made["profiles"], made["variants"])
