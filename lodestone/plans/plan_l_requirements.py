"""L: the requirement engine, over stand-in limits by region, nation and customer."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import folds
from lodestone.operators import requirements as R
from lodestone.plans.plan_e_windows import _CHAIN
from lodestone.plans.registry import query
from lodestone.plans.views import Tables


@query(
    "l01_comparator",
    """SELECT profile_id, CASE WHEN n.value_numeric IS NULL OR r.value_numeric IS NULL THEN 'ambiguous' WHEN n.value_numeric < r.value_numeric THEN 'tighten' WHEN n.value_numeric > r.value_numeric THEN 'loosen' ELSE 'same' END AS change
    FROM (SELECT * FROM v_limits WHERE priority = 200) n, (SELECT max(value_numeric) AS value_numeric FROM v_limits WHERE profile_id = 'R1') r""",
)
def l01(t: Tables) -> DataFrame:
    limits = t.v_limits
    one = limits.filter("profile_id = 'R1'").agg(F.max("value_numeric").alias("base"))  # one row
    n = limits.filter("priority = 200").crossJoin(F.broadcast(one))
    return n.select("profile_id", R.comparison(F.col("base"), F.col("value_numeric")).alias("change"))


@query("l02_effective", _CHAIN)
def l02(t: Tables) -> DataFrame:
    return folds.effective_limits(folds.layers_of(t.customer, t.nation), t.v_limits)


@query("l03_project_summary", _CHAIN.replace("SELECT leaf, min(value_numeric) AS effective", ", e AS (SELECT leaf, min(value_numeric) AS effective") + ") SELECT conflict, count(*) AS n, min(effective) AS least FROM e GROUP BY 1")
def l03(t: Tables) -> DataFrame:
    e = folds.effective_limits(folds.layers_of(t.customer, t.nation), t.v_limits)
    return e.groupBy("conflict").agg(F.count("*").alias("n"), F.min("effective").alias("least"))


@query(
    "l04_diff_to_base",
    """WITH a AS (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY 1), b AS (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
    SELECT a.k, b.v AS base_value, a.v, CASE WHEN b.v IS NULL THEN 'ambiguous' WHEN a.v < b.v THEN 'tighten' WHEN a.v > b.v THEN 'loosen' ELSE 'same' END AS change FROM a LEFT JOIN b ON a.k = b.k""",
)
def l04(t: Tables) -> DataFrame:
    per = lambda s: t.orders.filter(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("v"))
    return R.diff_to_base(per("O"), per("F"), "k", "v")


@query(
    "l05_compliance",
    """WITH r AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, value DESC) AS n FROM events),
    s AS (SELECT c_custkey AS user_id, CASE WHEN value IS NULL THEN 2 WHEN value <= 80 THEN 4 ELSE 1 END AS s FROM customer LEFT JOIN (SELECT * FROM r WHERE n = 1) r ON r.user_id = c_custkey)
    SELECT user_id, CASE min(s) WHEN 1 THEN 'fail' WHEN 2 THEN 'missing_test_result' ELSE 'pass' END AS state FROM s GROUP BY 1""",
)
def l05(t: Tables) -> DataFrame:
    limits = t.customer.select(F.col("c_custkey").alias("user_id"), F.lit(80.0).alias("lim"))
    return R.compliance(limits, t.events.select("user_id", "event_type", "ts", "value"), "user_id", "lim", "event_type", "ts", "value")


_IMPACT = """WITH chain AS (
  SELECT concat('C', CAST(c_custkey AS VARCHAR)) AS leaf, concat('C', CAST(c_custkey AS VARCHAR)) AS profile_id FROM customer WHERE c_nationkey = 3
  UNION ALL SELECT concat('C', CAST(c_custkey AS VARCHAR)), concat('N', CAST(c_nationkey AS VARCHAR)) FROM customer WHERE c_nationkey = 3
  UNION ALL SELECT concat('C', CAST(c_custkey AS VARCHAR)), concat('R', CAST(n_regionkey AS VARCHAR)) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_nationkey = 3),
a AS (SELECT leaf, min(value_numeric) AS before FROM chain JOIN v_limits USING (profile_id) GROUP BY 1),
p AS (SELECT leaf, priority, CASE WHEN profile_id = 'N3' THEN CAST(60000 AS DECIMAL(18,2)) ELSE value_numeric END AS v FROM chain JOIN v_limits USING (profile_id)),
b AS (SELECT leaf, min(v) AS after, arg_max(v, priority) > min(v) AS conflict FROM p GROUP BY 1)
SELECT leaf, before, after, CASE WHEN after < before THEN 'tighten' WHEN after > before THEN 'loosen' ELSE 'same' END AS change, conflict FROM a JOIN b USING (leaf)"""


@query("l06_impact", _IMPACT)
def l06(t: Tables) -> DataFrame:
    return R.impact(folds.layers_of(t.customer, t.nation), t.v_limits, "N3", 60000)


@query(
    "l07_baseline_drift",
    """WITH f AS (SELECT p_partkey AS k, p_size AS v FROM part WHERE p_partkey % 10 <> 0), n AS (SELECT p_partkey AS k, CASE WHEN p_size = 5 THEN 6 ELSE p_size END AS v FROM part WHERE p_partkey % 7 <> 0)
    SELECT CASE WHEN f.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'removed' WHEN f.v = n.v THEN 'unchanged' ELSE 'changed' END AS change, count(*) AS n FROM f FULL JOIN n ON f.k = n.k GROUP BY 1""",
)
def l07(t: Tables) -> DataFrame:
    frozen = t.part.filter("p_partkey % 10 <> 0").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("v"))
    now = t.part.filter("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("k"), F.when(F.col("p_size") == 5, 6).otherwise(F.col("p_size")).alias("v"))
    return R.drift(frozen, now, "k", "v")


@query(
    "l08_release_gate",
    """WITH p AS (SELECT user_id, count(*) FILTER (event_type = 'error' AND value > 100) AS blockers, count(*) FILTER (event_type = 'error' AND value <= 100) AS warnings FROM events WHERE event_type = 'error' GROUP BY 1),
    s AS (SELECT *, CAST(greatest(0, 100 - 25 * blockers - 5 * warnings) AS BIGINT) AS score FROM p) SELECT *, CASE WHEN blockers > 0 THEN 'blocked' WHEN score >= 90 THEN 'ready' ELSE 'conditional' END AS readiness FROM s""",
)
def l08(t: Tables) -> DataFrame:
    findings = t.events.filter("event_type = 'error'").select("user_id", F.when(F.col("value") > 100, "blocker").otherwise("warning").alias("severity"))
    return R.release_gate(findings, "user_id", "severity")


@query("l09_latest_state", "SELECT user_id, arg_max(event_type, ts) AS event_type FROM events GROUP BY 1")
def l09(t: Tables) -> DataFrame:
    return R.latest_state(t.events, "user_id", "ts", "event_type")


@query(
    "l10_guarded_transitions",
    "SELECT event_id, before, event_type FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events) WHERE before IS NOT NULL AND NOT (before = 'view' AND event_type IN ('click', 'view', 'error')) AND NOT (before = 'click' AND event_type IN ('purchase', 'view', 'error')) AND NOT (before = 'error' AND event_type = 'view')",
)
def l10(t: Tables) -> DataFrame:
    allowed = {"view": ["click", "view", "error"], "click": ["purchase", "view", "error"], "error": ["view"]}
    return R.bad_transitions(t.events, "user_id", "ts", "event_type", allowed).select("event_id", "before", "event_type")


@query("l16_scope_isolation", "SELECT c_custkey FROM customer WHERE c_nationkey IN (1, 2)")
def l16(t: Tables) -> DataFrame:
    grants = t.spark.createDataFrame([(1, "editor", 3), (2, "editor", 2), (3, "editor", 1), (4, "viewer", 3)], "c_nationkey int, role string, level int")
    return R.permitted(t.customer, grants, "c_nationkey", "editor", 2).select("c_custkey")
