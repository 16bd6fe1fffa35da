"""L: approvals and change orders as state machines over the whole event log."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import machines as M
from lodestone.plans.plan_h_rules import pick
from lodestone.plans.registry import query
from lodestone.plans.views import Tables

# Each user's events are one log; what an event does is an expression over its row.
_STEP = pick("(event_id + user_id)", *(f"'{e}'" for e in ("submit", "approve", "reject", "withdraw")))
_ACTION = "CASE WHEN (event_id * 7 + user_id) % 8 = 0 THEN 'create' ELSE " + pick("(event_id * 5 + user_id)", *(f"'{e}'" for e in ("analyze", "submit", "approve", "apply", "gate_fail", "gate_pass", "submit", "approve", "apply", "reject", "gate_pass"))) + " END"

#: The machines' rules once more, over one step of a numbered log.
_APPROVE = """WITH RECURSIVE e AS (SELECT event_id, user_id, ts, {step} AS step, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT user_id, 0::BIGINT AS n, 'none' AS state, 'none' AS before, NULL::BIGINT AS event_id, NULL::TIMESTAMP AS ts, NULL::VARCHAR AS step, false AS refused FROM e GROUP BY 1
  UNION ALL SELECT r.user_id, e.n, CASE WHEN e.step = 'submit' THEN 'submitted' WHEN r.state = 'submitted' AND e.step = 'approve' THEN 'approved' WHEN r.state = 'submitted' AND e.step = 'reject' THEN 'rejected' ELSE r.state END,
    r.state, e.event_id, e.ts, e.step, NOT (e.step = 'submit' OR (r.state = 'submitted' AND e.step IN ('approve', 'reject'))) FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)"""


def approval_log(t: Tables) -> DataFrame:
    log = t.events.selectExpr("event_id", "user_id", "ts", f"{_STEP} AS step")
    return M.run(log, M.APPROVAL, "user_id", ["ts", "event_id"], "step")


@query(
    "l09_approvals",
    _APPROVE.format(step=_STEP)
    + """ SELECT user_id, arg_max(state, n) AS status, arg_max(CASE WHEN step <> 'submit' THEN {'ts': ts} ELSE {'ts': NULL} END, n) FILTER (NOT refused).ts AS decided_at, count(*) AS steps, count(*) FILTER (refused) AS refused
    FROM r WHERE n > 0 GROUP BY 1""",
)
def l09_approvals(t: Tables) -> DataFrame:
    return M.approvals(approval_log(t), "user_id", "ts", "step", ["ts", "event_id"])


@query("l09_refused_steps", _APPROVE.format(step=_STEP) + " SELECT event_id, step, before FROM r WHERE refused")
def l09_refused(t: Tables) -> DataFrame:
    return approval_log(t).filter("refused").select("event_id", "step", "before")


_OVERRIDE = {
    "override_id": "o_orderkey", "override_type": pick("o_custkey", *(f"'{k}'" for k in ("loosen", "tighten", "disable", "exception", "replace"))), "approval_status": pick("o_orderkey", "'draft'", "'approved'", "'rejected'"),
    "evidence_id": "CASE WHEN o_orderkey % 4 = 1 THEN NULL ELSE o_custkey END", "risk_level": pick("o_orderkey", "'Critical'", "'low'", "NULL", "'medium'", "'high'"),
}


@query(
    "l09_review_scan",
    f"""WITH o AS (SELECT {', '.join(f'{e} AS {n}' for n, e in _OVERRIDE.items())} FROM orders),
    i AS (SELECT override_id, CASE WHEN evidence_id IS NULL OR lower(coalesce(risk_level, 'medium')) IN ('critical', 'high') THEN 'high' WHEN lower(risk_level) = 'low' THEN 'low' ELSE 'medium' END AS severity,
      approval_status <> 'approved' AS approval_required, evidence_id IS NULL AS evidence_required FROM o WHERE override_type IN ('loosen', 'disable', 'exception') AND (approval_status <> 'approved' OR evidence_id IS NULL))
    SELECT *, CASE severity WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS severity_rank FROM i""",
)
def l09_review(t: Tables) -> DataFrame:
    return M.review_items(t.orders.selectExpr(*(f"{e} AS {n}" for n, e in _OVERRIDE.items())))


_ORDER = """WITH RECURSIVE e AS (SELECT event_id, user_id, ts, {action} AS action, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT user_id, 0::BIGINT AS n, 'none' AS status, 'none' AS approval, 'none/none' AS before, NULL::BIGINT AS event_id, NULL::TIMESTAMP AS ts, NULL::VARCHAR AS action, false AS refused FROM e GROUP BY 1
  UNION ALL SELECT r.user_id, e.n,
    CASE WHEN x.ok THEN CASE e.action WHEN 'create' THEN 'draft' WHEN 'analyze' THEN 'impact_analyzed' WHEN 'submit' THEN 'approval_pending' WHEN 'approve' THEN 'approved' WHEN 'apply' THEN 'applied' WHEN 'gate_pass' THEN 'closed' WHEN 'gate_fail' THEN 'gate_blocked' ELSE r.status END ELSE r.status END,
    CASE WHEN x.ok THEN CASE e.action WHEN 'submit' THEN 'submitted' WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected' ELSE r.approval END ELSE r.approval END,
    r.status || '/' || r.approval, e.event_id, e.ts, e.action, NOT x.ok
  FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1, LATERAL (SELECT CASE WHEN e.action = 'create' THEN r.status = 'none' WHEN r.status = 'none' THEN false WHEN e.action IN ('analyze', 'submit') THEN true
    WHEN e.action IN ('approve', 'reject') THEN r.approval = 'submitted' WHEN e.action = 'apply' THEN r.status = 'approved' ELSE r.status IN ('applied', 'gate_blocked', 'closed') END AS ok) x)"""


def order_log(t: Tables) -> DataFrame:
    log = t.events.selectExpr("event_id", "user_id", "ts", f"{_ACTION} AS action")
    return M.run(log, M.CHANGE_ORDER, "user_id", ["ts", "event_id"], "action")


@query(
    "l10_change_orders",
    _ORDER.format(action=_ACTION)
    + """ SELECT user_id, arg_max(status, n) AS status, arg_max(approval, n) AS approval, max(ts) FILTER (action = 'submit' AND NOT refused) AS submitted_at, max(ts) FILTER (action = 'approve' AND NOT refused) AS approved_at,
      max(ts) FILTER (action = 'apply' AND NOT refused) AS applied_at, max(ts) FILTER (action = 'gate_pass' AND NOT refused) AS closed_at, count(*) AS steps, count(*) FILTER (refused) AS refused FROM r WHERE n > 0 GROUP BY 1""",
)
def l10_orders(t: Tables) -> DataFrame:
    return M.change_orders(order_log(t), "user_id", "ts", "action", ["ts", "event_id"])


@query("l10_refused_actions", _ORDER.format(action=_ACTION) + " SELECT event_id, action, before FROM r WHERE refused")
def l10_refused(t: Tables) -> DataFrame:
    return order_log(t).filter("refused").select("event_id", "action", "before")


_IMPACTS = {"order_id": "l_orderkey", "project_id": "l_linenumber", "direct": "l_returnflag = 'R'", "effect": pick("l_partkey", "'tighten'", "'loosen'", "'same'", "'clarify'", "'replace'", "NULL"), "fails": "l_discount > 0.08"}


@query(
    "l10_order_actions",
    f"""WITH i AS (SELECT {', '.join(f'{e} AS {n}' for n, e in _IMPACTS.items())} FROM lineitem), s AS (SELECT *, fails OR direct OR effect IS NULL OR effect IN ('loosen', 'replace') AS test, fails OR (NOT direct AND (effect IS NULL OR effect IN ('loosen', 'replace'))) AS review FROM i)
    SELECT order_id, project_id, 'regression_test' AS action_type, 'open' AS status FROM s WHERE test UNION ALL SELECT order_id, project_id, 'engineering_review', 'open' FROM s WHERE review""",
)
def l10_actions(t: Tables) -> DataFrame:
    return M.actions(t.lineitem.selectExpr(*(f"{e} AS {n}" for n, e in _IMPACTS.items())))
