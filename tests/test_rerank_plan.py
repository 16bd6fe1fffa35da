"""Candidates of one small file are scored in many tasks."""

from lodestone.plans import plan_i_rerank
from lodestone.plans.views import Tables


def test_candidates_are_dealt_before_they_are_scored(spark, data):
    rows = plan_i_rerank.candidates(Tables(spark, f"{data}/sf0.001"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan
    assert rows.select("result_id").distinct().count() == rows.count()
