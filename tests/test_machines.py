"""State machines over logs against a plain fold; one entity with most of the rows."""

import random

import pytest

from lodestone.operators import machines as M


@pytest.fixture
def quiet_settings(spark):
    """Small tables are neither coalesced nor broadcast, as large ones are not."""
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def fold(rows, machine):
    state, out = {}, []
    for key, at, event in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        before = state.get(key, machine.states[0])
        to = machine.events.get(event, {}).get(before)
        state[key] = to or before
        out.append((key, at, event, before, state[key], to is None))
    return out


def sortable(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def test_runs_equal_a_fold_with_a_hot_entity(spark):
    rng = random.Random(4)
    events = [*M.CHANGE_ORDER.events, "unknown", None]
    rows = [(rng.choice([1, 1, 1, 1, 1, 2, 3, None]), i, rng.choice(events)) for i in range(20_000)] + [(9, 0, "create")]
    log = spark.createDataFrame(rows, "id long, at long, action string").repartition(7)
    got = [tuple(r) for r in M.run(log, M.CHANGE_ORDER, "id", ["at"], "action").collect()]
    assert sortable(got) == fold(rows, M.CHANGE_ORDER)


def test_a_hot_entity_is_spread_over_tasks(spark, quiet_settings):
    rows = [(1, i, "submit" if i % 3 else "approve") for i in range(30_000)]
    ran = M.run(spark.createDataFrame(rows, "id long, at long, step string"), M.APPROVAL, "id", ["at"], "step")
    sizes = ran.selectExpr("spark_partition_id() AS p").groupBy("p").count().collect()
    assert sum(r["count"] for r in sizes) == 30_000 and max(r["count"] for r in sizes) < 20_000


def test_empty_logs_and_single_events(spark):
    empty = spark.createDataFrame([], "id long, at long, step string")
    assert M.run(empty, M.APPROVAL, "id", ["at"], "step").count() == 0
    one = M.run(spark.createDataFrame([(1, 1, "approve")], "id long, at long, step string"), M.APPROVAL, "id", ["at"], "step").first()
    assert (one["before"], one["after"], one["refused"]) == ("none", "none", True)


def test_the_change_order_guards():
    e = M.CHANGE_ORDER.events
    assert e["create"] == {"none/none": "draft/none"} and "none/none" not in e["submit"]
    assert e["apply"]["approved/approved"] == "applied/approved" and "applied/approved" not in e["apply"]
    assert e["gate_fail"]["closed/approved"] == "gate_blocked/approved" and "draft/none" not in e["gate_pass"]
