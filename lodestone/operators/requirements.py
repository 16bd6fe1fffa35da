"""Requirement engine: comparators, resolution, compliance, impact, baselines and release gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import rank_of
from lodestone.operators.folds import effective_limits
from lodestone.operators.joins import compared
from lodestone.operators.ranking import keep_best

# Compliance states, worst first.
STATES = ["fail", "missing_test_result", "not_evaluated", "pass"]


def comparison(old: Column, new: Column, kind: str = "max_limit") -> Column:
    """tighten, loosen, same or ambiguous of a new limit against an old one; null-safe."""
    tighter, looser = (new < old, new > old) if kind == "max_limit" else (new > old, new < old)
    return F.when(old.isNull() | new.isNull(), "ambiguous").when(tighter, "tighten").when(looser, "loosen").otherwise("same")


def diff_to_base(project: DataFrame, base: DataFrame, key: str, value: str) -> DataFrame:
    """(key, base_value, value, change) of a project's limits against its base's."""
    b = base.select(F.col(key), F.col(value).alias("base_value"))
    return project.join(b, key, "left").select(key, "base_value", value, comparison(F.col("base_value"), F.col(value)).alias("change"))


def compliance(limits: DataFrame, results: DataFrame, key: str, limit: str, case: str, at: str, measured: str) -> DataFrame:
    """(key, state): every key's worst state over its cases' latest results; no result is its own state."""
    latest = keep_best(results, [key, case], F.desc(at), F.desc(measured))
    rows = limits.join(latest, key, "left")
    state = F.when(F.col(measured).isNull(), "missing_test_result").when(F.col(limit).isNull(), "not_evaluated").when(F.col(measured) <= F.col(limit), "pass").otherwise("fail")
    return rows.withColumn("state", state).groupBy(key).agg(F.min_by("state", rank_of("state", STATES)).alias("state"))


def impact(layers: DataFrame, limits: DataFrame, profile: str, value: float) -> DataFrame:
    """What would change if a profile's limit were `value`: leaf, before, after, change, conflict."""
    proposed = limits.withColumn("value_numeric", F.when(F.col("profile_id") == profile, F.lit(value)).otherwise(F.col("value_numeric")).cast("decimal(18,2)"))
    touched = layers.join(layers.filter(F.col("profile_id") == profile).select("leaf"), "leaf", "left_semi")
    a = effective_limits(touched, limits).select("leaf", F.col("effective").alias("before"))
    b = effective_limits(touched, proposed).select("leaf", F.col("effective").alias("after"), "conflict")
    return a.join(b, "leaf").select("leaf", "before", "after", comparison(F.col("before"), F.col("after")).alias("change"), "conflict")


def drift(frozen: DataFrame, now: DataFrame, key: str, value: str) -> DataFrame:
    """(change, n) between a baseline and the present."""
    return compared(frozen, now, key, value).groupBy("change").agg(F.count("*").alias("n"))


def release_gate(findings: DataFrame, key: str, severity: str) -> DataFrame:
    """key, blockers, warnings, score = max(0, 100 - 25 blockers - 5 warnings), readiness."""
    per = findings.groupBy(key).agg(F.count_if(F.col(severity) == "blocker").alias("blockers"), F.count_if(F.col(severity) == "warning").alias("warnings"))
    score = F.greatest(F.lit(0), 100 - 25 * F.col("blockers") - 5 * F.col("warnings")).cast("long")
    return per.withColumn("score", score).withColumn("readiness", F.when(F.col("blockers") > 0, "blocked").when(F.col("score") >= 90, "ready").otherwise("conditional"))


def latest_state(log: DataFrame, key: str, at: str, state: str) -> DataFrame:
    """The state of each key's last event."""
    return log.groupBy(key).agg(F.max_by(state, at).alias(state))


def bad_transitions(log: DataFrame, key: str, at: str, state: str, allowed: dict[str, list[str]]) -> DataFrame:
    """Events whose state may not follow the one before."""
    from pyspark.sql.window import Window

    before = F.lag(state).over(Window.partitionBy(key).orderBy(at))
    pairs = F.array(*(F.lit(f"{a}>{b}") for a, bs in allowed.items() for b in bs))
    return log.withColumn("before", before).filter(F.col("before").isNotNull() & ~F.array_contains(pairs, F.concat("before", F.lit(">"), state)))


def permitted(rows: DataFrame, grants: DataFrame, scope: str, role: str, least: int) -> DataFrame:
    """Rows of the scopes on which a role has at least a level."""
    return rows.join(grants.filter((F.col("role") == role) & (F.col("level") >= least)).select(scope).distinct(), scope, "left_semi")
