"""Guarded state machines over event logs of any length per entity.

An event is a map from each state to the next; an event that a state refuses maps it to itself. Maps
compose, and composition is associative: so a log is cut into chunks of a range-partitioned order, the
chunks' maps are composed on their own, their prefixes within a range and over an entity's ranges give
each chunk its first state, and the chunks are then run from there. No window and no task holds an entity's whole log.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.scratch import materialize

#: Events that one row of an intermediate table holds, and bits of a row's number within its range.
CHUNK, _BITS = 512, 33


@dataclass(frozen=True)
class Machine:
    """States, the first of which every entity begins in, and for each event the moves that it allows."""

    states: tuple[str, ...]
    events: dict[str, dict[str, str]]

    def _moves(self) -> Column:
        """event -> the number of the next state for each state's number."""
        number = {s: i for i, s in enumerate(self.states)}
        arrays = ((e, F.array(*(F.lit(number[moves.get(s, s)]) for s in self.states))) for e, moves in self.events.items())
        return F.create_map(*(x for e, a in arrays for x in (F.lit(e), a)))

    def _refusals(self) -> Column:
        """event -> the numbers of the states that refuse it."""
        pairs = ((e, F.array(*(F.lit(i) for i, s in enumerate(self.states) if s not in moves)).cast("array<int>")) for e, moves in self.events.items())
        return F.create_map(*(x for e, a in pairs for x in (F.lit(e), a)))


def guarded(states: tuple[str, ...], rules: dict[str, Callable[[str], str | None]]) -> Machine:
    """A machine of rules: for each event a function from a state to the next, or to None where it is refused."""
    return Machine(states, {e: {s: to for s in states if (to := rule(s)) is not None} for e, rule in rules.items()})


def _composed(first: Column, then: Column) -> Column:
    return F.transform(first, lambda s: F.get(then, s))


def run(log: DataFrame, machine: Machine, key: str, order: list[str], event: str) -> DataFrame:
    """The rows of `log` with `before`, `after` (states) and `refused`.

    Rows of a key are taken by `order`, which must be unique within it. An event that the machine lacks, or a null one,
    is refused in every state; rows with a null key are an entity of their own."""
    moves, stay = machine._moves(), F.sequence(F.lit(0), F.lit(len(machine.states) - 1))
    own = [c for c in log.columns]
    sorted_log = log.repartitionByRange(F.col(key), *map(F.col, order)).sortWithinPartitions(key, *order)
    placed = materialize(sorted_log.select(F.struct(*own).alias("row"), F.monotonically_increasing_id().alias("n")), "machine-log")  # a task that is run again must find the same ranges
    chunk = F.floor(F.col("n") / CHUNK).alias("chunk")
    step = F.struct("n", F.coalesce(F.element_at(moves, F.coalesce(f"row.{event}", F.lit(""))), stay).alias("map"), "row").alias("step")
    chunks = placed.select(F.col(f"row.{key}").alias("key"), chunk, step).groupBy("key", "chunk").agg(F.array_sort(F.collect_list("step"), lambda a, b: F.when(a["n"] < b["n"], -1).otherwise(1)).alias("steps"))
    chunks = materialize(chunks.withColumn("map", F.aggregate("steps", stay, lambda f, x: _composed(f, x["map"]))), "machine-chunks")
    entries = _entries(chunks.select("key", "chunk", "map"), stay)
    started = chunks.drop("map").join(entries, [chunks["chunk"] == entries["c"], chunks["key"].eqNullSafe(entries["k"])]).drop("k", "c")
    names = F.array(*map(F.lit, machine.states))
    kind = f"array<struct<row:{placed.schema['row'].dataType.simpleString()},before:int,after:int>>"
    path = F.aggregate(
        "steps", F.struct(F.col("entry").alias("at"), F.array().cast(kind).alias("out")),
        lambda a, x: F.struct(F.get(x["map"], a["at"]).alias("at"), F.concat(a["out"], F.array(F.struct(x["row"].alias("row"), a["at"].alias("before"), F.get(x["map"], a["at"]).alias("after")))).alias("out")),
        lambda a: a["out"],
    )
    ran = started.select(F.inline(path))
    refused = F.coalesce(F.array_contains(F.element_at(machine._refusals(), F.coalesce(f"row.{event}", F.lit(""))), F.col("before")), F.lit(True))
    return ran.select("row.*", F.get(names, F.col("before")).alias("before"), F.get(names, F.col("after")).alias("after"), refused.alias("refused"))


def _entries(maps: DataFrame, stay: Column) -> DataFrame:
    """(k, c, entry): the state in which each chunk of a key begins. The chunks of a range are composed in one row, and a
    key's ranges in another: a row has no more entries than a range has chunks, or the log has ranges."""

    def prefixes(items: str, start: Column, then: Callable[[Column, Column], Column], kind: str) -> Column:
        """(at, value) of each item: what those before it give."""
        out = F.array().cast(f"array<struct<at:bigint,value:{kind}>>")
        return F.aggregate(items, F.struct(start.alias("now"), out.alias("out")), lambda a, x: F.struct(then(a["now"], x["map"]).alias("now"), F.concat(a["out"], F.array(F.struct(x["at"].alias("at"), a["now"].alias("value")))).alias("out")))

    part = F.floor(F.col("chunk") / ((1 << _BITS) // CHUNK)).alias("part")
    ranges = maps.groupBy("key", part).agg(F.array_sort(F.collect_list(F.struct(F.col("chunk").alias("at"), "map"))).alias("items"))
    ranges = ranges.select("key", "part", prefixes("items", stay, _composed, "array<int>").alias("r")).select("key", "part", F.col("r.now").alias("map"), F.col("r.out").alias("inner"))
    ranges = materialize(ranges, "machine-ranges")
    keys = ranges.groupBy("key").agg(F.array_sort(F.collect_list(F.struct(F.col("part").cast("long").alias("at"), "map"))).alias("items"))
    first = keys.select(F.col("key").alias("k"), F.inline(prefixes("items", F.lit(0), lambda s, f: F.get(f, s), "int")["out"]))
    placed = ranges.join(first, [ranges["part"] == first["at"], ranges["key"].eqNullSafe(first["k"])])
    return placed.select("k", F.col("value").alias("start"), F.inline("inner")).select("k", F.col("at").alias("c"), F.get(F.col("value"), F.col("start")).alias("entry"))


# ---- approvals and change orders -----------------------------------------------------------------

# States of an approval and of a change order, and the kinds of overrides that need a review.
APPROVAL_STATES = ("none", "submitted", "approved", "rejected")
ORDER_STATES = ("none", "draft", "impact_analyzed", "approval_pending", "approved", "applied", "gate_blocked", "closed")
RISKY_OVERRIDES = ("loosen", "disable", "exception")

#: A request may be submitted again from any state; only a submitted one is decided.
APPROVAL = guarded(APPROVAL_STATES, {"submit": lambda s: "submitted", "approve": lambda s: "approved" if s == "submitted" else None, "reject": lambda s: "rejected" if s == "submitted" else None})


def _order(rule: Callable[[str, str], tuple[str, str] | None]) -> Callable[[str], str | None]:
    """A rule over a change order's and its approval's state as one over both, written order/approval; an order must exist."""

    def both(state: str) -> str | None:
        status, approval = state.split("/")
        to = rule(status, approval) if status != "none" else None
        return to and "/".join(to)

    return both


#: A change order with its approval: a decision needs a submitted request, a change an approved order, and a gate an applied one.
CHANGE_ORDER = guarded(
    tuple(f"{s}/{a}" for s in ORDER_STATES for a in APPROVAL_STATES if s != "none" or a == "none"),
    {
        "create": lambda s: "draft/none" if s == "none/none" else None,
        "analyze": _order(lambda s, a: ("impact_analyzed", a)),
        "submit": _order(lambda s, a: ("approval_pending", "submitted")),
        "approve": _order(lambda s, a: ("approved", "approved") if a == "submitted" else None),
        "reject": _order(lambda s, a: (s, "rejected") if a == "submitted" else None),
        "apply": _order(lambda s, a: ("applied", a) if s == "approved" else None),
        "gate_pass": _order(lambda s, a: ("closed", a) if s in ("applied", "gate_blocked", "closed") else None),
        "gate_fail": _order(lambda s, a: ("gate_blocked", a) if s in ("applied", "gate_blocked", "closed") else None),
    },
)


def approvals(ran: DataFrame, key: str, at: str, event: str, last: list[str]) -> DataFrame:
    """(key, status, decided_at, steps, refused) of the rows of `run`: a decision's time falls with a new submission."""
    done = ~F.col("refused")
    latest = lambda value, when: F.max_by(value, F.when(when, F.struct(*last)))
    return ran.groupBy(key).agg(
        latest("after", F.lit(True)).alias("status"),
        latest(F.when(F.col(event) != "submit", F.col(at)), done).alias("decided_at"),
        F.count("*").alias("steps"), F.count_if("refused").alias("refused"),
    )


def change_orders(ran: DataFrame, key: str, at: str, event: str, last: list[str]) -> DataFrame:
    """(key, status, approval, submitted_at, approved_at, applied_at, closed_at, steps, refused): the last time of each step that was taken."""
    taken = lambda e: F.max(F.when((F.col(event) == e) & ~F.col("refused"), F.col(at)))
    state = F.split(F.max_by("after", F.struct(*last)), "/")
    return ran.groupBy(key).agg(
        state[0].alias("status"), state[1].alias("approval"), taken("submit").alias("submitted_at"), taken("approve").alias("approved_at"),
        taken("apply").alias("applied_at"), taken("gate_pass").alias("closed_at"), F.count("*").alias("steps"), F.count_if("refused").alias("refused"),
    )


def review_items(overrides: DataFrame) -> DataFrame:
    """Risky overrides that are not approved or lack evidence, with severity: of `override_id, override_type, approval_status, evidence_id, risk_level`."""
    missing = F.col("evidence_id").isNull()
    risk = F.lower(F.coalesce("risk_level", F.lit("medium")))
    severity = F.when(missing | risk.isin("critical", "high"), "high").when(risk == "low", "low").otherwise("medium")
    rank = F.when(F.col("severity") == "high", 1).when(F.col("severity") == "medium", 2).otherwise(3)
    open_ = overrides.filter(F.col("override_type").isin(*RISKY_OVERRIDES) & (~F.col("approval_status").eqNullSafe(F.lit("approved")) | missing))
    items = open_.select("override_id", severity.alias("severity"), (~F.col("approval_status").eqNullSafe(F.lit("approved"))).alias("approval_required"), missing.alias("evidence_required"))
    return items.withColumn("severity_rank", rank)


def actions(impacts: DataFrame) -> DataFrame:
    """(order_id, project_id, action_type, status) of `order_id, project_id, direct, effect, fails`: what an order must do for each project.

    A project that takes the changed value directly is tested anew; one whose own override compares as looser, or not
    clearly, is tested and reviewed, and so is one whose tests would fail."""
    unclear = ~F.coalesce(F.col("effect"), F.lit("ambiguous")).isin("tighten", "same", "clarify")
    review = F.col("fails") | (~F.col("direct") & unclear)
    test = F.col("fails") | F.col("direct") | unclear
    kinds = F.array_compact(F.array(F.when(test, "regression_test"), F.when(review, "engineering_review")))
    return impacts.select("order_id", "project_id", F.explode(kinds).alias("action_type"), F.lit("open").alias("status"))
