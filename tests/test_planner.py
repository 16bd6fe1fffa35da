"""The question planner: every intent and reason occurs, and names are found wherever they stand."""

import random
import tempfile

from lodestone.operators import joins, planner
from lodestone.plans import registry


def test_substrings_equal_brute_force(spark):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abc效率") for _ in range(rng.randrange(n)))
    texts = [(i, word(25)) for i in range(300)] + [(300, None)]
    terms = sorted({word(7) for _ in range(150)})
    got = joins.substrings(spark.createDataFrame(texts, "id long, t string"), "id", "t", spark.createDataFrame([(t,) for t in terms] + [(None,), ("",)], "w string"), "w")
    assert sorted(map(tuple, got.collect())) == sorted((i, w) for i, t in texts for w in terms if t and w and w in t)


def test_substrings_form_no_pairs_that_share_a_part_only(spark):
    """Many names of one pattern meet many questions of it: what is generated grows with the texts, not with names times texts."""
    terms = spark.range(3000).selectExpr("concat('proj-', lpad(id, 6, '0')) AS w")
    texts = spark.range(3000).selectExpr("id", "concat('status of proj-', lpad(id * 7 % 4000, 6, '0')) AS t")
    found = joins.substrings(texts, "id", "t", terms, "w")
    path = tempfile.mkdtemp()
    found.write.mode("overwrite").parquet(path)
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(i, f"proj-{i * 7 % 4000:06d}") for i in range(3000) if i * 7 % 4000 < 3000]
    assert "contains(" not in found._jdf.queryExecution().optimizedPlan().toString().lower()  # no pair is formed to be checked afterwards


def test_generated_questions_are_of_every_kind(spark, data):
    rows = registry.queries()["l14_intent_planner"](spark, f"{data}/sf0.01").collect()
    intents = {r["intent"] for r in rows}
    assert len(intents) == 12 and "clarification_required" in intents
    assert {r["reason"] for r in rows} - {None} == set(planner.REASONS.values())


def test_slots(spark):
    rows = [(1, "PROJ-7 效率"), (2, "proj-7 和 proj-8 效率"), (3, "Acme 效率 改成 ≤ 95.5%"), (4, "p7 项目 效率"), (5, None)]
    plan = planner.plan(
        spark.createDataFrame(rows, "question_id long, question string"),
        spark.createDataFrame([("proj-7", "c1", "X-P7", "seven"), ("proj-8", "c1", "X-P8", None)], "project_id string, customer_id string, project_code string, project_name string"),
        spark.createDataFrame([("REQATOM-DCDC-EFFICIENCY", "", None)], "atom_id string, canonical_name string, parameter_name string"),
        spark.createDataFrame([("c1", "Acme", "")], "customer_id string, customer_name string, customer_code string"),
        spark.createDataFrame([("b1", "c1", 1), ("b2", "c1", 2)], "profile_id string, customer_id string, updated_at long"),
        spark.createDataFrame([("v1", "c1", "REQATOM-DCDC-EFFICIENCY", 5, 1)], "variant_id string, customer_id string, atom_id string, priority long, updated_at long"),
    )
    got = {r["question_id"]: r for r in plan.collect()}
    assert (got[1]["intent"], got[1]["project_id"], got[1]["atom_id"]) == ("requirement_effective", "proj-7", "REQATOM-DCDC-EFFICIENCY")
    assert (got[2]["intent"], got[2]["reason"]) == ("clarification_required", planner.REASONS["project"])
    assert (got[3]["intent"], got[3]["variant_id"], got[3]["proposed_value"], got[3]["proposed_unit"]) == ("requirement_impact", "v1", 95.5, "%")
    assert got[4]["project_id"] == "proj-7" and got[5]["intent"] == "clarification_required"
