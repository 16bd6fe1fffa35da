"""Operators on small literal tables."""

import numpy as np
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import evaluation, folds, graph, joins, maintenance, ranking, vectors
from lodestone.plans import registry
from lodestone.scratch import materialize, shared_dir


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_paths_respect_hops_and_cycles(spark):
    edges = spark.createDataFrame([(7, 1), (1, 2), (2, 7)], "src long, dst long")
    start = spark.createDataFrame([(7,)], "node long")
    assert rows(graph.simple_paths(edges, start, 3).select("hops", "path")) == [(1, "7>1"), (2, "7>1>2")]
    assert rows(graph.simple_paths(edges, start, 1).select("path")) == [("7>1",)]


def test_dangling_ignores_null_keys(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "a int")
    right = spark.createDataFrame([(1,), (None,)], "b int")
    assert rows(joins.dangling(left, right, "a", "b")) == [(2,)]


def test_nearest_prefers_the_smaller_position(spark):
    left = spark.createDataFrame([("k", 5), ("k", 100), ("z", 1)], "k string, p int")
    right = spark.createDataFrame([("k", 3, "a"), ("k", 7, "b"), ("k", 90, "c")], "k string, q int, v string")
    assert rows(joins.nearest(left, right, "k", "p", "q", "v", "v"), "k", "p") == [("k", 5, "a"), ("k", 100, "c"), ("z", 1, None)]


def test_as_of_strict_and_not(spark):
    left = spark.createDataFrame([("k", 5), ("k", 3)], "k string, t int")
    right = spark.createDataFrame([("k", 3, 1), ("k", 5, 2)], "k string, u int, v int")
    assert rows(joins.as_of(left, right, "k", "t", "u", "v", "r"), "t") == [("k", 3, 1), ("k", 5, 2)]
    assert rows(joins.as_of(left, right, "k", "t", "u", "v", "r", strict=True), "t") == [("k", 3, None), ("k", 5, 1)]


def test_previous_run_of_runs_that_start_together(spark, tmp_path):
    """Runs of one suite with the same start follow each other by id, as in the SQL."""
    spark.sql("SELECT id AS event_id, if(id = 5, NULL, timestamp '2024-01-01' + make_interval(0, 0, 0, 0, 0, id div 3)) AS ts, 0L AS user_id, 'click' AS event_type, 1D AS value, '{}' AS props FROM range(8)").write.parquet(f"{tmp_path}/events.parquet")
    got = rows(registry.queries()["c15_as_of_previous_run"](spark, str(tmp_path)), "run_id")
    assert got == [(0, None), (1, 0), (2, 1), (3, 2), (4, 3), (5, 7), (6, 4), (7, 6)]


def test_merged_hits_take_the_smaller_of_equally_scored(spark):
    hits = spark.createDataFrame([("k", 2.0, "b", 9), ("k", 2.0, "a", 4), ("k", 2.0, "a", 7), ("k", 3.0, "a", None), ("k", 1.0, "c", 1), ("z", None, "c", 1)], "k string, s double, c string, id int")
    for n in (1, 4):
        for way in ("id", "-id"):
            assert rows(ranking.merge_hits(hits.orderBy(F.expr(way)).repartition(n), ["k"], "s", "c", ["id"]), "k") == [("k", 3.0, "a,b,c", 4), ("z", None, "c", None)]


def test_merged_hits_without_a_channel_have_none(spark):
    hits = spark.createDataFrame([("k", 2.0, None, 9), ("k", 1.0, None, 4), ("z", 1.0, "", 1)], "k string, s double, c string, id int")
    assert rows(ranking.merge_hits(hits, ["k"], "s", "c", ["id"]), "k") == [("k", 2.0, None, 9), ("z", 1.0, "", 1)]


def test_a_key_over_many_ranges_is_filled_across_them(spark):
    n = 4000
    left = spark.range(n).selectExpr("CASE WHEN id % 5 = 0 THEN 'z' ELSE 'k' END AS k", "id AS p")
    right = spark.createDataFrame([("k", 10, "a"), ("k", 3000, "b"), ("z", 2000, "c"), (None, 5, "n")], "k string, q long, v string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        near = {(r.k, r.p): r.v for r in joins.nearest(left, right, "k", "p", "q", "v", "v").collect()}
        last = {(r.k, r.p): r.v for r in joins.as_of(left, right, "k", "p", "q", "v", "v").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert near == {("z" if p % 5 == 0 else "k", p): "c" if p % 5 == 0 else "a" if abs(p - 10) <= abs(p - 3000) else "b" for p in range(n)}
    assert last == {("z" if p % 5 == 0 else "k", p): ("c" if p >= 2000 else None) if p % 5 == 0 else None if p < 10 else "a" if p < 3000 else "b" for p in range(n)}


def test_proximity_crosses_buckets_and_signs(spark):
    left = spark.createDataFrame([("g", -1), ("g", 10)], "g string, a int")
    right = spark.createDataFrame([("g", 1), ("g", 12), ("g", 13)], "g string, b int")
    assert rows(joins.proximity(left, right, "g", "a", "b", 2).select("a", "b")) == [(-1, 1), (10, 12)]


def test_compared_is_null_safe(spark):
    old = spark.createDataFrame([(1, None), (2, "x"), (3, "x")], "k int, v string")
    new = spark.createDataFrame([(1, None), (2, "y"), (4, "z")], "k int, v string")
    assert rows(joins.compared(old, new, "k", "v").select("k", "change")) == [(1, "unchanged"), (2, "changed"), (3, "removed"), (4, "added")]


def test_layers_tighten_and_conflicts_show(spark):
    limits = spark.createDataFrame([(100, "R", 80), (200, "N", 50), (500, "C", 60)], "priority int, profile_id string, value_numeric int").withColumn("value_numeric", F.col("value_numeric").cast("decimal(18,2)"))
    layers = spark.createDataFrame([("C", "R"), ("C", "N"), ("C", "C")], "leaf string, profile_id string")
    r = folds.effective_limits(layers, limits).first()
    assert (int(r.effective), int(r.nearest), r.conflict) == (50, 60, True)


def test_ten_rows_in_three_shards(spark):
    out = ranking.shards(spark.range(10), 3, "id").groupBy("shard").count()
    assert rows(out) == [(1, 4), (2, 3), (3, 3)]


def test_retrieval_quality_example(spark):
    hits = spark.createDataFrame([(1, 2, "swe.2.bp2"), (1, 3, "SWE.2.BP3"), (1, 4, "swe.2.bp4")], "case_id int, rank int, text string")
    anchors = spark.createDataFrame([(1, "SWE.2.BP3", "must"), (1, "SWE.2.BP4", "must"), (1, "SYS.3", "negative")], "case_id int, anchor string, kind string")
    r = evaluation.retrieval_quality(hits, anchors).first()
    assert (r.found, r.best_rank, r.recall_at_5, r.attribution) == (2, 3, 1.0, "ok")


def test_ancestors_reach_any_depth_and_cycles_end(spark):
    tree = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, None)], "child long, parent long")
    got = {(r.node, r.ancestor): r.depth for r in graph.ancestors(tree).collect()}
    assert got == {(i, j): j - i for i in range(40) for j in range(i + 1, 41)} | {(100, 101): 1, (101, 100): 1, (100, 100): 2, (101, 101): 2}
    assert {r.node for r in graph.cyclic_nodes(tree).collect()} == {100, 101}
    assert graph.ancestors(tree.limit(0)).count() == 0


def test_contained_terms_meet_on_their_rarest_token(spark):
    texts = spark.createDataFrame([(1, "the end of the line"), (2, "the line of the end"), (3, "")], "k long, text string")
    terms = spark.createDataFrame([("The end",), ("of the",), ("the",), ("end line",), ("zzz",), ("!",)], "term string")
    assert rows(joins.containing(texts, "k", "text", terms, "term")) == [(1, "The end"), (1, "of the"), (1, "the"), (2, "The end"), (2, "of the"), (2, "the")]


def test_nearest_vectors_in_small_blocks(spark):
    rng = np.random.Generator(np.random.PCG64(2))
    rows_ = [(i, [float(x) for x in rng.normal(size=5)]) for i in range(90)] + [(90, None), (91, [0.0] * 5), (92, [1.0]), (93, [1.0, None, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows_, "vec_id long, embedding array<double>")
    q = df.filter("vec_id < 4").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    v = {i: np.array(x) / np.linalg.norm(x) for i, x in rows_[:90]}
    want = {(a, b) for a in range(4) for _, b in sorted((-round(float(v[a] @ v[b]), 9), b) for b in v)[:6]}
    assert {(r.query_id, r.vec_id) for r in vectors.nearest(df, q, 6, rows_per_block=16).collect()} == want


def test_refusals_cover_nothing(spark):
    df = spark.createDataFrame([("nothing was not found", "found"), ("abc 5 V", "5 V"), ("", "x"), (None, "x"), ("x", "")], "a string, p string")
    assert [r.c for r in df.select(evaluation.coverage("a", F.array("p")).alias("c")).collect()] == [0.0, 1.0, 0.0, 0.0, 0.0]


def test_freshness_states(spark):
    new, old = spark.createDataFrame([("NEW",)], "k string"), spark.createDataFrame([("OLD",)], "k string")
    assert tuple(maintenance.freshness(new, old, "k").first()) == ("stale", 1, 1)
    assert tuple(maintenance.freshness(new, new, "k").first()) == ("fresh", 0, 0)
    assert maintenance.freshness(new, new.limit(0), "k").first().status == "missing"


def test_upsert_keeps_what_a_change_leaves_null(spark):
    a = spark.createDataFrame([(1, "a", 1)], "k int, n string, v int")
    b = spark.createDataFrame([(1, None, 5), (2, "b", 2)], "k int, n string, v int")
    assert rows(maintenance.upsert(a, b, "k")) == [(1, "a", 5), (2, "b", 2)]


def test_grams_of_short_strings(spark):
    df = spark.createDataFrame([("ab",), ("abc",), ("",)], "s string")
    assert [r.g for r in df.select(T.grams("s", 3).alias("g")).collect()] == [[], ["abc"], []]


def test_tags_and_entities(spark):
    df = spark.createDataFrame([("<p>a &amp; b<script>x()</script> c</p>",)], "s string")
    assert df.select(T.strip_tags("s").alias("s")).first().s == "a & b c"


def test_scratch_is_in_the_shared_folder(spark):
    df = materialize(spark.range(3), "t")
    assert df.inputFiles()[0].startswith(shared_dir(spark).replace("file://", "file:///").replace("////", "///"))
    assert df.count() == 3
