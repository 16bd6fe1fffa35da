"""Graph and hierarchy operators over edge tables (src, relation, dst)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.joins import substrings
from lodestone.scratch import materialize

_ROWS_A_TASK = 500_000


def build_edges(rows: DataFrame, keys: list[str], confidence: str, evidence: str) -> DataFrame:
    """One edge a key: the highest confidence and how many distinct pieces of evidence support it.

    Rows are dealt by key and one of 16 parts of the evidence into tasks of about as many rows, so that what a task holds does not grow
    with the table, and a key of many rows is spread; what the parts of a key count is added up."""
    n = max(1, -(-rows.count() // _ROWS_A_TASK))
    own = rows.select(*keys, F.col(confidence).alias("confidence"), F.col(evidence).alias("__evidence"), F.pmod(F.xxhash64(evidence), F.lit(16)).cast("int").alias("__part"))
    once = own.repartition(n, *keys, "__part").groupBy(*keys, "__part", "__evidence").agg(F.max("confidence").alias("confidence"))
    parts = once.groupBy(*keys, "__part").agg(F.max("confidence").alias("confidence"), F.count("__evidence").alias("n"))
    return parts.repartition(n, *keys).groupBy(*keys).agg(F.max("confidence").alias("confidence"), F.sum("n").alias("n_evidence"))


def simple_paths(edges: DataFrame, start: DataFrame, max_hops: int) -> DataFrame:
    """(start, node, hops, path) of all paths of 1 to `max_hops` edges without a repeated node.

    `start` has one column, node. Each hop is an equi-join on the frontier's last node; a frontier is written
    once, and the next one and the result read it."""
    step = materialize(edges.select(F.col("src").alias("node"), F.col("dst").alias("next")).distinct(), "steps")
    front = start.select(F.col("node").alias("start"), "node", F.array("node").alias("path"))
    fronts = []
    for hop in range(1, max_hops + 1):
        met = front.join(step, "node").filter(~F.array_contains("path", F.col("next")))
        front = materialize(met.select("start", F.col("next").alias("node"), F.concat("path", F.array("next")).alias("path")), "front")
        fronts.append(front.withColumn("hops", F.lit(hop)))
    return reduce(DataFrame.unionByName, fronts).select("start", "node", "hops", F.array_join("path", ">").alias("path"))


def ancestors(tree: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(node, ancestor, depth): the strict ancestors of every node of a child-parent table, with the
    least depth, to any depth (or `max_depth`, where that is the question).

    Each level is one equi-join of the pairs that the level before found first, so that cycles end; what is
    written is each pair once."""
    up = materialize(tree.select("child", "parent").filter("child is not null and parent is not null").distinct(), "tree")
    front = materialize(up.select(F.col("child").alias("node"), F.col("parent").alias("ancestor"), F.lit(1).alias("depth")), "pairs")
    levels = [front]
    while not front.isEmpty() and (max_depth is None or len(levels) < max_depth):
        further = front.join(up, F.col("ancestor") == F.col("child")).select("node", F.col("parent").alias("ancestor")).distinct()
        known = reduce(DataFrame.unionByName, levels).select("node", "ancestor")
        front = materialize(further.join(known, ["node", "ancestor"], "left_anti").withColumn("depth", F.lit(len(levels) + 1)), "pairs")
        levels.append(front)
    return reduce(DataFrame.unionByName, levels)


def descendants(tree: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(node, descendant, depth), strict."""
    return ancestors(tree, max_depth).select(F.col("ancestor").alias("node"), F.col("node").alias("descendant"), "depth")


def cyclic_nodes(tree: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Nodes that are their own ancestors."""
    return ancestors(tree, max_depth).filter(F.col("node") == F.col("ancestor")).select("node")


def neighbours(edges: DataFrame, node: str, direction: str = "both", relations: list[str] | None = None) -> DataFrame:
    """(other, relation, direction) of one node's edges."""
    e = edges.filter(F.col("relation").isin(relations)) if relations else edges
    out = e.filter(F.col("src") == node).select(F.col("dst").alias("other"), "relation", F.lit("out").alias("direction"))
    into = e.filter(F.col("dst") == node).select(F.col("src").alias("other"), "relation", F.lit("in").alias("direction"))
    return {"out": out, "in": into}.get(direction, out.unionByName(into))


def seeded_edges(edges: DataFrame, seeds: DataFrame, weights: dict[str, float], default: float) -> DataFrame:
    """Edges at either end of a seed node, scored by relation: a strong relation has a weight, others
    the default; an edge found from both ends is one row."""
    weight = F.coalesce(F.create_map(*(F.lit(x) for p in weights.items() for x in p))[F.col("relation")], F.lit(default))
    s = seeds.select(F.col("node"))
    a = edges.join(s, F.col("src") == F.col("node"), "left_semi")
    b = edges.join(s, F.col("dst") == F.col("node"), "left_semi")
    found = a.unionByName(b).distinct()
    return found.withColumn("score", weight).withColumn("tier", F.col("relation").isin(list(weights)))


def edge_problems(edges: DataFrame, nodes: DataFrame, node: str, registered: list[str]) -> DataFrame:
    """(problem, n): unregistered relations, self-loops, endpoints without a node, repeated edges."""
    known = nodes.select(F.col(node).alias("k")).distinct()
    one = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("problem"), "n")
    return (
        one("unregistered relation", edges.filter(~F.col("relation").isin(registered)))
        .unionByName(one("self-loop", edges.filter("src = dst")))
        .unionByName(one("missing source", edges.join(known, F.col("src") == F.col("k"), "left_anti")))
        .unionByName(one("missing target", edges.join(known, F.col("dst") == F.col("k"), "left_anti")))
        .unionByName(one("repeated edge", edges.groupBy("src", "relation", "dst").count().filter("count > 1")))
    )


def path_text(*parts: Column) -> Column:
    return F.concat_ws(" -> ", *parts)


def aligned(edges: DataFrame, facts: DataFrame, documents: DataFrame, k: int) -> DataFrame:
    """The k best edges (src, relation, dst, fact_id, doc_id, confidence) that an answer rests on: supported by one of its facts, or from one
    of its documents; supported ones first, then by confidence."""
    rows = edges.join(facts.select("fact_id").distinct().withColumn("__f", F.lit(1)), "fact_id", "left").join(documents.select("doc_id").distinct().withColumn("__d", F.lit(1)), "doc_id", "left")
    rows = rows.withColumn("supported", F.col("__f").isNotNull()).filter("supported or __d = 1").drop("__f", "__d")
    return rows.orderBy(F.desc("supported"), F.desc("confidence"), "src", "dst", "relation", "fact_id").limit(k)


def relation_checks(edges: DataFrame, nodes: DataFrame, node: str, kind: str, allowed: list[tuple[str, str, str]]) -> DataFrame:
    """(src_type, relation, dst_type, n, status) of all edges: consistent if the relation is allowed between those types, unknown if
    an end has no type, else mismatch."""
    t = nodes.select(F.col(node).alias("__n"), F.col(kind).alias("__t"))
    both = edges.join(t.withColumnsRenamed({"__n": "src", "__t": "src_type"}), "src", "left").join(t.withColumnsRenamed({"__n": "dst", "__t": "dst_type"}), "dst", "left")
    per = both.groupBy("src_type", "relation", "dst_type").agg(F.count("*").alias("n"))
    known = F.concat_ws("|", "src_type", "relation", "dst_type").isin(*("|".join(a) for a in allowed))
    return per.withColumn("status", F.when(F.col("src_type").isNull() | F.col("dst_type").isNull(), "unknown").when(known, "consistent").otherwise("mismatch"))



def type_report(questions: DataFrame, candidates: DataFrame, surfaces: DataFrame) -> DataFrame:
    """What filtering candidates by entity class would do to each question: (question_id, classes, total, dropped, kept, lost, reason).

    questions: question_id, question; candidates: question_id, candidate_id (unique), text; surfaces: surface, class_id. A candidate
    is dropped if it mentions an entity of another class and none of the question's; one that mentions neither is lost evidence. Nothing is
    dropped where the question has no class, or all entities share one. Names of less than two characters are not looked for."""
    names = surfaces.select(F.lower("surface").alias("name"), "class_id").filter("length(name) >= 2").distinct()
    distinct = names.agg(F.count_distinct("class_id").alias("__classes"))  # one row

    def classes(texts: DataFrame, key: str, text: str) -> DataFrame:
        low = texts.select(key, F.lower(text).alias("__low"))
        return substrings(low, key, "__low", names, "name").join(names, "name").filter("class_id IS NOT NULL").select(key, "class_id").distinct()

    asked = classes(questions, "question_id", "question")
    mentioned = candidates.select("question_id", "candidate_id").join(classes(candidates, "candidate_id", "text"), "candidate_id")
    own = asked.withColumn("__own", F.lit(True))
    marks = mentioned.join(own, ["question_id", "class_id"], "left").groupBy("candidate_id").agg(F.bool_or(F.coalesce("__own", F.lit(False))).alias("own"), F.bool_or(F.col("__own").isNull()).alias("other"))
    per = candidates.join(marks, "candidate_id", "left").groupBy("question_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("other") & ~F.col("own")).alias("__dropped"), F.count_if(F.col("own").isNull()).alias("__lost")
    )
    named = asked.groupBy("question_id").agg(F.array_join(F.array_sort(F.collect_set("class_id")), ",").alias("classes"))
    rows = questions.select("question_id").join(named, "question_id", "left").join(per, "question_id", "left").crossJoin(F.broadcast(distinct))
    reason = F.when(F.col("total").isNull(), "no_candidates").when(F.col("classes").isNull(), "query_has_no_known_entity_class").when(F.col("__classes") <= 1, "single_class_ontology_no_diversity").otherwise("projected")
    on = lambda c: F.when(F.col("reason") == "projected", F.col(c)).otherwise(0)
    total = F.coalesce("total", F.lit(0))
    return rows.withColumn("reason", reason).select("question_id", "classes", total.alias("total"), on("__dropped").alias("dropped"), (total - on("__dropped")).alias("kept"), on("__lost").alias("lost"), "reason")
