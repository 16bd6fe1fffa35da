"""J: graph and hierarchy operators."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import graph as G
from lodestone.operators.joins import containing
from lodestone.plans.registry import query
from lodestone.plans.views import Tables


@query("j01_edge_build", "SELECT concat('S', CAST(l_suppkey AS VARCHAR)) AS src, concat('P', CAST(l_partkey AS VARCHAR)) AS dst, max(l_quantity) AS confidence, count(DISTINCT l_orderkey) AS n_evidence FROM lineitem GROUP BY l_suppkey, l_partkey")
def j01(t: Tables) -> DataFrame:
    rows = G.build_edges(t.lineitem, ["l_suppkey", "l_partkey"], "l_quantity", "l_orderkey")
    return rows.select(F.concat(F.lit("S"), "l_suppkey").alias("src"), F.concat(F.lit("P"), "l_partkey").alias("dst"), "confidence", "n_evidence")


@query(
    "j03_seeded_edges",
    """SELECT DISTINCT src, relation, dst, CASE relation WHEN 'part_of' THEN 1.2 WHEN 'located_in' THEN 1.0 ELSE 0.4 END::DOUBLE AS score, relation IN ('part_of', 'located_in') AS tier
    FROM v_edges WHERE src IN ('N3', 'S5', 'S6') OR dst IN ('N3', 'S5', 'S6')""",
)
def j03(t: Tables) -> DataFrame:
    seeds = t.spark.createDataFrame([("N3",), ("S5",), ("S6",)], "node string")
    return G.seeded_edges(t.v_edges, seeds, {"part_of": 1.2, "located_in": 1.0}, 0.4)


@query("j05_path_payload", "SELECT a.src, concat_ws(' -> ', a.src, a.dst, b.dst) AS path FROM v_edges a JOIN v_edges b ON a.dst = b.src WHERE a.relation = 'located_in' AND b.relation = 'part_of'")
def j05(t: Tables) -> DataFrame:
    a = t.v_edges.filter("relation = 'located_in'").select("src", F.col("dst").alias("mid"))
    b = t.v_edges.filter("relation = 'part_of'").select(F.col("src").alias("mid"), "dst")
    return a.join(b, "mid").select("src", G.path_text(F.col("src"), F.col("mid"), F.col("dst")).alias("path"))


@query(
    "j06_simple_paths",
    """WITH RECURSIVE p AS (SELECT src AS start, dst AS node, 1 AS hops, [src, dst] AS path FROM v_edges WHERE src IN ('C1', 'C2', 'S3')
    UNION ALL SELECT p.start, e.dst, p.hops + 1, list_append(p.path, e.dst) FROM p JOIN v_edges e ON e.src = p.node WHERE p.hops < 3 AND NOT list_contains(p.path, e.dst))
    SELECT start, node, CAST(hops AS INTEGER) AS hops, array_to_string(path, '>') AS path FROM p""",
)
def j06(t: Tables) -> DataFrame:
    return G.simple_paths(t.v_edges, t.spark.createDataFrame([("C1",), ("C2",), ("S3",)], "node string"), 3)


@query("j08_neighbours", "SELECT dst AS other, relation, 'out' AS direction FROM v_edges WHERE src = 'N7' UNION ALL SELECT src, relation, 'in' FROM v_edges WHERE dst = 'N7'")
def j08(t: Tables) -> DataFrame:
    return G.neighbours(t.v_edges, "N7")


_CLOSURE = """WITH RECURSIVE c AS (SELECT child AS node, parent AS ancestor, 1 AS depth FROM v_tree UNION ALL SELECT c.node, v_tree.parent, c.depth + 1 FROM c JOIN v_tree ON v_tree.child = c.ancestor WHERE c.depth < 6)"""


@query("j09_ancestors", _CLOSURE + " SELECT node, ancestor, CAST(min(depth) AS INTEGER) AS depth FROM c GROUP BY 1, 2")
def j09(t: Tables) -> DataFrame:
    return G.ancestors(t.v_tree)


@query("j10_descendants", _CLOSURE + " SELECT ancestor AS node, node AS descendant, CAST(min(depth) AS INTEGER) AS depth FROM c GROUP BY 1, 2")
def j10(t: Tables) -> DataFrame:
    return G.descendants(t.v_tree)


@query("j11_subclass_test", _CLOSURE + " SELECT DISTINCT c_custkey FROM customer JOIN c ON c.node = concat('C', CAST(c_custkey AS VARCHAR)) WHERE c.ancestor = 'R2'")
def j11(t: Tables) -> DataFrame:
    inside = G.ancestors(t.v_tree).filter("ancestor = 'R2'").select("node")
    return t.customer.withColumn("node", F.concat(F.lit("C"), "c_custkey")).join(inside, "node", "left_semi").select("c_custkey")


@query("j12_cycles", "SELECT node FROM (VALUES ('a'), ('b'), ('c')) v(node)")
def j12(t: Tables) -> DataFrame:
    ring = t.spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "child string, parent string")
    return G.cyclic_nodes(t.v_tree.unionByName(ring))


@query("j13_profile_expansion", _CLOSURE + " SELECT node, ancestor, priority FROM c JOIN (SELECT DISTINCT profile_id, priority FROM v_limits) ON profile_id = ancestor WHERE node LIKE 'C%'")
def j13(t: Tables) -> DataFrame:
    up = G.ancestors(t.v_tree).filter("node like 'C%'")
    return up.join(t.v_limits.select(F.col("profile_id").alias("ancestor"), "priority").distinct(), "ancestor").select("node", "ancestor", "priority")


@query("j14_reverse_closure", _CLOSURE + " SELECT ancestor AS profile, count(DISTINCT node) AS projects FROM c WHERE node LIKE 'C%' GROUP BY 1")
def j14(t: Tables) -> DataFrame:
    return G.ancestors(t.v_tree).filter("node like 'C%'").groupBy(F.col("ancestor").alias("profile")).agg(F.countDistinct("node").alias("projects"))


@query(
    "j15_projection",
    "SELECT concat('C', CAST(o_custkey AS VARCHAR)) AS src, 'placed' AS relation, concat('O', CAST(o_orderkey AS VARCHAR)) AS dst FROM orders UNION SELECT concat('O', CAST(l_orderkey AS VARCHAR)), 'contains', concat('P', CAST(l_partkey AS VARCHAR)) FROM lineitem",
)
def j15(t: Tables) -> DataFrame:
    a = t.orders.select(F.concat(F.lit("C"), "o_custkey").alias("src"), F.lit("placed").alias("relation"), F.concat(F.lit("O"), "o_orderkey").alias("dst"))
    b = t.lineitem.select(F.concat(F.lit("O"), "l_orderkey").alias("src"), F.lit("contains").alias("relation"), F.concat(F.lit("P"), "l_partkey").alias("dst"))
    return a.unionByName(b).distinct()


@query(
    "j17_edge_validation",
    """SELECT 'unregistered relation' AS problem, count(*) AS n FROM v_edges WHERE relation NOT IN ('part_of', 'located_in') UNION ALL SELECT 'self-loop', count(*) FROM v_edges WHERE src = dst
    UNION ALL SELECT 'missing source', count(*) FROM v_edges WHERE src NOT IN (SELECT entity_id FROM v_entities) UNION ALL SELECT 'missing target', count(*) FROM v_edges WHERE dst NOT IN (SELECT entity_id FROM v_entities)
    UNION ALL SELECT 'repeated edge', count(*) FROM (SELECT 1 FROM v_edges GROUP BY src, relation, dst HAVING count(*) > 1)""",
)
def j17(t: Tables) -> DataFrame:
    return G.edge_problems(t.v_edges, t.v_entities, "entity_id", ["part_of", "located_in"])


@query(
    "j18_mentions",
    """WITH d AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9./-]+'), ' ') || ' ' AS s FROM documents),
    m AS (SELECT doc_id, term FROM d, (SELECT unnest(['mit license', 'license', 'apache license', 'general public license']) AS term) WHERE contains(s, ' ' || term || ' '))
    SELECT doc_id, term FROM m a WHERE NOT EXISTS (SELECT 1 FROM m b WHERE a.doc_id = b.doc_id AND a.term <> b.term AND contains(b.term, a.term))""",
)
def j18(t: Tables) -> DataFrame:
    terms = t.spark.createDataFrame([("mit license",), ("license",), ("apache license",), ("general public license",)], "term string")
    m = containing(t.documents, "doc_id", "text", terms, "term")
    longer = m.select("doc_id", F.col("term").alias("other"))
    return m.join(longer, (m.doc_id == longer.doc_id) & (F.col("term") != F.col("other")) & F.contains(F.col("other"), F.col("term")), "left_anti")
