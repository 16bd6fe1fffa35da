"""C: joins."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import joins
from lodestone.plans.registry import query
from lodestone.plans.views import Tables


@query("c01_inner_join", "SELECT o_orderkey, l_linenumber, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'P'")
def c01(t: Tables) -> DataFrame:
    return t.orders.filter("o_orderstatus = 'P'").join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "l_linenumber", "l_quantity")


_ENDPOINTS = """SELECT e.src, a.canonical_name AS src_name, e.relation, e.dst, b.canonical_name AS dst_name
FROM v_edges e JOIN v_entities a ON e.src = a.entity_id JOIN v_entities b ON e.dst = b.entity_id WHERE e.relation = 'located_in'"""


@query("c02_edge_endpoints", _ENDPOINTS)
def c02(t: Tables) -> DataFrame:
    names = t.v_entities
    a = names.select(F.col("entity_id").alias("src"), F.col("canonical_name").alias("src_name"))
    b = names.select(F.col("entity_id").alias("dst"), F.col("canonical_name").alias("dst_name"))
    return t.v_edges.filter("relation = 'located_in'").join(a, "src").join(b, "dst").select("src", "src_name", "relation", "dst", "dst_name")


@query("c03_bridge_join", "SELECT DISTINCT p_brand, s_name FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE p_size < 10")
def c03(t: Tables) -> DataFrame:
    bridge = t.lineitem.select("l_partkey", "l_suppkey")
    return bridge.join(t.part.filter("p_size < 10"), F.col("l_partkey") == F.col("p_partkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select("p_brand", "s_name").distinct()


@query("c04_left_enrichment", "SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def c04(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left").select("doc_id", "lang", "quality", "toxic")


@query(
    "c05_dangling_references",
    """SELECT 'customer without order' AS issue, count(*) AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
    UNION ALL SELECT 'order without line', count(*) FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
    UNION ALL SELECT 'line without order', count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE l_orderkey = o_orderkey)
    UNION ALL SELECT 'label without document', count(*) FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id)""",
)
def c05(t: Tables) -> DataFrame:
    checks = [
        ("customer without order", t.customer, t.orders, "c_custkey", "o_custkey"),
        ("order without line", t.orders, t.lineitem, "o_orderkey", "l_orderkey"),
        ("line without order", t.lineitem, t.orders, "l_orderkey", "o_orderkey"),
        ("label without document", t.labels, t.documents, "doc_id", "doc_id"),
    ]
    out = None
    for name, left, right, a, b in checks:
        one = joins.dangling(left.select(a), right.select(F.col(b).alias("other")), a, "other").agg(F.count("*").alias("n")).select(F.lit(name).alias("issue"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("c06_not_exists_either", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R') OR NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_linestatus = 'O')")
def c06(t: Tables) -> DataFrame:
    used = t.lineitem.groupBy("l_partkey").agg(F.max(F.col("l_returnflag") == "R").alias("returned"), F.max(F.col("l_linestatus") == "O").alias("open"))
    both = used.filter("returned and open").select(F.col("l_partkey").alias("p_partkey"))
    return t.part.select("p_partkey").join(both, "p_partkey", "left_anti")


@query("c07_existence_flags", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS has_pending, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000) AS has_large FROM customer")
def c07(t: Tables) -> DataFrame:
    out = joins.with_flag(t.customer.select("c_custkey"), t.orders.filter("o_orderstatus = 'P'"), "c_custkey", "o_custkey", "has_pending")
    return joins.with_flag(out, t.orders.filter("o_totalprice > 450000"), "c_custkey", "o_custkey", "has_large")


@query("c08_semi_join", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def c08(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "source").join(t.labels.filter("quality = 1").select("doc_id"), "doc_id", "left_semi")


@query(
    "c09_preaggregated_joins",
    """WITH a AS (SELECT l_suppkey AS k, count(*) AS lines FROM lineitem GROUP BY 1), b AS (SELECT l_suppkey AS k, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1),
    c AS (SELECT l_suppkey AS k, count(*) AS returned FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), d AS (SELECT l_suppkey AS k, max(l_quantity) AS most FROM lineitem GROUP BY 1)
    SELECT s_suppkey, coalesce(lines, 0) AS lines, coalesce(parts, 0) AS parts, coalesce(returned, 0) AS returned, most FROM supplier
    LEFT JOIN a ON s_suppkey = a.k LEFT JOIN b ON s_suppkey = b.k LEFT JOIN c ON s_suppkey = c.k LEFT JOIN d ON s_suppkey = d.k""",
)
def c09(t: Tables) -> DataFrame:
    # The four relations have one key, so one aggregation serves them all.
    per = t.lineitem.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(
        F.count("*").alias("lines"), F.countDistinct("l_partkey").alias("parts"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.max("l_quantity").alias("most")
    )
    out = t.supplier.select("s_suppkey").join(per, "s_suppkey", "left")
    return out.select("s_suppkey", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("lines", "parts", "returned")), "most")


@query(
    "c10_alias_join",
    """WITH n AS (SELECT n_nationkey, lower(n_name) AS k FROM nation UNION SELECT n_nationkey, lower(substr(n_name, 1, 3)) FROM nation)
    SELECT q.k AS asked, n_nationkey FROM (SELECT unnest(['ger', 'france', 'chi', 'nowhere', 'nation_3', 'nat']) AS k) q JOIN n USING (k)""",
)
def c10(t: Tables) -> DataFrame:
    named = t.nation.withColumn("aliases", F.array(F.substring("n_name", 1, 3)))
    asked = t.spark.createDataFrame([(x,) for x in ("ger", "france", "chi", "nowhere", "nation_3", "nat")], "asked string")
    names = joins.names_with_aliases(named, "n_nationkey", "n_name", "aliases")
    return asked.join(names, F.col("asked") == F.col("name_key")).select("asked", "n_nationkey")


_TERMS = ["mit license", "all rights reserved", "apache license", "password"]


@query(
    "c11_containment_join",
    "WITH d AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9./-]+'), ' ') || ' ' AS s FROM documents) "
    + " UNION ALL ".join(f"SELECT doc_id, '{x}' AS term FROM d WHERE contains(s, ' {x} ')" for x in _TERMS),
)
def c11(t: Tables) -> DataFrame:
    terms = t.spark.createDataFrame([(x,) for x in _TERMS], "term string")
    return joins.containing(t.documents, "doc_id", "text", terms, "term")


@query("c12_soft_containment", "SELECT DISTINCT a.p_name AS left_name, b.p_name AS right_name FROM (SELECT DISTINCT p_name FROM part) a, (SELECT DISTINCT string_split(p_name, ' ')[1] AS p_name FROM part) b WHERE list_contains(string_split(a.p_name, ' '), b.p_name)")
def c12(t: Tables) -> DataFrame:
    names = t.part.select(F.col("p_name").alias("left_name")).distinct()
    heads = t.part.select(F.element_at(F.split("p_name", " "), 1).alias("right_name")).distinct()
    return joins.containing(names, "left_name", "left_name", heads, "right_name")


@query(
    "c13_proximity_join",
    """SELECT a.event_id AS error_id, b.event_id AS click_id FROM (SELECT event_id, user_id, CAST(epoch(date_trunc('minute', ts)) / 60 AS BIGINT) AS m FROM events WHERE event_type = 'error') a
    JOIN (SELECT event_id, user_id, CAST(epoch(date_trunc('minute', ts)) / 60 AS BIGINT) AS m FROM events WHERE event_type = 'click') b ON a.user_id = b.user_id AND abs(a.m - b.m) <= 30""",
)
def c13(t: Tables) -> DataFrame:
    minute = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 60)
    rows = t.events.select("event_id", "user_id", "event_type", minute.alias("m"))
    errors = rows.filter("event_type = 'error'").select(F.col("event_id").alias("error_id"), "user_id", F.col("m").alias("m1"))
    clicks = rows.filter("event_type = 'click'").select(F.col("event_id").alias("click_id"), "user_id", F.col("m").alias("m2"))
    return joins.proximity(errors, clicks, "user_id", "m1", "m2", 30).select("error_id", "click_id")


@query(
    "c14_nearest_join",
    """SELECT e.event_id, (SELECT p.event_id FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' ORDER BY abs(p.event_id - e.event_id), p.event_id LIMIT 1) AS purchase_id
    FROM events e WHERE e.event_type = 'signup'""",
)
def c14(t: Tables) -> DataFrame:
    signups = t.events.filter("event_type = 'signup'").select("event_id", "user_id")
    bought = t.events.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("p_id"))
    return joins.nearest(signups, bought, "user_id", "event_id", "p_id", "p_id", "purchase_id").select("event_id", "purchase_id")


@query(
    "c15_as_of_previous_run",
    "SELECT run_id, lag(run_id) OVER (PARTITION BY suite_id ORDER BY started_at, run_id) AS previous_run_id FROM v_runs",
)
def c15(t: Tables) -> DataFrame:
    at = F.struct(F.col("started_at").isNull(), "started_at", "run_id").alias("at")  # of runs that start together the smaller one is earlier; those without a start come last
    runs = t.v_runs.select("run_id", "suite_id", at)
    return joins.as_of(runs, runs, "suite_id", "at", "at", "run_id", "previous_run_id", strict=True).select("run_id", "previous_run_id")


@query(
    "c15_as_of_join",
    """SELECT e.event_id, p.event_id AS last_purchase FROM (SELECT * FROM events WHERE event_type = 'error') e
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts""",
)
def c15b(t: Tables) -> DataFrame:
    errors = t.events.filter("event_type = 'error'").select("event_id", "user_id", "ts")
    bought = t.events.filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("p_ts"), F.col("event_id").alias("p_id"))
    return joins.as_of(errors, bought, "user_id", "ts", "p_ts", "p_id", "last_purchase").select("event_id", "last_purchase")


@query("c16_set_overlap_join", "WITH x AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) SELECT a.l_orderkey AS a, b.l_orderkey AS b, count(*) AS shared FROM x a JOIN x b ON a.l_partkey = b.l_partkey AND a.l_orderkey < b.l_orderkey GROUP BY 1, 2")
def c16(t: Tables) -> DataFrame:
    return joins.overlapping(t.lineitem, "l_orderkey", "l_partkey")


@query("c17_lookup_join", "SELECT n_name, r_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def c17(t: Tables) -> DataFrame:
    per = t.customer.groupBy("c_nationkey").agg(F.count("*").alias("customers"))  # aggregated before the lookups
    return per.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name", "customers")


_COMPARE = """WITH a AS (SELECT case_id, max(passed) AS p FROM v_runs WHERE code_version = 'v0' AND suite_id <> 'error' GROUP BY 1), b AS (SELECT case_id, max(passed) AS p FROM v_runs WHERE suite_id = 'purchase' GROUP BY 1)
SELECT coalesce(a.case_id, b.case_id) AS case_id, a.p AS old_value, b.p AS new_value,
  CASE WHEN a.case_id IS NULL THEN 'added' WHEN b.case_id IS NULL THEN 'removed' WHEN a.p = b.p THEN 'unchanged' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.case_id = b.case_id"""


@query("c18_full_outer_compare", _COMPARE)
def c18(t: Tables) -> DataFrame:
    old = t.v_runs.filter("code_version = 'v0' and suite_id <> 'error'").groupBy("case_id").agg(F.max("passed").alias("p"))
    new = t.v_runs.filter("suite_id = 'purchase'").groupBy("case_id").agg(F.max("passed").alias("p"))
    return joins.compared(old, new, "case_id", "p")


@query(
    "c19_two_hop_names",
    "SELECT DISTINCT a.canonical_name AS customer, c.canonical_name AS region FROM v_edges x JOIN v_edges y ON x.dst = y.src JOIN v_entities a ON a.entity_id = x.src JOIN v_entities c ON c.entity_id = y.dst WHERE x.relation = 'located_in' AND y.relation = 'part_of'",
)
def c19(t: Tables) -> DataFrame:
    e, names = t.v_edges, t.v_entities
    x = e.filter("relation = 'located_in'").select("src", F.col("dst").alias("mid"))
    y = e.filter("relation = 'part_of'").select(F.col("src").alias("mid"), "dst")
    hop = x.join(y, "mid").select("src", "dst")
    a = names.select(F.col("entity_id").alias("src"), F.col("canonical_name").alias("customer"))
    b = names.select(F.col("entity_id").alias("dst"), F.col("canonical_name").alias("region"))
    return hop.join(a, "src").join(b, "dst").select("customer", "region").distinct()


@query("c20_bridge_distinct_count", "SELECT c_mktsegment, count(DISTINCT l_partkey) AS parts FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def c20(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", "o_custkey").join(t.customer.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return t.lineitem.select("l_orderkey", "l_partkey").join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("c_mktsegment").agg(F.countDistinct("l_partkey").alias("parts"))
