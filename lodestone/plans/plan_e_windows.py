"""E: window-style operators; F: sorts and limits; G: set operations."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import text as T
from lodestone.operators import folds, ranking, sets
from lodestone.plans.registry import query
from lodestone.plans.views import Tables


@query("e01_keep_best", "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS n FROM events) WHERE n = 1")
def e01(t: Tables) -> DataFrame:
    return ranking.keep_best(t.events, ["user_id", "event_type"], F.desc("value"), "event_id").select("user_id", "event_type", "event_id", "value")


@query("e02_merge_channels", "SELECT user_id, max(value) AS value, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS channels, max_by(event_id, value) AS event_id FROM events GROUP BY 1")
def e02(t: Tables) -> DataFrame:
    return ranking.merge_hits(t.events, ["user_id"], "value", "event_type", ["event_id"])


@query(
    "e03_injection_merge",
    """WITH u AS (SELECT p_partkey, p_retailprice / 1000 AS score, 0 AS forced FROM part UNION ALL SELECT p_partkey, 5.0, 1 FROM part WHERE p_brand = 'Brand#5')
    SELECT p_partkey, max(score) AS score FROM u GROUP BY 1 ORDER BY score DESC, p_partkey LIMIT 120""",
)
def e03(t: Tables) -> DataFrame:
    hits = t.part.select("p_partkey", (F.col("p_retailprice") / 1000).alias("score"))
    forced = t.part.filter("p_brand = 'Brand#5'").select("p_partkey", F.lit(5.0).alias("score"))
    return ranking.inject(hits, forced, ["p_partkey"], "score").orderBy(F.desc("score"), "p_partkey").limit(120)


@query(
    "e04_best_view_and_chain",
    "SELECT l_orderkey, arg_max(l_linenumber, l_quantity * 100 - l_linenumber) AS best, string_agg(CAST(l_linenumber AS VARCHAR), '>' ORDER BY l_quantity DESC, l_linenumber) AS chain FROM (SELECT DISTINCT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2) GROUP BY 1",
)
def e04(t: Tables) -> DataFrame:
    lines = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"))
    chain = F.array_sort(F.collect_list(F.struct((-F.col("q")).alias("q"), "l_linenumber")))
    return lines.groupBy("l_orderkey").agg(chain.alias("c")).select("l_orderkey", F.col("c")[0]["l_linenumber"].alias("best"), F.array_join(F.transform("c", lambda x: x["l_linenumber"].cast("string")), ">").alias("chain"))


@query("e05_latest_row", "SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def e05(t: Tables) -> DataFrame:
    return ranking.keep_best(t.orders, ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey", "o_orderdate")


@query(
    "e06_first_with_ambiguity",
    "SELECT p_brand, p_partkey, c > 1 AS ambiguous FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS n, count(*) OVER (PARTITION BY p_brand, p_size) AS c FROM part) WHERE n = 1",
)
def e06(t: Tables) -> DataFrame:
    w = Window.partitionBy("p_brand", "p_size")
    first = ranking.keep_best(t.part.withColumn("c", F.count("*").over(w)), ["p_brand"], "p_size", "p_partkey")
    return first.select("p_brand", "p_partkey", (F.col("c") > 1).alias("ambiguous"))


_CHAIN = """WITH chain AS (
  SELECT concat('C', CAST(c_custkey AS VARCHAR)) AS leaf, concat('C', CAST(c_custkey AS VARCHAR)) AS profile_id FROM customer
  UNION ALL SELECT concat('C', CAST(c_custkey AS VARCHAR)), concat('N', CAST(c_nationkey AS VARCHAR)) FROM customer
  UNION ALL SELECT concat('C', CAST(c_custkey AS VARCHAR)), concat('R', CAST(n_regionkey AS VARCHAR)) FROM customer JOIN nation ON c_nationkey = n_nationkey),
x AS (SELECT leaf, priority, value_numeric FROM chain JOIN v_limits USING (profile_id))
SELECT leaf, min(value_numeric) AS effective, arg_max(value_numeric, priority) AS nearest, arg_max(value_numeric, priority) > min(value_numeric) AS conflict FROM x GROUP BY leaf"""


@query("e07_layer_fold", _CHAIN)
def e07(t: Tables) -> DataFrame:
    return folds.effective_limits(folds.layers_of(t.customer, t.nation), t.v_limits)


@query("e08_latest_versions", "WITH v AS (SELECT code_version, max(started_at) AS latest FROM v_runs GROUP BY 1) SELECT code_version, latest FROM v ORDER BY latest DESC LIMIT 2")
def e08(t: Tables) -> DataFrame:
    return t.v_runs.groupBy("code_version").agg(F.max("started_at").alias("latest")).orderBy(F.desc("latest"), "code_version").limit(2)


@query("e09_quota_sampling", "SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM (SELECT lang, min(doc_id) AS doc_id FROM documents GROUP BY lang, md5(text))) WHERE n <= 12")
def e09(t: Tables) -> DataFrame:
    firsts = t.documents.groupBy("lang", F.md5("text").alias("print")).agg(F.min("doc_id").alias("doc_id"))
    return ranking.top_per_group(firsts, ["lang"], 12, "doc_id").select("lang", "doc_id")


@query("e10_round_robin", "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) ORDER BY n, source LIMIT 55")
def e10(t: Tables) -> DataFrame:
    return ranking.round_robin(t.documents.select("doc_id", "source"), "source", ["doc_id"], 55).select("doc_id", "source")


@query("e11_shards", "SELECT o_orderkey, CAST(ntile(7) OVER (ORDER BY o_orderkey) AS INTEGER) AS shard FROM orders")
def e11(t: Tables) -> DataFrame:
    return ranking.shards(t.orders.select("o_orderkey"), 7, "o_orderkey")


@query("e12_diversify", "SELECT p_partkey, p_type, CAST(row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) > 1 AS INTEGER) AS rest FROM part")
def e12(t: Tables) -> DataFrame:
    return ranking.diversify(t.part.select("p_partkey", "p_type"), "p_type", "p_partkey").withColumnRenamed("__rest", "rest")


@query("e13_gap_dedup", "SELECT p_type, p_name, min(p_partkey) AS p_partkey FROM part GROUP BY 1, 2")
def e13(t: Tables) -> DataFrame:
    return ranking.keep_best(t.part.withColumn("label", T.normalise("p_name")), ["p_type", "label"], "p_partkey").select("p_type", "p_name", "p_partkey")


_CARRY = """SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading_turn FROM conversations"""


@query("e14_carry_forward", _CARRY)
def e14(t: Tables) -> DataFrame:
    return ranking.carried(t.conversations, "conv_id", ["turn"], F.when(F.col("role") == "user", F.col("turn")), "heading_turn").select("conv_id", "turn", "heading_turn")


@query("e15_fill_down", "SELECT event_id, last_value(CASE WHEN value > 100 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM events")
def e15(t: Tables) -> DataFrame:
    return ranking.carried(t.events, "user_id", ["ts", "event_id"], F.when(F.col("value") > 100, F.col("value")), "filled").select("event_id", "filled")


@query("e16_look_ahead", "SELECT conv_id, turn, lead(role) OVER w AS next_role, lead(length(text)) OVER w AS next_length FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def e16(t: Tables) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    return t.conversations.select("conv_id", "turn", F.lead("role").over(w).alias("next_role"), F.lead(F.length("text")).over(w).cast("long").alias("next_length"))


@query("e17_look_behind", "SELECT conv_id, turn, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS previous_role FROM conversations")
def e17(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")).alias("previous_role"))


@query("e18_continuity", "SELECT conv_id, round(avg(CASE WHEN role <> p THEN 1.0 ELSE 0.0 END), 6) AS alternation FROM (SELECT conv_id, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations) WHERE p IS NOT NULL GROUP BY 1")
def e18(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id", "role", F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")).alias("p")).filter("p is not null")
    return rows.groupBy("conv_id").agg(F.round(F.avg(F.when(F.col("role") != F.col("p"), 1.0).otherwise(0.0)), 6).alias("alternation"))


@query("e19_first_match_rank", "SELECT doc_id, min(line_no) AS rank FROM v_evidence WHERE contains(lower(normalized_text), 'license') GROUP BY 1")
def e19(t: Tables) -> DataFrame:
    return t.v_evidence.filter(F.contains(F.lower("normalized_text"), F.lit("license"))).groupBy("doc_id").agg(F.min("line_no").alias("rank"))


@query("e21_sample_per_class", "SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events) WHERE n <= 10")
def e21(t: Tables) -> DataFrame:
    return ranking.top_per_group(t.events, ["event_type"], 10, "event_id").select("event_type", "event_id")


@query("e22_parameter_dedup", "SELECT p_brand, p_size, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_retailprice DESC, p_partkey) AS n FROM part) WHERE n = 1")
def e22(t: Tables) -> DataFrame:
    return ranking.keep_best(t.part, ["p_brand", "p_size"], F.desc("p_retailprice"), "p_partkey").select("p_brand", "p_size", "p_partkey", "p_retailprice")


@query("e23_fill_missing", "SELECT o_custkey, arg_min(CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus END, o_orderkey) FILTER (o_orderstatus <> 'F') AS status FROM orders GROUP BY 1")
def e23(t: Tables) -> DataFrame:
    rows = t.orders.select("o_custkey", "o_orderkey", F.nullif("o_orderstatus", F.lit("F")).alias("status"))
    return ranking.fill_from_later(rows, ["o_custkey"], "o_orderkey", ["status"])


@query("e24_promote_first", "SELECT p_partkey, p_brand, CAST(n > 1 AS INTEGER) AS rest FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part) ORDER BY rest, p_partkey LIMIT 60")
def e24(t: Tables) -> DataFrame:
    rows = ranking.diversify(t.part.select("p_partkey", "p_brand"), "p_brand", "p_partkey").withColumnRenamed("__rest", "rest")
    return rows.orderBy("rest", "p_partkey").limit(60)


# ---- F -----------------------------------------------------------------------------------------


@query("f01_mixed_order_limit", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority ASC, o_totalprice DESC, o_orderkey LIMIT 25")
def f01(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice").orderBy("o_orderpriority", F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("f02_case_precedence", "SELECT event_id, event_type FROM events ORDER BY CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'error' THEN 3 ELSE 4 END, value DESC, event_id LIMIT 30")
def f02(t: Tables) -> DataFrame:
    return t.events.orderBy(T.rank_of("event_type", ["purchase", "signup", "error"]), F.desc("value"), "event_id").limit(30).select("event_id", "event_type")


@query("f03_boolean_order", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY (o_orderstatus = 'P') DESC, o_orderkey LIMIT 20")
def f03(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_orderstatus").orderBy((F.col("o_orderstatus") == "P").desc(), "o_orderkey").limit(20)


@query("f04_score_then_page", "SELECT p_partkey, p_size, p_retailprice FROM part ORDER BY p_retailprice DESC, p_size, p_partkey LIMIT 15")
def f04(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", "p_size", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_size", "p_partkey").limit(15)


@query("f05_overfetch_rerank", "SELECT p_partkey, p_size FROM (SELECT * FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 80) ORDER BY p_size DESC, p_partkey LIMIT 20")
def f05(t: Tables) -> DataFrame:
    return t.part.orderBy(F.desc("p_retailprice"), "p_partkey").limit(20 * 4).orderBy(F.desc("p_size"), "p_partkey").limit(20).select("p_partkey", "p_size")


@query("f06_bounded_scan", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 600")
def f06(t: Tables) -> DataFrame:
    return t.events.select("event_id", "value").orderBy(F.desc("value"), "event_id").limit(600)


@query("f07_envelope_slices", "SELECT user_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY value DESC, event_id) AS top FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM events) WHERE n <= 3 GROUP BY 1")
def f07(t: Tables) -> DataFrame:
    top = ranking.top_per_group(t.events.select("user_id", "value", "event_id"), ["user_id"], 3, F.desc("value"), "event_id")
    rows = F.array_sort(F.collect_list(F.struct((-F.col("value")).alias("v"), "event_id")))
    return top.groupBy("user_id").agg(F.array_join(F.transform(rows, lambda x: x["event_id"].cast("string")), ",").alias("top"))


@query("f08_offset_limit", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 40 OFFSET 100")
def f08(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey").orderBy("o_orderkey").offset(100).limit(40)


# ---- G -----------------------------------------------------------------------------------------


@query("g01_union_hits", "SELECT 'part' AS kind, p_name AS title, p_retailprice AS score FROM part UNION ALL SELECT 'customer', c_name, c_acctbal FROM customer UNION ALL SELECT 'supplier', s_name, s_acctbal FROM supplier")
def g01(t: Tables) -> DataFrame:
    return sets.hits({"part": (t.part, "p_name", "p_retailprice"), "customer": (t.customer, "c_name", "c_acctbal"), "supplier": (t.supplier, "s_name", "s_acctbal")})


@query("g03_shared_items", "SELECT o_custkey, count(DISTINCT o_orderpriority) AS shared FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') GROUP BY 1")
def g03(t: Tables) -> DataFrame:
    mine = t.orders.groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("p"))
    wanted = F.array(F.lit("1-URGENT"), F.lit("5-LOW"))
    return mine.select("o_custkey", F.size(F.array_intersect("p", wanted)).cast("long").alias("shared")).filter("shared > 0")


@query("g04_set_difference", "SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders")
def g04(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("id")).subtract(t.orders.select(F.col("o_custkey").alias("id")))


@query("g05_ordered_union", "SELECT p_partkey, CASE WHEN p_type = p_brand THEN p_type ELSE p_type || ',' || p_brand END AS terms FROM part")
def g05(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.array_join(sets.ordered_union(F.array("p_type"), F.array("p_brand", "p_type")), ",").alias("terms"))


@query("g07_subset_test", "SELECT o_custkey, bool_and(o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW')) AS all_known FROM orders GROUP BY 1")
def g07(t: Tables) -> DataFrame:
    mine = t.orders.groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("p"))
    known = F.array(*map(F.lit, ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")))
    return mine.select("o_custkey", sets.is_subset("p", known).alias("all_known"))


@query("g08_bidirectional", "SELECT src AS node, relation, dst AS other, 'out' AS direction FROM v_edges UNION ALL SELECT dst, relation, src, 'in' FROM v_edges")
def g08(t: Tables) -> DataFrame:
    return sets.both_ways(t.v_edges)


@query("g09_intersect", "SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_suppkey FROM lineitem WHERE l_linestatus = 'O'")
def g09(t: Tables) -> DataFrame:
    return t.lineitem.filter("l_returnflag = 'R'").select("l_suppkey").intersect(t.lineitem.filter("l_linestatus = 'O'").select("l_suppkey"))
