"""D: aggregations."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import aggregates as A
from lodestone.plans.registry import query
from lodestone.plans.views import Tables


@query("d01_counts", "SELECT count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (value > 100) AS large FROM events")
def d01(t: Tables) -> DataFrame:
    return t.events.agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("value") > 100).alias("large"))


@query("d02_group_counts", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL")
def d02(t: Tables) -> DataFrame:
    return A.histogram(t.lineitem, "l_returnflag", "l_linestatus")


@query("d03_hotspots", "SELECT user_id, count(*) AS n FROM events WHERE value < 20 GROUP BY 1 HAVING count(*) >= 5")
def d03(t: Tables) -> DataFrame:
    return A.histogram(t.events.filter("value < 20"), "user_id").filter("n >= 5")


@query("d04_distinct_counts", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1")
def d04(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(F.countDistinct("l_suppkey").alias("suppliers"), F.countDistinct("l_partkey").alias("parts"))


@query("d05_coverage_rates", "SELECT lang, count(*) AS n, CAST(sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS BIGINT) AS good, round(sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) / count(*), 6) AS good_rate FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def d05(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "lang").join(t.labels, "doc_id")
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), A.rate(F.col("quality") == 1).alias("good_rate"))


@query("d06_sum_or_zero", "SELECT coalesce(sum(value), 0) AS total FROM events WHERE event_type = 'none'")
def d06(t: Tables) -> DataFrame:
    return t.events.filter("event_type = 'none'").agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("total"))


@query("d07_joined_ids", "SELECT o_orderkey, (SELECT string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY CAST(l_linenumber AS VARCHAR)) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS lines FROM orders")
def d07(t: Tables) -> DataFrame:
    per = t.lineitem.filter("l_returnflag = 'R'").withColumn("line", F.col("l_linenumber").cast("string")).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(A.joined("line").alias("lines"))
    return t.orders.select("o_orderkey").join(per, "o_orderkey", "left")


@query("d09_scalar_max_merge", "SELECT c_custkey, greatest(coalesce(m, 0), c_acctbal) AS best FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) / 100 AS m FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def d09(t: Tables) -> DataFrame:
    top = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg((F.max("o_totalprice") / 100).alias("m"))
    return t.customer.select("c_custkey", "c_acctbal").join(top, "c_custkey", "left").select("c_custkey", F.greatest(F.coalesce("m", F.lit(0.0)), "c_acctbal").alias("best"))


@query("d10_grouping_sets", "SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY GROUPING SETS ((), (lang), (source))")
def d10(t: Tables) -> DataFrame:
    return A.levels(t.documents, [[], ["lang"], ["source"]], F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query(
    "d11_status_pivot",
    "SELECT suite_id, count(*) FILTER (code_version = 'v0') AS v0, count(*) FILTER (code_version = 'v1') AS v1, count(*) FILTER (code_version = 'v2') AS v2 FROM v_runs GROUP BY 1",
)
def d11(t: Tables) -> DataFrame:
    return t.v_runs.groupBy("suite_id").pivot("code_version", ["v0", "v1", "v2"]).agg(F.count("run_id")).fillna(0)


@query(
    "d12_page_rollup",
    """WITH p AS (SELECT source, CASE WHEN n_chars < 200 THEN 'high' WHEN n_chars < 1000 THEN 'medium' ELSE 'low' END AS risk FROM documents)
    SELECT source, count(*) AS pages, count(*) FILTER (risk = 'high') AS high, count(*) FILTER (risk = 'medium') AS medium,
    round(greatest(0, least(1, 1 - 0.5 * count(*) FILTER (risk = 'high') / count(*) - 0.2 * count(*) FILTER (risk = 'medium') / count(*))), 4) AS score FROM p GROUP BY 1""",
)
def d12(t: Tables) -> DataFrame:
    risk = F.when(F.col("n_chars") < 200, "high").when(F.col("n_chars") < 1000, "medium").otherwise("low")
    per = t.documents.select("source", risk.alias("risk")).groupBy("source").agg(F.count("*").alias("pages"), F.count_if(F.col("risk") == "high").alias("high"), F.count_if(F.col("risk") == "medium").alias("medium"))
    return per.withColumn("score", F.round(T.clamp(1 - 0.5 * F.col("high") / F.col("pages") - 0.2 * F.col("medium") / F.col("pages")), 4))


@query(
    "d13_weighted_gate",
    """WITH m AS (SELECT lang, avg(CAST(quality AS DOUBLE)) AS a, avg(1 - CAST(toxic AS DOUBLE)) AS b, least(count(*) / 100.0, 1) AS c, 0.5 AS d FROM documents JOIN labels USING (doc_id) GROUP BY 1)
    SELECT lang, round(0.30 * a + 0.25 * b + 0.25 * c + 0.20 * d, 4) AS score, CASE WHEN 0.30 * a + 0.25 * b + 0.25 * c + 0.20 * d >= 0.8 THEN 'pass' WHEN 0.30 * a + 0.25 * b + 0.25 * c + 0.20 * d >= 0.6 THEN 'warn' ELSE 'fail' END AS gate FROM m""",
)
def d13(t: Tables) -> DataFrame:
    m = t.documents.select("doc_id", "lang").join(t.labels, "doc_id").groupBy("lang")
    m = m.agg(F.avg("quality").alias("a"), F.avg(1 - F.col("toxic")).alias("b"), F.least(F.count("*") / 100, F.lit(1.0)).alias("c")).withColumn("d", F.lit(0.5))
    score = A.weighted({"a": 0.30, "b": 0.25, "c": 0.25, "d": 0.20})
    return m.select("lang", F.round(score, 4).alias("score"), A.gate(score, [(0.8, "pass"), (0.6, "warn")], "fail").alias("gate"))


@query(
    "d14_answerability",
    """WITH o AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), l AS (SELECT o_custkey AS k, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)
    SELECT c_custkey, round(0.45 * CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END + 0.30 * least(coalesce(o.n, 0) / 10.0, 1) + 0.25 * least(coalesce(l.n, 0) / 40.0, 1), 3) AS score
    FROM customer LEFT JOIN o ON o.k = c_custkey LEFT JOIN l ON l.k = c_custkey""",
)
def d14(t: Tables) -> DataFrame:
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_lines"))
    per = t.orders.join(lines, "o_orderkey", "left").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("o"), F.sum("n_lines").alias("l"))
    cap = lambda c, n: F.least(F.coalesce(c, F.lit(0)) / n, F.lit(1.0))
    score = 0.45 * F.when(F.col("c_acctbal") > 0, 1).otherwise(0) + 0.30 * cap("o", 10) + 0.25 * cap("l", 40)
    return t.customer.select("c_custkey", "c_acctbal").join(per, "c_custkey", "left").select("c_custkey", F.round(score, 3).alias("score"))


@query(
    "d15_contract_rollup",
    """WITH c AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS buys, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1)
    SELECT user_id, CASE WHEN n = 0 THEN 'inactive' WHEN buys = 0 THEN 'failed' WHEN errors > 12 THEN 'warn' ELSE 'passed' END AS status,
    concat_ws(',', CASE WHEN buys = 0 THEN 'no_purchase' END, CASE WHEN errors > 12 THEN 'many_errors' END) AS issues FROM c""",
)
def d15(t: Tables) -> DataFrame:
    c = t.events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("buys"), F.count_if(F.col("event_type") == "error").alias("errors"))
    status = F.when(F.col("buys") == 0, "failed").when(F.col("errors") > 12, "warn").otherwise("passed")
    return c.select("user_id", status.alias("status"), A.issues(no_purchase=F.col("buys") == 0, many_errors=F.col("errors") > 12).alias("issues"))


@query(
    "d16_parse_risk",
    """WITH d AS (SELECT o_orderkey, o_custkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS r FROM orders)
    SELECT CASE WHEN n = 0 THEN 'no_evidence' WHEN r = 0 THEN 'evidence_without_unit' WHEN r < n THEN 'unit_without_fact' ELSE 'fully_backed' END AS risk, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM d GROUP BY 1""",
)
def d16(t: Tables) -> DataFrame:
    per = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_lines"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    rows = t.orders.select("o_orderkey", "o_custkey").join(per, "o_orderkey", "left").fillna(0, ["n_lines", "r"])
    risk = F.when(F.col("n_lines") == 0, "no_evidence").when(F.col("r") == 0, "evidence_without_unit").when(F.col("r") < F.col("n_lines"), "unit_without_fact").otherwise("fully_backed")
    return rows.groupBy(risk.alias("risk")).agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("customers"))


@query(
    "d17_run_rollup",
    "SELECT suite_id, code_version, count(*) AS n, CAST(sum(passed) AS BIGINT) AS passed, round(avg(score), 4) AS mean_score FROM v_runs GROUP BY GROUPING SETS ((suite_id), (code_version), (suite_id, code_version))",
)
def d17(t: Tables) -> DataFrame:
    sets = [["suite_id"], ["code_version"], ["suite_id", "code_version"]]
    return A.levels(t.v_runs, sets, F.count("*").alias("n"), F.sum("passed").alias("passed"), F.round(F.avg("score"), 4).alias("mean_score"))


@query("d18_mean_of_numbers", "SELECT lang, round(coalesce(avg(TRY_CAST(substr(text, 1, 1) AS DOUBLE)), 0), 6) AS mean FROM documents GROUP BY 1")
def d18(t: Tables) -> DataFrame:
    return t.documents.withColumn("head", F.substring("text", 1, 1)).groupBy("lang").agg(A.mean_number("head").alias("mean"))


@query("d20_known_rates", "SELECT lang, count(*) AS n, count(toxic) AS known, round(count(*) FILTER (toxic = 1) / nullif(count(toxic), 0), 6) AS toxic_rate FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def d20(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left").withColumn("flag", F.col("toxic") == 1)
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.count("toxic").alias("known"), A.known_rate("flag").alias("toxic_rate"))


@query("d22_suite_summary", "SELECT suite_id, round(avg(CAST(passed AS DOUBLE)), 6) AS pass_rate, max(score) AS most, round(sum(score), 2) AS total FROM v_runs GROUP BY 1")
def d22(t: Tables) -> DataFrame:
    return t.v_runs.groupBy("suite_id").agg(F.round(F.avg("passed"), 6).alias("pass_rate"), F.max("score").alias("most"), F.round(F.sum("score"), 2).alias("total"))


@query(
    "d23_shard_merge",
    "SELECT code_version, count(*) AS n, CAST(sum(passed) AS BIGINT) AS passed, round(sum(passed) / count(*), 6) AS pass_rate FROM v_runs GROUP BY 1",
)
def d23(t: Tables) -> DataFrame:
    parts = t.v_runs.groupBy("code_version", (F.col("run_id") % 3).alias("shard")).agg(F.count("*").alias("n"), F.sum("passed").alias("passed"))
    return parts.groupBy("code_version").agg(F.sum("n").alias("n"), F.sum("passed").alias("passed")).withColumn("pass_rate", F.round(F.col("passed") / F.col("n"), 6))


@query(
    "d24_graph_health",
    "SELECT relation, count(*) AS n, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets, CASE WHEN count(*) > 1000 THEN 'strong' ELSE 'weak' END AS status FROM v_edges GROUP BY 1",
)
def d24(t: Tables) -> DataFrame:
    per = t.v_edges.groupBy("relation").agg(F.count("*").alias("n"), F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("targets"))
    return per.withColumn("status", F.when(F.col("n") > 1000, "strong").otherwise("weak"))


@query(
    "d25_priority_report",
    """WITH p AS (SELECT doc_id, CASE WHEN n_chars < 100 THEN 'short' WHEN quality = 0 THEN 'low_quality' WHEN quality IS NULL THEN 'unlabelled' ELSE 'other' END AS cause,
    (CASE WHEN n_chars < 100 THEN 30 ELSE 0 END) + (CASE WHEN quality = 0 THEN 50 ELSE 0 END) + (CASE WHEN quality IS NULL THEN 10 ELSE 0 END) AS priority FROM documents LEFT JOIN labels USING (doc_id))
    SELECT doc_id, cause, CAST(priority AS INTEGER) AS priority FROM p ORDER BY priority DESC, doc_id LIMIT 100""",
)
def d25(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id", "left")
    short, low, none = F.col("n_chars") < 100, F.col("quality") == 0, F.col("quality").isNull()
    cause = F.when(short, "short").when(low, "low_quality").when(none, "unlabelled").otherwise("other")
    points = F.when(short, 30).otherwise(0) + F.when(low, 50).otherwise(0) + F.when(none, 10).otherwise(0)
    return rows.select("doc_id", cause.alias("cause"), points.alias("priority")).orderBy(F.desc("priority"), "doc_id").limit(100)


@query(
    "d26_repair_tasks",
    """WITH f AS (SELECT case_id, suite_id AS reason, unnest(CASE WHEN score < 20 THEN ['reindex', 'review'] ELSE ['review'] END) AS action FROM v_runs WHERE passed = 0)
    SELECT reason, action, count(DISTINCT case_id) AS cases, count(*) AS impact FROM f GROUP BY 1, 2""",
)
def d26(t: Tables) -> DataFrame:
    actions = F.when(F.col("score") < 20, F.array(F.lit("reindex"), F.lit("review"))).otherwise(F.array(F.lit("review")))
    f = t.v_runs.filter("passed = 0").select("case_id", F.col("suite_id").alias("reason"), F.explode(actions).alias("action"))
    return f.groupBy("reason", "action").agg(F.countDistinct("case_id").alias("cases"), F.count("*").alias("impact"))


@query(
    "d27_task_coverage",
    """WITH failed AS (SELECT DISTINCT case_id FROM v_runs WHERE passed = 0), tasked AS (SELECT DISTINCT case_id FROM v_runs WHERE suite_id = 'purchase')
    SELECT count(*) AS failed, count(t.case_id) AS covered, round(count(t.case_id) / count(*), 6) AS share FROM failed f LEFT JOIN tasked t USING (case_id)""",
)
def d27(t: Tables) -> DataFrame:
    failed = t.v_runs.filter("passed = 0").select("case_id").distinct()
    tasked = t.v_runs.filter("suite_id = 'purchase'").select("case_id").distinct().withColumn("hit", F.lit(True))
    return failed.join(tasked, "case_id", "left").agg(F.count("*").alias("failed"), F.count("hit").alias("covered"), F.round(F.count("hit") / F.count("*"), 6).alias("share"))


_ORDER = ["P", "O", "F"]


@query("d28_dominant_status", "SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'P') THEN 'P' WHEN bool_or(o_orderstatus = 'O') THEN 'O' ELSE 'F' END AS status FROM orders GROUP BY 1")
def d28(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(A.dominant("o_orderstatus", _ORDER).alias("status"))


@query("d30_review_counters", "SELECT event_type, user_id % 4 AS severity, count(*) AS n FROM events GROUP BY GROUPING SETS ((event_type), (user_id % 4))")
def d30(t: Tables) -> DataFrame:
    rows = t.events.select("event_type", (F.col("user_id") % 4).alias("severity"))
    return A.levels(rows, [["event_type"], ["severity"]], F.count("*").alias("n"))


@query(
    "d31_release_score",
    "SELECT user_id, CAST(greatest(0, 100 - 25 * count(*) FILTER (event_type = 'error' AND value > 90) - 5 * count(*) FILTER (event_type = 'error' AND value <= 90)) AS BIGINT) AS score FROM events GROUP BY 1",
)
def d31(t: Tables) -> DataFrame:
    error = F.col("event_type") == "error"
    points = F.lit(100) - 25 * F.count_if(error & (F.col("value") > 90)) - 5 * F.count_if(error & (F.col("value") <= 90))
    return t.events.groupBy("user_id").agg(F.greatest(F.lit(0), points).cast("long").alias("score"))


@query("d33_type_histogram", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def d33(t: Tables) -> DataFrame:
    return A.histogram(t.events, "user_id", "event_type")


@query(
    "d34_line_metrics",
    "SELECT doc_id, count(*) AS lines, count(DISTINCT normalized_text) AS distinct_lines, round(1 - count(DISTINCT normalized_text) / count(*), 6) AS duplicate_ratio FROM v_evidence GROUP BY 1",
)
def d34(t: Tables) -> DataFrame:
    lines = F.filter(F.transform(F.split("text", "\n"), F.trim), lambda x: x != "")
    rows = t.documents.select("doc_id", F.size(lines).cast("long").alias("lines"), F.size(F.array_distinct(lines)).cast("long").alias("distinct_lines")).filter("lines > 0")
    return rows.withColumn("duplicate_ratio", F.round(1 - F.col("distinct_lines") / F.col("lines"), 6))


@query("d35_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def d35(t: Tables) -> DataFrame:
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("d36_grouped_lines", "SELECT p_brand, string_agg(DISTINCT p_type, '; ' ORDER BY p_type) AS types FROM part GROUP BY 1")
def d36(t: Tables) -> DataFrame:
    kinds = t.part.select("p_brand", "p_type").distinct()
    return kinds.groupBy("p_brand").agg(A.joined("p_type", "; ").alias("types"))


@query("d37_provider_means", "SELECT source, round(avg(n_chars), 4) AS mean_chars, round(avg(CAST(quality AS DOUBLE)), 4) AS mean_quality FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def d37(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "source", "n_chars").join(t.labels, "doc_id", "left")
    return rows.groupBy("source").agg(F.round(F.avg("n_chars"), 4).alias("mean_chars"), F.round(F.avg("quality"), 4).alias("mean_quality"))
