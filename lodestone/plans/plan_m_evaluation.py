"""M: evaluation and closed loop; P: DML and maintenance; N4: freshness."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import text as T
from lodestone.operators import evaluation as E
from lodestone.operators import maintenance as M
from lodestone.plans.registry import query
from lodestone.plans.views import Tables


_ANCHORS = "(VALUES ('general public license', 'must', 'g'), ('mail', 'must', 'm'), ('password', 'negative', 'p'))"


M01_SQL = rf"""WITH h AS (SELECT doc_id AS case_id, line_no AS rank, lower(regexp_replace(normalized_text, '\s+', '', 'g')) AS text FROM v_evidence),
    a AS (SELECT DISTINCT case_id, anchor, kind FROM h, {_ANCHORS} x(anchor, kind, k)),
    r AS (SELECT a.case_id, a.anchor, a.kind, min(h.rank) FILTER (contains(h.text, replace(a.anchor, ' ', '')) OR (kind = 'must' AND contains(anchor, ' ') AND list_bool_and(list_transform(string_split(anchor, ' '), lambda t: contains(h.text, t))))) AS rank FROM a JOIN h ON a.case_id = h.case_id GROUP BY 1, 2, 3),
    q AS (SELECT case_id, count(*) FILTER (kind = 'must') AS must, count(*) FILTER (kind = 'must' AND rank IS NOT NULL) AS found, min(rank) FILTER (kind = 'must') AS best_rank,
      count(*) FILTER (kind = 'must' AND rank <= 5) AS k5, count(*) FILTER (kind = 'must' AND rank <= 10) AS k10, count(*) FILTER (kind = 'negative' AND rank IS NOT NULL) AS negatives FROM r GROUP BY 1)
    SELECT case_id, must, found, best_rank, round(k5 / must, 6) AS recall_at_5, round(k10 / must, 6) AS recall_at_10, round(coalesce(1 / best_rank, 0), 6) AS mrr, negatives,
      CASE WHEN negatives > 0 THEN 'negative_hit' WHEN found = 0 THEN 'retrieval_miss' WHEN best_rank > 5 THEN 'rank_too_low' WHEN round(k5 / must, 6) < 0.8 THEN 'recall_at_5_below_threshold' ELSE 'ok' END AS attribution FROM q"""


@query("m01_retrieval_quality", M01_SQL)
def m01(t: Tables) -> DataFrame:
    hits = t.v_evidence.select(F.col("doc_id").alias("case_id"), F.col("line_no").alias("rank"), F.col("normalized_text").alias("text"))
    anchors = F.array(*(F.struct(F.lit(a).alias("anchor"), F.lit(k).alias("kind")) for a, k in (("general public license", "must"), ("mail", "must"), ("password", "negative"))))
    return E.retrieval_quality(hits, hits.select("case_id").distinct().select("case_id", F.inline(anchors)))


_ANSWERED = "SELECT conv_id, turn, role, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS asked, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS asker FROM conversations"


def _tokens_sql(c: str) -> str:
    return rf"list_distinct(list_concat(regexp_extract_all({c}, '\d+\.?\d*\s*[A-Za-zΩμ°℃％%]+'), list_filter(string_split(lower(regexp_replace({c}, '[^\p{{L}}\p{{N}}]', '', 'g')), ''), lambda x: x <> '')))"


@query(
    "m04_token_overlap",
    f"""WITH a AS ({_ANSWERED}), p AS (SELECT conv_id, turn, text, {_tokens_sql('asked')} AS points, {_tokens_sql('text')} AS said FROM a WHERE role = 'assistant' AND asker = 'user'),
    s AS (SELECT conv_id, turn, CASE WHEN trim(text) = '' OR regexp_matches(text, 'insufficient evidence|not found|未找到|无法回答|无法给出|当前候选证据不足以给出确定性答案') OR len(points) = 0 THEN 0 ELSE round(len(list_intersect(said, points)) / len(points), 6) END AS coverage FROM p)
    SELECT conv_id, turn, CAST(coverage AS DOUBLE) AS coverage, coverage >= 0.3 AS passed FROM s""",
)
def m04(t: Tables) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = t.conversations.select("conv_id", "turn", "role", "text", F.lag("text").over(w).alias("asked"), F.lag("role").over(w).alias("asker"))
    rows = turns.filter("role = 'assistant' and asker = 'user'").select("conv_id", "turn", E.coverage("text", F.array("asked")).alias("coverage"))
    return rows.withColumn("passed", F.col("coverage") >= 0.3)


@query(
    "m08_metric_deltas",
    """WITH d AS (SELECT suite_id, CAST(started_at AS DATE) AS day, round(avg(passed), 6) AS pass_rate FROM v_runs GROUP BY 1, 2)
    SELECT suite_id, day, pass_rate, round(pass_rate - lag(pass_rate) OVER (PARTITION BY suite_id ORDER BY day), 6) AS pass_rate_delta FROM d""",
)
def m08(t: Tables) -> DataFrame:
    daily = t.v_runs.groupBy("suite_id", F.col("started_at").cast("date").alias("day")).agg(F.round(F.avg("passed"), 6).alias("pass_rate"))
    return E.run_deltas(daily, "suite_id", "day", ["pass_rate"])


@query(
    "m11_golden_sync",
    """WITH s AS (SELECT p_partkey AS case_id, p_brand AS v FROM part WHERE p_size < 30), i AS (SELECT p_partkey AS case_id, CASE WHEN p_size = 20 THEN 'new' ELSE p_brand END AS v FROM part WHERE p_size >= 20)
    SELECT coalesce(i.case_id, s.case_id) AS case_id, coalesce(i.v, s.v) AS v, CASE WHEN i.case_id IS NULL THEN 'deprecated' WHEN s.case_id IS NULL THEN 'added' WHEN s.v = i.v THEN 'active' ELSE 'updated' END AS status FROM s FULL JOIN i ON s.case_id = i.case_id""",
)
def m11(t: Tables) -> DataFrame:
    stored = t.part.filter("p_size < 30").select(F.col("p_partkey").alias("case_id"), F.col("p_brand").alias("v"))
    new = t.part.filter("p_size >= 20").select(F.col("p_partkey").alias("case_id"), F.when(F.col("p_size") == 20, "new").otherwise(F.col("p_brand")).alias("v"))
    return E.merge_golden(stored, new, "case_id", "v")


@query(
    "m22_draft_readiness",
    """WITH s AS (SELECT doc_id, quality, greatest(0, 100 - CASE WHEN n_chars < 200 THEN 30 ELSE 0 END - CASE WHEN lang <> 'en' THEN 20 ELSE 0 END - CASE WHEN quality IS NULL THEN 10 ELSE 0 END) AS score FROM documents LEFT JOIN labels USING (doc_id))
    SELECT doc_id, CAST(score AS INTEGER) AS score, CASE WHEN quality = 0 THEN 'reject' WHEN score >= 85 THEN 'promotable' WHEN score >= 60 THEN 'ready_for_validation' ELSE 'needs_review' END AS status FROM s""",
)
def m22(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "n_chars", "lang").join(t.labels, "doc_id", "left")
    penalties = {"short": (F.col("n_chars") < 200, 30), "language": (F.col("lang") != "en", 20), "unlabelled": (F.col("quality").isNull(), 10)}
    score, status = E.readiness(penalties, F.coalesce(F.col("quality") == 0, F.lit(False)))
    return rows.select("doc_id", score.alias("score"), status.alias("status"))


# ---- N, P --------------------------------------------------------------------------------------


@query(
    "n04_freshness",
    "SELECT CASE WHEN m + o > 0 THEN 'stale' ELSE 'fresh' END AS status, m AS missing, o AS orphan FROM (SELECT (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS m, (SELECT count(DISTINCT doc_id) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS o)",
)
def n04(t: Tables) -> DataFrame:
    return M.freshness(t.documents, t.labels, "doc_id")


@query(
    "n07_event_windows",
    "SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
)
def n07(t: Tables) -> DataFrame:
    from lodestone.streaming.windows import tumbling

    return tumbling(t.events, "ts", "6 hours", "event_type", "value")


@query(
    "n07_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""",
)
def n07b(t: Tables) -> DataFrame:
    from lodestone.streaming.windows import sessions

    return sessions(t.events, "ts", "2 hours", "user_id")


@query("p01_upsert", "SELECT c_custkey, c_name, coalesce(n, c_acctbal) AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) ON o_custkey = c_custkey UNION ALL SELECT 900000000, 'new', 1.0")
def p01(t: Tables) -> DataFrame:
    target = t.customer.select("c_custkey", "c_name", "c_acctbal")
    new = t.orders.filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.lit(None).cast("string").alias("c_name"), F.max("o_totalprice").alias("c_acctbal"))
    one = t.spark.createDataFrame([(900000000, "new", 1.0)], "c_custkey long, c_name string, c_acctbal double")
    return M.upsert(target, new.unionByName(one), "c_custkey")


@query("p02_insert_or_ignore", "SELECT s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def p02(t: Tables) -> DataFrame:
    a = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return M.insert_new(a, t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), "id")


@query("p03_replace_groups", "SELECT doc_id, lang, source FROM documents WHERE lang <> 'fr' UNION ALL SELECT doc_id, lang, 'rebuilt' FROM documents WHERE lang = 'fr' AND n_chars > 500")
def p03(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "lang", "source")
    rebuilt = t.documents.filter("lang = 'fr' and n_chars > 500").select("doc_id", "lang", F.lit("rebuilt").alias("source"))
    return M.replace_groups(d, rebuilt, "lang")


@query("p06_run_pruning", "WITH v AS (SELECT code_version FROM v_runs GROUP BY 1 ORDER BY max(started_at) DESC LIMIT 2) SELECT code_version IN (SELECT code_version FROM v) AS keep, count(*) AS n FROM v_runs GROUP BY 1")
def p06(t: Tables) -> DataFrame:
    return M.prune(t.v_runs, "code_version", "started_at", 2).groupBy("keep").agg(F.count("*").alias("n"))


@query(
    "p07_doctor",
    "SELECT * FROM (SELECT 'unlabelled documents' AS issue, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'negative balance', count(*) FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'empty page', count(*) FROM pages WHERE html = '') WHERE n > 0",
)
def p07(t: Tables) -> DataFrame:
    return M.checks({"unlabelled documents": t.documents.join(t.labels.select("doc_id"), "doc_id", "left_anti"), "negative balance": t.customer.filter("c_acctbal < 0"), "empty page": t.pages.filter("html = ''")})


@query("p08_governance_plan", "SELECT event_type, CASE event_type WHEN 'error' THEN 'manual' WHEN 'signup' THEN 'confirm' ELSE 'auto' END AS plan, count(*) AS n FROM events GROUP BY 1, 2")
def p08(t: Tables) -> DataFrame:
    plan = F.coalesce(T.literal_map({"error": "manual", "signup": "confirm"})[F.col("event_type")], F.lit("auto"))
    return t.events.groupBy("event_type", plan.alias("plan")).agg(F.count("*").alias("n"))


@query("p10_missing_types", "SELECT user_id, count(DISTINCT event_type) FILTER (event_type IN ('signup', 'purchase', 'error')) AS present FROM events GROUP BY 1 HAVING count(DISTINCT event_type) FILTER (event_type IN ('signup', 'purchase', 'error')) < 3")
def p10(t: Tables) -> DataFrame:
    wanted = F.array(*map(F.lit, ("signup", "purchase", "error")))
    per = t.events.groupBy("user_id").agg(F.collect_set("event_type").alias("s"))
    return per.select("user_id", F.size(F.array_intersect("s", wanted)).cast("long").alias("present")).filter("present < 3")


@query("p12_cascade_delete", "SELECT 'documents' AS relation, count(*) AS n FROM documents WHERE source = 'src3' UNION ALL SELECT 'labels', count(*) FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE source = 'src3')")
def p12(t: Tables) -> DataFrame:
    gone = t.documents.filter("source = 'src3'").select("doc_id")
    a = gone.agg(F.count("*").alias("n")).select(F.lit("documents").alias("relation"), "n")
    return a.unionByName(t.labels.join(gone, "doc_id", "left_semi").agg(F.count("*").alias("n")).select(F.lit("labels").alias("relation"), "n"))
