"""Queues, rebuilds, versions, publication, feedback."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import evaluation as E
from lodestone.operators import maintenance as M
from lodestone.plans.plan_h_rules import pick
from lodestone.plans.registry import query
from lodestone.plans.views import Tables
from lodestone.scratch import scratch_path
from lodestone.sources import TABLES, files


@query("a02_table_listing", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in TABLES))
def a02(t: Tables) -> DataFrame:
    return files.listing({name: getattr(t, name) for name in TABLES})


_PATH = "concat(url, " + pick("page_id", "'.PDF'", "'.md'", "'.txt'", "'.docx'", "'.xlsx'", "'.jpeg'", "'.bin'", "''") + ")"


@query("a04_source_type", "SELECT page_id, " + pick("page_id", "'pdf'", "'markdown'", "'text'", "'word'", "'excel'", "'image'", "'file'", "'file'") + " AS source_type FROM pages")
def a04(t: Tables) -> DataFrame:
    return t.pages.select("page_id", files.source_type(F.expr(_PATH)).alias("source_type"))


_UNDONE = "CASE WHEN user_id % 4 = 0 THEN 1 ELSE 0 END"


@query("n03_drain_queue", f"WITH q AS (SELECT event_id, ts, {_UNDONE} AS processed FROM events), d AS (SELECT event_id FROM q WHERE processed = 0 ORDER BY ts, event_id LIMIT 100) SELECT q.event_id, CAST(CASE WHEN d.event_id IS NULL THEN processed ELSE 1 END AS INTEGER) AS processed, d.event_id IS NOT NULL AS taken FROM q LEFT JOIN d ON q.event_id = d.event_id")
def n03(t: Tables) -> DataFrame:
    queue = t.events.selectExpr("event_id", "ts", f"{_UNDONE} AS processed")
    taken, after = M.drain(queue, 100, "ts", "event_id")
    return after.join(taken.select("event_id", F.lit(True).alias("taken")), "event_id", "left").select("event_id", "processed", F.coalesce("taken", F.lit(False)).alias("taken"))


@query(
    "n05_state_rebuild",
    """WITH f AS (SELECT count(*) FILTER (l.doc_id IS NULL) AS missing, count(*) FILTER (d.doc_id IS NULL) AS orphan, count(*) FILTER (l.doc_id IS NULL AND d.doc_id % 2 = 0) AS left_open
      FROM documents d FULL JOIN (SELECT doc_id FROM labels UNION ALL SELECT -doc_id - 1 FROM labels WHERE doc_id < 20) l ON d.doc_id = l.doc_id)
    SELECT 'coverage' AS scope, 'stale' AS before, 'fresh' AS after, missing, orphan, missing + orphan AS changed, 'done' AS status FROM f
    UNION ALL SELECT 'fts', 'stale', 'stale', missing, orphan, 0, 'planned' FROM f
    UNION ALL SELECT 'wiki', 'stale', 'stale', missing, orphan, missing - left_open, 'failed' FROM f""",
)
def n05(t: Tables) -> DataFrame:
    odd = (F.pmod("doc_id", F.lit(2)) == 1).cast("int").alias("side")
    source = t.documents.select("doc_id", odd)
    index = t.labels.select("doc_id", odd).unionByName(t.labels.filter("doc_id < 20").select((-F.col("doc_id") - 1).alias("doc_id"), F.lit(0).alias("side")))
    state = {"coverage": (source, index), "wiki": (source, index), "fts": (source, index)}
    whole, planned, part = M.rebuild(state, "doc_id", "coverage"), M.rebuild(state, "doc_id", "fts", execute=False), M.rebuild(state, "doc_id", "wiki", doc="side", docs=[1])
    return whole.unionByName(planned).unionByName(part)


_STAGES = [("view", 15), ("click", 45), ("signup", 72), ("purchase", 99)]


@query(
    "n06_progress",
    f"""WITH p AS (SELECT user_id, list_position(['view', 'click', 'signup', 'purchase'], event_type) AS k FROM events WHERE event_type IN ('view', 'click', 'signup', 'purchase')), m AS (SELECT user_id, max(k) AS k, count(DISTINCT k) AS seen FROM p GROUP BY 1)
    SELECT user_id, ['view', 'click', 'signup', 'purchase'][k] AS stage, CAST([15, 45, 72, 99][k] AS INTEGER) AS percent, seen, CASE WHEN seen < k THEN 'gap' WHEN k = 4 THEN 'done' ELSE 'running' END AS state FROM m""",
)
def n06(t: Tables) -> DataFrame:
    return M.progress(t.events, "user_id", _STAGES, "event_type", "ts")


@query("n01_job_states", "WITH l AS (SELECT user_id, arg_max(event_type, {'ts': ts, 'event_type': event_type}) AS last, count(*) FILTER (event_type = 'error') AS attempts FROM events GROUP BY 1) SELECT user_id, CASE WHEN last = 'error' AND attempts <= 2 THEN 'pending' WHEN last = 'error' THEN 'failed' ELSE last END AS status, attempts FROM l")
def n01(t: Tables) -> DataFrame:
    jobs = t.events.select("user_id", "ts", F.when(F.col("event_type") == "error", "failed").otherwise(F.col("event_type")).alias("status"))
    return M.latest_status(jobs, "user_id", "ts", "status", 2)


@query("p04_migrations", "SELECT o_orderkey AS order_id, o_orderstatus AS status, round(o_totalprice, 0) AS price, CASE WHEN o_totalprice > 100000 THEN 'large' ELSE 'small' END AS size, '2,3,5' AS applied FROM orders")
def p04(t: Tables) -> DataFrame:
    steps = [
        M.Migration(5, "sizes", lambda d: d.withColumn("size", F.when(F.col("price") > 100_000, "large").otherwise("small"))),
        M.Migration(1, "ignored", lambda d: d.drop("o_orderstatus")),
        M.Migration(2, "names", lambda d: d.withColumnsRenamed({"o_orderkey": "order_id", "o_orderstatus": "status", "o_totalprice": "price"})),
        M.Migration(3, "columns", lambda d: d.select("order_id", "status", "price")),
    ]
    new, applied = M.migrate(t.orders, 1, steps)
    return new.select("order_id", "status", F.round("price", 0).alias("price"), "size", F.lit(",".join(map(str, applied))).alias("applied"))


@query("p05_transactions", "SELECT n_name AS name, n_regionkey + 1 AS value FROM nation UNION ALL SELECT r_name, r_regionkey FROM region")
def p05(t: Tables) -> DataFrame:
    """Two tables published together, then an attempt that fails after its first write and leaves nothing."""
    root = scratch_path(t.spark, "published")
    nation, region = t.nation.select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("value")), t.region.select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("value"))
    with M.Transaction(t.spark, root) as tx:
        tx.put("nation", nation)
        tx.put("region", region)
    with M.Transaction(t.spark, root) as tx:
        tx.put("nation", tx.read("nation").withColumn("value", F.col("value") + 1))
    try:
        with M.Transaction(t.spark, root) as tx:
            tx.put("region", tx.read("region").limit(0))
            raise InterruptedError
    except InterruptedError:
        pass
    last = M.Transaction(t.spark, root)
    return last.read("nation").unionByName(last.read("region"))


_FILE = {
    "path": "concat('db/', " + pick("s_suppkey", "'a'", "'knowledge'", "'c'", "'d'") + ", CASE WHEN s_suppkey = 1 THEN '' ELSE CAST(s_suppkey AS STRING) END, " + pick("s_nationkey", "'.db'", "'.json'") + ")",
    "length": "s_suppkey % 3 * 100", "head": pick("s_suppkey", "'PAR1'", "'PAR1'", "'PK'", "''"), "columns": "s_suppkey % 5",
}


@query("p09_hygiene", f"WITH f AS (SELECT {', '.join(f'{e} AS {n}' for n, e in _FILE.items())} FROM supplier) SELECT path, length, CASE WHEN length = 0 THEN 'empty_db_file' WHEN head <> 'PAR1' THEN 'unreadable_db_file' ELSE 'empty_schema_db_file' END AS reason, 'quarantine/' || string_split(path, '/')[-1] AS target FROM f WHERE path LIKE '%.db' AND path <> 'db/knowledge.db' AND (length = 0 OR head <> 'PAR1' OR columns = 0)")
def p09(t: Tables) -> DataFrame:
    return M.suspicious_files(t.supplier.selectExpr(*(f"{e} AS {n}" for n, e in _FILE.items())), "db/knowledge.db")


@query("p11_known_columns", "SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN 'CHANGED' ELSE c_mktsegment END AS c_mktsegment FROM customer UNION ALL SELECT -c_custkey - 1, NULL, 'CHANGED' FROM customer WHERE c_custkey % 7 = 0")
def p11(t: Tables) -> DataFrame:
    stored = t.customer.select("c_custkey", "c_name", "c_mktsegment")
    changed = F.lit("CHANGED").alias("c_mktsegment")
    more = t.customer.filter("c_custkey % 3 = 0").select("c_custkey", changed, F.lit(1).alias("no_such_column"))
    more = more.unionByName(t.customer.filter("c_custkey % 7 = 0").select((-F.col("c_custkey") - 1).alias("c_custkey"), changed, F.lit(1).alias("no_such_column")))
    return M.upsert_known(stored, more, "c_custkey")


_CATEGORIES = ("incomplete_answer", "inaccurate_answer", "retrieval_miss", "irrelevant_answer", "missing_evidence", "unclear_term")
_FEEDBACK = {
    "feedback_id": "event_id", "satisfaction": "CASE WHEN value > 40 THEN 'satisfied' WHEN value > 2 THEN 'unsatisfied' ELSE 'other' END", "confidence": "CAST(user_id % 10 AS DOUBLE) / 10", "doc_id": "CASE WHEN user_id % 3 = 0 THEN NULL ELSE event_id % 300 END",
    "hits": "event_id % 3", "category": pick("event_id", *(f"'{c}'" for c in (*_CATEGORIES, "no_such_category"))), "created_at": "ts",
}


@query(
    "m20_answer_feedback",
    f"""WITH f AS (SELECT {', '.join(f'{e} AS {n}' for n, e in _FEEDBACK.items())} FROM events)
    SELECT feedback_id, satisfaction, category, CASE category WHEN 'retrieval_miss' THEN CASE WHEN hits = 0 THEN 'fact_extraction_gap' ELSE 'retrieval_quality_low' END WHEN 'incomplete_answer' THEN 'knowledge_extraction_incomplete'
      WHEN 'inaccurate_answer' THEN CASE WHEN confidence < 0.5 THEN 'low_confidence_answer' ELSE 'fact_quality_low' END WHEN 'irrelevant_answer' THEN 'intent_mismatch' WHEN 'missing_evidence' THEN 'evidence_link_missing' ELSE 'term_definition_missing' END AS root_cause,
      CASE category WHEN 'retrieval_miss' THEN CASE WHEN hits = 0 THEN 'rebuild_coverage' ELSE 'auto_activate_golden' END WHEN 'incomplete_answer' THEN CASE WHEN doc_id IS NOT NULL THEN 'rebuild_coverage' END ELSE 'review' END AS action
    FROM f WHERE satisfaction = 'unsatisfied' AND category <> 'no_such_category'""",
)
def m20(t: Tables) -> DataFrame:
    submitted = E.accepted_feedback(t.events.selectExpr(*(f"{e} AS {n}" for n, e in _FEEDBACK.items())))
    return E.reflected(submitted).select("feedback_id", "satisfaction", "category", "root_cause", "action")


@query(
    "l13_package_import",
    """WITH s AS (SELECT conv_id, turn, trim(p) AS part FROM (SELECT conv_id, turn, unnest(regexp_split_to_array(text, '[\\n。；;.!?]+')) AS p FROM conversations)),
    r AS (SELECT DISTINCT conv_id, part FROM s WHERE part <> '' AND regexp_matches(lower(part), '应|必须|不得|不应|需|需要|要求|shall|must|should|require|[0-9]'))
    SELECT conv_id, count(*) AS candidates, count(*) FILTER (regexp_matches(part, '[0-9]')) AS promoted FROM r GROUP BY 1""",
)
def l13(t: Tables) -> DataFrame:
    return E.imported(t.conversations, "conv_id", "text")
