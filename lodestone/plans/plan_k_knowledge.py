"""K: document to knowledge."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import knowledge as K
from lodestone.plans.registry import query
from lodestone.plans.views import Tables


@query(
    "k02_line_types",
    r"""SELECT CASE WHEN regexp_matches(normalized_text, '^#{1,6} ') THEN 'heading' WHEN regexp_matches(normalized_text, '^([-*+]|[0-9]+[.)]) ') THEN 'list' WHEN contains(normalized_text, '|') THEN 'table' ELSE 'text' END AS kind, count(*) AS n FROM v_evidence GROUP BY 1""",
)
def k02(t: Tables) -> DataFrame:
    return K.typed_lines(t.v_evidence, "normalized_text").groupBy("kind").agg(F.count("*").alias("n"))


@query(
    "k05_wrapped_lines",
    """WITH b AS (SELECT *, CASE WHEN regexp_matches(coalesce(lag(normalized_text) OVER (PARTITION BY doc_id ORDER BY line_no), '.'), '[.!?:;]$') THEN 1 ELSE 0 END AS b FROM v_evidence),
    n AS (SELECT *, sum(b) OVER (PARTITION BY doc_id ORDER BY line_no) AS block FROM b) SELECT doc_id, CAST(block AS BIGINT) AS block, count(*) AS n_lines, md5(string_agg(normalized_text, ' ' ORDER BY line_no)) AS body FROM n GROUP BY 1, 2""",
)
def k05(t: Tables) -> DataFrame:
    return K.merged_wraps(t.v_evidence, "doc_id", "line_no", "normalized_text").withColumn("body", F.md5("body"))


@query(
    "k07_page_quality",
    """WITH f AS (SELECT doc_id, concat_ws(',', CASE WHEN n_chars < 100 THEN 'short' END, CASE WHEN contains(text, '!!') THEN 'shouting' END, CASE WHEN contains(text, '|') THEN 'table' END) AS flags,
    CAST(n_chars < 100 AS INTEGER) + CAST(contains(text, '!!') AS INTEGER) + CAST(contains(text, '|') AS INTEGER) AS k FROM documents) SELECT doc_id, flags, CASE WHEN k >= 2 THEN 'high' WHEN k = 1 THEN 'medium' ELSE 'low' END AS risk FROM f""",
)
def k07(t: Tables) -> DataFrame:
    flags = {"short": F.col("n_chars") < 100, "shouting": F.contains("text", F.lit("!!")), "table": F.contains("text", F.lit("|"))}
    return K.flagged(t.documents, flags).select("doc_id", "flags", "risk")


@query("k08_evidence", "SELECT doc_id, line_no, lower(trim(regexp_replace(normalized_text, '\\s+', ' ', 'g'))) AS s, round(least(1, length(normalized_text) / 100), 4) AS confidence FROM v_evidence WHERE length(normalized_text) >= 20")
def k08(t: Tables) -> DataFrame:
    rows = t.v_evidence.filter("length(normalized_text) >= 20")
    return rows.select("doc_id", "line_no", T.normalise("normalized_text").alias("s"), F.round(F.least(F.lit(1.0), F.length("normalized_text") / 100), 4).alias("confidence"))


@query(
    "k10_facts",
    """SELECT DISTINCT 'license' AS fact_type, doc_id, regexp_extract(text, '(MIT|Apache|GNU|CC BY)', 1) AS value FROM documents WHERE regexp_matches(text, '(MIT|Apache|GNU|CC BY)')
    UNION SELECT 'phone', doc_id, regexp_extract(text, '([0-9]{3}-[0-9]{4})', 1) FROM documents WHERE regexp_matches(text, '[0-9]{3}-[0-9]{4}')""",
)
def k10(t: Tables) -> DataFrame:
    d = t.documents
    license_ = d.select("doc_id", F.regexp_extract("text", "(MIT|Apache|GNU|CC BY)", 1).alias("value")).filter("value <> ''")
    phone = d.select("doc_id", F.regexp_extract("text", "([0-9]{3}-[0-9]{4})", 1).alias("value")).filter("value <> ''")
    return K.facts({"license": license_, "phone": phone}, ["doc_id", "value"])


@query("k13_entities", "SELECT lower(trim(p_name)) AS name, p_type, max(p_retailprice) AS confidence, count(DISTINCT p_brand) AS aliases, count(*) AS mentions FROM part GROUP BY 1, 2")
def k13(t: Tables) -> DataFrame:
    return K.entities(t.part, "p_name", "p_type", "p_retailprice", "p_brand")


@query(
    "k16_coverage",
    """SELECT p_partkey, CASE WHEN e AND s THEN 'u3' WHEN s THEN 'u2' WHEN e THEN 'u1' ELSE 'u0' END AS status FROM (SELECT p_partkey, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) AS e,
    p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0.08) AS s FROM part)""",
)
def k16(t: Tables) -> DataFrame:
    line = t.lineitem.withColumnRenamed("l_partkey", "p_partkey")
    return K.coverage(t.part.select("p_partkey"), line.filter("l_quantity > 45"), line.filter("l_returnflag = 'R' and l_discount > 0.08"), "p_partkey")


@query(
    "k19_backfill",
    """WITH u AS (SELECT conv_id, turn // 2 AS page, min(turn) AS unit FROM conversations WHERE role = 'user' GROUP BY 1, 2), f AS (SELECT conv_id, min(turn) AS unit FROM conversations WHERE role = 'user' GROUP BY 1)
    SELECT c.conv_id, c.turn, coalesce(u.unit, f.unit) AS unit FROM conversations c LEFT JOIN u ON c.conv_id = u.conv_id AND c.turn // 2 = u.page LEFT JOIN f ON c.conv_id = f.conv_id WHERE c.role = 'assistant'""",
)
def k19(t: Tables) -> DataFrame:
    rows = t.conversations.withColumn("page", F.floor(F.col("turn") / 2))
    units = rows.filter("role = 'user'").select("conv_id", "page", F.col("turn").alias("unit"))
    return K.backfill(rows.filter("role = 'assistant'").select("conv_id", "page", "turn"), units, "conv_id", "page", "unit").select("conv_id", "turn", "unit")


@query(
    "k21_acceptance",
    """WITH m AS (SELECT count(*) AS n, count(*) FILTER (n_chars = 0) AS empty, count(DISTINCT lang) AS langs FROM documents)
    SELECT 'has documents' AS check_name, CASE WHEN n > 0 THEN 'passed' ELSE 'failed' END AS status FROM m UNION ALL SELECT 'no empty text', CASE WHEN empty = 0 THEN 'passed' ELSE 'warn' END FROM m UNION ALL SELECT 'five languages', CASE WHEN langs >= 5 THEN 'passed' ELSE 'warn' END FROM m""",
)
def k21(t: Tables) -> DataFrame:
    m = t.documents.agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") == 0).alias("empty"), F.countDistinct("lang").alias("langs"))
    return K.acceptance(m, {"has documents": (F.col("n") > 0, "failed"), "no empty text": (F.col("empty") == 0, "warn"), "five languages": (F.col("langs") >= 5, "warn")})


@query(
    "k26_scope_change",
    """WITH p AS (SELECT user_id, event_type IN ('error', 'signup') AS earlier, event_type IN ('purchase', 'view') AS later, k % 9 + 1 AS page FROM events JOIN v_props USING (event_id)),
    s AS (SELECT user_id, count(DISTINCT page) FILTER (earlier) AS o, count(DISTINCT page) FILTER (later) AS n FROM p GROUP BY 1),
    f AS (SELECT user_id, count(*) AS fresh FROM (SELECT user_id, page FROM p WHERE later EXCEPT SELECT user_id, page FROM p WHERE earlier) GROUP BY 1)
    SELECT user_id, CASE WHEN o = 0 AND n > 0 THEN 'new_scope' WHEN o > 0 AND n = 0 THEN 'done' WHEN n < o THEN 'improved' WHEN coalesce(fresh, 0) = 0 THEN 'still_open' ELSE 'expanded' END AS status FROM s LEFT JOIN f USING (user_id)""",
)
def k26(t: Tables) -> DataFrame:
    """Pages at risk in an earlier report (errors and signups) against a later one (purchases and views)."""
    page = (F.col("k") % 9 + 1).alias("page")
    pages = t.events.join(t.v_props, "event_id").select("user_id", "event_type", page)
    per = lambda *kinds: F.collect_set(F.when(F.col("event_type").isin(*kinds), F.col("page")))
    sets = pages.groupBy("user_id").agg(per("error", "signup").alias("o"), per("purchase", "view").alias("n"))
    return sets.select("user_id", K.scope_change(F.col("o"), F.col("n")).alias("status"))
