"""A: scans, sources and sinks."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.plans.registry import query
from lodestone.plans.views import Tables
from lodestone.scratch import scratch_path
from lodestone.sources import files


@query("a01_scan", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_discount > 0.05")
def a01(t: Tables) -> DataFrame:
    return t.lineitem.filter("l_shipdate >= '1998-01-01' and l_discount > 0.05").select("l_orderkey", "l_linenumber", "l_quantity")


@query("a03_registration", "SELECT min('doc/' || lpad(CAST(doc_id AS VARCHAR), 9, '0')) AS path, sha256(text) AS sha256 FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id < 20) GROUP BY 2")
def a03(t: Tables) -> DataFrame:
    found = t.documents.select(F.concat(F.lit("doc/"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("path"), F.col("text").alias("content"))
    known = t.documents.filter("doc_id < 20").select(F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    return files.register(found, known).select("path", "sha256")


@query("a05_text_profile", "SELECT page_id, length(html) AS n, round((length(html) - length(regexp_replace(html, '[A-Za-z]', '', 'g'))) / length(html), 6) AS letters FROM pages")
def a05(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.length("html").cast("long").alias("n"), F.round(T.share_of("html", "A-Za-z"), 6).alias("letters"))


@query(
    "a06_html_view",
    "SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g')) AS s FROM pages",
)
def a06(t: Tables) -> DataFrame:
    return t.pages.select("page_id", T.strip_tags("html").alias("s"))


@query(
    "a08_whole_texts",
    """SELECT lang, source, count(*) AS lines, CAST(sum(length(block)) AS BIGINT) AS chars FROM (SELECT lang, source, unnest(string_split(text, chr(10))) AS block FROM documents) WHERE block <> '' GROUP BY 1, 2""",
)
def a08(t: Tables) -> DataFrame:
    """The documents' texts in files of a folder for each language and source, of 500 texts at most; each read whole and cut into blocks."""
    path = scratch_path(t.spark, "texts")
    t.documents.select("lang", "source", F.col("text").alias("value")).repartition("lang", "source").write.partitionBy("lang", "source").option("maxRecordsPerFile", 500).text(path)
    whole = t.spark.read.option("wholetext", "true").text(path)
    blocks = whole.select("lang", "source", F.explode(F.split("value", "\n")).alias("block")).filter("block <> ''")
    return blocks.groupBy("lang", "source").agg(F.count("*").alias("lines"), F.sum(F.length("block")).alias("chars"))


@query("a10_nested_documents", "SELECT conv_id AS doc_id, CAST(turn // 4 AS INTEGER) AS page_no, role AS type, text FROM conversations")
def a10(t: Tables) -> DataFrame:
    rows = t.conversations.select(F.col("conv_id").alias("doc_id"), F.floor(F.col("turn") / 4).cast("int").alias("page_no"), F.col("turn").alias("position"), F.col("role").alias("type"), "text")
    path = scratch_path(t.spark, "documents")
    files.nested(rows).write.json(path)
    return files.blocks(files.read_documents(t.spark, path)).select("doc_id", "page_no", "type", "text")


@query("a11_partition_overwrite", "SELECT event_id, event_type FROM events WHERE event_type <> 'error' UNION ALL SELECT event_id, event_type FROM events WHERE event_type = 'error' AND event_id < 500")
def a11(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "events")
    rows = t.events.select("event_id", "event_type")
    files.write_partitioned(rows, path, "event_type")
    files.write_partitioned(rows.filter("event_type = 'error' and event_id < 500"), path, "event_type")
    return t.spark.read.schema(rows.schema).parquet(path).select("event_id", "event_type")


@query(
    "a13_chunk_import",
    """WITH x AS (SELECT conv_id, turn, text, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS chunk FROM conversations)
    SELECT conv_id, CAST(chunk AS BIGINT) AS chunk, count(*) AS lines, string_agg(text, chr(10) ORDER BY turn) AS body FROM x GROUP BY 1, 2""",
)
def a13(t: Tables) -> DataFrame:
    return files.chunks(t.conversations, "conv_id", "turn", "text", F.col("role") == "user")


@query("a15_case_files", "SELECT item_id, length(text) AS n FROM benchmark")
def a15(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "cases")
    cases = t.benchmark.groupBy((F.col("item_id") % 4).alias("f")).agg(F.collect_list(F.struct("item_id", "text")).alias("cases"))
    cases.select("cases").write.json(path)
    rows = t.spark.read.schema("cases array<struct<item_id: long, text: string>>").json(path)
    return rows.select(F.inline("cases")).select("item_id", F.length("text").cast("long").alias("n"))


@query("a18_append_log", "SELECT event_id, ts FROM events ORDER BY ts DESC LIMIT 25")
def a18(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "log")
    for k in range(2):
        files.append(t.events.filter(F.col("event_id") % 2 == k).select("event_id", "ts"), path)
    return files.newest(t.spark.read.parquet(path), "ts", 25)
