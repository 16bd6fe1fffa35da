"""File sources and sinks: registration by content, whole texts, nested documents, chunks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Suffixes and the source types they stand for.
SOURCE_TYPES = {
    "pdf": "pdf", "md": "markdown", "markdown": "markdown", "txt": "text", "doc": "word", "docx": "word", "xls": "excel", "xlsx": "excel",
    "png": "image", "jpg": "image", "jpeg": "image",
}

#: A document with pages of blocks.
DOCUMENT = "doc_id long, pages array<struct<page_no: int, blocks: array<struct<block_id: string, type: string, text: string, bbox: array<double>>>>>"


def source_type(path: Column | str) -> Column:
    """The source type by file suffix; "file" for others."""
    suffix = F.lower(F.regexp_extract(F.col(path) if isinstance(path, str) else path, r"\.([^./?#]+)(?:[?#].*)?$", 1))
    kinds = F.create_map(*(F.lit(x) for pair in SOURCE_TYPES.items() for x in pair))
    return F.coalesce(kinds[suffix], F.lit("file"))


def register(found: DataFrame, known: DataFrame, content: str = "content") -> DataFrame:
    """Files whose content is new: sha256 added, one row a content, those in `known` (sha256) left out."""
    hashed = found.withColumn("sha256", F.sha2(F.col(content).cast("binary"), 256))
    fresh = hashed.join(known.select("sha256"), "sha256", "left_anti")
    return fresh.groupBy("sha256").agg(F.min_by(F.struct(*found.columns), "path").alias("f")).select("sha256", "f.*")


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, content (binary) and length of files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content", "length")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path and text: a file a row."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Nested documents from JSON lines, with a fixed schema."""
    return spark.read.schema(DOCUMENT).json(path)


def blocks(documents: DataFrame) -> DataFrame:
    """doc_id, page_no, position, type, text: a row per block of nested documents."""
    pages = documents.select("doc_id", F.explode("pages").alias("p"))
    return pages.select("doc_id", F.col("p.page_no").alias("page_no"), F.posexplode("p.blocks").alias("position", "b")).select("doc_id", "page_no", "position", F.col("b.type").alias("type"), F.col("b.text").alias("text"))


def nested(rows: DataFrame) -> DataFrame:
    """The inverse of `blocks`: nested documents from block rows."""
    b = F.struct(F.concat_ws("-", "page_no", "position").alias("block_id"), "type", "text", F.lit(None).cast("array<double>").alias("bbox"))
    pages = rows.groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list(F.struct("position", b.alias("b")))).alias("x"))
    pages = pages.select("doc_id", F.struct(F.col("page_no").cast("int").alias("page_no"), F.transform("x", lambda x: x["b"]).alias("blocks")).alias("p"))
    return pages.groupBy("doc_id").agg(F.array_sort(F.collect_list("p"), lambda a, c: a["page_no"] - c["page_no"]).alias("pages"))


def write_partitioned(df: DataFrame, path: str, key: str, fmt: str = "parquet") -> None:
    """Overwrite only the partitions that `df` has rows for."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).format(fmt).save(path)


def append(df: DataFrame, path: str) -> None:
    """Append to a log."""
    df.write.mode("append").parquet(path)


def newest(log: DataFrame, at: str, n: int) -> DataFrame:
    """The newest rows of a log."""
    return log.orderBy(F.desc(at)).limit(n)


def chunks(lines: DataFrame, doc: str, line_no: str, text: str, is_heading: Column) -> DataFrame:
    """(doc, chunk, lines, body): runs of lines that each heading begins; lines before the first are chunk 0."""
    w = Window.partitionBy(doc).orderBy(line_no)
    numbered = lines.withColumn("chunk", F.sum(is_heading.cast("long")).over(w))
    body = F.array_sort(F.collect_list(F.struct(line_no, text)))
    return numbered.groupBy(doc, "chunk").agg(F.count("*").alias("lines"), F.array_join(F.transform(body, lambda x: x[text]), "\n").alias("body"))


def listing(tables: dict[str, DataFrame]) -> DataFrame:
    """name, n: each table and its number of rows."""
    one = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, one)
