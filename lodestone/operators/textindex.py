"""A stored inverted index that is brought up to date instead of built anew.

Postings lie in segments, a row a text and a column for each term bucket, so that a search reads the columns of its
terms, and a text's postings are written by the task that splits it: nothing is shuffled or sorted, and a task's
memory does not grow with the source. A segment holds the texts that were new or changed when it was
written, by a digest of each text, and the keys whose earlier postings it ends. A refresh compares digests by
anti-joins, splits only those texts, and publishes one segment more; `compact` merges all segments into
one without dead postings. Segments and their statistics are named by one commit of a manifest, so a
search sees one state of the index, and a refresh that loses against another one starts over.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators.manifest import Manifest
from lodestone.scratch import free, materialize, scratch_root

_GROUP = 6  # terms are dealt into groups of so many buckets, then into buckets
_TERMS = "array<struct<term: string, tf: bigint>>"
_COLUMNS = {"keys": ", digest string, dl long", "gone": "", "postings": ", dl long, norm double"}


def source_stamp(df: DataFrame) -> str | None:
    """A digest of the files behind a table (paths, sizes and times); null if `df` is not one relation read from files."""
    try:
        files = df.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    except AnalysisException:
        return None
    row = files.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("*")).alias("x")).first()
    return f"{row['n']}-{row['x']}"


def _run_lengths(words: str) -> tuple[Column, Column]:
    """Of a sorted array column: where its distinct words start (to be selected as `starts`), and, above that, the words and how often each comes."""
    w = F.col(words)
    starts = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: (i == 0) | (F.get(w, i) != F.get(w, i - 1)))
    counts = F.transform(F.col("starts"), lambda s, j: F.struct(F.get(w, s).alias("term"), (F.coalesce(F.get(F.col("starts"), j + 1), F.size(w)) - s).cast("long").alias("tf")))
    return F.when(F.size(w) > 0, starts).otherwise(F.array().cast("array<int>")).alias("starts"), counts.alias("counts")


def _between(first: int, end: int) -> Callable[[Column], Column]:
    return lambda x: (x["bucket"] >= first) & (x["bucket"] < end)


class TextIndex:
    """The index of one source of texts under a folder that all executors share.

    Keys are meant to be unique: of rows that share one, that with the least digest is indexed; rows without a key are
    not. A null text has no terms. `buckets` parts the terms and holds from the first refresh on."""

    def __init__(self, spark: SparkSession, root: str, key: str = "doc_id", text: str = "text", buckets: int = 32):
        self.spark, self.root, self.key, self.text = spark, root.rstrip("/"), key, text
        self.buckets = buckets
        self.manifest = Manifest(spark, self.root)
        self.version, self.state = self.manifest.latest()
        self.kind = self.state.get("kind")  # of the keys

    @classmethod
    def of(cls, texts: DataFrame, name: str, key: str = "doc_id", text: str = "text") -> TextIndex:
        """The index called `name` in the application's shared folder, brought up to `texts`."""
        folder = hashlib.md5(f"{name}\n{key}\n{text}".encode()).hexdigest()
        index = cls(texts.sparkSession, f"{scratch_root(texts.sparkSession)}/index-{folder}", key, text)
        index.refresh(texts)
        return index

    # ---- writing -------------------------------------------------------------------------------

    def refresh(self, texts: DataFrame, compact_after: int = 8) -> dict[str, int]:
        """Bring the index up to `texts` before a search; how many keys were added, changed, removed and kept.

        Unchanged files end it at once; else keys and digests are compared, and only new and changed texts are split. More
        than `compact_after` segments are merged afterwards."""
        stamp = source_stamp(texts)
        while True:
            if stamp and self.state.get("stamp") == stamp:
                return {"added": 0, "changed": 0, "removed": 0, "kept": self.state["keys"]}
            done = self._append(texts, stamp)
            if done is not None:
                break
            self.version, self.state = self.manifest.latest()
        if len(self.state["segments"]) > compact_after:
            self.compact()
        return done

    def _append(self, texts: DataFrame, stamp: str | None) -> dict[str, int] | None:
        rows = texts.filter(F.col(self.key).isNotNull()).select(F.col(self.key).alias("key"), F.md5(F.coalesce(self.text, F.lit(""))).alias("digest"), F.coalesce(self.text, F.lit("")).alias("text"))
        self.kind = rows.schema["key"].dataType.simpleString()
        path = f"{self.root}/segments/{uuid.uuid4().hex}"
        if self.state.get("segments"):
            old = self._live_keys().select("key", F.col("digest").alias("old"))
            wanted = rows.groupBy("key").agg(F.min("digest").alias("digest"))
            both = wanted.join(old, "key", "full_outer").select("key", "digest", "old")
            both.withColumn("change", F.when(F.col("old").isNull(), "added").when(F.col("digest").isNull(), "removed").when(F.col("digest") == F.col("old"), "kept").otherwise("changed")).write.parquet(f"{path}/delta")
            delta = self.spark.read.parquet(f"{path}/delta")
            n = {r[0]: r[1] for r in delta.groupBy("change").count().collect()}
            delta.filter("change IN ('changed', 'removed')").select("key").write.parquet(f"{path}/gone")
            todo = delta.filter("change IN ('added', 'changed')").select("key", "digest")
            self._write_segment(rows.join(todo, ["key", "digest"], "left_semi"), path)
            self.manifest.discard(f"{path}/delta")
        else:
            n = {"added": self._write_segment(rows, path)}
        counts = {c: int(n.get(c, 0)) for c in ("added", "changed", "removed", "kept")}
        segments = [*self.state.get("segments", []), {"path": path, "gone": counts["changed"] + counts["removed"] > 0}]
        return counts if self._publish(segments, stamp) else None

    def _write_segment(self, rows: DataFrame, path: str) -> int:
        """Keys with digest and length; postings by bucket. Texts are split, counted and dealt into buckets row by row, once. Of
        rows that share a key that with the least digest stays. Returns the number of keys."""
        words = rows.select("key", "digest", F.sort_array(T.latin_tokens("text")).alias("w"))
        starts, counts = _run_lengths("w")
        words = words.select("key", "digest", "w", starts).select("key", "digest", F.size("w").cast("long").alias("dl"), counts)
        norm = F.sqrt(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x["tf"] * x["tf"])).alias("norm")
        placed = F.transform("counts", lambda x: F.struct(self._bucket(x["term"]).alias("bucket"), x.alias("of"))).alias("placed")
        groups = [F.filter("placed", _between(a, a + _GROUP)).alias(f"g{a}") for a in range(0, self.buckets, _GROUP)]
        columns = [F.transform(F.filter(f"g{b - b % _GROUP}", _between(b, b + 1)), lambda x: x["of"]).alias(f"b{b}") for b in range(self.buckets)]
        words.select("key", "digest", "dl", norm, placed).select("key", "digest", "dl", "norm", *groups).select("key", "digest", "dl", "norm", *columns).write.parquet(f"{path}/postings")
        postings = self.spark.read.parquet(f"{path}/postings")
        postings.groupBy("key").agg(F.min(F.struct("digest", "dl")).alias("m")).select("key", "m.*").write.parquet(f"{path}/keys")
        n = self.spark.read.parquet(f"{path}/keys").count()
        if postings.count() > n:
            self._write_once(postings, path)
        return n

    def _write_once(self, postings: DataFrame, path: str) -> None:
        """The postings again, one row for each key, in place of those that were written; only keys that are repeated are grouped."""
        again = materialize(postings.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "repeated")
        rest = [c for c in postings.columns if c not in ("key", "digest")]
        merged = postings.join(again, "key", "left_semi").groupBy("key").agg(F.min_by(F.struct(*rest), "digest").alias("m")).select("key", "m.*")
        postings.join(again, "key", "left_anti").select("key", *rest).unionByName(merged).write.parquet(f"{path}/once")
        self.manifest.discard(f"{path}/postings")
        self.manifest.fs.rename(self.manifest._path(f"{path}/once"), self.manifest._path(f"{path}/postings"))
        free(again)

    def _bucket(self, term: Column | str = "term") -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def _publish(self, segments: list[dict], stamp: str | None) -> bool:
        live = self._live_keys(segments).agg(F.count("*"), F.count_if(F.col("dl") > 0), F.sum("dl")).first()
        state = {"kind": self.kind, "segments": segments, "stamp": stamp, "keys": live[0], "texts": live[1], "terms": int(live[2] or 0)}
        if not self.manifest.commit(self.version + 1, state):
            self.manifest.discard(segments[-1]["path"])
            return False
        self.version, self.state = self.version + 1, state
        return True

    def compact(self) -> bool:
        """Merge all segments into one that holds living postings only; False if another writer was first."""
        path = f"{self.root}/segments/{uuid.uuid4().hex}"
        self._alive(self._read("postings"), self.state["segments"]).drop("seg").write.parquet(f"{path}/postings")
        self._live_keys().write.parquet(f"{path}/keys")
        return self._publish([{"path": path, "gone": False}], self.state["stamp"])

    def vacuum(self) -> None:
        """Delete the segments of earlier versions, once no search reads them any more."""
        named = {s["path"] for s in self.state["segments"]}
        for version in range(1, self.version):
            for s in self.manifest.at(version)["segments"]:
                if s["path"] not in named:
                    self.manifest.discard(s["path"])

    # ---- reading -------------------------------------------------------------------------------

    def _read(self, what: str, segments: list[dict] | None = None, buckets: list[int] | None = None) -> DataFrame:
        """`keys`, `postings` (of all buckets, or some) or `gone` of all segments, with the segment's number."""
        columns = "".join(f", b{b} {_TERMS}" for b in (range(self.buckets) if buckets is None else buckets)) if what == "postings" else ""
        parts = []
        for i, s in enumerate(segments or self.state["segments"]):
            if what != "gone" or s["gone"]:
                parts.append(self.spark.read.schema(f"key {self.kind}{_COLUMNS[what]}{columns}").parquet(f"{s['path']}/{what}").withColumn("seg", F.lit(i)))
        return reduce(DataFrame.unionByName, parts)

    def _alive(self, rows: DataFrame, segments: list[dict]) -> DataFrame:
        """Rows of which no later segment ended the key."""
        if not any(s["gone"] for s in segments):
            return rows
        ends = self._read("gone", segments).groupBy("key").agg(F.max("seg").alias("__end"))
        return rows.join(ends, "key", "left").filter("__end IS NULL OR seg >= __end").drop("__end")

    def _live_keys(self, segments: list[dict] | None = None) -> DataFrame:
        segments = segments or self.state["segments"]
        return self._alive(self._read("keys", segments), segments).drop("seg")

    @property
    def size(self) -> tuple[int, float]:
        """How many texts have terms, and their mean number of terms."""
        return self.state["texts"], self.state["terms"] / self.state["texts"] if self.state["texts"] else 0.0

    def hits(self, asked: DataFrame) -> DataFrame:
        """(key, dl, norm, term, tf) of every text that has one of the terms of `asked`: the buckets of those terms are read. The
        terms are written first, so that Spark knows their size when it chooses the join."""
        terms = materialize(asked.select("term").distinct().withColumn("bucket", self._bucket()), "asked-terms")
        here = sorted(r[0] for r in terms.filter("bucket IS NOT NULL").select("bucket").distinct().collect())
        found = self._alive(self._read("postings", buckets=here), self.state["segments"])
        listed = F.concat(*(F.col(f"b{b}") for b in here)) if here else F.array().cast(_TERMS)
        return found.select(F.col("key").alias(self.key), "dl", "norm", F.inline(listed)).join(terms.select("term"), "term", "left_semi").select(self.key, "dl", "norm", "term", "tf")
