"""DML shapes over immutable tables: merges, pruning, signatures and checks."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.manifest import Conflict, Manifest


def upsert(target: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """`target` with rows of `changes` put in or in place; its columns win where the change has null."""
    c = changes.select(*(F.col(x).alias(f"__{x}") for x in target.columns))
    joined = target.join(c, F.col(key) == F.col(f"__{key}"), "full_outer")
    return joined.select(*(F.coalesce(f"__{x}", x).alias(x) for x in target.columns))


def insert_new(target: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """`target` and those rows whose key it lacks (INSERT OR IGNORE)."""
    return target.unionByName(rows.join(target.select(key), key, "left_anti").select(*target.columns))


def replace_groups(target: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """`target` with all rows of the groups that `rows` has replaced by its rows."""
    return target.join(rows.select(key).distinct(), key, "left_anti").select(*target.columns).unionByName(rows.select(*target.columns))


def prune(runs: DataFrame, version: str, at: str, keep: int) -> DataFrame:
    """Runs and whether to keep them: those of the `keep` versions seen last."""
    latest = runs.groupBy(version).agg(F.max(at).alias("__at")).orderBy(F.desc("__at"), version).limit(keep).select(version).withColumn("keep", F.lit(True))
    return runs.join(latest, version, "left").withColumn("keep", F.coalesce("keep", F.lit(False)))


def checks(named: dict[str, DataFrame]) -> DataFrame:
    """(issue, n) of every check that finds rows."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("issue"), "n") for name, df in named.items()]
    return reduce(DataFrame.unionByName, parts).filter("n > 0")


def freshness(source: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """One row: status (fresh, stale or missing), missing and orphan counts of an index."""
    a, b = source.select(key).distinct().withColumn("__s", F.lit(1)), index.select(key).distinct().withColumn("__i", F.lit(1))
    both = a.join(b, key, "full_outer").agg(F.count_if(F.col("__i").isNull()).alias("missing"), F.count_if(F.col("__s").isNull()).alias("orphan"), F.count("__i").alias("indexed"))
    status = F.when(F.col("indexed") == 0, "missing").when((F.col("missing") > 0) | (F.col("orphan") > 0), "stale").otherwise("fresh")
    return both.select(status.alias("status"), "missing", "orphan")


# ---- versions, publication, hygiene --------------------------------------------------------------


@dataclass(frozen=True)
class Migration:
    """A step from one version of a table's schema to the next."""

    version: int
    name: str
    apply: Callable[[DataFrame], DataFrame]


def migrate(df: DataFrame, current: int, migrations: list[Migration]) -> tuple[DataFrame, list[int]]:
    """`df` after all steps beyond version `current`, in order of their versions, and which those were. Two steps of
    one version are refused."""
    versions = [m.version for m in migrations]
    if len(set(versions)) < len(versions):
        raise ValueError(f"versions repeat: {sorted(versions)}")
    pending = sorted((m for m in migrations if m.version > current), key=lambda m: m.version)
    return reduce(lambda d, m: m.apply(d), pending, df), [m.version for m in pending]


class Transaction:
    """Tables that are published together or not at all, on the versions that the block began with.

    `put` writes beside the tables; leaving the block without an error names all that was written in one commit of
    the manifest, and with an error removes it. If others have published meanwhile, the commit is put on top of
    theirs, unless they changed a table that this block read or wrote: then it raises `Conflict` and
    leaves nothing. A process that dies before the commit leaves folders that no version names."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.manifest = Manifest(spark, self.root)
        self.version, self.tables = self.manifest.latest()
        self.staged: dict[str, str] = {}
        self.seen: set[str] = set()

    def __enter__(self) -> Transaction:
        return self

    def put(self, table: str, df: DataFrame) -> None:
        if table in self.staged:
            self.manifest.discard(self.staged.pop(table))
        path = f"{self.root}/{table}/{uuid.uuid4().hex}"
        self.staged[table] = path
        df.write.parquet(path)

    def read(self, table: str) -> DataFrame:
        """The table as this block wrote it, or else as it was when the block began."""
        self.seen.add(table)
        return self.spark.read.parquet(self.staged.get(table) or self.tables[table])

    def __exit__(self, kind, *_) -> bool:
        if kind is not None:
            self._drop()
            return False
        version, now = self.version, self.tables
        while self.staged and not self.manifest.commit(version + 1, now | self.staged):
            version, now = self.manifest.latest()
            lost = sorted(t for t in self.seen | self.staged.keys() if now.get(t) != self.tables.get(t))
            if lost:
                self._drop()
                raise Conflict(f"published by another writer since version {self.version}: {', '.join(lost)}")
        return False

    def _drop(self) -> None:
        for path in self.staged.values():
            self.manifest.discard(path)


def suspicious_files(files: DataFrame, primary: str) -> DataFrame:
    """path, length, reason, target of the data files of a workspace that are no data: empty ones, ones that cannot be read (no
    magic number) and ones without a column; the primary file and files of other kinds are never suspicious.

    `files` has path, length, head (its first bytes) and columns (how many columns its schema has)."""
    reason = F.when(F.col("length") == 0, "empty_db_file").when(~F.startswith("head", F.lit("PAR1")), "unreadable_db_file").when(F.col("columns") == 0, "empty_schema_db_file")
    name = F.element_at(F.split("path", "/"), -1)
    return files.filter(F.endswith("path", F.lit(".db")) & (F.col("path") != primary)).withColumn("reason", reason).filter("reason is not null").select("path", "length", "reason", F.concat(F.lit("quarantine/"), name).alias("target"))


def upsert_known(target: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """`upsert` of those columns of `changes` that the table has; columns that it lacks are not stored, and columns
    that the changes lack stay."""
    own = changes.select(*(F.col(c) if c in changes.columns else F.lit(None).cast(target.schema[c].dataType).alias(c) for c in target.columns))
    return upsert(target, own, key)


# ---- queues and rebuilds -------------------------------------------------------------------------


def drain(queue: DataFrame, limit: int, at: str, key: str, done: str = "processed") -> tuple[DataFrame, DataFrame]:
    """(the rows taken, the queue after it): the oldest rows that are not done, at most `limit`, ties to the smaller
    key, and the queue with them marked. What is taken is known by key alone, so to take a batch twice (the
    marked queue was not stored) gives the same rows."""
    taken = queue.filter(F.col(done) == 0).orderBy(at, key).limit(limit)
    marked = queue.join(taken.select(key, F.lit(1).alias("__taken")), key, "left")
    return taken, marked.withColumn(done, F.greatest(F.col(done), F.coalesce("__taken", F.lit(0)))).drop("__taken").select(*queue.columns)


def latest_status(jobs: DataFrame, job: str, at: str, status: str, retries: int) -> DataFrame:
    """job, status, attempts: a job's state from its events: the last one's, but a failed job that has attempts
    left is pending again."""
    last = jobs.groupBy(job).agg(F.max_by(status, F.struct(at, status)).alias("status"), F.count_if(F.col(status) == "failed").alias("attempts"))
    return last.withColumn("status", F.when((F.col("status") == "failed") & (F.col("attempts") <= retries), "pending").otherwise(F.col("status")))


# What can be rebuilt, in order.
REBUILT = ("graph", "wiki", "coverage", "fts")


def rebuild(states: dict[str, tuple[DataFrame, DataFrame]], key: str, scope: str = "all", execute: bool = True, doc: str | None = None, docs: list | None = None) -> DataFrame:
    """scope, before, after, missing, orphan, changed, status of each derived state in the scope.

    `states` has a source and an index by scope, both with `key`. Planned only, nothing changes; executed, the index
    gets what it lacks and loses what has no source, in the named documents alone if `docs` (values of the column
    `doc`) are given, and is checked again."""
    if scope != "all" and scope not in REBUILT:
        raise ValueError(f"unknown scope {scope}")
    out = []
    for name in (s for s in REBUILT if s in states and scope in ("all", s)):
        source, index = states[name]
        columns = [key] + ([doc] if doc else [])
        s, i = source.select(*columns).distinct(), index.select(*columns).distinct()
        touched = F.col(doc).isin(docs) if doc and docs is not None else F.lit(True)
        new = i.filter(~touched).unionByName(s.filter(touched)) if execute else i
        before, after = freshness(s, i, key), freshness(s, new, key)
        row = before.select(F.lit(name).alias("scope"), F.col("status").alias("before"), "missing", "orphan").crossJoin(after.select(F.col("status").alias("after"), F.col("missing").alias("__m"), F.col("orphan").alias("__o")))  # one row each
        changed = F.col("missing") - F.col("__m") + F.col("orphan") - F.col("__o")
        status = F.when(F.lit(not execute), "planned").when(F.col("after") == "fresh", "done").otherwise("failed")
        out.append(row.select("scope", "before", "after", "missing", "orphan", changed.alias("changed"), status.alias("status")))
    return reduce(DataFrame.unionByName, out)


def progress(events: DataFrame, job: str, stages: list[tuple[str, int]], stage: str, at: str) -> DataFrame:
    """job, stage, percent, seen, state of a pipeline's events: the furthest stage of each job, how far that is, how many of the
    stages were seen, and whether none before it is missing."""
    place = F.array_position(F.array(*(F.lit(s) for s, _ in stages)), F.col(stage))
    rows = events.withColumn("__place", place).filter("__place > 0").groupBy(job).agg(F.max("__place").cast("int").alias("__at"), F.countDistinct("__place").alias("seen"), F.max(at).alias("__last"))
    percent = F.element_at(F.array(*(F.lit(p) for _, p in stages)), F.col("__at"))
    name = F.element_at(F.array(*(F.lit(s) for s, _ in stages)), F.col("__at"))
    return rows.select(job, name.alias("stage"), percent.alias("percent"), "seen", F.when(F.col("seen") < F.col("__at"), "gap").when(F.col("__at") == len(stages), "done").otherwise("running").alias("state"))
