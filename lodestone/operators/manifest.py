"""Versions of several tables, each published by the creation of one file.

A commit is a file `_commits/<version>.json` that names the folder of every table. It is written whole beside its
place and then put there only if nothing is there yet: by a hard link on a local file system, by a rename
that never overwrites elsewhere (HDFS, and object stores whose rename refuses an existing target). So a reader sees
all tables of a version or none, a writer that dies leaves nothing but unnamed folders, and of two
writers of one version one is told that it lost.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer has published what this one has read or written."""


class Manifest:
    """The commits of a folder that all writers and readers share."""

    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def latest(self) -> tuple[int, dict]:
        """The last version and what it names; 0 and nothing before the first commit."""
        folder = self._path(f"{self.root}/_commits")
        names = [s.getPath().getName() for s in self.fs.listStatus(folder)] if self.fs.exists(folder) else []
        version = max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)
        return (version, self.at(version)) if version else (0, {})

    def at(self, version: int) -> dict:
        stream = self.fs.open(self._path(self._name(version)))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, version: int, named: dict) -> bool:
        """Publish `named` as `version`; False, and nothing is changed, if that version is there already."""
        staged = self._path(f"{self.root}/_commits/_staged-{uuid.uuid4().hex}")
        out = self.fs.create(staged, True)
        out.write(bytearray(json.dumps(named, sort_keys=True).encode()))
        out.close()
        target = self._path(self._name(version))
        if self.fs.getScheme() == "file":
            try:
                os.link(staged.toUri().getPath(), target.toUri().getPath())
                done = True
            except FileExistsError:
                done = False
        else:
            done = not self.fs.exists(target) and self.fs.rename(staged, target)
        self.fs.delete(staged, False)
        return done

    def discard(self, folder: str) -> None:
        """Delete a folder that no version names."""
        self.fs.delete(self._path(folder), True)

    def _name(self, version: int) -> str:
        return f"{self.root}/_commits/{version:012}.json"
