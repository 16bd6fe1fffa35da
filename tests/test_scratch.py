"""Scratch tables: shared folders only, freed when nothing reads them."""

import os

import pytest

from lodestone import scratch


class Session:
    """As much of a session as `shared_dir` asks."""

    def __init__(self, master, folder=None):
        self.conf, self.folder = self, folder
        self.sparkContext = type("Context", (), {"applicationId": "app", "master": master})

    def get(self, key, default):
        return self.folder or default


def test_a_cluster_without_a_shared_folder_is_refused():
    for master in ("yarn", "spark://x:7077", "local-cluster[3,2,1000]"):
        with pytest.raises(ValueError, match="checkpoint"):
            scratch.shared_dir(Session(master))
        assert scratch.shared_dir(Session(master, "s3://b/x/")) == "s3://b/x"
    assert scratch.shared_dir(Session("local[8]")).startswith("file:///")


def test_freed_tables_are_gone(spark):
    df = scratch.materialize(spark.range(5), "gone")
    folder = os.path.dirname(df.inputFiles()[0].removeprefix("file://"))
    assert os.path.isdir(folder)
    scratch.free(df)
    assert not os.path.isdir(folder)
