"""The stored index: what a refresh touches, and that searches equal those over a new index."""

import re
from collections import Counter

import pytest

from lodestone.operators import retrieval
from lodestone.operators.textindex import TextIndex, source_stamp
from lodestone.scratch import scratch_path

ASKED = ["b", "a.c", "zz"]


@pytest.fixture
def index(spark):
    return TextIndex(spark, scratch_path(spark, "index"), buckets=4)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, dl string")


def hits(spark, index):
    asked = spark.createDataFrame([(t,) for t in ASKED], "term string")
    return sorted((r.doc_id, r.term, r.tf, r.dl, round(r.norm, 9)) for r in index.hits(asked).collect())


def brute(texts):
    out = []
    for key, text in texts.items():
        tf = Counter(re.findall(r"[a-z0-9./-]+", (text or "").lower()))
        norm = round(sum(n * n for n in tf.values()) ** 0.5, 9)
        out += [(key, t, tf[t], sum(tf.values()), norm) for t in ASKED if tf[t]]
    return sorted(out)


def test_refresh_splits_only_what_changed(spark, index):
    old = {1: "b B a.c", 2: "zz " * 40, 3: None, 4: "b", 5: ""}
    assert index.refresh(frame(spark, [(k, t, "x") for k, t in old.items()] + [(None, "b", "x")])) == {"added": 5, "changed": 0, "removed": 0, "kept": 0}
    assert hits(spark, index) == brute(old) and index.size == (3, (3 + 40 + 1) / 3)
    new = {1: "b B a.c", 2: "zz b", 4: None, 5: "a.c", 6: "b"}
    assert index.refresh(frame(spark, [(k, t, "x") for k, t in new.items()])) == {"added": 1, "changed": 3, "removed": 1, "kept": 1}
    segment = spark.read.parquet(index.state["segments"][-1]["path"] + "/keys")
    assert sorted(r["key"] for r in segment.collect()) == [2, 4, 5, 6]
    assert hits(spark, index) == brute(new)
    assert TextIndex(spark, index.root, buckets=4).state == index.state


def test_back_and_forth_compaction_and_vacuum(spark, index):
    states = [{1: "b", 2: "zz"}, {1: "a.c", 2: "zz"}, {1: "b"}, {1: "b", 2: "zz zz"}]
    for s in states:
        index.refresh(frame(spark, [(k, t, "") for k, t in s.items()]))
        assert hits(spark, index) == brute(s)
    first = index.state["segments"][0]["path"]
    assert len(index.state["segments"]) == 4 and index.compact() and len(index.state["segments"]) == 1
    assert hits(spark, index) == brute(states[-1])
    index.vacuum()
    assert not index.manifest.fs.exists(index.manifest._path(first)) and hits(spark, index) == brute(states[-1])
    index.refresh(frame(spark, [(k, "b", "") for k in range(3)]), compact_after=1)
    assert len(index.state["segments"]) == 1 and hits(spark, index) == brute({k: "b" for k in range(3)})


def test_repeated_keys_and_empty_sources(spark, index):
    index.refresh(frame(spark, []))
    assert hits(spark, index) == [] and index.size == (0, 0.0)
    index.refresh(frame(spark, [(1, "b", ""), (1, "zz", ""), (1, "b", "")]))
    found = hits(spark, index)
    assert found in (brute({1: "b"}), brute({1: "zz"}))  # that with the least digest
    assert index.refresh(frame(spark, [(1, "zz", ""), (1, "b", "")]))["kept"] == 1


def test_unchanged_files_end_a_refresh_at_once(spark, index, tmp_path):
    path = str(tmp_path / "t.parquet")
    frame(spark, [(1, "b", "")]).write.parquet(path)
    index.refresh(spark.read.parquet(path))
    version = index.version
    assert source_stamp(spark.read.parquet(path)) and index.refresh(spark.read.parquet(path))["kept"] == 1 and index.version == version
    assert source_stamp(spark.range(1)) is None
    frame(spark, [(2, "a.c b", "")]).write.mode("append").parquet(path)
    assert index.refresh(spark.read.parquet(path)) == {"added": 1, "changed": 0, "removed": 0, "kept": 1}


def test_a_refresh_that_loses_starts_over(spark, index):
    other = TextIndex(spark, index.root, buckets=4)
    other.refresh(frame(spark, [(1, "b", ""), (2, "zz", "")]))
    assert index.refresh(frame(spark, [(1, "b", ""), (3, "b", "")])) == {"added": 1, "changed": 0, "removed": 1, "kept": 1}
    assert index.version == 2 and hits(spark, index) == brute({1: "b", 3: "b"})


def test_bm25_over_hits(spark, index):
    index.refresh(frame(spark, [(1, "b a", ""), (2, "c", ""), (4, "b b b", "")]))
    asked = spark.createDataFrame([(1, "b"), (1, "none")], "query_id int, term string")
    assert {(r.query_id, r.doc_id) for r in retrieval.bm25(index.hits(asked), index.size, asked).collect()} == {(1, 1), (1, 4)}


def test_a_text_is_one_row_and_buckets_are_columns(spark, index):
    texts = {k: " ".join(f"t{k + i}" for i in range(50)) for k in range(20)} | {99: "b"}
    index.refresh(frame(spark, [(k, t, "") for k, t in texts.items()] + [(99, "b", "")]))
    postings = spark.read.parquet(index.state["segments"][-1]["path"] + "/postings")
    assert postings.count() == 21 and {f"b{b}" for b in range(4)} <= set(postings.columns)
    assert hits(spark, index) == brute({99: "b"})
    read = index.hits(spark.createDataFrame([("b",)], "term string"))._jdf.queryExecution().optimizedPlan().toString()
    assert sum(f"b{b}#" in read for b in range(4)) == 1
