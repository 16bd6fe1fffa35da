"""Publication of several tables: whole or not at all, also against a second writer."""

import pytest

from lodestone.operators.maintenance import Transaction
from lodestone.operators.manifest import Conflict, Manifest
from lodestone.scratch import scratch_path


@pytest.fixture
def root(spark):
    return scratch_path(spark, "manifest")


def rows(spark, root, table):
    return sorted(r[0] for r in Transaction(spark, root).read(table).collect())


def test_a_version_is_created_once(spark, root):
    m = Manifest(spark, root)
    assert m.latest() == (0, {})
    assert m.commit(1, {"a": "x"}) and not m.commit(1, {"a": "y"}) and m.latest() == (1, {"a": "x"})
    assert m.commit(2, {"a": "z"}) and m.latest() == (2, {"a": "z"}) and m.at(1) == {"a": "x"}


def test_death_between_the_steps_leaves_the_last_version(spark, root):
    with Transaction(spark, root) as tx:
        tx.put("a", spark.range(2))
        tx.put("b", spark.range(3))
    dying = Transaction(spark, root)  # never reaches its commit
    dying.put("a", spark.range(9))
    assert rows(spark, root, "a") == [0, 1]
    dying.put("b", spark.range(9))
    assert rows(spark, root, "a") == [0, 1] and rows(spark, root, "b") == [0, 1, 2]


def test_an_error_removes_what_was_written(spark, root):
    with Transaction(spark, root) as tx:
        tx.put("a", spark.range(2))
    with pytest.raises(InterruptedError), Transaction(spark, root) as tx:
        tx.put("a", spark.range(5))
        written = tx.staged["a"]
        raise InterruptedError
    assert rows(spark, root, "a") == [0, 1] and not tx.manifest.fs.exists(tx.manifest._path(written))


def test_two_writers(spark, root):
    with Transaction(spark, root) as tx:
        tx.put("a", spark.range(1))
        tx.put("b", spark.range(1))
    first, second, third = (Transaction(spark, root) for _ in range(3))
    first.put("a", spark.range(2))
    second.put("b", spark.range(2))
    third.put("a", third.read("b"))
    assert first.__exit__(None) is False
    assert second.__exit__(None) is False  # other tables: both stay
    assert rows(spark, root, "a") == [0, 1] and rows(spark, root, "b") == [0, 1]
    with pytest.raises(Conflict, match="a, b"):
        third.__exit__(None)
    assert Manifest(spark, root).latest()[0] == 3


def test_a_block_reads_its_own_snapshot(spark, root):
    with Transaction(spark, root) as tx:
        tx.put("a", spark.range(1))
    reader = Transaction(spark, root)
    with Transaction(spark, root) as tx:
        tx.put("a", spark.range(4))
    assert reader.read("a").count() == 1 and Transaction(spark, root).read("a").count() == 4
