from datetime import datetime

from quillgraph.operators.references import orphan_report, orphans, parents, references
from quillgraph.plans import skew
from quillgraph.plans.skew import Bloom, join_many, join_unique

T = [datetime(2024, m, 1) for m in range(1, 8)]
CHILD = "id long, name string, loaded_at timestamp_ntz, key string"
PARENT = "name string, loaded_at timestamp_ntz"
GONE = "table_name string, row_key string, removed_at timestamp_ntz"


def found(spark, child, parent, gone, **more):
    refs = references(spark.createDataFrame(child, CHILD), "c", "name", "p")
    known = parents(spark.createDataFrame(parent, PARENT), "p", "name", spark.createDataFrame(gone, GONE))
    return orphans(refs, known, **more)


def test_kinds_and_periods(spark):
    child = [(1, "here", T[1], "x"), (2, "late", T[1], "x"), (3, "gone", T[2], "x"), (4, "never", T[3], "x"), (4, "never", T[2], "x"), (5, None, T[1], "x"), (6, "back", T[1], "x"), (7, "only log", T[4], "x"), (8, "", T[1], None)]
    parent = [("here", T[0]), ("late", T[2]), ("gone", T[0]), ("back", T[0]), ("back", T[5]), (None, T[0])]
    gone = [("p", "gone", T[3]), ("p", "gone", T[3]), ("p", "back", T[3]), ("p", "only log", T[0]), ("q", "here", T[6])]
    rows = {(r.row_id, r.kind, r.period) for r in found(spark, child, parent, gone).collect()}
    assert rows == {(2, "late", "2024-02"), (3, "removed", "2024-03"), (4, "missing", "2024-03"), (7, "removed", "2024-05"), (8, "missing", "2024-02")}


def test_empty_tables(spark):
    assert found(spark, [], [], []).count() == 0
    assert [r.kind for r in found(spark, [(1, "a", T[0], "x")], [], []).collect()] == ["missing"]


def test_report_counts(spark):
    df = found(spark, [(i, "never", T[0], "x") for i in range(5)], [("a", T[0])], [])
    assert [(r.n_references, r.n_rows, r.kind) for r in orphan_report(df).collect()] == [(5, 5, "missing")]


def test_join_unique_keeps_hot_null_and_unmatched_rows(spark, monkeypatch):
    monkeypatch.setattr(skew, "FEW", 1000)
    left = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i}") for i in range(20_001)] + [(-1, None)], "id int, k string")
    right = spark.createDataFrame([("hot", 1), ("k2", 2)], "k string, v int")
    out = join_unique(left, right, "k", "left")
    assert out.count() == 20_002
    assert out.filter("v = 1").count() == 10_000 and out.filter("v = 2").count() == 1 and out.filter("id = -1 AND v IS NULL").count() == 1
    assert join_unique(left, right, "k", "inner").count() == 10_001


def test_filters_of_bounded_size_find_the_same(spark):
    child = [(i, f"n{i}", T[1], "x") for i in range(600)]
    parent = [(f"n{i}", T[0]) for i in range(0, 600, 2)]
    rows = {(r.row_id, r.kind) for r in found(spark, child, parent, [], words=16).collect()}
    assert rows == {(i, "missing") for i in range(1, 600, 2)}


def test_bloom_filter_never_misses_and_rules_out_most(spark):
    keys = spark.range(5000).selectExpr("concat('k', id) AS k")
    for words in (1 << 21, 64):
        bloom = Bloom(keys, "k", words)
        assert (bloom.n_filters > 1) == (words == 64)
        assert bloom.table.groupBy("__filter").count().filter(f"count > {words}").count() == 0
        assert bloom.test(keys, "k").filter("NOT maybe").count() == 0
        others = spark.range(5000).selectExpr("concat('x', id) AS k").unionByName(spark.sql("SELECT CAST(NULL AS string) AS k"))
        tested = bloom.test(others, "k")
        assert tested.count() == 5001 and tested.filter("maybe").count() < 150 and tested.filter("k IS NULL AND NOT maybe").count() == 1


def test_many_to_many_join_splits_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(skew, "FEW", 0)
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 50}") for i in range(30_000)] + [(-1, None)], "a int, k string")
    right = spark.createDataFrame([(1, "hot"), (2, "hot"), (3, "k3"), (4, "none"), (5, None)], "b int, k string")
    plain = left.join(right, "k")
    for x, y in ((left, right), (right, left)):
        met = join_many(x, y, "k").select("a", "b", "k")
        assert met.count() == plain.count() and met.exceptAll(plain.select("a", "b", "k")).count() == 0


def test_a_cluster_needs_a_shared_folder(spark):
    from types import SimpleNamespace

    import pytest

    from quillgraph.session import shared_folder

    other = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(other)
