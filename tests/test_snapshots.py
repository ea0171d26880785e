import json

from loomspan.operators.snapshots_diff import change_counts, snapshot_changes

SCHEMA = "id string, knowledge_id string, label string, created_at bigint, snapshot_data string, hash string"


def doc(files=(), chunks=(), **more):
    return json.dumps({"files": [{"file_id": f, "filename": n, "directory_id": None} for f, n in files], "chunks": [dict(id=i, **c) for i, c in chunks], **more})


def run(spark, rows):
    df = spark.createDataFrame([(*r, "h") for r in rows], SCHEMA)
    return {tuple(r) for r in snapshot_changes(df).collect()}


def test_added_removed_changed(spark):
    rows = [
        ("s1", "k", "v1", 10, doc([("a", "x"), ("b", "y")], [("c", {"n": 7})])),
        ("s3", "k", "run 3", 11, doc([("a", "x2"), ("d", "z")], [("c", {"n": "7", "extra": None})])),
        ("s4", "k", "V 4", 12, doc([("d", "z"), ("d", "z")], [("c", {"n": 7.0})])),
    ]
    assert run(spark, rows) == {("k", "s3", "file", "a", "changed"), ("k", "s3", "file", "b", "removed"), ("k", "s3", "file", "d", "added"), ("k", "s4", "file", "a", "removed")}


def test_which_deliveries_count(spark):
    rows = [
        ("s1", "k", "1", 10, doc([("a", "x")])), ("bad", "k", "2", 99, doc([("q", "x")])[:-9]), ("s2a", "k", "2", 20, doc([("b", "x")])), ("s2b", "k", "2", 30, doc([("a", "x")])), ("s2b", "k", "2", 30, doc([("a", "x")])),
        ("adhoc", "k", "before cleanup", 40, doc([("z", "x")])), ("none", "k", None, 41, doc()), ("null", "k", "3", 42, None), ("arr", "k", "4", 43, "[1]"), ("s5", "k", "快照 ５", 5, '{"files": null}'),
    ]
    assert run(spark, rows) == {("k", "s5", "file", "a", "removed")}


def test_empty_and_first(spark):
    assert run(spark, []) == set()
    assert run(spark, [("s", "k", "1", 1, doc([("a", "x")]))]) == set()


def test_same_is_empty_and_counts(spark):
    df = spark.createDataFrame([("s1", "k", "1", 1, doc([("a", "x")]), "h"), ("s2", "k", "2", 2, doc([("b", "x"), ("c", "y")]), "h")], SCHEMA)
    assert {(r["delta"], r["n_records"]) for r in change_counts(snapshot_changes(df)).collect()} == {("added", 2), ("removed", 1)}
    assert run(spark, [("s1", "k", "1", 1, doc([("a", "x")])), ("s2", "k", "2", 2, doc([("a", "x")]))]) == set()
