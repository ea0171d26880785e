import uuid

from hypothesis import given, settings
from hypothesis import strategies as st

from loomspan.operators.orphans import Child, Parent, orphan_references, orphan_report

A, B = str(uuid.UUID(int=2**127 + 5)), str(uuid.UUID(int=2**127 + 6))


def run(spark, children, parents, deleted=()):
    c = spark.createDataFrame(children, "id string, ref string, created bigint, entity string, bucket string")
    p = spark.createDataFrame(parents, "id string, created bigint, hi string")
    d = spark.createDataFrame(list(deleted), "entity string, entity_id string")
    out = orphan_references([Child("t", c, "id", "ref", "created", "file")], [Parent("file", p, "id", "created")], d)
    return sorted(map(tuple, out.collect()), key=str)


def test_reasons_and_spelling(spark):
    children = [
        ("1", f" {A.upper()}\n", 100, "x", "y"), ("2", B, 100, "x", "y"), ("3", "gone", 0, "x", "y"), ("4", None, 1, "x", "y"), ("5", " 　", 1, "x", "y"),
        ("6", "nowhere", None, "x", "y"), ("7", "12", 5, "x", "y"), ("8", "14", 5, "x", "y"), ("8", "14", 5, "x", "y"), ("9", "13", 5, "x", "y"), ("10", "012", 5, "x", "y"),
    ]
    parents = [(A, 100, "h"), (B, 500, "h"), (B, 101, "h"), ("12", 1, "h"), ("13", 9, "h"), (None, 1, "h"), ("11", None, "h")]
    got = run(spark, children, parents, [("file", "GONE "), ("chunk", "nowhere"), ("file", A)])
    assert {(r[1], r[2]) for r in got} == {("2", "late"), ("3", "deleted"), ("6", "missing"), ("8", "missing"), ("9", "late"), ("10", "missing")}
    assert {r[3] for r in got if r[1] == "6"} == {None}


def test_empty_tables(spark):
    assert run(spark, [], [(A, 1, "h")]) == []
    assert run(spark, [("1", A, 1, "x", "y")], []) == [("t", "1", "missing", "1970-01")]


def test_hot_key_comes_out_whole(spark):
    rows = [(str(i), "hot", 10, "x", "y") for i in range(3000)] + [("a", A, 10, "x", "y")]
    got = run(spark, rows, [(A, 1, "h")])
    assert len(got) == 3000 and {r[2] for r in got} == {"missing"}


def test_report(spark):
    c = spark.createDataFrame([("1", "x", 0), ("2", "x", 0), ("3", "y", 2_700_000)], "id string, ref string, created bigint")
    p = spark.createDataFrame([], "id string, created bigint")
    out = orphan_report(orphan_references([Child("t", c, "id", "ref", "created", "e")], [Parent("e", p, "id", "created")]))
    assert sorted((r["period"], r["n_records"]) for r in out.collect()) == [("1970-01", 2), ("1970-02", 1)]


@settings(max_examples=6, deadline=None)
@given(parents=st.sets(st.integers(0, 70_000), max_size=40), refs=st.lists(st.integers(0, 70_000), max_size=40), base=st.sampled_from([0, 65_530]))
def test_runs_against_brute_force(spark, parents, refs, base):
    parents = parents | {base + k for k in range(8)}
    got = run(spark, [(str(i), str(r), 1, "x", "y") for i, r in enumerate(refs)], [(str(p), 1, "h") for p in parents])
    assert {r[1] for r in got} == {str(i) for i, r in enumerate(refs) if r not in parents}


def test_kinds_of_keys_never_meet(spark):
    twelve = str(uuid.UUID(int=12))
    got = run(spark, [("1", twelve, 1, "x", "y"), ("2", "12", 1, "x", "y"), ("3", "13", 1, "x", "y")], [("12", 1, "h"), (str(uuid.UUID(int=13)), 1, "h")])
    assert {r[1] for r in got} == {"1", "3"}


def test_dense_and_time_ordered_keys(spark):
    ordered = lambda i: str(uuid.UUID(int=(0x0190_0000_0000 + i << 80) | (7 << 76) | (2 << 62) | i))
    children = spark.range(120_000).selectExpr("cast(id as string) id", "cast(id as string) ref", "5L created")
    children = children.unionByName(spark.createDataFrame([(f"u{i}", ordered(i), 5) for i in range(200)], "id string, ref string, created bigint"))
    parents = spark.range(110_000).selectExpr("cast(id as string) id", "if(id = 7, 9L, 1L) created")
    parents = parents.unionByName(spark.createDataFrame([(ordered(i), 1) for i in range(0, 200, 2)], "id string, created bigint"))
    out = orphan_references([Child("t", children, "id", "ref", "created", "e")], [Parent("e", parents, "id", "created")])
    got = {r["record_id"]: r["reason"] for r in out.collect()}
    assert len(got) == 10_101 and got["7"] == "late" and got["u1"] == "missing" and "u2" not in got
