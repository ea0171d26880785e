import importlib

import duckdb
import pytest
from pyspark.sql import functions as F

from loomspan.operators import catalog, evaluation, messages, retrieval, tree
from loomspan.operators.chunk_table import merge_range, split_chunk
from loomspan.plans import CORE
from loomspan.streaming import progress


def norm(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    return str(v)


CASES = [(m, name) for m in CORE for name in importlib.import_module(f"loomspan.plans.{m}").SQL]


@pytest.fixture(scope="module")
def db(small):
    import os

    con = duckdb.connect()
    for f in os.listdir(small):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{small}/{f}')")
    return con


@pytest.mark.parametrize(("module", "name"), CASES)
def test_against_sql(spark, small, db, module, name):
    m = importlib.import_module(f"loomspan.plans.{module}")
    df = m.QUERIES[name](spark, small)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    res = db.execute(m.SQL[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in res.fetchall())


def test_merge_then_split(spark):
    df = spark.createDataFrame([("a", "k", "f", 0, "one", "m"), ("b", "k", "f", 1, "two", "n"), ("c", "k", "f", 2, "three", "o")], "id string, knowledge_id string, file_id string, pos bigint, content string, meta string")
    merged = merge_range(df, 0, 1)
    assert sorted((r["pos"], r["content"]) for r in merged.collect()) == [(0, "one\n\ntwo"), (1, "three")]
    back = split_chunk(merged, F.lit(4), F.col("pos") == 0)
    assert sorted((r["pos"], r["content"]) for r in back.collect()) == [(0, "one"), (1, "two"), (2, "three")]
    assert split_chunk(df, F.lit(0), F.lit(True)).count() == 3


def test_tree_cycles_and_missing_parents(spark):
    nodes = spark.createDataFrame([("a", None, "A"), ("b", "a", "B"), ("c", "b", "C"), ("x", "y", "X"), ("y", "x", "Y"), ("z", "gone", "Z")], "id string, parent_id string, name string")
    assert {r["id"] for r in tree.in_cycle(nodes).collect()} == {"x", "y"}
    paths = {r["id"]: r["path"] for r in tree.full_paths(nodes).collect()}
    assert paths["c"] == "A/B/C" and paths["z"] == "Z"


def test_sync_diff_null_checksum(spark):
    m = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "key string, checksum string")
    i = spark.createDataFrame([("b", "2"), ("c", None), ("d", "4")], "key string, checksum string")
    assert {(r[0], r[1]) for r in tree.sync_diff(m, i).collect()} == {("a", "added"), ("b", "unmodified"), ("c", "modified"), ("d", "deleted")}


def test_vector_topk_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 2)
    rows = [(i, [float(i % 3), float(i % 5), 1.0], i % 2) for i in range(12)] + [(99, None, 0), (98, [1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    got = retrieval.vector_topk(df, df.where("vec_id < 5"), k=3).collect()
    assert len(got) == 15 and all(r["query_id"] != r["item_id"] for r in got)
    assert retrieval.vector_topk(df, df.where("false")).count() == 0



def test_vector_topk_skips_no_query(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 2)
    vectors = [(1, [1.0, 0.0]), (2, [1.0, 0.5]), (2, [0.0, 1.0]), (2, [1.0, 1.0]), (3, [1.0, 0.0, 0.0]), (4, [0.0, 1.0]), (5, [0.0, 1.0, 0.0]), (None, [1.0, 0.0]), (6, [])]
    df = spark.createDataFrame([(*x, 0) for x in vectors], "vec_id bigint, embedding array<float>, label int")
    got = {(r["query_id"], r["item_id"]) for r in retrieval.vector_topk(df, df, k=9).collect()}
    assert got == {(a, b) for ids in ((1, 2, 4), (3, 5)) for a in ids for b in ids if a != b}
    repeats = [r["score"] for r in retrieval.vector_topk(df, df.where("vec_id = 2"), k=9).where("item_id = 4").collect()]
    assert len(repeats) == 3


def test_metrics_with_nulls(spark):
    rows = [("k", "q", None, 0, 1), ("k", "q", "c", 2, 1), ("k", "q", "c", 2, 1), ("k", "p", "d", 1, 0)]
    df = spark.createDataFrame(rows, "knowledge_id string, query_text string, chunk_id string, rank_position bigint, relevance bigint")
    got = evaluation.retrieval_metrics(df).collect()
    assert [(r["query_text"], r["n_relevant"], r["recall"], r["mrr"]) for r in got] == [("q", 2, 0.5, 0.5)]


def test_gate_of_nothing(spark):
    got = evaluation.gate(spark.createDataFrame([], "faithfulness double")).first()
    assert (got["n_items"], got["mean_faithfulness"], got["passed"]) == (0, 0.0, False)


def test_progress_stream_equals_batch(spark, small, tmp_path):
    schema = spark.read.parquet(f"{small}/events.parquet").schema
    (tmp_path / "in").mkdir()
    import shutil

    shutil.copy(f"{small}/events.parquet", tmp_path / "in")
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = progress.start_progress(stream, "progress_now", str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = {tuple(map(norm, r)) for r in spark.table("progress_now").collect()}
    assert got == {tuple(map(norm, r)) for r in progress.progress_of(spark.read.parquet(f"{small}/events.parquet")).collect()}


def test_upsert_keeps_set_values(spark):
    df = spark.createDataFrame([("k", 1, "a", 5), ("k", 2, "b", None)], "k string, ts int, status string, total int")
    r = progress.upsert(df, ["k"], ["ts"], ["status"], ["total"]).first()
    assert (r["status"], r["total"], r["n_events"]) == ("b", 5, 2)
    assert not progress.all_done(spark.createDataFrame([], "status string")).first()["all_done"]


def test_sse_and_glob(spark):
    df = spark.createDataFrame([("data: {\"a\": 1}",), ("data: [DONE]",), ("",), ("data: {broken",), (None,)], "l string")
    assert [r[0] for r in df.select(messages.parse_sse(F.col("l"))).collect()] == ['{"a": 1}', None, None, None, None]
    assert catalog.glob("a_*.m?") == "a\\_%.m_"


def test_deep_chains(spark):
    n = 150
    nodes = spark.createDataFrame([(str(i), str(i - 1) if i else None, f"n{i}") for i in range(n)], "id string, parent_id string, name string")
    up = tree.ancestors(nodes)
    assert up.count() == n * (n + 1) // 2 and up.where("id = '149' AND ancestor_id = '0'").first()["distance"] == 149
