"""Odd input of search, changes, messages, citations, directories and external sources."""

from pyspark.sql import functions as F

from loomspan.operators import chat as H
from loomspan.operators import external as X
from loomspan.operators import mutations as U
from loomspan.operators import search as S
from loomspan.operators import tree as T
from loomspan.streaming import progress as P


def ids(df, col="id"):
    return sorted(r[col] for r in df.collect())


def test_access(spark):
    rows = spark.createDataFrame([("a", "me"), ("b", None), ("c", "you"), ("d", "you"), (None, "you")], "id string, user_id string")
    grants = spark.createDataFrame([("b", "user", "me", "read"), ("b", "user", "me", "read"), ("c", "group", "g", "write"), ("d", "user", "you", "write"), (None, "user", "me", "read")], "resource_id string, kind string, grantee string, permission string")
    assert ids(S.accessible(rows, grants, "me", ["g"])) == ["a", "b", "c"]
    assert ids(S.accessible(rows, grants, "me", ["g"], "write")) == ["a", "c"]
    assert ids(S.accessible(rows, grants, "me", [])) == ["a", "b"]
    assert S.accessible(rows, grants, "x", [], admin=True).count() == 5
    assert ids(S.viewed(rows, "shared", "me").where("id IS NOT NULL")) == ["c", "d"] and S.viewed(rows, None, "me").count() == 5


def test_pages(spark):
    rows = spark.createDataFrame([(str(i), i // 2) for i in range(7)], "id string, updated_at int")
    order = [F.desc("updated_at"), F.col("id")]
    page, total = S.paged(rows, order, 2, 3)
    assert [r["id"] for r in page.collect()] == ["2", "3", "0"]
    assert total.first()["total"] == 7 and len(S.paged(rows, order, 0, 0)[0].collect()) == 1
    assert str(S.file_order("name", "asc")[0]) == str(F.col("filename").asc()) and str(S.file_order("odd", "asc")[0]) == str(F.col("updated_at").desc())


def test_changes(spark):
    t = spark.createDataFrame([("a", "x", 1), ("b", None, 1), (None, "z", 1)], "id string, name string, updated_at bigint")
    new = spark.createDataFrame([("a", "dup"), ("c", "n"), ("c", "n")], "id string, name string")
    assert sorted((r["id"] or "", r["updated_at"]) for r in U.insert_rows(t, new, ["id"]).collect()) == [("", 1), ("a", 1), ("b", 1), ("c", None)]
    got = {r["id"]: (r["name"], r["updated_at"]) for r in U.update_rows(t, spark.createDataFrame([("a", None), ("b", "n"), ("q", "n")], "id string, name string"), ["id"], F.lit(9).cast("bigint")).collect()}
    assert got == {"a": ("x", 9), "b": ("n", 9), None: ("z", 1)}
    assert U.delete_rows(t, spark.createDataFrame([("a",), (None,)], "k string"), [("id", "k")]).count() == 2
    models = spark.createDataFrame([("m", [("a",), ("b",), ("a",)]), ("n", None), ("o", [])], "id string, refs array<struct<id:string>>")
    left = {r["id"]: r["refs"] for r in U.without_reference(models, "refs", spark.createDataFrame([("a",)], "id string")).collect()}
    assert [x["id"] for x in left["m"]] == ["b"] and left["n"] is None and left["o"] == []


def test_swap_keeps_other_files(spark):
    old = spark.createDataFrame([("1", "k", "f"), ("2", "k", "g")], "id string, knowledge_id string, file_id string")
    new = spark.createDataFrame([("1", "k", "f"), ("3", "k", "f")], "id string, knowledge_id string, file_id string")
    assert ids(U.swap_vectors(old, new)) == ["1", "2", "3"]


def test_tool_pairs(spark):
    rows = [(1, 1, "assistant", "", ["a", "b"], None), (1, 2, "tool", "r", None, "a"), (1, 3, "tool", "r", None, "zz"), (1, 4, "assistant", "", ["c"], None), (1, 5, "assistant", "text", ["c"], None), (1, 6, "user", None, None, None), (2, 1, "tool", "r", None, "a"), (1, 7, "tool", "r", None, None)]
    df = spark.createDataFrame(rows, "conv int, pos int, role string, content string, tool_calls array<string>, tool_call_id string")
    got = {(r["conv"], r["pos"]): r["tool_calls"] for r in H.sanitize_tool_pairs(df).collect()}
    assert set(got) == {(1, 1), (1, 2), (1, 5), (1, 6)} and got[(1, 1)] == ["a"] and not got[(1, 5)]
    assert H.sanitize_tool_pairs(df.where("false")).count() == 0


def test_texts_of_messages(spark):
    df = spark.createDataFrame([("a <$x|L> b </y|M> <$z>",), ("plain ",), ("[1, 2",), ('[{"type":"text","text":"t"},{"type":"image"}]',), (None,)], "c string")
    got = df.select(H.mention_ids(F.col("c")).alias("i"), H.without_mentions(F.col("c")).alias("w"), H.text_parts(F.col("c")).alias("p")).collect()
    assert got[0]["i"] == ["x", "y", "z"] and got[0]["w"] == "a L b M" and got[1]["w"] == "plain " and got[2]["p"] == ["[1, 2"] and got[3]["p"] == ["t"] and got[4]["p"] == []


def test_replies(spark):
    df = spark.createDataFrame([('x {"queries": ["a"]} {"queries": ["b"]}',), ('{"queries": []}',), ("{oops",), ("plain",), (None,)], "r string")
    assert [r[0] for r in df.select(H.generated_queries(F.col("r"), F.lit("last"))).collect()] == [["b"], ["last"], [""], ["plain"], ["last"]]
    df = spark.createDataFrame([('```json\n{"claims": [{"text": "t", "supported": "yes"}]}\n```',), ("no",), ("{broken}",)], "r string")
    assert [len(r[0] or []) for r in df.select(H.judged_claims(F.col("r"))).collect()] == [1, 0, 0]


def test_citations_of_odd_results(spark):
    rows = [("1", "search_web", "", "", "[]"), ("2", "search_web", "", "", "{}"), ("3", "view_file", "", "", '{"error": "x"}'), ("4", "view_file", "", "", "{}"), ("5", "fetch_url", "", "", "p" * 600), ("6", "calc", None, "id7", "42"), ("7", "query_knowledge_files", "", "", '[{"content":"a","file_id":"f","source":"s"},{"content":"b","note_id":"n"},{"content":"c","file_id":"f","source":"t"}]'), ("8", "view_file", "", "", None)]
    out = H.citations(spark.createDataFrame(rows, "call string, tool string, url string, tool_id string, result string")).collect()
    got = {}
    for r in out:
        got.setdefault(r["call"], []).append((r["source_no"], r["source_id"], r["name"], r["doc_no"], r["document"]))
    assert set(got) == {"4", "5", "6", "7"} and got["4"] == [(1, "", "Unknown File", 1, "")] and got["5"][0][1] == "fetch_url" and len(got["5"][0][4]) == 503 and got["6"][0][1] == "id7"
    assert sorted(got["7"]) == [(1, "f", "s", 1, "a"), (1, "f", "s", 2, "c"), (2, "n", "Unknown", 1, "b")]


def test_retrieved_texts(spark):
    hits = [("q", k, "f" if k % 2 else None, k, "" if k == 3 else "x" * 900) for k in range(1, 31)]
    df = spark.createDataFrame(hits, "conv string, rank int, file_id string, chunk_index int, content string")
    out = H.retriever_texts(df, spark.createDataFrame([("f", "name.md")], "id string, filename string")).first()["output"]
    assert out.startswith("[Retrieved 15 chunks from 2 documents]\n\n\n=== Document 1: name.md ===\n\nx") and "=== Document 2: Unknown ===" in out and len(out) < 13_000


def test_directories(spark):
    d = spark.createDataFrame([("1", "k", None, "a", 1), ("2", "k", None, "a", 2), ("3", "k", "1", "b", 1), ("4", "k", "1", "b", 0)], "id string, knowledge_id string, parent_id string, name string, created_at int")
    assert ids(T.named_once(d)) == ["1", "2", "4"]
    moves = spark.createDataFrame([("1", "3"), ("2", "1"), ("3", None), ("4", "gone")], "id string, target string")
    assert {r["id"]: r["parent_id"] for r in T.moved(d, moves).collect()} == {"1": None, "2": "1", "3": None, "4": "1"}


def test_external(spark):
    df = spark.createDataFrame([("Qdrant ", "n", "e", {"timeout": "1", "x": "2"}), ("odd", "n", "e", None), ("milvus", " ", "e", None), ("milvus", "n", None, None), (None, "n", "e", None)], "p string, n string, e string, c map<string,string>")
    got = [r[0] for r in df.select(X.valid_connection(F.col("p"), F.col("n"), F.col("e"), F.col("c"))).collect()]
    assert got[0]["error"] is None and got[0]["config"] == {"timeout": "1"} and all(r["error"] and r["config"] is None for r in got[1:])


def test_streams_end(spark):
    rows = [(1, 1, "pending"), (1, 2, "completed"), (1, 3, "pending"), (2, 1, None)]
    out = P.until_ended(spark.createDataFrame(rows, "k int, t int, status string"), ["k"], ["t"])
    assert sorted((r["k"], r["t"]) for r in out.collect()) == [(1, 1), (1, 2), (2, 1)]
