import json

from pyspark.sql import functions as F

from loomspan.operators import messages as M
from loomspan.sources import files as S


def test_texts_and_manifest(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / ".hidden").mkdir()
    (tmp_path / "a" / "u.txt").write_text("héllo", encoding="utf-8")
    (tmp_path / "g.txt").write_bytes("中文".encode("gbk"))
    (tmp_path / "bad.bin").write_bytes(b"\x00\xff\xff\xff")
    (tmp_path / "empty.txt").write_bytes(b"")
    (tmp_path / ".hidden" / "x.txt").write_text("no")
    got = {r["path"]: (r["text"], r["encoding"]) for r in S.text_files(spark, str(tmp_path)).collect()}
    assert got == {"a/u.txt": ("héllo", "utf-8"), "g.txt": ("中文", "gbk"), "bad.bin": (None, None)}
    kinds = {r["path"]: r["t"] for r in S.binary_files(spark, str(tmp_path)).select("path", S.is_text(F.col("content")).alias("t")).collect()}
    assert kinds == {"a/u.txt": True, "g.txt": True, "bad.bin": False}
    assert {r["path"]: r["size"] for r in S.manifest(spark, str(tmp_path)).collect()}["g.txt"] == 4


def test_json_sources_and_report(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps([{"id": "q1", "question": "x?", "golden_answer": "y", "context_chunks": [{"text": "t", "rank": 1}]}, {"id": "q2"}]))
    assert S.golden_set(spark, str(tmp_path / "g.json")).count() == 2 and S.golden_set(spark, str(tmp_path / "g.json"), 1).count() == 1
    (tmp_path / "d.json").write_text(json.dumps({"a.txt": "one", "b.txt": "two"}))
    docs = S.documents_map(spark, str(tmp_path / "d.json"))
    assert {tuple(r) for r in docs.collect()} == {("a.txt", "one"), ("b.txt", "two")}
    S.write_report(docs, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_glued_json(spark):
    rows = ['{"a": "}"}{"b": {"c": 1}} ', '{"a": 1', "[1]", "", None, '{"x": 1}']
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    assert [r[0] for r in df.select(M.split_json_objects(F.col("t"))).collect()] == [['{"a": "}"}', '{"b": {"c": 1}}'], None, None, None, None, ['{"x": 1}']]
