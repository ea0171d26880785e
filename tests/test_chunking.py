"""Chunkers against plain restatements of their definitions, on random and on hand-made texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from loomspan.operators import chunking as C


def general(text, size=1000):
    out, cur, n = [], [], 0
    for p in (x.strip() for x in re.split(r"\n\n+", text)):
        if not p:
            continue
        if cur and n + len(p) > size:
            out.append("\n\n".join(cur))
            cur, n = [cur[-1], p], len(cur[-1]) + len(p)
        else:
            cur.append(p)
            n += len(p)
    return out + (["\n\n".join(cur)] if cur else [])


def markdown(text):
    out, header, rows, title, inside = [], None, 0, None, False
    for line in (x.strip() for x in text.split("\n")):
        if line.startswith("#"):
            if header and rows:
                header, rows = None, 0
            title, inside = line.lstrip("#").strip(), False
        elif "|" in line:
            if set(line) <= set("|-: \t"):
                continue
            if not inside:
                inside, header, rows = True, line, 0
            else:
                rows += 1
                names = [h.strip() for h in header.split("|") if h.strip()]
                cells = line.split("|")
                values = ([v.strip() for v in cells[1:-1]] if len(cells) > 2 else []) + [""] * len(names)
                out.append((f"表格: {title}\n\n" if title else "") + "\n".join(f"{h}: {v}" for h, v in zip(names, values)))
        elif inside and header and rows:
            header, rows, inside = None, 0, False
    return out


def qa(text):
    found = re.findall(r"(?:问题?[:：]|Q[:：])\s*(.+?)\s*(?:答案?[:：]|A[:：])\s*(.+?)(?=(?:问题?[:：]|Q[:：])|$)", text, re.S | re.I)
    return [f"问题: {q.strip()}\n答案: {a.strip()}" for q, a in found] or general(text)


def texts(seed, parts):
    r = random.Random(seed)
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(60)]


def spark_chunks(spark, rows, column):
    df = spark.createDataFrame(list(enumerate(rows)), "i int, t string")
    got = {r["i"]: [x["content"] for x in r["c"]] for r in df.select("i", column(F.col("t")).alias("c")).collect()}
    return [got[i] for i in range(len(rows))]


def test_general(spark):
    rows = texts(1, ["\n\n", "\n", " ", "word " * 20, "长" * 90, "x" * 1200, "　", "\n\n\n"])
    assert spark_chunks(spark, rows, C.general) == [general(t) for t in rows]


def test_markdown_rows(spark):
    rows = texts(2, ["\n", "| a | b |\n", "|---|---|\n", "| 1 | 2 | 3 |\n", "# Title\n", "text\n", "a | b\n", "|x|\n", "## \n"])
    assert spark_chunks(spark, rows, C.markdown_rows) == [markdown(t) for t in rows]


def test_qa(spark):
    rows = texts(3, ["Q: ", "A: ", "问：", "答案: ", "问题:", "one", " two\n", "q: ", "é"])
    rows = [t for t in rows if t]
    assert spark_chunks(spark, rows, lambda t: C.pieces(t, "qa")) == [qa(t) for t in rows]


def test_naive_covers_the_text(spark):
    rows = ["", "a", "x" * 500, "y" * 501, "你" * 1300]
    got = spark_chunks(spark, rows, C.naive)
    assert got[0] == [] and [len(c) for c in got[3]] == [500, 51] and "".join(c[:450] for c in got[4][:-1]) + got[4][-1] == rows[4]
    with pytest.raises(ValueError):
        C.naive(F.col("t"), 10, 10)


def test_table_and_fallbacks(spark):
    rows = ["a, b\n1,2,3\n\n4", "# a,b\nplain text", "| h |\n| 1 |", "h,x"]
    got = spark_chunks(spark, rows, C.table)
    assert got == [["a: 1\nb: 2", "a: 4\nb: "], ["# a,b\nplain text"], [], []] or got[2] == markdown(rows[2])
    assert spark_chunks(spark, ["no structure"], lambda t: C.pieces(t, "paper")) == [["no structure"]]
    assert spark_chunks(spark, ["x"], lambda t: C.pieces(t, "unknown")) == [["x"]]


def test_sections(spark):
    text = "Abstract\n" + "a" * 60 + "\nConclusion\nshort\nReferences\n" + "b" * 70
    assert spark_chunks(spark, [text], C.paper) == [["Abstract\n" + "a" * 60, "References\n" + "b" * 70]]
    book = "Chapter 1\n" + "\n".join(["w" * 200 + "."] * 20) + "\nSmall\nx."
    got = spark_chunks(spark, [book], C.book)[0]
    assert len(got) == 2 and got[0].startswith("Chapter 1") and len(got[0]) > 3000


def test_nulls_and_custom_method(spark):
    df = spark.createDataFrame([(1, None, "z"), (2, "", "z"), (3, "abc", "z")], "doc_id int, text string, content string")
    assert [r["doc_id"] for r in C.chunk_documents(df, "general").collect()] == [3]
    C.register_chunker("whole", lambda t: F.array(F.struct(F.lit("t").alias("title"), t.alias("content"))))
    assert C.chunk_documents(df, "whole").collect()[0]["content"] == "abc"


def test_questions_and_keywords(spark):
    df = spark.createDataFrame([(1, "这是一个超过十个字符的句子吧。短。如何处理这个很长的句子呢？", "x"), (2, None, "x")], "doc_id int, text string, word string")
    got = df.where("doc_id = 1").select(C.questions(F.col("text"))).first()[0]
    assert len(got) == 3 and got[2] == C.DEFAULT_QUESTION and got[1].startswith("如何处理")
    words = spark.createDataFrame([(1, "苹果 香蕉 苹果 梨 葡萄", "x")], "doc_id int, text string, word string")
    assert [(r["rank"], r["word"], r["n"]) for r in C.keywords(words).orderBy("rank").collect()] == [(1, "苹果", 2), (2, "香蕉", 1), (3, "葡萄", 1)]


def test_sections_are_linear_in_lines(spark):
    import time

    text = "\n".join("abstract" if k % 40 == 0 else f"line {k} of the text" for k in range(40_000))
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    began = time.time()
    assert df.select(F.size(C.paper(F.col("text")))).first()[0] == 1000
    assert time.time() - began < 20
