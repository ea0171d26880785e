"""Operators at sizes where rows of pairs would show: what they shuffle, and results over blocks."""

import math

import pytest
from pyspark.sql import functions as F

from loomspan.operators import retrieval


def shuffled(spark, make):
    """Rows of what ``make`` gives, and the number of records that were shuffled for it."""
    sc = spark.sparkContext._jsc.sc()
    quantiles = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def written():
        sc.listenerBus().waitUntilEmpty(30_000)
        stages = sc.statusStore().stageList(None, False, False, quantiles, spark.sparkContext._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = written()
    rows = make().collect()
    return rows, written() - before


def scoped_texts(spark, n):
    texts = [("a" if i % 3 else "b", f"i{i:04d}", f"common w{i % 7} w{i % 11} w{i % 11}" if i % 50 else None) for i in range(n)]
    asked = [("a" if i % 4 else "b", f"q{i:04d}", f"Common w{i % 5}, w{i % 13}? unknown") for i in range(n)]
    return texts, asked, spark.createDataFrame(texts, "scope string, item_id string, text string"), spark.createDataFrame(asked, "scope string, query_id string, text string")


def brute_bm25(texts, asked, k):
    words = {i: (s, None if t is None else t.lower().split()) for s, i, t in texts}
    best = {}
    for scope in ("a", "b"):
        own = {i: w for i, (s, w) in words.items() if s == scope}
        mean = sum(len(w) for w in own.values() if w is not None) / sum(w is not None for w in own.values())
        df = {}
        for w in own.values():
            for x in set(w or []):
                df[x] = df.get(x, 0) + 1
        for s, q, t in asked:
            if s == scope:
                wanted, found = {x.strip(",?") for x in t.lower().split()}, []
                for i, w in own.items():
                    if hit := wanted & set(w or []):
                        found.append((-round(sum(math.log(1 + (len(own) - df[x] + 0.5) / (df[x] + 0.5)) * w.count(x) * 2.2 / (w.count(x) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for x in hit), 6), i))
                best[q] = [(i, -x) for x, i in sorted(found)[:k]]
    return best


@pytest.mark.parametrize("block", [16384, 40])
def test_bm25_makes_no_rows_of_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(retrieval, "ITEM_BLOCK", block, raising=False)
    texts, asked, items, queries = scoped_texts(spark, 300)
    rows, records = shuffled(spark, lambda: retrieval.bm25_topk(items, queries, 7))
    got = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append((r["item_id"], r["score"]))
    want = brute_bm25(texts, asked, 7)
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}
    assert all(abs(a[1] - b[1]) < 2e-6 for q in want for a, b in zip(got[q], want[q]))
    if block > 300:  # over 40,000 pairs share a scope and a word
        assert records < 15_000


@pytest.mark.parametrize("block", [16384, 40])
def test_scoped_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(retrieval, "ITEM_BLOCK", block)
    monkeypatch.setattr(retrieval, "SCORES", 500)
    vec = lambda i: None if i % 41 == 0 else [] if i % 43 == 0 else [0.0, 0.0] if i % 7 == 0 else [1.0, float(i % 9)] if i % 5 else [1.0, 2.0, float(i % 4)]
    own = [("a" if i % 3 else "b", i, vec(i)) for i in range(200)] + [(None, 900, [1.0, 1.0])]
    asked = [("a" if i % 4 else "b", f"q{i:04d}", vec(i + 3)) for i in range(150)] + [("c", "qc", [1.0, 1.0]), ("a", "qn", [None, 1.0])]
    items = spark.createDataFrame(own, "scope string, item_id bigint, embedding array<double>")
    rows = retrieval.scoped_topk(items, spark.createDataFrame(asked, "scope string, query_id string, embedding array<double>"), 6).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append((r["item_id"], r["score"]))
    want = {}
    for scope, q, v in asked:
        found = []
        for s, i, w in own:
            if s == scope and v and w and len(v) == len(w):
                norm = 0 if None in v else math.sqrt(sum(x * x for x in v) * sum(x * x for x in w))
                found.append((-round(sum(x * y for x, y in zip(v, w)) / norm if norm else 0.0, 6), i))
        if found:
            want[q] = [(i, -x) for x, i in sorted(found)[:6]]
    assert got == want


def test_hybrid_reads_chunks_a_fixed_number_of_times(spark, small, monkeypatch):
    """However many blocks of questions there are."""
    from loomspan.plans import knowledge

    def scans():
        plan = knowledge.hybrid_topk(spark, small)._jdf.queryExecution().optimizedPlan().toString()
        return plan.count("mapInArrow") + plan.count("MapInArrow") + plan.count("Relation")

    once = scans()
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 5)
    assert scans() == once


def test_letter_vectors(spark):
    from loomspan.plans.knowledge import _letter_vectors

    rows = [(1, "Abba zÅ 中z"), (2, None), (3, ""), (4, "中K")]
    got = {r["n"]: r["embedding"] for r in _letter_vectors(spark.createDataFrame(rows, "n int, text string"), "text").collect()}
    assert got[2] is None and got[3] == [0.0] * 26 and sum(got[4]) == got[4][10] == 1.0
    assert (got[1][0], got[1][1], got[1][25], sum(got[1])) == (2.0, 2.0, 2.0, 6.0)


def test_chains(spark):
    from loomspan.operators import chat

    n = 700  # a long chain, a tree, a missing parent and a cycle with a way into it
    rows = [(i, i - 1 if i else None) for i in range(40)] + [(1000 + i, 1000 + i // 2 if i else None) for i in range(n)] + [(5000, 4999), (5001, 5000)] + [(6000, 6002), (6001, 6000), (6002, 6001), (6003, 6002), (6004, 6003)]
    up = dict(rows)
    leaves = [39, 17, 5001, 6004, 6001] + [1000 + i for i in range(n // 2, n)]
    want = {}
    for leaf in leaves:
        way, x = [], leaf
        while x in up and x not in way:
            way.append(x)
            x = up[x]
        want[leaf] = way[::-1]
    messages = spark.createDataFrame([(i, p, f"r{i}") for i, p in rows], "id bigint, parent_id bigint, role string")
    found, records = shuffled(spark, lambda: chat.chains(messages, spark.createDataFrame([(x,) for x in leaves], "id bigint")))
    got = {}
    for r in sorted(found, key=lambda r: r["place"]):
        assert r["role"] == f"r{r['id']}" and r["place"] == len(got.setdefault(r["leaf"], [])) + 1
        got[r["leaf"]].append(r["id"])
    assert got == want


def test_message_chain_shuffles_less_than_its_result(spark, small):
    """Ways are rows only at the end; joined with the messages row by row, they were shuffled several times over."""
    from loomspan.plans import chat

    found, records = shuffled(spark, lambda: chat.message_chain(spark, "/root/testdata/sf0.01"))
    assert records < 3 * len(found), (records, len(found))
