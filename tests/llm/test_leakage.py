import random

from loomspan.llm.leakage import leaked_items


def plain(t):
    return "".join(c for c in (t or "").casefold() if c.isalpha() or c.isdecimal())


def brute(docs, items, span):
    out = set()
    for i, t in items:
        p = plain(t)
        windows = {p[k : k + span] for k in range(len(p) - span + 1)}
        out |= {(d, i) for d, x in docs if any(plain(x)[k : k + span] in windows for k in range(max(0, len(plain(x)) - span + 1)))}
    return out


def test_against_brute_force(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6)))
    items = [(i, " ".join(word() for _ in range(40))) for i in range(12)] + [(90, "short"), (91, ""), (92, None), (0, "Straße №5 " * 12)]
    docs = [(i, " ".join(word() for _ in range(60))) for i in range(40)]
    for k in range(30):
        i, t = r.choice(items[:12])
        at = r.randint(0, 60)
        cut = t[at : at + r.randint(40, 120)]
        docs.append((100 + k, "Intro. " + r.choice([cut.upper(), cut.replace(" ", " - "), "​".join(cut), cut, cut.replace(" ", "\n\n")]) + " end"))
    docs += [(200, "STRASSE 5 " * 12), (201, None), (202, ""), (202, items[0][1]), (202, items[0][1]), (203, items[1][1] + " x " + items[2][1])]
    d = spark.createDataFrame([(*x, "z") for x in docs], "doc_id bigint, text string, item_id string")
    i = spark.createDataFrame([(*x, "z") for x in items], "item_id bigint, text string, doc_id string")
    got = leaked_items(d, i, span=50).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == brute(docs, items, 50)
    assert len(got) == len({(r["doc_id"], r["item_id"]) for r in got}) and all(r["span"] >= 50 for r in got)


def test_empty(spark):
    d = spark.createDataFrame([(1, "a" * 100)], "doc_id bigint, text string")
    i = spark.createDataFrame([(1, "a" * 100)], "item_id bigint, text string")
    assert leaked_items(d.where("false"), i).count() == 0
    assert leaked_items(d, i.where("false")).count() == 0
    assert leaked_items(d, i).count() == 1
