import random

import numpy as np

from loomspan.llm import near_duplicates as N


def jaccard(a, b):
    a, b = N.normalise(a), N.normalise(b)
    s, t = ({x[i : i + 5] for i in range(len(x) - 4)} for x in (a, b))
    return len(s & t) / len(s | t) if s and t else 0


def brute(rows):
    rows = sorted({(i, t) for i, t in rows if i is not None and t is not None})
    return {(min(a, b), max(a, b)) for k, (a, t) in enumerate(rows) for b, u in rows[:k] if a != b and jaccard(t, u) >= 0.7}


def family(r, base, n):
    out = [base]
    for _ in range(n):
        words = r.choice(out).split()
        for _ in range(r.randint(0, 4)):
            k = r.randrange(len(words))
            words[k : k + r.choice([0, 1])] = r.choice([[], [r.choice(words)], ["Xq" + str(r.randint(1, 99))]])
        out.append(r.choice([" ".join(words), "  ".join(words).upper(), "p. 3 " + " ".join(words)]))
    return out


def test_against_brute_force(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 9)))
    rows = []
    for f in range(12):
        for k, t in enumerate(family(r, " ".join(word() for _ in range(r.choice([8, 60, 200]))), 5)):
            rows.append((f"{f:02d}-{k}", t))
    rows += [("z1", "----------====++++;;;;::::12345"), ("z2", "----------====++++;;;;::::12346"), ("e1", ""), ("e2", "abcd"), ("e3", None), (None, rows[0][1]), rows[0], ("c1", rows[0][1]), ("c2", rows[0][1].upper())]
    df = spark.createDataFrame([(*x, "s") for x in rows], "id string, content string, cls string")
    members, links = N.similar_classes(df)
    got = [(x["chunk_a"], x["chunk_b"]) for x in N.similar_pairs(members, links).collect()]
    want = brute(rows)
    assert len(got) == len(set(got)) and set(got) == want
    parts = {x["id"]: x["group_id"] for x in N.groups(members, links).collect()}
    assert all(parts[a] == parts[b] for a, b in want) and parts["02-0"] != parts["03-0"] and "e2" not in parts
    classes = {x["id"]: (x["class_id"], x["copies"], x["n_links"]) for x in N.memberships(members, links).collect()}
    assert classes["c2"][:2] == ("00-0", 3) and classes["c1"] == classes["c2"] and "e3" not in classes
    big = N.similar_pairs(members, links, expand=2).collect()
    assert {("00-0", "c1"), ("00-0", "c2")} <= {(x["chunk_a"], x["chunk_b"]) for x in big} and not {("c1", "c2")} & {(x["chunk_a"], x["chunk_b"]) for x in big}


def test_empty(spark):
    df = spark.createDataFrame([], "id string, content string")
    members, links = N.similar_classes(df)
    assert N.similar_pairs(members, links).count() == 0 and N.groups(members, links).count() == 0


def recurring(share, letters, hot, n, seed):
    """A base text in ``hot`` rows with small changes, and ``n`` versions with ``share`` of its length put in as one block."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 9)))
    text = lambda size: " ".join(word() for _ in range(size))[:size]
    base = text(letters)
    rows = [(f"h{k:03d}", base + " " + word()) for k in range(hot)]
    for k in range(n):
        at = r.choice([len(base), r.randrange(len(base))])
        rows.append((f"v{k:03d}", base[:at] + " " + text(int(letters * share)) + " " + base[at:]))
    return rows


def similar(rows):
    sets = [(i, {t[k : k + 5] for k in range(len(t) - 4)}) for i, t in ((i, N.normalise(t)) for i, t in rows)]
    return {(min(a, b), max(a, b)) for k, (a, s) in enumerate(sets) for b, t in sets[:k] if len(s & t) >= 0.7 * len(s | t)}


def found_in(spark, rows):
    return {(x["chunk_a"], x["chunk_b"]) for x in N.similar_pairs(*N.similar_classes(spark.createDataFrame(rows, "id string, content string"))).collect()}


def test_inserts_into_a_recurring_text(spark):
    rows = recurring(0.35, 600, 60, 30, 1) + [("o" + i, t) for i, t in recurring(0.2, 600, 60, 30, 2)]
    want = similar(rows)
    got = found_in(spark, rows)
    assert got == want, f"{len(got & want)} of {len(want)}"


def test_longer_texts_have_no_quota(spark):
    rows = recurring(0.42, 1000, 30, 20, 3) + recurring(0.35, 2000, 30, 20, 4)
    rows = [(f"{k:03d}{i}", t) for k, (i, t) in enumerate(rows)]
    got, want = found_in(spark, rows), similar(rows)
    assert got == want, f"{len(got & want)} of {len(want)}"


def edited(seed, words, gap, kind, n):
    """Pairs of a text and a version with an edit each ``gap`` characters."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 9)))
    rows = []
    for k in range(n):
        text = " ".join(word() for _ in range(words))
        if kind == "typos":
            other = "".join("#" if i % gap == gap - 1 else c for i, c in enumerate(text))
        elif kind == "random":
            at = set(r.sample(range(len(text)), len(text) // gap))
            other = "".join(r.choice(["", "#", c + "#"]) if i in at else c for i, c in enumerate(text))
        else:
            parts = [text[i : i + gap] for i in range(0, len(text), gap)]
            r.shuffle(parts)
            other = "".join(parts)
        rows += [(f"{kind}{words}-{gap}-{k}a", text), (f"{kind}{words}-{gap}-{k}b", other)]
    return rows


def test_edit_patterns(spark):
    rows = []
    for words in (8, 40, 200, 2000):
        for kind, gaps in (("typos", (29, 31, 36)), ("random", (30, 40)), ("moved", (30, 45))):
            for gap in gaps:
                rows += edited(words * gap, words, gap, kind, 3 if words == 2000 else 12)
    want = similar(rows)
    got = found_in(spark, rows)
    assert len(want) > 200 and got == want, f"{len(got & want)} of {len(want)}"


def test_bounds_drop_no_similar_pair():
    texts = [N.normalise(t) for _, t in recurring(0.35, 600, 20, 20, 5) + recurring(0.42, 1500, 10, 10, 6)]
    ((_, offsets, h, at),) = N._shingled(texts)
    own, hashes = N.distinct_hashes(offsets, h, at)
    sizes, words = np.bincount(own), N.bitmaps(len(texts), own, hashes)
    sets = [set(hashes[own == k].tolist()) for k in range(len(texts))]
    a, b = np.triu_indices(len(texts), 1)
    may = N.may_be_similar(sizes[a], sizes[b], words[a], words[b], 0.7)
    is_similar = np.array([len(sets[x] & sets[y]) >= 0.7 * len(sets[x] | sets[y]) for x, y in zip(a, b)])
    assert is_similar.sum() > 100 and not (is_similar & ~may).any() and (~may).sum() > 100


def test_texts_agree_in_a_bin_as_they_are_similar():
    r = np.random.default_rng(3)
    for size in (7, 20, 100, 700):
        own, hashes, union = [], [], int(size / 0.7)
        for k in range(400):
            both = r.integers(0, 1 << 52, union, dtype=np.uint64)
            for row, x in ((2 * k, both[:size]), (2 * k + 1, np.concatenate([both[: 2 * size - union], both[size:]]))):
                own.append(np.full(len(x), row))
                hashes.append(np.sort(x))
        own, hashes = np.concatenate(own), np.concatenate(hashes)
        values = N.bin_values(800, own, hashes)
        share = (2 * size - union) / union
        assert abs((values[::2] == values[1::2]).mean() - share) < 0.03
        _, rows = N.tile_members(np.arange(800), np.bincount(own), values, 1)
        pairs = np.concatenate([*N.met_in(N.ordered(rows), 0.5)[0], np.zeros((0, 2), np.int64)])
        assert {(2 * k, 2 * k + 1) for k in range(400)} - set(map(tuple, pairs.tolist())) == set() or share < 0.6
    assert N.miss(0.7) < 3e-6 and N.miss(0.75) < 1e-7


def test_large_tiles_are_cut():
    values = np.random.default_rng(5).integers(0, 3, (60, N.BANDS * N.ROWS)).astype(np.uint32)
    values[:, : N.ROWS] = 7  # all meet in the first band
    _, rows = N.tile_members(np.arange(60), np.arange(100, 160), values, 1)
    rows = N.ordered(rows)
    want = {tuple(p) for x in N.met_in(rows, 0.7)[0] for p in x.tolist()}
    pairs, later = N.met_in(rows, 0.7, tile=8)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*later)], names=["left", "right"])
    got = {tuple(p) for x in pairs for p in x.tolist()} | {(a, b) for x in N._between([batch]) for a, b in zip(*(c.to_pylist() for c in x.columns))}
    assert len(later) > 20 and len(want) > 30 and want <= got
