import base64
import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomspan.llm import encode as E
from loomspan.llm.arrays import blocks
from loomspan.llm.transducer import Lexicon, compile_lexicon

pytestmark = pytest.mark.skipif(not os.path.isdir(E.TOKENIZERS), reason="no vocabularies here")
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    with open(f"{E.TOKENIZERS}/{E.VOCABULARY}", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("reference", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(texts, words=()):
    merge = E._merger(E.TOKENIZERS)
    lexicon, out = Lexicon(data=compile_lexicon({w: list(merge(w)) for w in words})), []
    for lo, hi, cp, offsets in blocks(texts, 200):
        ids, ends = E.encode_block(cp, offsets, lexicon, merge)
        out += [ids[ends[i] : ends[i + 1]].tolist() for i in range(hi - lo)]
    return out


PARTS = st.sampled_from(["a", "The", " the", "'s", "'ll", "'", "don't", " ", "  ", "\n", "\t", "１", "12", "½", "漢字", "é", "🙂", ".", "...", " ?", "\u3000", "\x85", "x" * 90])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(PARTS, max_size=12).map("".join), max_size=5))
def test_equals_the_library(reference, texts):
    assert encode(texts, [b" the", b"The", b"'s", "漢字".encode()]) == [reference.encode_ordinary(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text_and_round_trip(reference, text):
    ids = encode([text])[0] if text else []
    assert ids == reference.encode_ordinary(text)
    assert reference.decode(ids) == text


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.binary(min_size=1, max_size=5), st.lists(st.integers(0, 9), min_size=1, max_size=3), max_size=30), st.lists(st.binary(max_size=6), max_size=20))
def test_lexicon(words, asked):
    lexicon = Lexicon(data=compile_lexicon(words))
    asked = asked + list(words)
    data = np.frombuffer(b"".join(asked), np.uint8)
    sizes = np.array([len(w) for w in asked], np.int64)
    found = lexicon.find(data, np.cumsum(sizes) - sizes, sizes) if len(asked) else []
    for w, k in zip(asked, found):
        assert (lexicon.ids[lexicon.offsets[k] : lexicon.offsets[k + 1]].tolist() if k >= 0 else None) == words.get(w)


def test_suffixes_are_shared():
    words = {w.encode(): [1] for w in ("walking", "talking", "king", "walked", "talked")}
    assert len(Lexicon(data=compile_lexicon(words)).final) < sum(map(len, words))


def test_table(spark, reference):
    rows = [(1, "one two one two", "x"), (2, "", "x"), (3, None, "x"), (3, None, "x"), (4, "word " * 5000, "x"), (None, "two", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = sorted(((r["doc_id"], list(r["ids"])) for r in E.encode_corpus(df).collect()), key=str)
    assert got == sorted(((d, reference.encode_ordinary(t or "")) for d, t, _ in rows), key=str)
    assert E.encode_corpus(df.where("false")).count() == 0


def test_words_of_one_hash_are_told_apart(reference):
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(4096))  # equal to its complement under any polynomial modulo 2^64
    b = a.translate({97: 98, 98: 97})
    texts = [a, b, a, b + " x"]
    ((_, _, cp, offsets),) = blocks(texts)
    ids, ends = E.encode_block(cp, offsets, Lexicon(data=compile_lexicon({b"x": [87]})), E._merger(E.TOKENIZERS))
    assert [ids[x:y].tolist() for x, y in zip(ends, ends[1:])] == [reference.encode_ordinary(t) for t in texts]
