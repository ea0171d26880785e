"""Token ids of a whole corpus by a public byte-level BPE vocabulary.

Texts are cut into words by the vocabulary's split rule, computed on whole blocks of code
points. One pass over all documents counts words; the ``LEXICON_WORDS`` most frequent ones are
encoded once and compiled into a minimal acyclic automaton, written to the shared folder and
mapped into memory by every worker. In the second pass each distinct word of a block is looked
up there; words that aren't in it are merged exactly by the vocabulary's ranks. The lexicon's
size affects speed only, never ids.

Results for odd input: NULL and empty texts give an empty list; white space is encoded like
other text; one row per document, repeated rows included; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import os
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import put_file
from .arrays import LETTER, OTHER, SPACE, blocks, char_classes, owners, ragged
from .transducer import Lexicon, compile_lexicon

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
LEXICON_WORDS = 40_000
#: A word longer than this many bytes is never put into the lexicon.
LEXICON_BYTES = 64


def word_starts(cp: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """True where a word begins, by the split rule of byte-level BPE (GPT-2's pattern)."""
    n = len(cp)
    kind = char_classes()[cp]
    fresh = np.zeros(n + 1, bool)
    fresh[offsets[:-1]] = True
    fresh = fresh[:n]
    start = fresh.copy()
    start[1:] |= kind[1:] != kind[:-1]
    start[:1] = True
    # White space before a word: its last character is split off, and joins the word if it is a blank.
    first = np.nonzero((kind[1:] != SPACE) & (kind[:-1] == SPACE) & ~fresh[1:])[0] + 1
    start[first - 1] = True
    start[first[cp[first - 1] == 0x20]] = False
    # Contractions: an apostrophe that is a word of its own takes s, t, m, d, re, ve or ll along.
    quote = np.nonzero((cp[:-1] == 0x27) & start[:-1] & (kind[1:] == LETTER) & ~fresh[1:])[0] if n > 1 else np.zeros(0, np.int64)
    if len(quote):
        a = cp[quote + 1]
        two = quote + 2
        b = np.where((two < n) & ~fresh[np.minimum(two, n - 1)], cp[np.minimum(two, n - 1)], 0)
        short = np.isin(a, [ord(c) for c in "stmd"])
        long = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        start[quote[short | long] + 1] = False
        for which, step in ((short, 2), (long, 3)):
            after = quote[which] + step
            start[after[after < n]] = True
    return start


class _Words:
    """Distinct words of a block: ``first`` (position of one occurrence), ``which`` (of each word)."""

    def __init__(self, cp: np.ndarray, offsets: np.ndarray) -> None:
        self.at = np.nonzero(word_starts(cp, offsets))[0]
        self.length = np.diff(np.append(self.at, len(cp)))
        place = np.arange(len(cp)) - np.repeat(self.at, self.length)
        mixed = [np.add.reduceat((cp.astype(np.uint64) + np.uint64(salt)) * _powers(int(self.length.max()), base)[place], self.at) for salt, base in ((77, 0x9E3779B97F4A7C15), (1, 0xC2B2AE3D27D4EB4F))]
        both = mixed[0] ^ (mixed[1] << np.uint64(1)) ^ (self.length.astype(np.uint64) << np.uint64(48))
        _, self.first, self.which = np.unique(both, return_index=True, return_inverse=True)
        # Hashes only propose: words that differ from the one they stand for are taken by themselves.
        at, length = self.at[self.first][self.which], self.length[self.first][self.which]
        twin = np.minimum(np.repeat(at, self.length) + place, len(cp) - 1)
        odd = np.nonzero((length != self.length) | np.logical_or.reduceat(cp != cp[twin], self.at))[0]
        self.which[odd] = len(self.first) + np.arange(len(odd))
        self.first = np.append(self.first, odd)
        self.owner = np.searchsorted(offsets, self.at, "right") - 1
        size = 1 + (cp >= 0x80).astype(np.int8) + (cp >= 0x800) + (cp >= 0x10000)
        byte_at = np.zeros(len(cp) + 1, np.int64)
        np.cumsum(size, out=byte_at[1:])
        self.byte_start = byte_at[self.at[self.first]]
        self.byte_length = byte_at[self.at[self.first] + self.length[self.first]] - self.byte_start


@cache
def _powers_cached(size: int, base: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _powers(size: int, base: int) -> np.ndarray:
    return _powers_cached(1 << max(10, int(size).bit_length()), base)


@cache
def _merger(folder: str):
    import tiktoken

    with open(os.path.join(folder, VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


def _word_counts():
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for _, _, cp, offsets in blocks([t for t in batch.column(0).to_pylist() if t]):
                words = _Words(cp, offsets)
                n = np.bincount(words.which, minlength=len(words.first))
                data = cp.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
                for k in np.nonzero((n > 1) & (words.byte_length <= LEXICON_BYTES))[0]:
                    at = int(words.byte_start[k])
                    seen[data[at : at + int(words.byte_length[k])]] += int(n[k])
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    return count


def frequent_words(docs: DataFrame, text_col: str = "text", limit: int = LEXICON_WORDS) -> list[bytes]:
    """The ``limit`` most frequent words of all texts (a word counts in blocks where it recurs)."""
    counts = docs.select(F.col(text_col).cast("string")).mapInArrow(_word_counts(), "word binary, n bigint")
    top = counts.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(limit)
    return [bytes(r["word"]) for r in top.collect()]


def _encoder(lexicon_name: str, tokenizers: str, keep: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, merge = Lexicon(SparkFiles.get(lexicon_name)), _merger(tokenizers)
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            for lo, hi, cp, offsets in blocks(texts):
                ids, ends = encode_block(cp, offsets, lexicon, merge)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in range(keep)), lists], names=[*batch.schema.names[:keep], "ids"])

    return encode


def encode_block(cp: np.ndarray, offsets: np.ndarray, lexicon: Lexicon, merge) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts of a block, and where each text's ids begin and end."""
    if not len(cp):
        return np.zeros(0, np.int32), np.zeros(len(offsets), np.int32)
    words = _Words(cp, offsets)
    raw = cp.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    found = lexicon.find(np.frombuffer(raw, np.uint8), words.byte_start, words.byte_length)
    known, new = found >= 0, np.nonzero(found < 0)[0]
    size = np.zeros(len(found), np.int64)
    begin = np.zeros(len(found), np.int64)
    size[known] = lexicon.offsets[found[known] + 1] - lexicon.offsets[found[known]]
    begin[known] = lexicon.offsets[found[known]]
    merged = [merge(raw[a:b]) for a, b in zip(words.byte_start[new].tolist(), (words.byte_start[new] + words.byte_length[new]).tolist())]
    size[new] = [len(x) for x in merged]
    base = len(lexicon.ids)
    begin[new] = base + np.concatenate([[0], np.cumsum(size[new])[:-1]]).astype(np.int64) if len(new) else 0
    table = np.concatenate([lexicon.ids, np.array([i for x in merged for i in x], np.int64)])
    per_word = size[words.which]
    ids = table[ragged(begin[words.which], per_word)]
    per_text = np.bincount(words.owner, weights=per_word, minlength=len(offsets) - 1).astype(np.int64)
    return ids.astype(np.int32), np.concatenate([[0], np.cumsum(per_text)]).astype(np.int32)


def build_lexicon(docs: DataFrame, text_col: str = "text", tokenizers: str = TOKENIZERS, limit: int = LEXICON_WORDS) -> str:
    """Compile the frequent words of ``docs`` into a file that executors get; its name for SparkFiles."""
    merge = _merger(tokenizers)
    data = compile_lexicon({w: list(merge(w)) for w in frequent_words(docs, text_col, limit)})
    spark = docs.sparkSession
    uri = put_file(spark, data, ".lexicon")
    spark.sparkContext.addFile(uri)
    return uri.rpartition("/")[2]


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizers: str = TOKENIZERS, limit: int = LEXICON_WORDS) -> DataFrame:
    """(``id_col``, ids ARRAY<INT>) of every row."""
    name = build_lexicon(docs, text_col, tokenizers, limit)
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text__"))
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(_encoder(name, tokenizers, 1), f"`{id_col}` {kind}, ids array<int>")
