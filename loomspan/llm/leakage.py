"""Held-out texts inside a training corpus.

A document leaks an item if it holds ``span`` consecutive letters and digits of it, other
characters and letter case aside. Each such stretch of an item (a window) is a set of
character shingles; a document that contains the window contains all of them, so the prefix
that is necessary for a match is one shingle: the window's rarest. One pass counts in how many
documents each item shingle occurs; windows with a shingle that occurs nowhere are dropped (a
length-zero prefix), the others contribute their rarest shingle as anchor. The second pass
joins documents and items on anchors, drops pairs too short to match, and verifies by extending
the match to both sides of the anchor until it breaks: containment over the item's window.

The items are a fixed test set of bounded size: ``MAX_ITEMS`` and ``MAX_ITEM_CHARS`` are
checked, and only the items and counts of their shingles reach the driver or a broadcast. The
corpus is read where it lies and never shuffled, so copies and hot sources cost no more.

Results for odd input: NULL, empty and short texts leak nothing; a document with several rows
comes out once per item; items under ``span`` letters and digits never match; two items with a
common passage both match; empty tables give no rows.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import LETTER, blocks, char_classes, rolling

SPAN = 50
SHINGLE = 12
MAX_ITEMS = 100_000
MAX_ITEM_CHARS = 50_000_000


@cache
def _counted() -> np.ndarray:
    """Letters and decimal digits by code point."""
    table = char_classes() == LETTER
    table[[c for c in range(0x20000) if unicodedata.category(chr(c)) == "Nd"]] = True
    return table


def letters_digits(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, folded letters and digits of a block's texts, offset of each text and the end)."""
    for lo, _, cp, offsets in blocks([(t or "").casefold() for t in texts]):
        keep = _counted()[cp]
        before = np.zeros(len(cp) + 1, np.int64)
        np.cumsum(keep, out=before[1:])
        yield lo, cp[keep], before[offsets]


def _shingles(cp: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash at each position and whether the shingle there ends within its text."""
    h = rolling(cp, width)
    if not len(h):
        return h, np.zeros(0, bool)
    end = np.repeat(offsets[1:], np.diff(offsets))[: len(h)]
    return h, np.arange(len(h)) + width <= end


class _Filter:
    """Membership in a set of hashes: a bitmap first, then a search."""

    def __init__(self, sorted_hashes: np.ndarray) -> None:
        self.all = sorted_hashes
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(sorted_hashes >> np.uint64(42)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of members in ``h`` and their places in the set."""
        at = np.nonzero(self.bits[(h >> np.uint64(42)).astype(np.int64)])[0]
        place = np.minimum(np.searchsorted(self.all, h[at]), max(0, len(self.all) - 1))
        hit = self.all[place] == h[at] if len(self.all) else np.zeros(len(at), bool)
        return at[hit], place[hit]


def _count_shingles(shared: Broadcast, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Filter(shared.value)
        total = np.zeros(len(known.all), np.int64)
        for batch in batches:
            for _, cp, offsets in letters_digits(batch.column(0).to_pylist()):
                h, ok = _shingles(cp, offsets, width)
                at, place = known.find(h)
                at, place = at[ok[at]], place[ok[at]]
                doc = np.searchsorted(offsets, at, "right")
                once = np.unique(doc * np.int64(len(total) + 1) + place) % (len(total) + 1)
                total += np.bincount(once, minlength=len(total))
        some = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["place", "n"])

    return run


def _join_and_verify(shared: Broadcast, width: int, span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, first, item_cp, item_off, posting, ids = shared.value
        known = _Filter(anchors)
        for batch in batches:
            docs, found = batch.column(0), []
            for lo, cp, offsets in letters_digits(batch.column(1).to_pylist()):
                h, ok = _shingles(cp, offsets, width)
                at, place = known.find(h)
                at, place = at[ok[at]], place[ok[at]]
                doc = np.searchsorted(offsets, at, "right") - 1
                long = offsets[doc + 1] - offsets[doc] >= span
                best: dict[tuple[int, int], int] = {}
                for p, a, d in zip(at[long].tolist(), place[long].tolist(), doc[long].tolist()):
                    for k in range(first[a], first[a + 1]):
                        q, item = posting[k]
                        n = _extend(cp, p, offsets[d], offsets[d + 1], item_cp, q, item_off[item], item_off[item + 1], width)
                        if n >= span and n > best.get((d, item), 0):
                            best[d, item] = n
                found += [(lo + d, item, n) for (d, item), n in best.items()]
            if found:
                rows, items, spans = zip(*found)
                yield pa.RecordBatch.from_arrays([docs.take(pa.array(rows)), pa.array([ids[i] for i in items], pa.int64()), pa.array(spans, pa.int32())], names=["doc_id", "item_id", "span"])

    return run


def _extend(a: np.ndarray, i: int, a_lo: int, a_hi: int, b: np.ndarray, j: int, b_lo: int, b_hi: int, width: int) -> int:
    """Length of the longest common stretch that holds a[i : i + width] and b[j : j + width]; 0 if those differ."""
    ahead = int(min(a_hi - i, b_hi - j))
    same = a[i : i + ahead] == b[j : j + ahead]
    right = ahead if same.all() else int(same.argmin())
    if right < width:
        return 0
    back = int(min(i - a_lo, j - b_lo))
    same = a[i - back : i][::-1] == b[j - back : j][::-1]
    return right + (back if same.all() else int(same.argmin()))


def leaked_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", span: int = SPAN, width: int = SHINGLE) -> DataFrame:
    """doc_id, item_id and span (letters and digits of the longest common stretch), once per pair."""
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType.simpleString()
    size = items.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length(item_text)), F.lit(0)).alias("chars")).first()
    if size["n"] > MAX_ITEMS or size["chars"] > MAX_ITEM_CHARS:
        raise ValueError(f"{size['n']} items of {size['chars']} characters: split the test set")
    rows = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).cast("bigint"), F.col(item_text).cast("string")).distinct().orderBy(item_id, item_text).collect()
    ids = [r[0] for r in rows]
    parts = [(cp, np.diff(offsets)) for _, cp, offsets in letters_digits([r[1] for r in rows])]
    cp = np.concatenate([p for p, _ in parts]) if parts else np.zeros(0, np.uint32)
    offsets = np.concatenate([[0], np.cumsum(np.concatenate([n for _, n in parts]))]).astype(np.int64) if parts else np.zeros(1, np.int64)
    h, ok = _shingles(cp, offsets, width)
    hashes = np.unique(h[ok])
    corpus = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))

    counted = corpus.select("text").mapInArrow(_count_shingles(spark.sparkContext.broadcast(hashes), width), "place bigint, n bigint")
    df = np.zeros(len(hashes), np.int64)
    for r in counted.groupBy("place").agg(F.sum("n").alias("n")).collect():  # at most one row per item shingle
        df[r["place"]] = r["n"]

    anchors, first, posting = _rarest(h, offsets, hashes, df, span, width)
    shared = spark.sparkContext.broadcast((anchors, first, cp, offsets, posting, ids))
    found = corpus.mapInArrow(_join_and_verify(shared, width, span), f"doc_id {kind}, item_id bigint, span int")
    return found.groupBy("doc_id", "item_id").agg(F.max("span").alias("span"))


def _rarest(h: np.ndarray, offsets: np.ndarray, hashes: np.ndarray, df: np.ndarray, span: int, width: int) -> tuple[np.ndarray, list[int], list[tuple[int, int]]]:
    """Anchors (sorted hashes), where the postings of each begin, postings (position, item)."""
    chosen: set[tuple[int, int, int]] = set()
    for item in range(len(offsets) - 1):
        lo, hi = int(offsets[item]), int(offsets[item + 1])
        if hi - lo < span:
            continue
        place = np.searchsorted(hashes, h[lo : hi - width + 1])
        rank = np.lexsort((place, df[place]))
        order = np.empty(len(rank), np.int64)
        order[rank] = np.arange(len(rank))
        per = span - width + 1
        windows = np.lib.stride_tricks.sliding_window_view(order, per)
        least = windows.argmin(axis=1) + np.arange(len(windows))
        for k in np.unique(least[df[place[least]] > 0]).tolist():
            chosen.add((int(hashes[place[k]]), lo + k, item))
    ordered = sorted(chosen)
    anchors = np.array(sorted({a for a, _, _ in ordered}), np.uint64)
    first = np.searchsorted(np.array([a for a, _, _ in ordered], np.uint64), anchors).tolist() + [len(ordered)] if ordered else [0]
    return anchors, first, [(q, item) for _, q, item in ordered]
