"""Cutting oversized texts at natural boundaries by agglomerative merging.

A text becomes atomic segments: sentences and lines; where one is larger than a piece may be,
its clauses, then its words, then runs of characters. Adjacent segments wait in a heap ordered
by the strength of the boundary between them (character, word, clause, sentence, line,
paragraph, heading), and the weakest boundary is merged first while the combined size plus the
overlap fits. What is left when no pair fits are the pieces. Each piece but the first starts
with the end of the piece before, at most the overlap, from a natural boundary on.

Size is ``length div 4`` with length in code points; a piece is strictly under the limit.
Pieces are ranges of the text: without their overlaps they join up to exactly that text.

Results for odd input: NULL, empty and fitting texts give no pieces; a text without any boundary
is cut after as many characters as fit; surrogates and combining marks stay with their base
where a base fits; repeated rows come out once; a limit of 0 or NULL cuts nothing; an overlap
of more than half a piece counts as half.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEADING, PARAGRAPH, LINE, SENTENCE, CLAUSE, WORD, CHARACTER = 6, 5, 4, 3, 2, 1, 0
NAMES = ("character", "word", "clause", "sentence", "line", "paragraph", "heading")
_COARSE = re.compile(r"(?P<par>\n[^\S\n]*(?:\r?\n[^\S\n]*)+)(?P<head>(?=\#{1,6} |\d+(?:\.\d+)*[.)] |={2,6} ))?|(?P<line>\r?\n)|(?P<sent>(?:[.!?…]+[\"'”’»)\]*]*(?:\[\d+\])*[^\S\n]+)|(?:[。！？｡]+[\"'”’»」』）\]]*[^\S\n]*))")
_CLAUSE = re.compile(r"[,;:–—]+[^\S\n]+|[，、；：]+[^\S\n]*|[)\]}>|][^\S\n]+")
_WORD = re.compile(r"[^\S\n]+|(?<=[/_\-=&?.,;])(?=\w)")


def atoms(text: str, limit: int) -> list[tuple[int, int, int]]:
    """(start, end, strength of the boundary at the end) of atomic segments of at most ``limit`` characters."""
    out: list[tuple[int, int, int]] = []
    at = 0
    for m in _COARSE.finditer(text):
        strength = (HEADING if m["head"] is not None else PARAGRAPH) if m["par"] else LINE if m["line"] else SENTENCE
        _refine(text, at, m.end(), strength, limit, 0, out)
        at = m.end()
    if at < len(text):
        _refine(text, at, len(text), HEADING, limit, 0, out)
    return out


_FINER = ((_CLAUSE, CLAUSE), (_WORD, WORD))


def _refine(text: str, lo: int, hi: int, strength: int, limit: int, level: int, out: list[tuple[int, int, int]]) -> None:
    if hi - lo <= limit:
        out.append((lo, hi, strength))
        return
    if level == len(_FINER):
        step = max(1, limit // 4)
        while hi - lo > step:
            end = lo + step
            while end > lo + 1 and (unicodedata.combining(text[end]) or text[end] in "‍️"):
                end -= 1
            out.append((lo, end, CHARACTER))
            lo = end
        out.append((lo, hi, strength))
        return
    pattern, own = _FINER[level]
    at = lo
    for m in pattern.finditer(text, lo, hi):
        if lo < m.end() < hi and m.end() > at:
            _refine(text, at, m.end(), own, limit, level + 1, out)
            at = m.end()
    _refine(text, at, hi, strength, limit, level + 1, out)


def merge_atoms(parts: list[tuple[int, int, int]], limit: int) -> list[tuple[int, int, int]]:
    """Merge neighbours over the weakest boundaries first while they fit ``limit``."""
    n = len(parts)
    start, end, strength = [p[0] for p in parts], [p[1] for p in parts], [p[2] for p in parts]
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(strength[i], end[i + 1] - start[i], i, i + 1) for i in range(n - 1)]
    heapq.heapify(heap)
    while heap:
        _, size, i, j = heapq.heappop(heap)
        if not (alive[i] and alive[j]) or after[i] != j or end[j] - start[i] != size or size > limit:
            continue
        end[i], strength[i], after[i], alive[j] = end[j], strength[j], after[j], False
        if after[j] < n:
            before[after[j]] = i
            heapq.heappush(heap, (strength[i], end[after[i]] - start[i], i, after[i]))
        if before[i] >= 0:
            heapq.heappush(heap, (strength[before[i]], end[i] - start[before[i]], before[i], i))
    return [(start[i], end[i], strength[i]) for i in range(n) if alive[i]]


def _overlap_start(text: str, lo: int, hi: int, room: int) -> int:
    """Where the overlap with ``text[lo:hi]`` begins: the first natural boundary within ``room`` of the end."""
    if room <= 0:
        return hi
    first = max(lo, hi - room)
    if first == lo:
        return lo
    for pattern in (_COARSE, _CLAUSE, _WORD):
        for m in pattern.finditer(text, first - 1, hi):
            if first <= m.end() < hi:
                return m.end()
    return first if not text[first - 1 : hi].isascii() else hi


def cut(text: str, max_tokens: int, overlap_tokens: int) -> list[tuple[int, int, int, int]]:
    """(own start, start with overlap, end, strength of the boundary at the end) of each piece; [] if the text fits."""
    if not text or not max_tokens or max_tokens <= 0 or len(text) // 4 <= max_tokens:
        return []
    room = 4 * max_tokens - 1
    overlap = min(4 * max(0, overlap_tokens or 0), room // 2)
    pieces = merge_atoms(atoms(text, room - overlap), room - overlap)
    out = []
    for k, (lo, hi, strength) in enumerate(pieces):
        begin = _overlap_start(text, pieces[k - 1][0], lo, overlap) if k else lo
        out.append((lo, begin, hi, strength))
    return out


_FIELDS = "chunk_id string, piece_no int, own_start int, start int, end int, n_tokens int, boundary string, text string"


def _cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for key, text, most, overlap in zip(*(batch.column(i).to_pylist() for i in range(4))):
            for k, (own, begin, end, strength) in enumerate(cut(text, most, overlap)):
                rows.append((key, k, own, begin, end, (end - begin) // 4, NAMES[strength] if end < len(text) else "end", text[begin:end]))
            if len(rows) > 2000:
                yield _arrow(rows)
                rows = []
        if rows:
            yield _arrow(rows)


def _arrow(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), *[pa.int32()] * 5, pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[f.split()[0] for f in _FIELDS.split(", ")])


def method_of(meta: Column) -> Column:
    """The text ``method`` of a JSON object; NULL where that can't be read."""
    doc = F.from_json(meta, "method string, _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})
    return F.when(doc["_bad"].isNull() & F.rtrim(meta).endswith("}"), doc["method"])


def oversized(chunks: DataFrame, limits: DataFrame, default: str = "general") -> DataFrame:
    """chunk_id, content, max_tokens, overlap_tokens of distinct texts over the limit of their method.

    ``limits`` is joined without a hint: it is broadcast where its size allows, shuffled elsewhere.
    """
    limit = limits.groupBy("method").agg(F.min("max_tokens").alias("most"), F.max("overlap_tokens").alias("over"))
    named = limit.select(F.col("method").alias("m1"), F.col("most").alias("most1"), F.col("over").alias("over1"))
    general = limit.where(F.col("method") == default).agg(F.min("most").alias("most2"), F.min("over").alias("over2"))
    row = general.first()  # one row of an aggregate
    rows = chunks.select(F.col("id").cast("string").alias("chunk_id"), "content", method_of(F.col("meta")).alias("m"))
    rows = rows.join(named, rows["m"] == named["m1"], "left")
    known = F.col("m1").isNotNull()
    rows = rows.select("chunk_id", "content", F.when(known, F.col("most1")).otherwise(F.lit(row["most2"])).cast("int").alias("max_tokens"), F.when(known, F.col("over1")).otherwise(F.lit(row["over2"])).cast("int").alias("overlap_tokens"))
    return rows.where(F.floor(F.length("content") / 4) > F.col("max_tokens"))


def split_pieces(chunks: DataFrame, limits: DataFrame, default: str = "general") -> DataFrame:
    """The ordered pieces of every oversized text: chunk_id, piece_no, own_start, start, end, n_tokens, boundary, text."""
    return oversized(chunks, limits, default).mapInArrow(_cut_batches, _FIELDS)
