"""Texts that share most of their character shingles.

The similarity of two texts is the Jaccard coefficient of their sets of ``SHINGLE``-character
sequences, after lower-casing, replacing white space runs by a blank and trimming.

1. Each distinct text (class of exact copies) gets the smallest hash of its shingles in each of
   ``BANDS * ROWS`` bins (an empty bin takes the value of another one, drawn by a fixed rule), so
   that two texts agree in a bin with a probability equal to their similarity, whatever the
   edits, the order of the parts and the lengths are.
2. Texts that agree in all ``ROWS`` bins of a band meet in its *tile*. A tile is sorted by size;
   a text meets only those in its size band (no pair at the threshold is outside of it), and only
   if at least ``AGREE`` of ``NIBBLES`` four-bit values, taken from the bins after the band, are equal.
   A tile of more than ``TILE`` texts is cut by size into several, and compatible pairs of those
   are compared by other tasks.
3. Texts that met get a hashed bitmap of ``BITS`` bits, one set for each shingle. Bit counts bound
   the overlap of a pair from above: each bit set in one bitmap only stands for at least one
   shingle that the other text lacks. Pairs whose bound is too low go.
4. The rest is decided exactly by intersecting the sorted shingle arrays of both texts.

What is lost. Steps 3 and 4 and the size band lose nothing. A pair of similarity s fails a band with
probability 1 - s^ROWS * P(at least AGREE of NIBBLES agree), and all of them with that to the power of
``BANDS``: ``miss(0.7)`` is 2.5e-6, ``miss(0.75)`` 1.3e-8. It depends neither on edits, order, frequency
of shingles nor on the number of texts, and nothing is capped. Where both texts together have some
20 shingles or fewer, bins repeat each other; 5e-5 were missed there in simulations at 0.7.

Distribution. Copies are reduced to one row per class in every task before anything is shuffled. A
task sends each partition one binary row for some thousand texts, 26 bytes for each text and band
(their number is chosen by the number of rows). Bitmaps are made and shuffled for texts that met,
texts are fetched for pairs that passed the bound. Only marks of fixed size are broadcast.

Results for odd input: NULL texts and those under ``SHINGLE`` characters pair with nothing;
repeated rows of an id count once (an id with several texts has the pairs of all of them); an
empty table gives no rows. Copies of one text are pairs of similarity 1: all of them in classes up
to ``EXPAND`` members; a larger class is given by pairs of its representative (smallest id) with
each copy, and only its representative is paired with other texts (``memberships`` gives every
id with its class).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut, materialize
from .arrays import blocks, owners, ragged, rolling

SHINGLE = 5
THRESHOLD = 0.7
BANDS = 48
ROWS = 4
NIBBLES = 24
AGREE = 13
TILE = 16384
BITS = 1024
EXPAND = 64
#: Texts are filtered by a broadcast bit table of at most so many bits (a power of two), beyond it by the join alone.
MARK_BITS_LOG2 = 27
_BINS = BANDS * ROWS
_ROW_BITS = 12  # texts of a block, so that each hash keeps 52 bits
_PAIRS = 1 << 18  # pairs looked at together
_CHUNK = 16384  # bytes per row when a table is put together
_PART_BYTES = 64 << 20  # of tile rows in a partition, about
_SPACE = re.compile(r"\s+")
_MEMBER = np.dtype([("key", "<u4"), ("size", "<u2"), ("cls", "<i8"), ("low", "<u8"), ("high", "<u4")])
_SIZE_STEPS = 2000  # size codes in a factor of e
#: Bins an empty bin looks into, in order: a fixed random order for each.
_DONORS = np.stack([np.random.default_rng(b).permutation(_BINS) for b in range(_BINS)])


def miss(similarity: float) -> float:
    """Probability that a pair of this similarity meets in no tile."""
    equal = similarity + (1 - similarity) / 16
    kept = sum(comb(NIBBLES, k) * equal**k * (1 - equal) ** (NIBBLES - k) for k in range(AGREE, NIBBLES + 1))
    return (1 - similarity**ROWS * kept) ** BANDS


def normalise(text: str | None) -> str:
    return _SPACE.sub(" ", (text or "").lower()).strip()


def class_of(normalised: str) -> int:
    """63 bits of a digest: the class of a text and its exact copies."""
    return int.from_bytes(hashlib.blake2b(normalised.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _shingled(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, offsets, hash of the shingle at each position, which of those lie within a text)."""
    for base in range(0, len(texts), 1 << _ROW_BITS):
        for lo, _, cp, offsets in blocks(texts[base : base + (1 << _ROW_BITS)]):
            h = rolling(cp, SHINGLE)
            end = np.repeat(offsets[1:], np.diff(offsets))[: len(h)]
            yield base + lo, offsets, h, np.nonzero(np.arange(len(h)) + SHINGLE <= end)[0]


def _slot(h: np.ndarray, log2: int) -> np.ndarray:
    return (h >> np.uint64(64 - log2)).astype(np.int64)


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        classes = [class_of(t) if len(t) >= SHINGLE else None for t in map(normalise, batch.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), batch.column(0)], names=["cls", "id"]).filter(pa.array([c is not None for c in classes], pa.bool_()))


def distinct_hashes(offsets: np.ndarray, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, 52 bits of the hash) of all distinct shingles of a block, by text and hash."""
    both = np.sort((owners(offsets)[at].astype(np.uint64) << np.uint64(64 - _ROW_BITS)) | (h[at] >> np.uint64(_ROW_BITS)))
    if len(both):
        both = both[np.concatenate([[True], both[1:] != both[:-1]])]
    return (both >> np.uint64(64 - _ROW_BITS)).astype(np.int64), both & np.uint64((1 << (64 - _ROW_BITS)) - 1)


def bitmaps(rows: int, own: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Bitmap of each text as 64-bit words."""
    bitmap = np.zeros((rows, BITS), bool)
    bitmap[own, (hashes >> np.uint64(64 - _ROW_BITS - BITS.bit_length() + 1)).astype(np.int64)] = True
    return np.packbits(bitmap, axis=1, bitorder="little").view(np.uint64)


def bin_values(rows: int, own: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A value for each text and bin; each text has a shingle."""
    bins = ((hashes >> np.uint64(32 - _ROW_BITS)) * np.uint64(_BINS) >> np.uint64(32)).astype(np.int64)
    first = np.nonzero(np.concatenate([[True], (bins[1:] != bins[:-1]) | (own[1:] != own[:-1])]))[0]
    values, filled = np.zeros((rows, _BINS), np.uint32), np.zeros((rows, _BINS), bool)
    mixed = hashes[first] * np.uint64(0x9E3779B97F4A7C15)
    values[own[first], bins[first]] = (mixed >> np.uint64(32)).astype(np.uint32)
    filled[own[first], bins[first]] = True
    row, col = np.nonzero(~filled)
    for step in range(_BINS):
        if not len(row):
            break
        donor = _DONORS[col, step]
        ready = filled[row, donor]
        values[row[ready], col[ready]] = values[row[ready], donor[ready]]
        row, col = row[~ready], col[~ready]
    return values


def tile_members(classes: np.ndarray, sizes: np.ndarray, values: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Partition and row of each text and band, in the order of partitions."""
    n = len(classes)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93), (n, BANDS)).copy()
    for k in range(ROWS):
        key = (key ^ values[:, k::ROWS]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    part = ((key >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32).ravel()
    low = (values & np.uint32(15)).astype(np.uint8)
    packed = low[:, 0::2] | (low[:, 1::2] << np.uint8(4))
    packed = np.ascontiguousarray(np.concatenate([packed, packed[:, : NIBBLES // 2 + ROWS]], axis=1))
    windows = np.lib.stride_tricks.sliding_window_view(packed, NIBBLES // 2, axis=1)[:, ROWS // 2 :: ROWS // 2][:, :BANDS]
    marks = np.ascontiguousarray(windows).view(np.dtype([("low", "<u8"), ("high", "<u4")])).reshape(n, BANDS)
    out = np.empty((n, BANDS), _MEMBER)
    out["key"], out["cls"] = key & np.uint64(0xFFFFFFFF), classes[:, None]
    out["size"] = np.floor(np.log(sizes) * _SIZE_STEPS).astype(np.uint16)[:, None]
    out["low"], out["high"] = marks["low"], marks["high"]
    by = np.argsort(part, kind="stable")
    return part[by], out.ravel()[by]


def _tiles(parts: int):
    """One row for each block of texts and partition: the tile rows that go there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            fresh: dict[int, str] = {}
            for t in map(normalise, batch.column(0).to_pylist()):
                if len(t) >= SHINGLE and (c := class_of(t)) not in seen:
                    seen.add(c)
                    fresh[c] = t
            classes = np.fromiter(fresh, np.int64, len(fresh))
            for lo, offsets, h, at in _shingled(list(fresh.values())):
                rows = len(offsets) - 1
                own, hashes = distinct_hashes(offsets, h, at)
                part, out = tile_members(classes[lo : lo + rows], np.bincount(own, minlength=rows), bin_values(rows, own, hashes), parts)
                start = np.nonzero(np.concatenate([[True], part[1:] != part[:-1]]))[0]
                yield pa.RecordBatch.from_arrays([pa.array(part[start]), pa.array([x.tobytes() for x in np.split(out, start[1:])], pa.binary())], names=["part", "rows"])

    return run


def _ones(words: np.ndarray) -> np.ndarray:
    """Bits set in each row of words."""
    return np.bitwise_count(words).sum(axis=1, dtype=np.int64)


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether enough of the four-bit values of two members are equal."""
    ones = np.uint64(0x1111111111111111)
    low, high = a["low"] ^ b["low"], (a["high"] ^ b["high"]).astype(np.uint64)
    low |= low >> np.uint64(2)
    low |= low >> np.uint64(1)
    high |= high >> np.uint64(2)
    high |= high >> np.uint64(1)
    return np.bitwise_count(low & ones) + np.bitwise_count(high & ones) <= NIBBLES - AGREE


def ordered(rows: np.ndarray) -> np.ndarray:
    """Members by tile and size, a class once in a tile, without tiles of one."""
    rows = rows[np.lexsort((rows["cls"], rows["size"], rows["key"]))]
    if len(rows):
        rows = rows[np.concatenate([[True], (rows["key"][1:] != rows["key"][:-1]) | (rows["cls"][1:] != rows["cls"][:-1])])]
        same = rows["key"][1:] == rows["key"][:-1]
        rows = rows[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
    return rows


def _pairs(rows: np.ndarray, first: np.ndarray, last: np.ndarray) -> Iterator[np.ndarray]:
    """Pairs (a < b) of classes, each row with those from ``first`` to ``last`` that agree, some at a time."""
    times, out, lo = np.maximum(last - first, 0), [], 0
    total = np.cumsum(times)
    marks = {k: np.ascontiguousarray(rows[k]) for k in ("low", "high", "cls")}
    while lo < len(rows):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + _PAIRS, side="right")))
        i, j = np.repeat(np.arange(lo, hi), times[lo:hi]), ragged(first[lo:hi], times[lo:hi])
        near = _agree({k: v[i] for k, v in marks.items()}, {k: v[j] for k, v in marks.items()})
        a, b = marks["cls"][i[near]], marks["cls"][j[near]]
        out.append(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)[a != b])
        lo = hi
        if lo == len(rows) or sum(map(len, out)) > 4 * _PAIRS:
            yield np.unique(np.concatenate(out), axis=0)
            out = []


def met_in(rows: np.ndarray, threshold: float, tile: int = TILE) -> tuple[Iterator[np.ndarray], list[tuple[bytes, bytes]]]:
    """(pairs of classes that met, pairs of tiles still to be compared) of ordered members."""
    size = rows["size"].astype(np.int64)
    band = int(np.ceil(-np.log(threshold) * _SIZE_STEPS)) + 1
    place = rows["key"].astype(np.int64) << 17 | size
    ends = np.searchsorted(place, place + min(band, 0xFFFF), side="right")
    start = np.nonzero(np.concatenate([[True], rows["key"][1:] != rows["key"][:-1]]))[0] if len(rows) else np.zeros(0, np.int64)
    length = np.diff(np.append(start, len(rows)))
    later = []
    for s, n in zip(start[length > tile], length[length > tile]):
        cuts = [rows[k : min(k + tile, s + n)] for k in range(s, s + n, tile)]
        for x, left in enumerate(cuts):
            later += [(left.tobytes(), b"" if right is left else right.tobytes()) for right in cuts[x:] if int(right["size"][0]) - int(left["size"][-1]) <= band]
    small = np.repeat(length <= tile, length)
    ends -= np.concatenate([[0], np.cumsum(~small)])[ends]
    return _pairs(rows[small], np.arange(1, small.sum() + 1), ends[small]), later


def _meet(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = [r for b in batches for r in b.column("rows").to_pylist()]
        if some:
            met, later = met_in(ordered(np.frombuffer(b"".join(some), _MEMBER)), threshold)
            yield from map(_met, met)
            for left, right in later:
                yield _met(np.zeros((1, 2), np.int64), left, right)

    return run


def _met(pairs: np.ndarray, left: bytes | None = None, right: bytes | None = None) -> pa.RecordBatch:
    more = [pa.array([x] * len(pairs), pa.binary()) for x in (left, right)]
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), *more], names=["a", "b", "left", "right"])


def _between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for left, right in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist()):
            rows = np.frombuffer(left + right, _MEMBER)
            n = len(left) // _MEMBER.itemsize
            first = np.full(n, n) if right else np.arange(1, n + 1)
            for pairs in _pairs(rows, np.pad(first, (0, len(rows) - n)), np.pad(np.full(n, len(rows)), (0, len(rows) - n))):
                yield _met(pairs).select(["a", "b"])


def _signed(shared: Broadcast | None):
    """(class, number of distinct shingles, bitmap) once per class in a task, of classes that may be among the marked ones."""
    texts = _texts(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in texts(batches):
            classes = batch.column(0).to_numpy()
            for lo, offsets, h, at in _shingled(batch.column(1).to_pylist()):
                rows = len(offsets) - 1
                own, hashes = distinct_hashes(offsets, h, at)
                words = bitmaps(rows, own, hashes)
                yield pa.RecordBatch.from_arrays([pa.array(classes[lo : lo + rows]), pa.array(np.bincount(own, minlength=rows)), pa.array([w.tobytes() for w in words], pa.binary())], names=["cls", "n", "bits"])

    return run


def may_be_similar(size_a: np.ndarray, size_b: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether sizes and bitmaps leave room for the overlap that the threshold needs."""
    needed = np.ceil(threshold / (1 + threshold) * (size_a + size_b) - 1e-6).astype(np.int64)
    needed -= (size_a.astype(float) * size_b / 2**40).astype(np.int64)  # sizes count 52 bits of a hash
    return (_ones(a & ~b) <= size_a - needed) & (_ones(b & ~a) <= size_b - needed)


def _bounded(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sizes = [batch.column(c).to_numpy() for c in ("na", "nb")]
                words = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in ("bits_a", "bits_b")]
                yield batch.select(["a", "b"]).filter(pa.array(may_be_similar(*sizes, *words, threshold)))

    return run


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, ta, tb = (batch.column(i).to_pylist() for i in range(4))
            kept: dict[int, np.ndarray] = {}

            def shingles(key: int, text: str) -> np.ndarray:
                if key not in kept:
                    if len(kept) > 4096:
                        kept.clear()
                    kept[key] = np.unique(rolling(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), SHINGLE))
                return kept[key]

            out = []
            for x, y, u, v in zip(a, b, ta, tb):
                s, t = shingles(x, u), shingles(y, v)
                shared = len(np.intersect1d(s, t, assume_unique=True))
                sim = shared / (len(s) + len(t) - shared)
                if sim >= threshold:
                    out.append((x, y, sim))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64()))], names=["a", "b", "similarity"])

    return run


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()


def _marked(shared: Broadcast):
    """Rows whose class (the first column) may be among the marked ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(shared.value).view(bool)
        log2 = len(bits).bit_length() - 1
        for batch in batches:
            keep = bits[_slot(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), log2)]
            yield batch.filter(pa.array(keep))

    return run


def _mark_bits(log2: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << log2, bool)
        for batch in batches:
            bits[_slot(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), log2)] = True
        packed = np.packbits(bits).reshape(-1, _CHUNK)
        some = np.nonzero(packed.any(axis=1))[0]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([packed[i].tobytes() for i in some], pa.binary())], names=["part", "bits"])

    return run


def _marks(classes: DataFrame) -> np.ndarray | None:
    """A bit table that has every class in it, 16 bits a class; None if that would pass ``MARK_BITS_LOG2``."""
    log2 = max(17, (16 * classes.count()).bit_length())
    if log2 > MARK_BITS_LOG2:
        return None
    table = np.zeros(((1 << log2) // 8 // _CHUNK, _CHUNK), np.uint8)
    for r in classes.mapInArrow(_mark_bits(log2), "part bigint, bits binary").toLocalIterator():
        table[r["part"]] |= np.frombuffer(r["bits"], np.uint8)
    return table.ravel()


def _texts(shared: Broadcast | None):
    """(class, text) once per class in a task; with marks, only of classes that may be among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if shared is None else np.unpackbits(shared.value).view(bool)
        log2 = 0 if bits is None else len(bits).bit_length() - 1
        seen: set[int] = set()
        for batch in batches:
            classes, kept = [], []
            for t in map(normalise, batch.column(0).to_pylist()):
                if len(t) < SHINGLE or (c := class_of(t)) in seen or (bits is not None and not bits[(c & 0xFFFFFFFFFFFFFFFF) >> (64 - log2)]):
                    continue
                seen.add(c)
                classes.append(c)
                kept.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), pa.array(kept, pa.string())], names=["cls", "text"])

    return run


def similar_classes(rows: DataFrame, threshold: float = THRESHOLD, id_col: str = "id", text_col: str = "content") -> tuple[DataFrame, DataFrame]:
    """(members: cls, id, as often as delivered; links: a, b, similarity of classes, a < b), both from tables in the shared folder."""
    spark = rows.sparkSession
    rows = rows.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() * BANDS * _MEMBER.itemsize // _PART_BYTES))
    tiles = rows.select("text").mapInArrow(_tiles(parts), "part int, rows binary").repartitionById(parts, F.col("part"))
    met = materialize(tiles.mapInArrow(_meet(threshold), "a bigint, b bigint, left binary, right binary"))
    hot = met.where("left IS NOT NULL").select("left", "right")
    hot = hot.repartition(parts, F.xxhash64("left", "right")).mapInArrow(_between, "a bigint, b bigint")
    pairs = materialize(met.where("left IS NULL").select("a", "b").union(hot).dropDuplicates(["a", "b"]))

    wanted = _ends(pairs)
    signed = _once(rows.select("text").mapInArrow(_signed(_spread(wanted)), "cls bigint, n bigint, bits binary"), wanted)
    side = lambda c: signed.select(F.col("cls").alias(c), F.col("n").alias("n" + c), F.col("bits").alias("bits_" + c))
    pairs = materialize(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_bounded(threshold), "a bigint, b bigint"))

    wanted = _ends(pairs)
    texts = _once(rows.select("text").mapInArrow(_texts(_spread(wanted)), "cls bigint, text string"), wanted)
    both = pairs.join(texts.select(F.col("cls").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("cls").alias("b"), F.col("text").alias("tb")), "b")
    links = materialize(both.select("a", "b", "ta", "tb").mapInArrow(_verify(threshold), "a bigint, b bigint, similarity double"))
    return materialize(rows.select("id", "text").mapInArrow(_classes, "cls bigint, id string")), links


def _spread(classes: DataFrame) -> Broadcast | None:
    mark = _marks(classes)
    return None if mark is None else classes.sparkSession.sparkContext.broadcast(mark)


def _once(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row for each of the wanted classes."""
    return rows.join(wanted, "cls", "left_semi").dropDuplicates(["cls"])


def similar_pairs(members: DataFrame, links: DataFrame, expand: int = EXPAND) -> DataFrame:
    """chunk_a < chunk_b and their similarity, copies included."""
    name = F.xxhash64("id")
    several = members.groupBy("cls").agg(F.min(name).alias("x"), F.max(name).alias("y")).where("x < y").select("cls")
    involved = materialize(several.union(_ends(links)).distinct())
    mark = _marks(involved)
    if mark is not None:
        members = members.mapInArrow(_marked(members.sparkSession.sparkContext.broadcast(mark)), "cls bigint, id string")
    m = materialize(members.join(involved, "cls", "left_semi").distinct())
    sizes = m.groupBy("cls").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("rep"))
    m = m.join(sizes.where("copies > 1"), "cls", "left")
    shown = m.where(F.col("copies").isNull() | (F.col("copies") <= expand) | (F.col("id") == F.col("rep"))).select("cls", "id")
    across = links.join(shown.select(F.col("cls").alias("a"), F.col("id").alias("x")), "a").join(shown.select(F.col("cls").alias("b"), F.col("id").alias("y")), "b").select("x", "y", "similarity")
    copies = m.where("copies > 1")
    small = copies.where(F.col("copies") <= expand)
    within = small.select("cls", F.col("id").alias("x")).join(small.select("cls", F.col("id").alias("y")), "cls").where("x < y").select("x", "y")
    stars = copies.where((F.col("copies") > expand) & (F.col("id") != F.col("rep"))).select(F.col("rep").alias("x"), F.col("id").alias("y"))
    everything = across.unionByName(within.unionByName(stars).withColumn("similarity", F.lit(1.0)))
    return everything.where("x != y").groupBy(F.least("x", "y").alias("chunk_a"), F.greatest("x", "y").alias("chunk_b")).agg(F.max("similarity").alias("similarity"))


def memberships(members: DataFrame, links: DataFrame) -> DataFrame:
    """id, class_id (smallest id with the same text), copies (ids of the class), n_links (other classes it is similar to)."""
    degree = links.select(F.col("a").alias("cls")).union(links.select("b")).groupBy("cls").agg(F.count(F.lit(1)).alias("n_links"))
    members = members.distinct()
    named = members.groupBy("cls").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("copies")).join(degree, "cls", "left")
    return members.join(named, "cls").select("id", "class_id", "copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """id, group_id (smallest id of its connected group), n_links (similar classes): one row per id.

    Components by repeated minimum: each round every class takes the smallest label among its own, its
    neighbours' and the label of its label, so paths halve; the rounds end when nothing changes.
    """
    members = members.distinct()
    edges = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    degree = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n_links"))
    label = cut(edges.select(F.col("a").alias("v")).distinct().withColumn("g", F.col("v")))
    while True:
        near = edges.join(label, edges["b"] == label["v"]).groupBy("a").agg(F.min("g").alias("m"))
        step = label.join(near, label["v"] == near["a"], "left").select("v", "g", F.least("g", F.coalesce("m", "g")).alias("m"))
        jump = step.select(F.col("v").alias("at"), F.col("m").alias("far"))
        step = cut(step.join(jump, step["m"] == jump["at"], "left").select("v", "g", F.least("m", F.coalesce("far", "m")).alias("m")))
        changed = step.where("m != g").limit(1).count()
        label = step.select("v", F.col("m").alias("g"))
        if not changed:
            break
    named = members.join(label, members["cls"] == label["v"], "left").join(degree, members["cls"] == degree["a"], "left")
    named = named.select("id", F.coalesce("g", "cls").alias("g"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    names = named.groupBy("g").agg(F.min("id").alias("group_id"))
    return named.join(names, "g").groupBy("id").agg(F.min("group_id").alias("group_id"), F.max("n_links").alias("n_links"))
