"""Texts of an Arrow batch as flat arrays of code points, in blocks of bounded size."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np

#: Characters of a block; one longer text is a block of its own.
BLOCK_CHARS = 1 << 20
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
_WHITE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


@cache
def char_classes() -> np.ndarray:
    """Class of each code point: letter (L*), number (N*), white space or other."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[list(_WHITE)] = SPACE
    return table


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def blocks(texts: list[str], max_chars: int = BLOCK_CHARS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, code points of their texts, offset of each text and the end)."""
    lo, total = 0, 0
    for i, t in enumerate(texts):
        if total and total + len(t) > max_chars:
            yield _block(texts, lo, i)
            lo, total = i, 0
        total += len(t)
    if lo < len(texts):
        yield _block(texts, lo, len(texts))


def _block(texts: list[str], lo: int, hi: int) -> tuple[int, int, np.ndarray, np.ndarray]:
    part = texts[lo:hi]
    offsets = np.zeros(len(part) + 1, np.int64)
    np.cumsum([len(t) for t in part], out=offsets[1:])
    return lo, hi, codepoints("".join(part)), offsets


def rolling(values: np.ndarray, width: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of each window of ``width`` values, by doubling; windows may cross texts."""
    h, have, out, done = values.astype(np.uint64) + np.uint64(0x51ED27), 1, None, 0
    mult = [pow(base, k, 1 << 64) for k in range(width + 1)]
    while True:
        if width & have:
            if out is None:
                out = h
            else:
                n = len(values) - done - have + 1
                out = out[:n] * np.uint64(mult[have]) + h[done : done + n] if n > 0 else h[:0]
            done += have
        if done == width:
            break
        n = len(values) - 2 * have + 1
        h = h[:n] * np.uint64(mult[have]) + h[have : have + n] if n > 0 else h[:0]
        have *= 2
    out = out[: max(0, len(values) - width + 1)]
    out = out ^ (out >> np.uint64(29))
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def owners(offsets: np.ndarray) -> np.ndarray:
    """Row of each flat position."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start..start+length of each row, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
