"""Minimal acyclic automaton over byte strings whose words carry lists of ids.

States with equal futures are shared (suffixes are stored once). A word's index is the sum of
the numbers its arcs skip, and the index selects its ids. The automaton is one flat file of
arrays that workers map into memory; look-ups walk all words of a block at once.
"""

from __future__ import annotations

import numpy as np

_MAGIC = 0x4C584631


def compile_lexicon(words: dict[bytes, list[int]]) -> bytes:
    """The file's bytes for ``words`` (bytes to ids); the empty word is left out."""
    register: dict[tuple, int] = {}
    arcs_of: list[list[tuple[int, int]]] = [[]]
    final = [False]
    path = [0]  # unminimised states of the last word, by depth
    last = b""

    def settle(depth: int, word: bytes) -> None:
        for d in range(len(path) - 1, depth, -1):
            state = path[d]
            key = (final[state], *arcs_of[state])
            if (same := register.get(key)) is not None:
                arcs_of[path[d - 1]][-1] = (word[d - 1], same)
            else:
                register[key] = state
        del path[depth + 1 :]

    for word in sorted(w for w in words if w):
        common = next((i for i, (a, b) in enumerate(zip(last, word)) if a != b), min(len(last), len(word)))
        settle(common, last)
        for b in word[common:]:
            arcs_of.append([])
            final.append(False)
            arcs_of[path[-1]].append((b, len(arcs_of) - 1))
            path.append(len(arcs_of) - 1)
        final[path[-1]] = True
        last = word
    settle(0, last)

    number: dict[int, int] = {}
    order: list[int] = []
    stack = [0]
    while stack:
        s = stack.pop()
        if s not in number:
            number[s] = len(order)
            order.append(s)
            stack.extend(t for _, t in arcs_of[s])
    below: dict[int, int] = {}

    def count(root: int) -> None:
        work = [root]
        while work:
            s = work[-1]
            need = [t for _, t in arcs_of[s] if t not in below]
            if need:
                work.extend(need)
            else:
                below[s] = final[s] + sum(below[t] for _, t in arcs_of[s])
                work.pop()

    count(0)
    keys, targets, skips = [], [], []
    for s in order:
        skip = int(final[s])
        for b, t in arcs_of[s]:
            keys.append(number[s] * 256 + b)
            targets.append(number[t])
            skips.append(skip)
            skip += below[t]
    ids = [words[w] for w in sorted(w for w in words if w)]
    offsets = np.zeros(len(ids) + 1, np.int64)
    np.cumsum([len(x) for x in ids], out=offsets[1:])
    parts = [
        np.array(keys, np.int64), np.array(targets, np.int64), np.array(skips, np.int64),
        np.array([final[s] for s in order], np.int64), offsets, np.array([i for x in ids for i in x], np.int64),
    ]
    by_key = np.argsort(parts[0], kind="stable")
    parts[:3] = [p[by_key] for p in parts[:3]]
    head = np.array([_MAGIC, *map(len, parts)], np.int64)
    return b"".join(x.tobytes() for x in (head, *parts))


class Lexicon:
    """A compiled lexicon, mapped from its file."""

    def __init__(self, path: str | None = None, data: bytes | None = None) -> None:
        flat = np.frombuffer(data, np.int64) if path is None else np.memmap(path, np.int64, "r")
        if flat[0] != _MAGIC:
            raise ValueError("not a compiled lexicon")
        sizes, at, parts = flat[1:7], 7, []
        for n in map(int, sizes):
            parts.append(flat[at : at + n])
            at += n
        self.keys, self.targets, self.skips, self.final, self.offsets, self.ids = parts

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def find(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Index of each word ``data[start : start + length]``, -1 if it isn't in the lexicon."""
        out = np.full(len(starts), -1, np.int64)
        if not len(self) or not len(starts):
            return out
        alive = np.nonzero(lengths > 0)[0]
        state, index, depth = np.zeros(len(alive), np.int64), np.zeros(len(alive), np.int64), 0
        while len(alive):
            key = state * 256 + data[starts[alive] + depth]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            there = self.keys[at] == key
            alive, at = alive[there], at[there]
            state, index = self.targets[at], index[there] + self.skips[at]
            depth += 1
            ended = lengths[alive] == depth
            if ended.any():
                done = ended & (self.final[state] == 1)
                out[alive[done]] = index[done]
                keep = ~ended
                alive, state, index = alive[keep], state[keep], index[keep]
        return out
