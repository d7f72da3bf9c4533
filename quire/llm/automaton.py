"""A minimal acyclic transducer in one memory-mapped file: words, as bytes, to lists of ids.

Words that end alike share states. Each arc carries the number of words that come before those behind it, so the sum along
a path is the word's rank, and the rank leads to its ids.
"""

from __future__ import annotations

import numpy as np

MAGIC = 0x51554952


def build(words: list[bytes]) -> dict[str, np.ndarray]:
    """States and arcs for distinct words in ascending order, each state registered as soon as no later word can change it."""
    arcs: list[list[tuple[int, int]]] = [[]]  # of the states on the path of the last word
    ends = [False]
    register: dict[tuple, int] = {}
    frozen: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

    def freeze(depth: int) -> None:
        while len(arcs) > depth + 1:
            key = (ends.pop(), tuple(arcs.pop()))
            state = register.get(key)
            if state is None:
                state = register[key] = len(frozen)
                frozen.append(key)
            label, _ = arcs[-1][-1]
            arcs[-1][-1] = (label, state)

    last = b""
    for k, word in enumerate(words):
        if k and word <= last:
            raise ValueError("words must be distinct and ascending")
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        freeze(common)
        for c in word[common:]:
            arcs[-1].append((c, -1))
            arcs.append([])
            ends.append(False)
        ends[-1] = True
        last = word
    freeze(0)
    frozen.append((ends[0], tuple(arcs[0])))
    sizes = [0] * len(frozen)  # words behind each state; states come after their targets
    first = np.zeros(len(frozen) + 1, np.int64)
    keys, target, before = [], [], []
    for s, (end, out) in enumerate(frozen):
        n = int(end)
        for label, t in out:
            keys.append(s << 8 | label)
            target.append(t)
            before.append(n)
            n += sizes[t]
        sizes[s] = n
        first[s + 1] = len(keys)
    return {"key": np.array(keys, np.int64), "target": np.array(target, np.int32), "before": np.array(before, np.int32), "end": np.array([e for e, _ in frozen], np.uint8)}


def save(path: str, words: list[bytes], ids: np.ndarray, offset: np.ndarray) -> None:
    """Writes the transducer of words, in ascending order, to their ids: those of word k are ids[offset[k]:offset[k + 1]]."""
    part = build(words) | {"offset": offset.astype(np.int32), "ids": ids.astype(np.int32)}
    names = ("key", "target", "before", "end", "offset", "ids")
    with open(path, "wb") as f:
        np.array([MAGIC, *[len(part[n]) for n in names]], np.int64).tofile(f)
        for n in names:
            f.write(part[n].tobytes() + b"\0" * (-part[n].nbytes % 8))


class Lexicon:
    """The file of save(), mapped into memory and shared by all processes of a machine."""

    def __init__(self, path: str):
        raw = np.asarray(np.memmap(path, np.uint8, "r"))
        head = raw[:56].view(np.int64)
        if head[0] != MAGIC:
            raise ValueError(f"{path} is no lexicon")
        at = 56
        for n, name, kind in zip(head[1:].tolist(), ("key", "target", "before", "end", "offset", "ids"), (np.int64, np.int32, np.int32, np.uint8, np.int32, np.int32), strict=True):
            size = n * np.dtype(kind).itemsize
            setattr(self, name, raw[at : at + size].view(kind))
            at += size + -size % 8
        self.root = len(self.end) - 1

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """Each word's rank, -1 for words that aren't in it. All words take a step at a time."""
        if not len(self.key):
            return np.full(len(words), 0 if len(self.offset) > 1 else -1, np.int64) if not any(words) else np.full(len(words), -1, np.int64)
        flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        start = np.cumsum(size) - size
        state, rank = np.full(len(words), self.root, np.int64), np.zeros(len(words), np.int64)
        live = np.arange(len(words))
        k = 0
        while len(live := live[size[live] > k]):
            want = state[live] << 8 | flat[start[live] + k]
            at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            hit = self.key[at] == want
            state[live[~hit]] = -1
            live, at = live[hit], at[hit]
            rank[live] += self.before[at]
            state[live] = self.target[at]
            k += 1
        return np.where((state >= 0) & (self.end[state] == 1), rank, -1)
