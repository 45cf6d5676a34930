"""A minimal acyclic transducer from byte strings to sequences of numbers.

Sorted words are added one by one; states with equal continuations are shared (as all
common suffixes are). Each arc adds the number of words that it passes by, so the sum along
a word is its rank, and ranks index the output sequences. The automaton is a few flat
arrays in one file, which readers map into memory and walk for many words at once.
"""

from __future__ import annotations

import numpy as np

MAGIC = 0x47524C58


def build(words: list[bytes], outputs: list[list[int]]) -> bytes:
    """The file for distinct words in ascending order and their outputs."""
    arcs: list[dict[int, int]] = [{}]
    final = [False]
    register: dict[tuple, int] = {}
    path: list[tuple[int, int]] = []  # (parent, label) along the last word
    free: list[int] = []
    before = b""

    def settle(depth: int) -> None:
        while len(path) > depth:
            parent, label = path.pop()
            child = arcs[parent][label]
            key = (final[child], tuple(arcs[child].items()))
            twin = register.setdefault(key, child)
            if twin != child:
                arcs[parent][label] = twin
                free.append(child)

    for word in words:
        if word <= before and before:
            raise ValueError("words must ascend")
        k = 0
        while k < min(len(word), len(before)) and word[k] == before[k]:
            k += 1
        settle(k)
        state = arcs[path[-1][0]][path[-1][1]] if path else 0
        for c in word[k:]:
            if free:
                new = free.pop()
                arcs[new], final[new] = {}, False
            else:
                new = len(arcs)
                arcs.append({})
                final.append(False)
            arcs[state][c] = new
            path.append((state, c))
            state = new
        final[state] = True
        before = word
    settle(0)

    number = {0: 0}
    order = [0]
    for s in order:
        for t in arcs[s].values():
            if t not in number:
                number[t] = len(order)
                order.append(t)
    below: dict[int, int] = {}
    stack = [0]
    while stack:  # words below each state, children first
        s = stack[-1]
        todo = [t for t in arcs[s].values() if t not in below]
        if todo:
            stack += todo
            continue
        stack.pop()
        below[s] = int(final[s]) + sum(below[t] for t in arcs[s].values())
    keys, targets, skips = [], [], []
    for s in order:
        skip = int(final[s])
        for c in sorted(arcs[s]):
            t = arcs[s][c]
            keys.append(number[s] << 8 | c)
            targets.append(number[t])
            skips.append(skip)
            skip += below[t]
    offsets = np.cumsum([0] + [len(o) for o in outputs])
    flat = [i for o in outputs for i in o]
    head = np.array([MAGIC, len(order), len(keys), len(words), len(flat), 0], np.int64)
    parts = [head, np.array(keys, np.int64), np.array(targets, np.int32), np.array(skips, np.int32), offsets.astype(np.int32), np.array(flat, np.int32), np.array([final[s] for s in order], np.uint8)]
    return b"".join(x.tobytes() for x in parts)


class Transducer:
    """Reads a built file, which is mapped, not loaded."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        magic, states, arcs, words, flat, _ = (int(x) for x in raw[:48].view(np.int64))
        if magic != MAGIC:
            raise ValueError("not a transducer file")
        at = 48

        def take(kind: type, n: int) -> np.ndarray:
            nonlocal at
            size = n * np.dtype(kind).itemsize
            part = raw[at : at + size].view(kind)
            at += size
            return part

        self.keys, self.targets, self.skips = take(np.int64, arcs), take(np.int32, arcs), take(np.int32, arcs)
        self.offsets, self.outputs, self.final = take(np.int32, words + 1), take(np.int32, flat), take(np.uint8, states)

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """Rank of each word, -1 for words that aren't held."""
        out = np.full(len(words), -1, np.int64)
        if not len(self.keys) or not words:
            return out
        size = np.array([len(w) for w in words])
        order = np.argsort(-size, kind="stable")
        flat = np.frombuffer(b"".join(words), np.uint8)
        start = (np.cumsum(size) - size)[order]
        size = size[order]
        state, rank, ok = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.ones(len(words), bool)
        for k in range(int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -k, "left"))
            i = np.flatnonzero(ok[:n])
            if not len(i):
                break
            key = state[i] << 8 | flat[start[i] + k]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            ok[i[~hit]] = False
            i, at = i[hit], at[hit]
            rank[i] += self.skips[at]
            state[i] = self.targets[at]
        good = ok & (self.final[state] > 0)
        out[order[good]] = rank[good]
        return out

    def output(self, rank: int) -> np.ndarray:
        return self.outputs[self.offsets[rank] : self.offsets[rank + 1]]
