"""All places of vocabulary entries in many words at once, with numpy.

A trie's edges (node, symbol) are a hash table in two arrays. Every position of
every word starts a walk; all walks go on together, one symbol in each round,
and those that leave the trie end there."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

SYMBOL_BITS = 21  # of a code point
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class Trie:
    def __init__(self, entries: Iterable[tuple[Iterable[int], int]]):
        """entries: the symbols of each entry, and its number."""
        edges: dict[int, int] = {}
        name, nodes = {}, 1
        for symbols, number in entries:
            at = 0
            for s in symbols:
                key = (at << SYMBOL_BITS) | s
                at = edges.get(key, -1)
                if at < 0:
                    edges[key] = at = nodes
                    nodes += 1
            name[at] = number
        self.name = np.full(nodes, -1, np.int32)
        self.name[list(name.keys())] = list(name.values())
        key, to = np.fromiter(edges.keys(), np.int64, len(edges)), np.fromiter(edges.values(), np.int32, len(edges))
        bits = max(8, int(4 * max(1, len(key))).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.key, self.to = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        slot = self._slot(key)
        while len(key):
            free = np.flatnonzero(self.key[slot] < 0)
            slots, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.key[slots], self.to[slots] = key[put], to[put]
            left = np.ones(len(key), bool)
            left[put] = False
            key, to, slot = key[left], to[left], (slot[left] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * _FACTOR) >> self.shift).astype(np.int64)

    def _step(self, node: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The next node, -1 if there is none."""
        key = (node.astype(np.int64) << SYMBOL_BITS) | symbol
        slot = self._slot(key)
        found = self.key[slot]
        out = np.where(found == key, self.to[slot], -1)
        open_ = np.flatnonzero((found != key) & (found >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            found = self.key[slot[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.to[slot[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out

    def matches(self, symbols: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """symbols: those of all words; end: for each of them, where its word
        ends. (start, end, number) of every entry that occurs, in no order."""
        start, at = np.arange(len(symbols)), np.arange(len(symbols))
        node = np.zeros(len(symbols), np.int32)
        found = []
        while len(start):
            node = self._step(node, symbols[at])
            alive = node >= 0
            start, node, at = start[alive], node[alive], at[alive] + 1
            name = self.name[node]
            hit = name >= 0
            found.append((start[hit], at[hit], name[hit]))
            inside = at < end[start]
            start, node, at = start[inside], node[inside], at[inside]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        a, b, c = zip(*found, strict=True)
        return np.concatenate(a), np.concatenate(b), np.concatenate(c)
