"""Sums over all segmentations of words into vocabulary pieces.

A word is read with a mark in front that stands for the white space before it;
pieces carry that mark at their start only, so no segmentation crosses words.
forward() gives the log of the summed probability of all segmentations, by a
forward recursion in log space over the characters; expected_counts() adds the
backward recursion for expectation-maximisation. Characters that are no piece
are the product of their bytes' pieces.

The pieces in all words are found by one walk of a trie (trie.py) and serve all
models (columns). The recursions go on in all words at once: a round handles
the pieces that end (or begin) at the same distance from the words' starts.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from .pretoken import offsets
from .trie import Trie
from .vocab import pieces

MARK = "▁"
FILE = "piece_bpe_32k.model"


class Lattice:
    def __init__(self, file: str):
        self.ids, self.scores, self.bytes = pieces(file)
        self.size = len(self.scores) + 256
        self.trie = Trie((map(ord, piece), i) for piece, i in self.ids.items())

    def start(self) -> np.ndarray:
        """Log probabilities from the vocabulary's own scores, which are
        negative ranks: in proportion to 1 / (rank + 10), byte pieces last."""
        rank = np.maximum(-np.array(self.scores + [-float(len(self.scores))] * 256), 0)
        rank[rank > 1e8] = len(self.scores)
        p = 1 / (rank + 10)
        return np.log(p / p.sum())

    def _cells(self, words: list[str]) -> _Cells:
        joined = MARK.join(["", *words]).encode("utf-32-le", "replace")
        symbols = np.frombuffer(joined, np.uint32).astype(np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        word, at = np.repeat(np.arange(len(words)), lengths), offsets(lengths)
        start, end, piece = self.trie.matches(symbols, at[1:][word])
        alone = np.ones(len(symbols), bool)
        alone[start[end == start + 1]] = False
        alone = np.flatnonzero(alone)
        chars, which = np.unique(symbols[alone], return_inverse=True)
        start, end = np.concatenate([start, alone]), np.concatenate([end, alone + 1])
        return _Cells(start, end, np.concatenate([piece, self.size + which]), word[start], at, [self._own_bytes(int(c)) for c in chars])

    def _own_bytes(self, char: int) -> list[int]:
        return [self.bytes[b] for b in chr(char).encode("utf-8", "replace")]

    @staticmethod
    def _table(logp: np.ndarray, strange: list[list[int]]) -> np.ndarray:
        """logp (size, columns), then a row for each strange character."""
        return np.concatenate([logp, np.array([logp[own].sum(0) for own in strange]).reshape(-1, logp.shape[1])])

    def forward(self, words: list[str], logp: np.ndarray) -> np.ndarray:
        """(words, columns): the natural log of each word's probability."""
        cells = self._cells(words)
        p = self._table(logp, cells.strange)
        return cells.recursion(lambda edges: p[cells.piece[edges]], logp.shape[1], True)[cells.last]

    def expected_counts(self, words: list[str], column: np.ndarray, weight: np.ndarray, logp: np.ndarray) -> np.ndarray:
        """(size, columns): how often each piece is expected, words taken
        `weight` times under the model in `column`."""
        cells = self._cells(words)
        own = column[cells.word]
        p = self._table(logp, cells.strange)[cells.piece, own]
        alpha, beta = (cells.recursion(lambda edges: p[edges, None], 1, onward)[:, 0] for onward in (True, False))
        got = np.exp(alpha[cells.of] + p + beta[cells.to] - alpha[cells.last][cells.word]) * weight[cells.word]
        n = logp.shape[1]
        total = np.bincount(cells.piece * n + own, got, (self.size + len(cells.strange)) * n).reshape(-1, n)
        for bytes_, own in zip(cells.strange, total[self.size :], strict=True):
            for b in bytes_:
                total[b] += own
        return total[: self.size]


class _Cells:
    """The pieces in words as edges between nodes, the places between characters:
    of, to (nodes), piece, word; the words' last nodes."""

    def __init__(self, start, end, piece, word, at, strange):
        self.of, self.to, self.piece, self.word, self.strange = start + word, end + word, piece, word, strange
        self.first = (at + np.arange(len(at)))[:-1]
        self.last = (at[1:] + np.arange(len(at) - 1)) if len(at) > 1 else self.first

    def recursion(self, p, columns: int, onward: bool) -> np.ndarray:
        """(nodes, columns): logs of the sums over all ways from a word's first
        node, or to its last one; p(edges) are the edges' own logs."""
        here, there = (self.to, self.of) if onward else (self.of, self.to)
        far = here - self.first[self.word] if onward else self.last[self.word] - here
        order = np.argsort((far << 40) | here)
        node, far = here[order], far[order]
        out = np.zeros((int(self.last[-1]) + 1 if len(self.last) else 0, columns))
        start = np.flatnonzero(np.r_[True, node[1:] != node[:-1]]) if len(node) else np.zeros(0, np.int64)
        ends = np.r_[start[1:], len(node)]
        cut = np.searchsorted(far[start], np.arange(1, far.max(initial=0) + 2))
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            low, high = start[a], ends[b - 1]
            edges = order[low:high]
            x = out[there[edges]] + p(edges)
            if b - a < high - low:
                own, n = start[a:b] - low, ends[a:b] - start[a:b]
                top = np.maximum.reduceat(x, own)
                x -= np.repeat(top, n, 0)
                x = np.log(np.add.reduceat(np.exp(x, out=x), own)) + top
            out[node[start[a:b]]] = x
        return out


@lru_cache(maxsize=2)
def lattice(file: str) -> Lattice:
    return Lattice(file)
