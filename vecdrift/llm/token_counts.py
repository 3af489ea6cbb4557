"""Token counts by prefix dynamic programming (operator 3).

For byte-pair encoding there is, at every prefix of a word, exactly one last
token that the encoding of that prefix ends with. It is found from left to
right: a vocabulary token t that ends the prefix is the one if the encoding of
the rest ends with a token u that stays apart from t (u and t next to each
other encode to themselves). So counts[i] = counts[i - len(t)] + 1, and the
table of a word answers the count of every prefix of it. Summed over the words
of a text, it answers the count of every prefix that ends in a word, and where
a budget of tokens ends, without encoding anything again.

Defined results: a null text is the empty text, with 0 bytes and 0 tokens. The
strings of added tokens inside a text are one token each. Rows are counted one
by one, so ties, repeated rows and further columns do not matter.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from .common import bounded_batches, pieces_of
from .pretoken import Known, coded_parts, compiled, offsets, strings, sums, words_of
from .trie import Trie
from .vocab import merges, path

LIMIT = 1024
CACHED, CACHED_LENGTH = 1_000_000, 64
SLICE = 8 << 20
AT_ONCE = 100_000
APART, FEW = 1_000_000, 8
FOUND = pa.schema([("key", pa.string()), ("n", pa.int64())])


class PrefixCounter:
    """Counts the tokens of every prefix of a word."""

    def __init__(self, file: str):
        ids, self.pairs, self.added = merges(file)
        self.trie = Trie(ids.items())
        self.made_of = {made: (place, pair) for pair, (place, made) in sorted(self.pairs.items(), key=lambda x: -x[1][0])}
        self.apart: dict[int, bool] = {}
        self.parts, self.words = (Known(FOUND, CACHED, CACHED_LENGTH) for _ in range(2))

    def _apart(self, left: int, right: int) -> bool:
        """Whether the tokens stay as they are when next to each other: going
        back through the merges that made them, latest first, no merge across
        the border may have come before the merges that closed it."""
        limit = 1 << 60
        while True:
            across = self.pairs.get((left, right))
            if across is not None and across[0] < limit:
                return False
            a, b = self.made_of.get(left), self.made_of.get(right)
            if a is None and b is None:
                return True
            # the later of the two merges is undone; of equal ones the right, as merges go from left to right
            if b is None or (a is not None and a[0] > b[0]):
                limit, left = a[0], a[1][1]
                across = self.pairs.get((left, right))
                if across is not None and across[0] <= limit - 1:
                    return False
            else:
                limit, right = b[0] + 1, b[1][0]

    def _stay_apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """_apart() of each pair; distinct pairs are looked at once."""
        pairs, which = np.unique((left.astype(np.int64) << 32) | right, return_inverse=True)
        if len(self.apart) > APART:
            self.apart = {}
        return np.array([self._is_apart(p >> 32, p & 0xFFFFFFFF) for p in pairs.tolist()], bool)[which]

    def _is_apart(self, left: int, right: int) -> bool:
        """_apart(), remembered."""
        pair = (left << 32) | right
        found = self.apart.get(pair)
        if found is None:
            self.apart[pair] = found = self._apart(left, right)
        return found

    def prefix_tables(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """words: binary. The tokens of every prefix of every word, from 0 bytes
        on, one word after the other, and where each word's table begins."""
        lengths = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        at, base = offsets(lengths)[:-1], offsets(lengths + 1)
        symbols = np.frombuffer(b"".join(words.to_pylist()), np.uint8).astype(np.int64)
        start, end, token = self.trie.matches(symbols, np.repeat(at + lengths, lengths))
        word = np.repeat(np.arange(len(words)), lengths)[start]
        inside = end - at[word]  # a prefix's length
        # by length of the prefix; of one prefix the longest last token first
        order = np.argsort((inside << 40) | start)  # starts of one word are together
        to, of, token, inside = (end + word)[order], (start + word)[order], token[order], inside[order]
        counts, last = np.zeros(base[-1], np.int64), np.full(base[-1], -1, np.int64)
        first = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(to) else np.zeros(0, np.int64)
        many = np.diff(np.r_[first, len(to)])
        cut = np.searchsorted(inside[first], np.arange(1, lengths.max(initial=0) + 2))
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            edge, left = first[a:b], many[a:b]
            if b - a <= FEW:  # the rest of long words
                for e in edge.tolist():
                    while last[of[e]] >= 0 and not self._is_apart(int(last[of[e]]), int(token[e])):
                        e += 1
                    last[to[e]], counts[to[e]] = token[e], counts[of[e]] + 1
                continue
            while len(edge):
                before = last[of[edge]]
                holds = before < 0
                known = np.flatnonzero(~holds)
                holds[known] = self._stay_apart(before[known], token[edge[known]])
                done = edge[holds]
                last[to[done]], counts[to[done]] = token[done], counts[of[done]] + 1
                more = ~holds & (left > 1)
                edge, left = edge[more] + 1, left[more] - 1
        return counts, base[:-1]

    def prefix_counts(self, word: str) -> tuple[int, ...]:
        """Tokens of each prefix of the word's bytes, from 0 bytes on."""
        return tuple(self.prefix_tables(pa.array([word.encode()], pa.binary()))[0].tolist())

    def _count_words(self, words: pa.Array) -> pa.Table:
        n = np.zeros(len(words), np.int64)
        for i in range(0, len(words), AT_ONCE):
            some = words.slice(i, AT_ONCE).cast(pa.binary())
            counts, base = self.prefix_tables(some)
            n[i : i + AT_ONCE] = counts[base + pc.binary_length(some).to_numpy(zero_copy_only=False)]
        return pa.table([words, pa.array(n)], schema=FOUND)

    def count_words(self, words: pa.Array) -> np.ndarray:
        """Tokens of each word."""
        distinct = words.dictionary_encode()
        return self.words.get(distinct.dictionary, self._count_words).column("n").to_numpy()[distinct.indices.to_numpy()]

    def _count_parts(self, parts: pa.Array) -> pa.Table:
        words, lengths = words_of(parts, public_tokenizers.PATTERN)
        return pa.table([parts, pa.array(sums(self.count_words(words), lengths))], schema=FOUND)

    def count_parts(self, parts: pa.Array) -> np.ndarray:
        """Tokens of each of the distinct parts (see coded_parts)."""
        return self.parts.get(parts, self._count_parts).column("n").to_numpy()

    def tokens_of_words(self, words: list[tuple[str, bool]]) -> np.ndarray:
        """Tokens of each of text_words()."""
        distinct = pa.array([w for w, _ in words], pa.string()).dictionary_encode()
        n = self._count_words(distinct.dictionary).column("n").to_numpy()[distinct.indices.to_numpy()]
        return np.where(np.array([is_added for _, is_added in words], bool), 1, n)


@lru_cache(maxsize=2)
def _counter(file: str) -> PrefixCounter:
    return PrefixCounter(file)


@lru_cache(maxsize=2)
def _patterns(added: tuple[str, ...]):
    return compiled(public_tokenizers.PATTERN), (regex.compile("|".join(regex.escape(a) for a in added)) if added else None)


def text_words(text: str, added: tuple[str, ...]) -> list[tuple[str, bool]]:
    """The words that are encoded on their own, and whether each is an added token."""
    words, special = _patterns(added)
    if special is None or not any(a in text for a in added):
        return [(w, False) for w in words.findall(text)]
    out, at = [], 0
    for m in special.finditer(text):
        out += [(w, False) for w in words.findall(text[at : m.start()])] + [(m[0], True)]
        at = m.end()
    return out + [(w, False) for w in words.findall(text[at:])]


def prefix_table(text: str, file: str) -> list[tuple[int, int]]:
    """(end in bytes, tokens up to there) at every word end of the text; within
    a word, PrefixCounter.prefix_counts() goes on."""
    counter = _counter(file)
    words = text_words(text, counter.added)
    ends = accumulate(len(w.encode("utf-8")) for w, _ in words)
    return list(zip(ends, accumulate(counter.tokens_of_words(words)), strict=True))


def _leads(texts: list[str], limits: list[int], counter: PrefixCounter) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the tokens, and the bytes of the longest run of whole words
    from its start that holds at most `limit` tokens."""
    words = [text_words(t, counter.added) for t in texts]
    n = counter.tokens_of_words([w for own in words for w in own])
    at = offsets(np.array([len(own) for own in words], np.int64))
    totals, leads = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for i, own in enumerate(words):
        held = np.cumsum(n[at[i] : at[i + 1]])
        totals[i] = held[-1] if len(held) else 0
        leads[i] = sum(len(w.encode()) for w, _ in own[: int(np.searchsorted(held, limits[i], "right"))])
    return totals, leads


def _counts(texts: pa.Array, counter: PrefixCounter, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The same of each text. What adds up over parts is summed; words are only
    looked at in the part in which the limit is reached."""
    added = np.zeros(len(texts), bool)
    for a in counter.added:
        added |= pc.match_substring(texts, a).to_numpy(zero_copy_only=False)
    plain = np.flatnonzero(~added)
    parts, codes, lengths = coded_parts(texts.take(pa.array(plain)), compiled(public_tokenizers.PATTERN).findall)
    n, size = counter.count_parts(parts), pc.binary_length(parts).to_numpy(zero_copy_only=False)
    totals, leads = np.zeros(len(texts), np.int64), pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    totals[plain] = sums(n[codes], lengths)
    at, over = offsets(lengths), np.flatnonzero(totals[plain] > limit)
    last, left = [], []
    for i in over:
        own = codes[at[i] : at[i + 1]]
        held = np.cumsum(n[own])
        k = int(np.searchsorted(held, limit, "right"))
        last.append(parts[int(own[k])].as_py())
        left.append(limit - (int(held[k - 1]) if k else 0))
        leads[plain[i]] = size[own[:k]].sum()
    leads[plain[over]] += _leads(last, left, counter)[1]
    totals[added], leads[added] = _leads(texts.filter(pa.array(added)).to_pylist(), [limit] * int(added.sum()), counter)
    return totals, leads


def token_counts(docs: DataFrame, file: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_tokens, over_limit, and bytes_in_limit
    (bytes of the longest run of whole words from the start within the limit)."""
    bounded_batches(docs.sparkSession)
    file = file or path("byte_bpe_50k.json")

    def run(batches):
        counter = _counter(file)
        for batch in batches:
            for part in pieces_of(batch, rows=4096, size=SLICE):
                texts = strings(part.column("text"))
                n, lead = _counts(texts, counter, limit)
                size = pc.cast(pc.binary_length(texts), pa.int64())
                yield pa.record_batch([part.column("doc_id"), size, pa.array(n), pa.array(n > limit), pa.array(lead)], ["doc_id", "n_bytes", "n_tokens", "over_limit", "bytes_in_limit"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_tokens long, over_limit boolean, bytes_in_limit long")


def op3_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
