"""Byte-level BPE encoding and decoding with DuckDB recursive queries (operator 1).

A text is cut into words by a fixed pattern. A task gathers the words of a few
megabytes of text that it has not met yet and encodes them with one recursive
query: rows (word, position, token) meet the table of merges on adjacent
tokens; each word's pair of least rank is contracted, and so on until no pair
is left. The query stops after a number of steps that bounds its rows and
starts again from where it was.

A word of more than SHORT bytes is encoded in blocks. A sequence of tokens is
the encoding of its bytes exactly when every two neighbours are the encoding of
theirs, so only the seams between blocks are looked at: where two neighbours
are not, some tokens around them are encoded again as one block, twice as many
each time, until no such seam is left. The cost follows the word's length.

Decoding joins (word, position, token) with the token table and gathers the
bytes in the order of the positions, again in DuckDB.

A task turns its texts into distinct parts and numbers into them (pretoken.py)
and keeps the results of recent ones, up to a fixed number. Nothing is shuffled,
and the memory of a task does not depend on the table.

Defined results: a null text is the empty text, of 0 tokens, and decodes to it.
Rows are independent: ties and repeated rows do not matter. Columns of docs named
ids or decoded give way to those of the result; others pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import public_tokenizers

from .common import bounded_batches, pieces_of, release_memory
from .pretoken import Known, coded_parts, compiled, lists, runs, strings, sums, words_of
from .vocab import path, ranks

FILE = "byte_bpe_50k.tiktoken"
CACHED = 200_000
CACHED_LENGTH = 48
SLICE = 4 << 20
SHORT, BLOCK = 64, 24
AT_ONCE = 25_000
ROWS_OF_STEPS = 8_000_000

#: Where no merge that involves the new token has a lower rank, all places of a
#: pair are contracted in one step, leftmost first, which is what contracting
#: them one by one comes to; for the other tokens, only the leftmost place.
ENCODE = """
WITH RECURSIVE state(w, p, k, step) AS (
    SELECT w, p, k, 0 FROM start
    UNION ALL
    (
        WITH pairs AS (
            SELECT w, p, k, step, lead(k) OVER o AS k2, lag(p) OVER o AS before, row_number() OVER o AS place
            FROM state WINDOW o AS (PARTITION BY w ORDER BY p)
        ), ranked AS (
            SELECT pairs.*, m.made, m.leftmost_only FROM pairs LEFT JOIN merges m ON m.pair = (pairs.k::BIGINT << 32) | pairs.k2
        ), best AS (
            SELECT w, min(made) AS made FROM ranked WHERE made IS NOT NULL GROUP BY w
        ), places AS (
            SELECT r.w, r.p, r.made, r.k = r.k2 AS twin, r.leftmost_only, r.place,
                   row_number() OVER (PARTITION BY r.w ORDER BY r.p) AS nth
            FROM ranked r JOIN best USING (w) WHERE r.made = best.made
        ), chosen AS (
            SELECT w, p, made FROM (
                SELECT *, row_number() OVER (PARTITION BY w, place - nth ORDER BY p) AS in_run FROM places)
            WHERE CASE WHEN leftmost_only THEN nth = 1 WHEN twin THEN in_run % 2 = 1 ELSE true END
        )
        SELECT r.w, r.p, coalesce(c.made, r.k), r.step + 1
        FROM ranked r JOIN best USING (w)
        LEFT JOIN chosen c ON c.w = r.w AND c.p = r.p
        LEFT JOIN chosen gone ON gone.w = r.w AND gone.p = r.before
        WHERE gone.p IS NULL AND r.step < $steps
    )
)
SELECT w, p, k, step FROM state QUALIFY step = max(step) OVER (PARTITION BY w)
"""

#: The same for words of few bytes, one place in each step: a token's row also has
#: its end, at which the next one begins, and a pair's rank, places and new end
#: are one number, of which each word's least is taken.
ENCODE_SHORT = """
WITH RECURSIVE state(w, p, k, q, step) AS (
    SELECT w, p, k, p + octet_length(token.bytes)::INT, 0 FROM start JOIN token ON token.id = k
    UNION ALL
    (
        WITH best AS (
            SELECT l.w, min((m.made::BIGINT << 21) | (l.p << 14) | (r.p << 7) | r.q) AS pair
            FROM state l JOIN state r ON r.w = l.w AND r.p = l.q JOIN merges m ON m.pair = (l.k::BIGINT << 32) | r.k
            GROUP BY l.w
        ), parts AS (
            SELECT w, (pair >> 21)::INT AS made, ((pair >> 14) & 127)::INT AS place, ((pair >> 7) & 127)::INT AS gone, (pair & 127)::INT AS new_end FROM best
        )
        SELECT s.w, s.p, CASE WHEN s.p = place THEN made ELSE s.k END, CASE WHEN s.p = place THEN new_end ELSE s.q END, s.step + 1
        FROM state s JOIN parts USING (w)
        WHERE s.p <> gone AND s.step < $steps
    )
)
SELECT w, p, k, step FROM state JOIN (SELECT w, max(step) AS step FROM state GROUP BY w) USING (w, step)
"""
#: Ordered aggregation: a word's ids and the bytes that they decode to.
DECODE = """
SELECT w, list(k ORDER BY p) AS ids, list(token.bytes ORDER BY p) AS bytes FROM encoded JOIN token ON token.id = k GROUP BY w ORDER BY w
"""
FOUND = pa.schema([("key", pa.string()), ("ids", pa.string()), ("n", pa.int64()), ("bytes", pa.binary())])


class BpeCodec:
    """The merges and tokens of a rank file, in a DuckDB database in memory."""

    def __init__(self, file: str):
        known = ranks(file)
        a, b, made = [], [], []
        unsafe = set()  # tokens that a merge of lower rank involves
        for token, rank in known.items():
            for cut in range(1, len(token)):
                left, right = known.get(token[:cut]), known.get(token[cut:])
                if left is not None and right is not None:
                    a.append(left), b.append(right), made.append(rank)
                    unsafe.update(x for x in (left, right) if x > rank)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB"})
        pair = (np.array(a, np.int64) << 32) | np.array(b, np.int64)
        merges = pa.table({"pair": pair, "made": pa.array(made, pa.int32()), "leftmost_only": pa.array([m in unsafe for m in made])})
        self.ids, self.tokens = pa.array(known.values(), pa.int32()), pa.array(known, pa.binary())
        self.by_id = {i: token for token, i in known.items()}
        self.byte_ids = np.array([known[bytes([b])] for b in range(256)], np.int32)
        for name, table in (("merges", merges), ("token", pa.table({"id": self.ids, "bytes": self.tokens}))):
            self._table(name, table)

    def _table(self, name: str, table: pa.Table) -> None:
        self.db.register("given", table)
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS FROM given")
        self.db.unregister("given")

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word."""
        if not words:
            return []
        w, k = self._encoded(pa.array(words, pa.binary()))
        return [x.tolist() for x in np.split(k, np.cumsum(np.bincount(w, minlength=len(words)))[:-1])]

    def encode_decode(self, words: pa.Array) -> tuple[pa.Array, np.ndarray, pa.Array]:
        """For each word (binary) its ids in decimal, joined by spaces, their
        number, and the bytes that they decode to."""
        w, k = self._encoded(words)
        n = np.bincount(w, minlength=len(words))
        self._table("encoded", pa.table({"w": w, "p": np.arange(len(w)), "k": k}))
        found = self.db.sql(DECODE).to_arrow_table().combine_chunks()
        ids, parts = (found.column(c).combine_chunks() for c in ("ids", "bytes"))
        text = pc.binary_join(pa.ListArray.from_arrays(ids.offsets, pc.cast(ids.values, pa.string())), " ")
        out = pa.table({"ids": text, "bytes": pc.binary_join(parts, b"")})
        if len(out) < len(words):  # empty words have no row
            at = np.where(n > 0, np.cumsum(n > 0) - 1, 0)
            out = pa.concat_tables([out, pa.table({"ids": pa.array([""]), "bytes": pa.array([b""])})]).combine_chunks().take(pa.array(np.where(n > 0, at, len(out))))
        return out.column("ids").combine_chunks(), n, out.column("bytes").combine_chunks()

    def _encoded(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(word's place, id) of every token, in order. A word that is a token is
        that token."""
        lengths = pc.binary_length(words).to_numpy(zero_copy_only=False)
        token = pc.index_in(words, value_set=self.tokens)
        whole = token.is_valid().to_numpy(zero_copy_only=False)
        parts = [(np.flatnonzero(whole), self.ids.take(token.drop_null()).to_numpy())]
        short = np.flatnonzero(~whole & (lengths > 0) & (lengths <= SHORT))
        for at in range(0, len(short), AT_ONCE):
            some = short[at : at + AT_ONCE]
            w, k = self._contract(ENCODE_SHORT, words.take(pa.array(some)))
            parts.append((some[w], k))
        long = np.flatnonzero(~whole & (lengths > SHORT))
        if len(long):
            w, k = self._long(words.take(pa.array(long)).to_pylist())
            parts.append((long[w], k))
        w, k = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(w, kind="stable")
        return w[order], k[order]

    def _contract(self, query: str, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(word's place, id) of every token of words that aren't empty, by the
        recursive query."""
        lengths = pc.binary_length(words).to_numpy()
        joined = np.frombuffer(pc.binary_join(lists(words, np.array([len(words)])), b"")[0].as_buffer(), np.uint8)
        w, p = np.repeat(np.arange(len(words), dtype=np.int32), lengths), runs(np.zeros(len(words), np.int64), lengths).astype(np.int32)
        self._table("start", pa.table({"w": w, "p": p, "k": self.byte_ids[joined]}))
        parts, left = [], len(w)
        while left:
            steps = max(4, ROWS_OF_STEPS // left)
            self.db.execute("CREATE OR REPLACE TABLE reached AS " + query.replace("$steps", str(steps)))
            parts.append(self.db.sql(f"SELECT w, p, k FROM reached WHERE step < {steps}").to_arrow_table())
            self.db.execute(f"CREATE OR REPLACE TABLE start AS SELECT w, p, k FROM reached WHERE step >= {steps}")
            ((left,),) = self.db.execute("SELECT count(*) FROM start").fetchall()
        w, p, k = (pa.concat_tables(parts).column(c).to_numpy() for c in ("w", "p", "k"))
        order = np.lexsort((p, w))
        return w[order], k[order]

    def _blocks(self, blocks: list[bytes]) -> list[np.ndarray]:
        """Ids of each block; equal blocks are contracted once."""
        distinct = pa.array(blocks, pa.binary()).dictionary_encode()
        given, found = distinct.dictionary, {}
        length = pc.binary_length(given)
        for query, some in ((ENCODE_SHORT, pc.less_equal(length, SHORT)), (ENCODE, pc.greater(length, SHORT))):
            place = np.flatnonzero(some.to_numpy(zero_copy_only=False))
            for at in range(0, len(place), AT_ONCE):
                own = place[at : at + AT_ONCE]
                w, k = self._contract(query, given.take(pa.array(own)))
                found.update(zip(own.tolist(), np.split(k, np.cumsum(np.bincount(w))[:-1]), strict=True))
        return [found[i] for i in distinct.indices.to_pylist()]

    def _long(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(word's place, id) of every token of long words: blocks, then whatever
        the seams between them ask for."""
        blocks = [(w, word[i : i + BLOCK]) for w, word in enumerate(words) for i in range(0, len(word), BLOCK)]
        parts = self._blocks([x for _, x in blocks])
        k, n = np.concatenate(parts), np.array([len(x) for x in parts])
        w = np.repeat(np.array([i for i, _ in blocks]), n)
        seams = np.cumsum(n)[:-1]  # before the token at that place
        reach = 2
        while True:
            seams = seams[w[seams] == w[seams - 1]]
            pairs, which = np.unique(np.stack([k[seams - 1], k[seams]], 1), axis=0, return_inverse=True)
            again = self._blocks([self.by_id[a] + self.by_id[b] for a, b in pairs.tolist()])
            holds = np.array([len(x) == 2 and x[0] == a and x[1] == b for x, (a, b) in zip(again, pairs, strict=True)], bool)
            seams = seams[~holds[which.ravel()]]
            if not len(seams):
                return w, k
            start = np.maximum(seams - reach, np.searchsorted(w, w[seams]))
            end = np.minimum(seams + reach, np.searchsorted(w, w[seams], "right"))
            begins = np.flatnonzero(np.r_[True, start[1:] >= np.maximum.accumulate(end)[:-1]])
            start, end = start[begins], np.r_[end[begins[1:] - 1], end[-1]]
            fresh = self._blocks([b"".join([self.by_id[x] for x in k[s:e].tolist()]) for s, e in zip(start, end, strict=True)])
            n = np.array([len(x) for x in fresh])
            # what stays, with the new tokens in between
            stays = np.ones(len(k), bool)
            stays[runs(start, end - start)] = False
            order = np.argsort(np.concatenate([np.flatnonzero(stays), np.repeat(start, n)]), kind="stable")
            k, w = (np.concatenate([old[stays], new])[order] for old, new in ((k, np.concatenate(fresh)), (w, np.repeat(w[start], n))))
            ends = end + np.cumsum(n - (end - start))
            seams = np.unique(np.concatenate([ends - n, ends]))
            seams = seams[(seams > 0) & (seams < len(k))]
            reach *= 2

    def decode(self, ids: Iterable[list[int]]) -> list[bytes]:
        """Bytes of each sequence of ids."""
        ids = list(ids)
        lengths = np.array([len(own) for own in ids], np.int64)
        k = np.fromiter((k for own in ids for k in own), np.int32, lengths.sum())
        self._table("encoded", pa.table({"w": np.repeat(np.arange(len(ids)), lengths), "p": np.arange(len(k)), "k": k}))
        found = {w: b"".join(parts) for w, _, parts in self.db.sql(DECODE).fetchall()}
        return [found.get(i, b"") for i in range(len(ids))]


class TextCodec:
    """Encodes and decodes texts; remembers parts and words that it met lately."""

    def __init__(self, file: str, pattern: str):
        self.codec, self.pattern = BpeCodec(file), pattern
        self.parts, self.words = (Known(FOUND, CACHED, CACHED_LENGTH) for _ in range(2))

    def forget(self) -> None:
        """Lets go of what is remembered, for what the process does next."""
        self.parts, self.words = (Known(FOUND, CACHED, CACHED_LENGTH) for _ in range(2))
        release_memory()

    def _encode(self, words: pa.Array) -> pa.Table:
        ids, n, data = self.codec.encode_decode(words.cast(pa.binary()))
        return pa.table([words, ids, pa.array(n), data], schema=FOUND)

    def _cut(self, parts: pa.Array) -> pa.Table:
        flat, lengths = words_of(parts, self.pattern)
        words = flat.dictionary_encode()
        found = self.words.get(words.dictionary, self._encode)
        return pa.table([parts, *_gathered(found, words.indices.to_numpy(), lengths)], schema=FOUND)

    def run(self, texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
        """For each text its ids in decimal, joined by spaces, their number and
        the bytes that they decode to."""
        parts, codes, lengths = coded_parts(texts, compiled(self.pattern).findall)
        return _gathered(self.parts.get(parts, self._cut), codes, lengths)


def _gathered(found: pa.Table, codes: np.ndarray, lengths: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array]:
    """The results of runs of `lengths` codes, numbers into the rows of found.
    Only a run's single code may have no tokens."""
    n = found.column("n").to_numpy()[codes]
    at = pa.array(codes)
    ids, data = (found.column(c).combine_chunks().take(at) for c in ("ids", "bytes"))
    return pc.binary_join(lists(ids, lengths), " "), pa.array(sums(n, lengths)), pc.binary_join(lists(data, lengths), b"")


@lru_cache(maxsize=2)
def text_codec(file: str, pattern: str) -> TextCodec:
    """One per Python process."""
    return TextCodec(file, pattern)


def sha256s(values: pa.Array) -> pa.Array:
    return pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in values], pa.string())


def encode_decode(docs: DataFrame, file: str | None = None, pattern: str = public_tokenizers.PATTERN, digests: bool = False) -> DataFrame:
    """Adds to docs the columns ids (array of int) and decoded (binary); with
    digests, returns doc_id, n_tokens, ids_sha256 and decoded_sha256 instead."""
    bounded_batches(docs.sparkSession)
    file = file or path(FILE)
    docs = docs.withColumn("text", F.coalesce("text", F.lit("")))

    def run(batches):
        release_memory()
        codec = text_codec(file, pattern)
        for batch in batches:
            for part in pieces_of(batch, rows=4096, size=SLICE):
                ids, n, data = codec.run(strings(part.column("text")))
                if digests:
                    yield pa.record_batch([part.column("doc_id"), n, sha256s(ids), sha256s(data)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    numbers = pc.cast(pc.split_pattern(ids.filter(pc.greater(n, 0)), " ").flatten(), pa.int32())
                    yield pa.record_batch([*part.columns, lists(numbers, n.to_numpy()), data], [*part.schema.names, "ids", "decoded"])
        codec.forget()

    if digests:
        return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("ids", "decoded")])
    schema = T.StructType([*docs.schema.fields]).add("ids", T.ArrayType(T.IntegerType())).add("decoded", "binary")
    return docs.mapInArrow(run, schema)


def decode_ids(rows: DataFrame, ids: str = "ids", out: str = "decoded", file: str | None = None) -> DataFrame:
    """Adds the bytes that a column of ids decodes to; null ids give null."""
    bounded_batches(rows.sparkSession)
    file = file or path(FILE)

    def run(batches):
        codec = text_codec(file, public_tokenizers.PATTERN).codec
        for batch in batches:
            given = batch.column(ids).to_pylist()
            found = codec.decode([x or [] for x in given])
            yield pa.record_batch([*batch.columns, pa.array([None if x is None else f for x, f in zip(given, found, strict=True)], pa.binary())], [*batch.schema.names, out])

    rows = rows.drop(out)
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields]).add(out, "binary"))


def op1_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), digests=True)
