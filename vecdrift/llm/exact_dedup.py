"""Exact deduplication by content-defined chunk recipes (operator 7).

A text (A-Z lower-cased) is cut where a rolling hash of its last 32 bytes has
zero low bits, so that equal texts are cut alike. A chunk's identifier is a
short digest that is *verified*: all chunk contents in the corpus are grouped
by (identifier, content), and where one identifier stands for two contents the
identifiers are made twice as wide and verified again. Then two texts are equal
exactly when their ordered identifier lists (recipes) are, and grouping,
counting and joining move recipes of 16 bytes per chunk rather than texts.
Contents move once, in the verification.

Defined results: a null text is the empty text, whose recipe is empty; a null
doc_id never beats another one; a group with null ids only keeps null. Rows that
repeat both doc_id and text are one document: all of them carry the same
decision, and drop_exact_duplicates() leaves one. Further columns pass through
drop_exact_duplicates() untouched; working columns are prefixed `_xd_`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import among, ascii_lower, bounded_batches, joined_to_groups, materialize, pieces_of, tidy

MIN_CHUNK, MAX_CHUNK, MASK_BITS = 1024, 16384, 12
WINDOW = 32


def _gear_table() -> np.ndarray:
    """256 fixed odd-looking 32-bit values, from the splitmix rule."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(32)).astype(np.uint32)


GEAR = _gear_table()


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """At each byte, a hash of the 32 bytes that end there, by doubling."""
    h, width = GEAR[data], 1
    while width < WINDOW:
        shifted = h[:-width] << np.uint32(width)
        h = h.copy()
        h[width:] += shifted
        width *= 2
    return h


def cut_points(texts: list[bytes]) -> list[list[int]]:
    """For each text, the ends of its chunks. No cut is within the first
    MIN_CHUNK bytes of a chunk, so the hash window never reaches into the
    preceding text of the buffer."""
    joined = b"".join(texts)
    if not joined:
        return [[] for _ in texts]
    high = np.uint32(((1 << MASK_BITS) - 1) << (32 - MASK_BITS))
    marks = np.flatnonzero((rolling_hash(np.frombuffer(joined, np.uint8)) & high) == 0) + 1
    out, start = [], 0
    for text in texts:
        end, at, ends = start + len(text), start, []
        own = marks[np.searchsorted(marks, start + MIN_CHUNK) : np.searchsorted(marks, end, "right")]
        k = 0
        while end - at > MAX_CHUNK or k < len(own):
            while k < len(own) and own[k] < at + MIN_CHUNK:
                k += 1
            cut = min(int(own[k]) if k < len(own) else end, at + MAX_CHUNK, end)
            if cut == end:
                break
            ends.append(cut - start)
            at = cut
        if end > at:
            ends.append(end - start)
        out.append(ends)
        start = end
    return out


def _chunks(texts: list[bytes], width: int) -> list[list[tuple[bytes, bytes]]]:
    out = []
    for text, ends in zip(texts, cut_points(texts), strict=True):
        at, own = 0, []
        for end in ends:
            own.append((hashlib.blake2b(text[at:end], digest_size=width).digest(), text[at:end]))
            at = end
        out.append(own)
    return out


def recipes(docs: DataFrame, id_bytes: int) -> DataFrame:
    """doc_id, `_xd_recipe` (ordered chunk identifiers) and `_xd_sha`."""

    def run(batches):
        for batch in batches:
            for part in pieces_of(batch, rows=4096):
                texts = [x.lower() for x in part.column("text").cast(pa.binary()).to_pylist()]
                ids = [b"".join(k for k, _ in own) for own in _chunks(texts, id_bytes)]
                shas = [hashlib.sha256(x).hexdigest() for x in texts]
                yield pa.record_batch([part.column("doc_id"), pa.array(ids, pa.binary()), pa.array(shas)], ["doc_id", "_xd_recipe", "_xd_sha"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, _xd_recipe binary, _xd_sha string"
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(tidy(run), schema)


def ambiguous_identifiers(docs: DataFrame, id_bytes: int) -> DataFrame:
    """Identifiers that stand for more than one chunk content."""

    def run(batches):
        for batch in batches:
            for part in pieces_of(batch, rows=4096):
                texts = [x.lower() for x in part.column("text").cast(pa.binary()).to_pylist()]
                pairs = list({c: k for own in _chunks(texts, id_bytes) for k, c in own}.items())
                yield pa.record_batch([pa.array([k for _, k in pairs], pa.binary()), pa.array([c for c, _ in pairs], pa.binary())], ["id", "content"])

    chunks = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(tidy(run), "id binary, content binary")
    return chunks.distinct().groupBy("id").count().where("count > 1")


def verified_width(docs: DataFrame, id_bytes: int = 16) -> int:
    """The least width, from id_bytes on by doubling (64 at most: the digest's
    own limit), at which no identifier is ambiguous in docs."""
    while not ambiguous_identifiers(docs, id_bytes).isEmpty():
        if id_bytes >= 64:
            raise ValueError("two chunk contents share a 512-bit digest")
        id_bytes = min(64, 2 * id_bytes)
    return id_bytes


def exact_duplicates(docs: DataFrame, id_bytes: int = 16) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest doc_id stays. The copies of one text
    are counted map-side first; a hot group's result is broadcast to its rows, the
    others' meet them by recipe."""
    bounded_batches(docs.sparkSession)
    width = verified_width(docs, id_bytes)
    rows = materialize(recipes(docs, width))
    groups = materialize(rows.groupBy("_xd_recipe").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")))
    return joined_to_groups(rows, groups, "_xd_recipe", "group_size").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("_xd_sha").alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_bytes: int = 16) -> DataFrame:
    """docs without the rows whose text (A-Z lower-cased) a kept row has too.

    The rows to drop are found by exact_duplicates(); docs whose digest may be
    among theirs (see among()) meet them in an anti join on (doc_id, digest)."""
    marks = materialize(exact_duplicates(docs, id_bytes))
    sha = F.sha2(ascii_lower(F.coalesce("text", F.lit(""))).cast("binary"), 256)
    drop = marks.where(~F.col("kept")).select(F.col("doc_id").alias("_xd_id"), F.col("text_sha256").alias("_xd_sha2")).distinct()
    drop = materialize(drop.withColumn("_xd_number", F.xxhash64("_xd_sha2")))
    keyed = docs.withColumn("_xd_sha", sha).withColumn("_xd_own", F.xxhash64("_xd_sha"))
    keyed = among(keyed, "_xd_own", drop, "_xd_number", "_xd_maybe").drop("_xd_own")
    maybe = keyed.where("_xd_maybe").join(drop, F.col("doc_id").eqNullSafe(F.col("_xd_id")) & (F.col("_xd_sha") == F.col("_xd_sha2")), "left_anti")
    left = keyed.where("not _xd_maybe").unionByName(maybe).drop("_xd_maybe")
    repeated = marks.where("kept").groupBy("doc_id", F.col("text_sha256").alias("_xd_sha")).count().where("count > 1")
    if not repeated.isEmpty():
        left = left.dropDuplicates(["doc_id", "_xd_sha"])
    return left.drop("_xd_sha")
