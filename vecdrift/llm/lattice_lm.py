"""Language-model scores from a subword lattice (operator 8).

The model: a text is a sequence of pieces of a fixed public vocabulary, drawn
one by one, and an end. The probability of a text sums over all segmentations
of its words into pieces (lattice.py). Piece probabilities start from the
vocabulary's own scores and are re-estimated on the word counts of the training
texts by expectation-maximisation. For comparison, each text has the score of a
smoothed word unigram model of the same training texts.

How it runs: a task turns about BLOCK bytes of text into one row: the block's
distinct words with their training counts, and the documents as numbers into
that list. Only (block, word) rows meet the others: they are counted per word
and later joined with the word's total count and lattice probability, and the
block's row is joined with what came back for it. Texts are read once and never
shuffled; each distinct word is decoded once. What reaches the driver is bounded
by the piece vocabulary.

Defined results: a null text is the empty text, whose only token is the end.
With no training texts every count is 0, base_score is null and the pieces keep
the vocabulary's probabilities. Rows are scored one by one; repeated rows train
as often as they occur; further columns do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, gathered, materialize, pieces_of, remainder
from .lattice import FILE, lattice
from .pretoken import CodedWords, lists, strings, sums, totals
from .vocab import path

BLOCK = 16 << 20
STEPS = 2
SMOOTH = 0.05
HELD_OUT = (5, 1)


def packed(codes: np.ndarray) -> bytes:
    """int32 numbers, their bytes of one place together, compressed."""
    return pa.compress(np.ascontiguousarray(codes.astype("<i4").view(np.uint8).reshape(-1, 4).T), "zstd", asbytes=True) if len(codes) else b""


def unpacked(data: pa.Buffer, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int32)
    planes = np.frombuffer(pa.decompress(data, 4 * n, "zstd"), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<i4")[:, 0]


def _blocks(docs: DataFrame) -> DataFrame:
    """docs: doc_id, train, text. One row per block of documents."""
    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType().add("block", "long").add("doc_ids", T.ArrayType(id_type)).add("train", T.ArrayType(T.BooleanType())).add("lengths", T.ArrayType(T.IntegerType())).add("codes", "binary").add("words", T.ArrayType(T.StringType())).add("counts", T.ArrayType(T.LongType()))

    def row(number, ids, train, coded):
        """One block's row."""
        words, codes, lengths = coded.result()
        ids, train = pa.concat_arrays(ids), pa.concat_arrays(train)
        counts = np.bincount(codes[np.repeat(train.to_numpy(zero_copy_only=False), lengths)], minlength=len(words))
        one = lambda values: lists(values, np.array([len(values)]))
        return pa.record_batch([pa.array([number]), one(ids), one(train), one(pa.array(lengths, pa.int32())), pa.array([packed(codes)], pa.binary()), one(words), one(pa.array(counts, pa.int64()))], schema.names)

    def run(batches):
        number, size, held = TaskContext.get().partitionId() << 24, 0, ([], [], CodedWords())
        for batch in batches:
            for part in pieces_of(batch, rows=4096):
                held[0].append(part.column("doc_id"))
                held[1].append(part.column("train"))
                held[2].add(pc.ascii_lower(strings(part.column("text"))))
                size += part.column("text").nbytes
                if size >= BLOCK or sum(map(len, held[0])) >= 200_000:
                    yield row(number, *held)
                    number, size, held = number + 1, 0, ([], [], CodedWords())
                    pa.default_memory_pool().release_unused()
        if held[0]:
            yield row(number, *held)

    return docs.mapInArrow(run, schema)


def piece_counts(words: DataFrame, logp: np.ndarray, file: str, columns: list[str] | None = None) -> np.ndarray:
    """words: word, c (and `of`, a name in columns). Expected piece counts
    (pieces, columns) under logp: a partial table per task, then a sum per
    piece; the result has a row for each piece and column at most."""
    def run(batches):
        model, total = lattice(file), None
        for batch in gathered(batches):
            column = np.zeros(batch.num_rows, np.int64)
            if "of" in batch.schema.names:
                column = pc.index_in(batch.column("of"), value_set=pa.array(columns, pa.string())).to_numpy()
            got = model.expected_counts(batch.column("word").to_pylist(), column, batch.column("c").to_numpy().astype(float), logp)
            total = got if total is None else total + got
        if total is not None:
            piece, column = np.nonzero(total)
            yield pa.record_batch([pa.array(piece), pa.array(column), pa.array(total[piece, column])], ["piece", "column", "n"])

    rows = words.mapInArrow(run, "piece long, column long, n double").groupBy("piece", "column").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(logp.shape)
    out[rows["piece"].to_numpy(int), rows["column"].to_numpy(int)] = rows["n"].to_numpy()
    return out


def scores(docs: DataFrame, file: str | None = None, steps: int = STEPS) -> DataFrame:
    """Per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score (log10 both)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    file = file or path(FILE)
    held_out = remainder(F.col("doc_id"), HELD_OUT[0]) == HELD_OUT[1]
    blocks = materialize(_blocks(docs.select("doc_id", (~held_out).alias("train"), "text")))
    entries = blocks.select("block", F.posexplode(F.arrays_zip("words", "counts")).alias("pos", "e")).select("block", "pos", F.col("e.words").alias("word"), F.col("e.counts").alias("c"))
    lexicon = materialize(entries.groupBy("word").agg(F.sum("c").alias("c")))
    of_words = lexicon.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    ends = blocks.select(F.sum(F.size(F.filter("train", lambda x: x)))).first()[0] or 0
    total, distinct = of_words[0] + ends, of_words[1] + (ends > 0)

    logp = lattice(file).start()[:, None]
    log_end = float(np.log(0.1))
    for _ in range(steps if ends else 0):
        n = piece_counts(lexicon.where("c > 0"), logp, file)
        whole = n.sum() + SMOOTH * len(n) + ends
        logp, log_end = np.log((n + SMOOTH) / whole), float(np.log(ends / whole))

    def decode(batches):
        for batch in gathered(batches):
            log10 = lattice(file).forward(batch.column("word").to_pylist(), logp)[:, 0] / np.log(10)
            yield pa.record_batch([batch.column("word"), batch.column("c"), pa.array(log10)], ["word", "c", "lm"])

    known = lexicon.mapInArrow(decode, "word string, c long, lm double")
    back = entries.select("block", "pos", "word").join(known, "word").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("pos", "c", "lm"))).alias("found"))
    joined = blocks.select("block", "doc_ids", "train", "lengths", "codes").join(back, "block", "left")
    scale = total + 0.5 * (distinct + 1)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def scored(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                lengths = batch.column("lengths")[i].values.to_numpy().astype(np.int64)
                codes = unpacked(batch.column("codes")[i].as_buffer(), int(lengths.sum()))
                found = batch.column("found")[i]
                c = found.values.field("c").to_numpy() if found.is_valid else np.zeros(0, np.int64)
                lm = found.values.field("lm").to_numpy() if found.is_valid else np.zeros(0)
                base = totals(np.log10((c + 0.5) / scale)[codes], lengths) + np.log10((ends + 0.5) / scale) if total else [None] * len(lengths)
                n_known = sums((c > 0)[codes].astype(np.int64), lengths) + int(ends > 0)
                score = totals(lm[codes], lengths) + log_end / np.log(10)
                yield pa.record_batch(
                    [batch.column("doc_ids")[i].values, pc.invert(batch.column("train")[i].values), pa.array(lengths + 1), pa.array(n_known), pa.array(np.full(len(lengths), total)), pa.array(base, pa.float64()), pa.array(score)], names
                )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(scored, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op8_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
