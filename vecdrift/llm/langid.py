"""Language identification by segmentation-marginalised unigrams (operator 10).

Each language has a probability for every piece of a fixed public vocabulary,
estimated from its training texts' word counts: the expected number of uses
over all segmentations (lattice.py), started from the vocabulary's scores. A
text is scored per language by the forward sum over all segmentations of its
words; the language with the greatest sum is predicted, ties going to the first
name. The score is that language's share of the summed likelihoods, per word
geometric mean first (which keeps it from being 1 for any long text).

Learning moves (language, word, count) rows, summed map-side; the model has
pieces x languages numbers. Predicting is one pass without a shuffle, in which
a task remembers the words it met, up to a fixed number.

Defined results: a null text, or one without a letter, is `und` with score 0;
so is every text if there is nothing to learn from. Training rows with a null
text or lang are left out. Repeated rows train as often as they occur; further
columns do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, pieces_of, remainder
from .lattice import FILE, lattice
from .lattice_lm import BLOCK, piece_counts
from .pretoken import CodedWords, Known, coded_words, strings, totals
from .vocab import path

HELD_OUT = (3, 1)
SMOOTH = 0.05
CACHED, CACHED_LENGTH = 400_000, 64
AT_ONCE = 50_000


def word_counts(docs: DataFrame) -> DataFrame:
    """docs: lang, text. of (the language), word, c."""

    def counted(lang, coded):
        words, codes, lengths = coded.result()
        langs = pa.concat_arrays(lang).dictionary_encode()
        n = max(1, len(words))
        found, c = np.unique(np.repeat(langs.indices.to_numpy().astype(np.int64), lengths) * n + codes, return_counts=True)
        return pa.table([langs.dictionary.take(pa.array(found // n)), words.take(pa.array(found % n)), pa.array(c)], ["of", "word", "c"])

    def run(batches):
        lang, coded, size = [], CodedWords(), 0
        for batch in batches:
            for part in pieces_of(batch, rows=4096):
                lang.append(part.column("lang"))
                coded.add(pc.utf8_lower(part.column("text")))
                size += part.column("text").nbytes
                if size >= BLOCK:
                    yield from counted(lang, coded).to_batches()
                    lang, coded, size = [], CodedWords(), 0
        if lang:
            yield from counted(lang, coded).to_batches()

    rows = docs.mapInArrow(run, "of string, word string, c long")
    return rows.groupBy("of", "word").agg(F.sum("c").alias("c"))


def learn(docs: DataFrame, file: str) -> tuple[list[str], np.ndarray]:
    """The languages, and log probabilities (pieces, languages)."""
    counts = materialize(word_counts(docs))
    langs = sorted(r[0] for r in counts.select("of").distinct().collect())  # one row per language
    if not langs:
        return [], np.zeros((0, 0))
    start = np.repeat(lattice(file).start()[:, None], len(langs), 1)
    n = piece_counts(counts, start, file, langs)
    return langs, np.log((n + SMOOTH) / (n.sum(0) + SMOOTH * len(n)))


class _Words:
    """Log probabilities of words under each language; remembers those of words
    met lately."""

    def __init__(self, file: str, logp: np.ndarray):
        self.model, self.logp = lattice(file), logp
        self.columns = [f"p{i}" for i in range(logp.shape[1])]
        self.schema = pa.schema([("key", pa.string()), *((c, pa.float64()) for c in self.columns)])
        self.known = Known(self.schema, CACHED, CACHED_LENGTH)

    def _learn(self, words: pa.Array) -> pa.Table:
        parts = [self.model.forward(words.slice(i, AT_ONCE).to_pylist(), self.logp) for i in range(0, len(words), AT_ONCE)]
        rows = np.concatenate([np.zeros((0, len(self.columns))), *parts])
        return pa.table([words, *(pa.array(np.ascontiguousarray(rows[:, i])) for i in range(len(self.columns)))], schema=self.schema)

    def means(self, texts: pa.Array) -> np.ndarray:
        """(texts, languages): the mean over a text's words."""
        words, codes, lengths = coded_words(pc.utf8_lower(texts))
        found = self.known.get(words, self._learn)
        each = [totals(found.column(c).to_numpy()[codes], lengths) for c in self.columns]
        return np.stack(each, 1) / np.maximum(1, lengths)[:, None]


def predict(docs: DataFrame, langs: list[str], logp: np.ndarray, file: str) -> DataFrame:
    """Per row of docs: doc_id, lang_pred, score."""

    def run(batches):
        known = _Words(file, logp) if langs else None
        for batch in batches:
            for part in pieces_of(batch, rows=4096):
                texts = strings(part.column("text"))
                lettered = np.array([any(map(str.isalpha, x)) for x in texts.to_pylist()], bool) & bool(langs)
                names, score = np.full(len(texts), "und", object), np.zeros(len(texts))
                if lettered.any():
                    mean = known.means(texts.filter(pa.array(lettered)))
                    names[lettered] = np.array(langs, object)[mean.argmax(1)]
                    score[lettered] = 1 / np.exp(mean - mean.max(1, keepdims=True)).sum(1)
                yield pa.record_batch([part.column("doc_id"), pa.array(names), pa.array(score)], ["doc_id", "lang_pred", "score"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, lang_pred string, score double")


def identify(docs: DataFrame, file: str | None = None) -> DataFrame:
    """Per row of docs: doc_id, held_out, lang_pred, score."""
    bounded_batches(docs.sparkSession)
    file = file or path(FILE)
    held_out = remainder(F.col("doc_id"), HELD_OUT[0]) == HELD_OUT[1]
    train = docs.where(~held_out & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    langs, logp = learn(train, file)
    found = predict(docs, langs, logp, file)
    return found.select("doc_id", (remainder(F.col("doc_id"), HELD_OUT[0]) == HELD_OUT[1]).alias("held_out"), "lang_pred", "score")


def op10_lattice_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
