"""Counts over a whole text that the quality operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, pieces_of

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATIOS = (
    "log_words", "word_length", "symbols", "dup_lines", "repeats", "distinct", "most_frequent", "upper", "digits", "exclamations", "bars", "line_length",
    "long_words", "short_words", "stops", "other",
)


def repeated_words(words: list, k: int = 5) -> int:
    """Words that lie in a run of k words which the text has twice or more."""
    runs = list(zip(*[words[i:] for i in range(k)], strict=False))
    if len(set(runs)) == len(runs):
        return 0
    seen, twice = set(), set()
    for r in runs:
        (twice if r in seen else seen).add(r)
    held, end = 0, 0
    for at, r in enumerate(runs):
        if r in twice:
            held += at + k - max(at, end)
            end = at + k
    return held


def counts(text: str) -> tuple[list[bytes], tuple[int, ...]]:
    """The words (as bytes), and COUNTS."""
    words = text.encode().split()
    seen, dup, lines = set(), 0, text.split("\n")
    for line in lines:
        if line in seen:
            dup += bool(line.strip(SPACES))
        else:
            seen.add(line)
    return words, (len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), dup, repeated_words(words))


def ratios(text: str, words: list[bytes], n: tuple[int, ...]) -> tuple[float, ...]:
    """RATIOS, from the text and its counts; finite for every text."""
    n_words, chars, symbols, dup, repeat = n
    w, c = max(1, n_words), max(1, chars)
    each: dict[bytes, int] = {}
    for x in words:
        each[x] = each.get(x, 0) + 1
    sizes = np.fromiter(map(len, words), np.int64, n_words)
    lines = text.count("\n") + 1
    upper = sum(map(str.isupper, text)) if not text.isascii() else len(text) - len(text.translate(_NO_UPPER))
    digits = sum(map(text.count, "0123456789"))
    stops = text.count(".") + text.count(",")
    return (
        float(np.log1p(n_words)), chars / w, symbols / c, dup / lines, repeat / w, len(each) / w, max(each.values(), default=0) / w, upper / c, digits / c,
        text.count("!") / w, text.count("|") / w, float(np.log1p(n_words / lines)), float((sizes > 25).sum()) / w, float((sizes <= 2).sum()) / w, stops / w,
        sum(map(text.count, "{}[]()=_/\\@^~`")) / c,
    )


_NO_UPPER = dict.fromkeys(map(ord, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))


def with_stats(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in `keep`, COUNTS (long) and `ratios` (array of double)."""
    bounded_batches(docs.sparkSession)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, rows=4096):
                n, r = [], []
                for text in part.column("text").to_pylist():
                    words, own = counts(text)
                    n.append(own)
                    r.append(ratios(text, words, own))
                yield pa.record_batch([*[part.column(c) for c in keep], *[pa.array([x[i] for x in n], pa.int64()) for i in range(len(COUNTS))], pa.array(r, pa.list_(pa.float64()))], [*keep, *COUNTS, "ratios"])

    given = docs.select(*keep, F.coalesce("text", F.lit("")).alias("text"))
    schema = docs.select(*keep).schema
    for c in COUNTS:
        schema = schema.add(c, "long")
    return given.mapInArrow(run, schema.add("ratios", T.ArrayType(T.DoubleType())))
