"""Operator 12: phrases whose words occur together more often than apart.

Counting goes up by one word a round. A phrase of m words is frequent only if its
first and its last m - 1 words are, so round m counts pairs (unit, next unit)
whose units are the frequent phrases of m - 1 words, ranked anew by frequency in
each round, one word further on in the text.

A task takes texts in chunks, maps words to numbers by one dictionary look-up
each, and works on arrays from there. Units among the HEAD most frequent ones have
their rank for an id, the same in all tasks; pairs of two such ids fall into tiles
of TILE x TILE pairs, each a dense array that bincount fills at the pair's own
address. A chunk's tile that is nearly empty, and pairs with a unit beyond the
head, are counted as sorted coordinates (COO): pairs of ids as one number, sorted,
with run lengths. The partial counts leave the task as (lang, phrase, count) and
are summed by Spark, with its map-side combine. Once pairs are counted, texts are cut
down to the runs of words in which longer phrases can lie.

What goes to every task has a fixed size: the head (at most HEAD phrases of
LONGEST bytes) and a bitmap of 2 ** FILTER hashed phrases. A clear bit proves that
a phrase is not frequent; a set bit that is wrong costs a count that the final sum
then rejects, so that the result is exact.

Results for odd input: a null text has no words; a null lang is the language
`und`; texts of any length are cut into chunks at piece ends or, in a piece of
more than a chunk, at words, with the words before repeated so that each phrase is
counted once; repeated rows count each; an empty table gives no rows; other
columns are not read and may have any name."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, pieces_of

MIN_COUNT, MOST_WORDS, TOP = 100, 5, 2000
TILE, HEAD, LONGEST, FILTER = 1024, 4096, 256, 24
#: A tile is counted densely if a chunk has at least one pair for so many cells.
SPARSE = 64
#: Tiles that a task holds before it gives their counts away (8 MB each).
MOST_TILES = 8
#: Coordinates and names that a task holds at most before it gives them away.
MOST_PAIRS = 500_000
CHUNK = 1 << 19
_BREAK = b"\xff"  # in no UTF-8 text
_CUTS = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d", _BREAK * 10)
#: The multiplier of the hash of word hashes; odd, fixed for all tasks.
_P = np.uint64(0x9E3779B97F4A7C15)


def word_blocks(text: bytes, size: int = 4 << 20) -> Iterator[list[bytes]]:
    """Lower-cased words, with a break between pieces; of a text of more than
    `size` bytes block by block, cut between words."""
    text, start = text.lower().translate(_CUTS), 0
    while start < len(text):
        stop = len(text)
        if stop - start > size:
            last = max(text.rfind(c, start, start + size) for c in (b" ", b"\t", _BREAK))
            ahead = [x for c in (b" ", b"\t", _BREAK) if last < 0 and (x := text.find(c, start + size)) >= 0]
            stop = last + 1 if last >= 0 else min(ahead, default=stop - 1) + 1
        yield text[start:stop].replace(_BREAK, b" \xff ").split()
        start = stop


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def phrase_hashes(columns: list[np.ndarray]) -> np.ndarray:
    """One hash for each row of word hashes."""
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = (h ^ c) * _P
        h ^= h >> np.uint64(29)
    return h


class Numbers(dict):
    """Word to number, in the order of appearance."""

    def __init__(self):
        super().__init__()
        self.names: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.names)
        self.names.append(word)
        return n


def _chunks(batches: Iterator[pa.RecordBatch], overlap: int, size: int) -> Iterator[tuple[str, list[bytes], int]]:
    """(lang, words with breaks, how many leading words were in a chunk before)."""
    held: dict[str, list[bytes]] = defaultdict(list)
    for whole in batches:
        for batch in pieces_of(whole):
            for lang, text, before in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()), batch.column("skip").to_pylist(), strict=True):
                own: list[bytes] = []
                for block in word_blocks(text.as_py() or b""):
                    own += block
                    while len(own) >= size:
                        yield lang, own[:size], before
                        own, before = own[size - overlap :], overlap
                if before:
                    if len(own) > before:
                        yield lang, own, before
                    continue
                mine = held[lang]
                mine += own
                mine.append(_BREAK)
                if len(mine) >= size:
                    yield lang, held.pop(lang), 0
            if len(held) > 64:  # many languages: let go of what is gathered
                for lang in list(held):
                    yield lang, held.pop(lang), 0
    for lang, own in held.items():
        yield lang, own, 0


def word_counts(docs: DataFrame, size: int = CHUNK) -> DataFrame:
    """lang, phrase (a word), a: all words."""

    def run(batches):
        for lang, own, before in _chunks(batches, 0, size):
            numbers = Numbers()
            counts = np.bincount(np.fromiter(map(numbers.__getitem__, own), np.int64, len(own)), minlength=len(numbers.names))
            keep = [i for i, w in enumerate(numbers.names) if w != _BREAK]
            yield from _rows(lang, [numbers.names[i] for i in keep], counts[keep])

    return _summed(docs.mapInArrow(run, "lang string, phrase string, a long"))


def _rows(lang: str, names: list[bytes], counts: np.ndarray, step: int = 20_000) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(names), step):
        part = names[i : i + step]
        yield pa.record_batch([pa.array([lang] * len(part), pa.string()), pa.array(part, pa.binary()).cast(pa.string()), pa.array(counts[i : i + step], pa.int64())], names=["lang", "phrase", "a"])


def _summed(partial: DataFrame) -> DataFrame:
    return partial.groupBy("lang", "phrase").agg(F.sum("a").alias("a"))


class Units:
    """What tasks know of the frequent phrases of m words: the head by rank and
    language, and the bitmap of all."""

    def __init__(self, m: int, head: dict[str, dict[bytes, int]], bits: np.ndarray):
        self.m, self.head, self.bits = m, head, bits

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> np.uint64(64 - FILTER)
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def units_of(frequent: DataFrame, m: int, head: int = HEAD) -> Units:
    """frequent: lang, phrase, a; of m words each. The head is by frequency over
    all languages; a rank counts within its language."""
    top = frequent.where(F.octet_length("phrase") <= LONGEST).orderBy(F.col("a").desc(), "lang", "phrase").limit(head)
    ranks: dict[str, dict[bytes, int]] = defaultdict(dict)
    for r in top.collect():  # at most `head` rows of LONGEST bytes
        ranks[r["lang"]][r["phrase"].encode()] = len(ranks[r["lang"]])

    def places(batches):
        for batch in batches:
            seen = np.unique([_hash_of(lang, phrase.split(b" ")) >> np.uint64(64 - FILTER) for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").cast(pa.binary()).to_pylist(), strict=True)])
            yield pa.record_batch([pa.array(seen.astype(np.int64))], ["p"])

    at = frequent.select("lang", "phrase").mapInArrow(places, "p long")
    rows = at.groupBy(F.bitmap_bucket_number(F.col("p") + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("p") + 1)).alias("bits"))
    bits = np.zeros(1 << (FILTER - 3), np.uint8)
    for r in rows.collect():  # 2 ** FILTER bits at most
        own = np.frombuffer(r["bits"], np.uint8)
        start = (r["bucket"] - 1) * len(own)
        bits[start : start + len(own)] = own
    return Units(m, dict(ranks), bits)


def _hash_of(lang: str, phrase: list[bytes]) -> np.uint64:
    return _with_lang(lang, phrase_hashes([np.array([word_hash(w)], np.uint64) for w in phrase]))[0]


def _with_lang(lang: str, h: np.ndarray) -> np.ndarray:
    return phrase_hashes([h, np.full(len(h), word_hash(lang.encode()), np.uint64)])


class Words:
    """A task's numbers and hashes of words; a break is number 0."""

    def __init__(self):
        self.numbers, self.hashes = Numbers(), np.zeros(0, np.uint64)
        self.numbers[_BREAK]  # noqa: B018 numbered first

    def __call__(self, own: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        word = np.fromiter(map(self.numbers.__getitem__, own), np.int64, len(own))
        new = self.numbers.names[len(self.hashes) :]
        self.hashes = np.r_[self.hashes, np.fromiter(map(word_hash, new), np.uint64, len(new))]
        return word, self.hashes[word]


def _units(known: Units, lang: str, word: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a unit that may be frequent starts at each place, and its hash."""
    m = known.m
    n = max(0, len(word) - m + 1)
    whole = np.ones(n, bool)
    for k in range(m):
        whole &= word[k : k + n] != 0
    h = _with_lang(lang, phrase_hashes([hashes[k : k + n] for k in range(m)]))
    return whole & known.has(h), h


class Counter:
    """Counts of pairs of units of one language in a task: dense tiles, and sorted
    coordinates for the rest. The head's ranks are the first ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.head = ranks, len(ranks)
        self._clear()

    def _clear(self) -> None:
        self.ids = Numbers()
        self.ids.update(self.ranks)
        self.ids.names = list(self.ranks)
        self.tiles: dict[tuple[int, int], np.ndarray] = {}
        self.coo: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, left: np.ndarray, right: np.ndarray) -> None:
        dense = np.zeros(len(left), bool)
        both = np.flatnonzero((left < self.head) & (right < self.head))
        across = self.head // TILE + 1
        tile = (left[both] // TILE) * across + right[both] // TILE
        for t in np.flatnonzero(np.bincount(tile, minlength=1) * SPARSE >= TILE * TILE):
            own = both[tile == t]
            key = (int(t) // across, int(t) % across)
            cells = np.bincount((left[own] % TILE) * TILE + right[own] % TILE, minlength=TILE * TILE)
            self.tiles[key] = self.tiles[key] + cells if key in self.tiles else cells
            dense[own] = True
        pairs = (left[~dense] << 32) | right[~dense]
        self._keep(pairs, np.ones(len(pairs), np.int64))

    def _keep(self, pairs: np.ndarray, counts: np.ndarray) -> None:
        order = np.argsort(pairs, kind="stable")
        pairs, counts = pairs[order], counts[order]
        starts = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]]) if len(pairs) else np.zeros(0, np.int64)
        if len(starts):
            self.coo.append((pairs[starts], np.add.reduceat(counts, starts)))

    def full(self) -> bool:
        """Merges the coordinates when they are many; true if they stay so."""
        if sum(len(p) for p, _ in self.coo) <= MOST_PAIRS and len(self.ids) <= MOST_PAIRS:
            return False
        parts, self.coo = self.coo, []
        self._keep(np.concatenate([p for p, _ in parts]), np.concatenate([c for _, c in parts]))
        return len(self.coo[0][0]) > MOST_PAIRS // 2 or len(self.ids) > MOST_PAIRS

    def counted(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """left, right, count; then empty."""
        for (a, b), cells in self.tiles.items():
            at = np.flatnonzero(cells)
            yield a * TILE + at // TILE, b * TILE + at % TILE, cells[at]
        if self.coo:
            parts, self.coo = self.coo, []
            self._keep(np.concatenate([p for p, _ in parts]), np.concatenate([c for _, c in parts]))
            yield self.coo[0][0] >> 32, self.coo[0][0] & 0xFFFFFFFF, self.coo[0][1]

    def rows(self, lang: str, step: int = 100_000) -> Iterator[pa.RecordBatch]:
        """lang, phrase (the left unit and the right one's last word), a; then empty."""
        names = pa.array(self.ids.names, pa.binary())
        lasts = pa.array([x[x.rfind(b" ") + 1 :] for x in self.ids.names], pa.binary())
        for left, right, counts in self.counted():
            for i in range(0, len(left), step):
                phrase = pc.binary_join_element_wise(names.take(pa.array(left[i : i + step])), lasts.take(pa.array(right[i : i + step])), b" ")
                yield pa.record_batch([pa.array([lang], pa.string()).take(pa.array(np.zeros(len(phrase), np.int64))), phrase.cast(pa.string()), pa.array(counts[i : i + step])], names=["lang", "phrase", "a"])
        self._clear()


def pair_counts(docs: DataFrame, units: Units, size: int = CHUNK) -> DataFrame:
    """lang, phrase of units.m + 1 words, a: phrases both of whose units may be
    frequent, with their exact counts."""
    shared = docs.sparkSession.sparkContext.broadcast(units)

    def run(batches):
        known = shared.value
        m, words = known.m, Words()
        counters: dict[str, Counter] = {}
        for lang, own, before in _chunks(batches, m, size):
            if len(words.numbers) > MOST_PAIRS:
                words = Words()
            word, hashes = words(own)
            unit, h = _units(known, lang, word, hashes)
            at = np.flatnonzero(unit[:-1] & unit[1:])
            at = at[at + m >= before]  # the others' last word is in the chunk before
            if not len(at):
                continue
            counter = counters.setdefault(lang, Counter(known.head.get(lang, {})))
            # ids of the units that are in a pair; two phrases of one hash are told apart by their words
            used = np.unique(np.r_[at, at + 1])
            _, first, same = np.unique(h[used], return_index=True, return_inverse=True)
            name = lambda p, w=words.numbers.names, x=word: b" ".join([w[i] for i in x[p : p + m].tolist()])
            place = np.zeros(len(unit), np.int64)
            place[used] = np.fromiter((counter.ids[name(p)] for p in used[first].tolist()), np.int64, len(first))[same]
            twins = np.zeros(len(used), bool)
            for k in range(m):
                twins |= word[used + k] != word[used[first][same] + k]
            for p in used[twins].tolist():
                place[p] = counter.ids[name(p)]
            counter.add(place[at], place[at + 1])
            if counter.full():
                yield from counter.rows(lang)
            if sum(len(c.tiles) for c in counters.values()) > MOST_TILES or len(counters) > 64:
                for other in list(counters):
                    yield from counters.pop(other).rows(other)
        for lang, counter in counters.items():
            yield from counter.rows(lang)

    return _summed(docs.mapInArrow(run, "lang string, phrase string, a long"))


def runs(docs: DataFrame, units: Units, most_words: int = MOST_WORDS, size: int = CHUNK) -> DataFrame:
    """lang, text, skip: what is left of the texts if only words in two successive
    units that may be frequent stay, with a break where words are left out. It
    holds every longer phrase whose parts are all frequent. skip: so many leading
    words were in the row before (texts of more than a chunk)."""
    shared = docs.sparkSession.sparkContext.broadcast(units)

    def run(batches):
        known, words = shared.value, Words()
        for lang, own, before in _chunks(batches, most_words - 1, size):
            if len(words.numbers) > MOST_PAIRS:
                words = Words()
            unit, _ = _units(known, lang, *words(own))
            at = np.flatnonzero(unit[:-1] & unit[1:])
            stay = np.zeros(len(own), bool)
            for k in range(known.m + 1):
                stay[at + k] = True
            place = np.flatnonzero(stay)
            if not len(place):
                continue
            # runs that begin in the chunk before have a row each
            start, parts = 0, []
            for stop in [*(np.flatnonzero(np.diff(place) > 1) + 1).tolist(), len(place)] if before else ():
                if place[start] >= before:
                    break
                parts.append((place[start:stop], before - int(place[start])))
                start = stop
            for part, skip in [*parts, (place[start:], 0)]:
                if len(part) > skip:
                    after = np.r_[np.diff(part) > 1, True].tolist()
                    text = b" ".join([own[p] + b" ." if end else own[p] for p, end in zip(part.tolist(), after, strict=True)])
                    yield pa.record_batch([pa.array([lang], pa.string()), pa.array([text], pa.binary()).cast(pa.string()), pa.array([skip], pa.int64())], names=["lang", "text", "skip"])

    return docs.mapInArrow(run, "lang string, text string, skip long")


def frequent_phrases(docs: DataFrame, most_words: int = MOST_WORDS, min_count: int = MIN_COUNT, size: int = CHUNK, head: int = HEAD) -> tuple[DataFrame, DataFrame]:
    """docs: lang, text. (lang, m, phrase, a of all phrases of 1 to most_words
    words with a >= min_count; lang, n: all word occurrences)."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"), F.lit(0).cast("long").alias("skip"))
    counts = materialize(word_counts(rows, size))
    totals = materialize(counts.groupBy("lang").agg(F.sum("a").alias("n")))
    level = materialize(counts.where(F.col("a") >= min_count))
    found = [level.withColumn("m", F.lit(1))]
    for m in range(1, most_words):
        if level.isEmpty():
            break
        units = units_of(level, m, head)
        if m == 2:  # longer phrases lie within what the frequent pairs leave
            rows = materialize(runs(rows, units, most_words, size))
        level = materialize(pair_counts(rows, units, size).where(F.col("a") >= min_count))
        found.append(level.withColumn("m", F.lit(m + 1)))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out, totals


def collocations(docs: DataFrame, most_words: int = MOST_WORDS, min_count: int = MIN_COUNT, top: int = TOP, size: int = CHUNK, head: int = HEAD) -> DataFrame:
    """docs: lang, text. lang, rank, phrase, a, l, r, n, score: each language's
    phrases with the highest scores, without those whose words lie in a longer
    candidate that is as frequent."""
    found, totals = frequent_phrases(docs, most_words, min_count, size, head)
    words = F.split("phrase", " ")
    candidates = found.where("m > 1").withColumn("w", words)
    cut = lambda a, b: F.array_join(F.slice("w", a, b), " ")
    # all cuts of each candidate, with the counts of both parts
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 1)))
    cuts = cuts.select("lang", "phrase", "m", "a", "k", cut(F.lit(1), F.col("k")).alias("first"), cut(F.col("k") + 1, F.col("m") - F.col("k")).alias("rest"))
    part = lambda name, count: found.select("lang", F.col("phrase").alias(name), F.col("a").alias(count))
    cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]).join(F.broadcast(totals) if _few(totals) else totals, "lang")
    d = lambda c: F.col(c).cast("decimal(19,0)")
    # in 38 digits: a and n have at most 17 each here, l and r 19 each
    over = (F.lit(1000).cast("decimal(4,0)") * F.col("a").cast("decimal(16,0)") * F.col("n").cast("decimal(18,0)")).alias("over")
    cuts = cuts.select("*", over, (d("l") * d("r")).alias("under")).withColumn("score", F.expr("over div under"))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "m", "a", "l", "r", "n")).alias("c")).select("lang", "phrase", "c.*")
    # a phrase in a longer one as frequent is also in one a single word longer
    inner = candidates.where("m > 2").select("lang", F.explode(F.array(cut(F.lit(1), F.col("m") - 1), cut(F.lit(2), F.col("m") - 1))).alias("phrase"), "a")
    inner = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("a")))
    order = (F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    # first in parts of a language, then what is left of each part
    part_of = F.pmod(F.xxhash64("phrase"), F.lit(64))
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", part_of).orderBy(*order))).where(F.col("rank") <= top)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return kept.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _few(rows: DataFrame, most: int = 10_000) -> bool:
    return rows.limit(most + 1).count() <= most


def op12_tiled_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
    WITH docs AS (SELECT row_number() OVER () AS k, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    pieces AS (SELECT k, lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM docs),
    lists AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
    grams AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM lists, range(1, 6) AS s(m) WHERE len(w) >= m)),
    f AS (SELECT lang, m, phrase, count(*)::HUGEINT AS a FROM grams GROUP BY ALL),
    totals AS (SELECT lang, sum(a)::HUGEINT AS n FROM f WHERE m = 1 GROUP BY lang),
    c AS (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND a >= 100),
    cuts AS (SELECT lang, m, phrase, a, w, unnest(range(1, m)) AS k FROM c),
    scored AS (SELECT c.lang, c.phrase, c.a, x.a AS l, y.a AS r, n, 1000 * c.a * n // (x.a * y.a) AS score, k
               FROM cuts c JOIN totals USING (lang) JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:k], ' ') AND x.m = k
               JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[k + 1:], ' ') AND y.m = c.m - k),
    best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    kept AS (SELECT b.* FROM best b WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.lang = b.lang AND o.m > len(string_split(b.phrase, ' ')) AND o.a >= b.a AND contains(' ' || o.phrase || ' ', ' ' || b.phrase || ' ')))
    SELECT lang, row_number() OVER w AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
    FROM kept WINDOW w AS (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase))
    QUALIFY rank <= 2000"""
