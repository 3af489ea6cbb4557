"""SimHash near-duplicates with Golay-code fuzzy hashing (operator 5).

A fingerprint is cut into segments. A segment of up to 23 bits is decoded to
the indices of the Golay codewords near it (one or six, see golay.py): vectors
that differ in at most 2 bits have an index in common. A key is one segment as
it is and the index of another one.

near_fingerprints() links 64-bit fingerprints that differ in at most 2 bits, and
loses none: of three segments, at most two hold errors, so that one is equal
and the next one holds at most one error if the right one is taken; the three
keys (first, second), (second, third), (third, first) cover every case.

near_duplicates() links texts whose sets of word shingles have a Jaccard
similarity of at least `similarity`, and loses none. Candidates come from ten
keys of 12 equal bits and a Golay index over a 384-bit fingerprint of the
text's words, which changes little where single words do, and from the prefixes
of the shingle sets: in any one order of all shingles, sets that are so similar
share one of their first |x| - ceil(similarity * |x|) + 1. Common shingles come
last in the order. Of two texts that share a key, a bound on the similarity that
holds for certain (see may_be_similar) decides whether they are candidates;
every link is verified on the shingles.

Hot keys and hot groups: equal fingerprints are one row before any key is made.
The rows of a key are compared where they meet, and give a spanning forest of
their links instead of all pairs. A key or group with more than TILE rows is
dealt out as pairs of tiles, each a task-sized unit of its own; see verified()
for large groups of candidates.

Disk: near_duplicates() shuffles its keys, and then the texts of candidates, in
SLICES, one after another, so that the disk holds one slice's shuffle at a time,
and deletes each table once its consumers are written.

Defined results: a null text is the empty text; texts without words have
fingerprint zero, linked like any other; repeated rows are in one component;
a null doc_id takes part in links but is never the id of a component unless all
are null; rows with a null or repeated doc_id are rows of their own, told apart
by their texts. An empty table gives an empty result; further columns pass through
drop_near_duplicates() and do not matter to the rest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, among, bounded_batches, in_turn, joined_to_groups, materialize, pieces_of, tidy, text_bytes
from .golay import list_keys
from .graph import components
from .pretoken import coded_words, offsets, runs, strings, sums

SEED = 42
MAX_BITS = 2
TABLES, EQUAL_BITS, SEGMENT = 10, 12, 23
WIDE_WORDS = 6
TOKEN = 1 << 62  # added to the keys that are shingles
COUNT_WORDS = 8  # of 16 counts each
COMMON_SAMPLE, COMMON_LEAST, COMMON_MOST = 4000, 4, 50_000
HOT_KEY = 20_000
SLICES = 4
TILE_ITEMS = 2_000_000
TILE = 2000
SEGMENTS = ((0, 21), (21, 21), (42, 22))


def shingles(words: list[bytes], k: int) -> list[bytes]:
    """Runs of k words; fewer words are one run, no words none."""
    if not words:
        return []
    joined, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    if len(words) <= k:
        return [joined]
    return [joined[s:e] for s, e in zip([0, *[x + 1 for x in ends[: -k]]], ends[k - 1 :], strict=True)]


def hashes(items: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(x, SEED) for x in items], np.uint64)


def majority(h: np.ndarray) -> np.ndarray:
    """Bits (n_words * 64) that are set in over half of the rows of h (n, n_words)."""
    counts = np.zeros(h.shape[1] * 64, np.int64)
    for at in range(0, len(h), 16384):
        part = np.ascontiguousarray(h[at : at + 16384].astype(">u8"))
        counts += np.unpackbits(part.view(np.uint8).reshape(len(part), -1), axis=1).sum(0, dtype=np.int64)
    return counts * 2 > len(h)


def packed(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=-1).view(">u8").astype(np.uint64)


def fingerprint(words: list[bytes], k: int) -> int:
    h = hashes(shingles(words, k))
    return int(packed(majority(h[:, None]))[0]) if len(h) else 0


def spread(h: np.ndarray, n: int) -> np.ndarray:
    """n independent 64-bit words from each hash, by the splitmix rule."""
    y = h[:, None] + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    y = (y ^ (y >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    y = (y ^ (y >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return y ^ (y >> np.uint64(31))


def hashed_shingles(texts: pa.Array, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text (A-Z lower-cased) its distinct shingles and its distinct
    words, as hashes. A shingle's hash is made of its words' ones."""
    words, codes, lengths = coded_words(pc.ascii_lower(strings(texts)))
    of = hashes(words.cast(pa.binary()).to_pylist())
    each = of[codes]
    n = max(0, len(each) - k + 1)
    run = each[:n]
    for j in range(1, k):
        run = spread(run, 1)[:, 0] + each[j : n + j]
    run, out = spread(run, 1)[:, 0], []
    for start, m in zip((np.cumsum(lengths) - lengths).tolist(), lengths.tolist(), strict=True):
        if m >= k:
            own = np.unique(run[start : start + m - k + 1])
        else:
            own = hashes([each[start : start + m].tobytes()][:m])
        out.append((own, of[np.unique(codes[start : start + m])]))
    return out


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a long)."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for part in pieces_of(batch, rows=4096):
                fps = [fingerprint(x.lower().split(), k) for x in part.column("text").to_pylist()]
                yield pa.record_batch([part.column("doc_id"), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_bytes().alias("text")).mapInArrow(tidy(run), f"doc_id {id_type}, fp long")


def golay_keys(nodes: DataFrame) -> DataFrame:
    """nodes: fp. Rows key, node, f0, one for each key of each fingerprint."""

    def run(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            segment = [((fp >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
            for one, other in ((0, 1), (1, 2), (2, 0)):
                index = list_keys(segment[other])
                row, column = np.nonzero(index >= 0)
                key = (np.int64(one) << 40) | (segment[one][row] << 12) | index[row, column]
                node = fp.view(np.int64)[row]
                yield pa.record_batch([pa.array(key), pa.array(node), pa.array(node)], ["key", "node", "f0"])

    return nodes.select("fp").mapInArrow(tidy(run), "key long, node long, f0 long")


def slots_of(rows: int, most: int) -> int:
    """Slots of which a full one (over `most` rows) is rare: a power of two, 4
    million at most."""
    return 1 << min(22, max(16, (8 * rows // most).bit_length()))


def tiled(rows: DataFrame, key: str, node: str, tile: int = TILE, weight: str | None = None) -> DataFrame:
    """Adds `unit`: the key's rows are compared within a unit. A key of up to
    `tile` rows (or so much weight) is one unit; one with more is dealt into
    tiles, and each pair of tiles is a unit that holds the rows of both."""
    big = heavy(rows, key, tile, (F.sum(weight) if weight else F.count("*")).alias("_sum")).select(F.col(key).alias("_big"), F.ceil(F.col("_sum") / (tile // 2)).alias("_tiles"))
    big = materialize(big)
    if big.isEmpty():
        return rows.withColumn("unit", F.lit(0).cast("long"))
    rows = rows.join(big, rows[key] == big["_big"], "left")
    own = F.pmod(F.xxhash64(node, F.lit(11)), F.coalesce("_tiles", F.lit(1)))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_tiles", F.lit(1)) - 1))
    rows = rows.withColumn("_own", own).withColumn("_other", other)
    unit = F.least("_own", "_other") * F.coalesce("_tiles", F.lit(1)) + F.greatest("_own", "_other")
    return rows.withColumn("unit", unit).drop("_own", "_other", "_big", "_tiles")


def heavy(rows: DataFrame, key: str, most: int, amount: Column, *more: Column, n_rows: int | None = None) -> DataFrame:
    """The keys whose `amount` (named _sum) is over `most`. A key is in a slot
    with that much, so that only the keys of full slots are summed one by one."""
    slot = F.pmod(F.xxhash64(key), F.lit(slots_of(rows.count() if n_rows is None else n_rows, most)))
    full = F.broadcast(rows.groupBy(slot.alias("_slot")).agg(amount).where(F.col("_sum") > most).select("_slot"))  # a row per slot at most
    return rows.join(full, slot == F.col("_slot"), "left_semi").groupBy(key).agg(amount, *more).where(F.col("_sum") > most)


def counted(items: np.ndarray) -> np.ndarray:
    """128 counts of a set of items, by 7 bits of each, modulo 16, as words."""
    n = np.bincount((items >> np.uint64(57)).astype(np.int64), minlength=COUNT_WORDS * 16) & 15
    return (n[0::2] | n[1::2] << 4).astype(np.uint8).view(np.uint64)


def may_be_similar(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Rows of counted() words and the set's size. False only where the Jaccard
    similarity is certainly less: sets of similarity t differ in at most
    (1 - t) / (1 + t) * (|x| + |y|) items, and counts modulo 16 differ by no
    more, around the circle, than the sets do."""
    x, y = a[..., -1].astype(np.int64), b[..., -1].astype(np.int64)
    near = np.minimum(x, y) >= similarity * np.maximum(x, y) - 1e-9
    bytes_ = [np.ascontiguousarray(v[..., :-1]).view(np.uint8) for v in (a, b)]
    apart = 0
    for one, other in (tuple(v & 15 for v in bytes_), tuple(v >> 4 for v in bytes_)):
        d = (one - other) & 15
        apart = apart + np.minimum(d, 16 - d).sum(-1, dtype=np.int64)
    return near & (apart <= (1 - similarity) / (1 + similarity) * (x + y) + 1e-9)


def _forest(fps: np.ndarray, is_near) -> list[tuple[int, int]]:
    """A spanning forest of the rows of fps (n, words) that are near."""
    open_, links = np.arange(len(fps)), []
    while len(open_):
        todo, open_ = [int(open_[0])], open_[1:]
        while todo and len(open_):
            at = todo.pop()
            near = is_near(fps[open_], fps[at])
            found = open_[near]
            links += [(at, int(x)) for x in found]
            todo += found.tolist()
            open_ = open_[~near]
    return links


def bucket_links(keyed: DataFrame, words: int, most: int, tile: int = TILE, is_near=None, slices: int = 1) -> DataFrame:
    """keyed: key, node, f0.. (long). Links a, b between nodes that share a key
    and differ in at most `most` bits, or are near by is_near(rows, rows): all of
    them for keys with few rows, a spanning forest for the others. Several slices of
    the keys are shuffled one after another, and their links written."""
    columns = [f"f{i}" for i in range(words)]
    if is_near is None:

        def is_near(a, b):
            return np.bitwise_count(a ^ b).sum(1) <= most

    def links_of(key, unit, node, fps):
        out_a, out_b = [], []
        n = len(node)
        start = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (unit[1:] != unit[:-1])]) if n else np.zeros(0, np.int64)
        size = np.diff(np.r_[start, n])
        length = np.repeat(size, size)
        few = np.flatnonzero(length <= 8)
        group = np.repeat(np.arange(len(start)), size)
        for shift in range(1, 8):
            at = few[few + shift < n]
            at = at[group[at] == group[at + shift]]
            if not len(at):
                break
            at = at[is_near(fps[at], fps[at + shift])]
            out_a.append(node[at]), out_b.append(node[at + shift])
        for s, m in zip(start[size > 8], size[size > 8], strict=True):
            found = np.array(_forest(fps[s : s + m], is_near), np.int64).reshape(-1, 2) + s
            out_a.append(node[found[:, 0]]), out_b.append(node[found[:, 1]])
        return np.concatenate(out_a or [node[:0]]), np.concatenate(out_b or [node[:0]])

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table]).combine_chunks()
            key, unit = table.column("key").to_numpy(), table.column("unit").to_numpy()
            if not len(key):
                continue
            same = (key == key[-1]) & (unit == unit[-1])
            cut = len(key) - int(same.sum())
            held = table.slice(cut)
            yield from emit(table.slice(0, cut))
        if held is not None:
            yield from emit(held)

    def emit(table):
        if table.num_rows:
            fps = np.stack([table.column(c).to_numpy().view(np.uint64) for c in columns], 1)
            a, b = links_of(*(table.column(c).to_numpy() for c in ("key", "unit", "node")), fps)
            yield pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])

    keyed = tiled(keyed, "key", "node", tile)
    links = lambda rows: rows.repartition("key", "unit").sortWithinPartitions("key", "unit").mapInArrow(tidy(run), "a long, b long").where("a <> b")
    if slices == 1:
        return links(keyed)
    slot = F.pmod(F.xxhash64("key", F.lit(13)), F.lit(slices))
    return in_turn([links(keyed.where(slot == i)) for i in range(slices)])


def near_fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """Per row of docs: doc_id, fingerprint (16 hex digits), component_id (the
    least doc_id that links of at most 2 bits lead to)."""
    rows = materialize(fingerprints(docs, k))
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    links = bucket_links(materialize(golay_keys(nodes)), 1, MAX_BITS)
    roots = materialize(components(materialize(links.distinct())))
    grouped = nodes.join(roots, nodes["fp"] == roots["node"], "left").withColumn("root", F.coalesce("root", "fp"))
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialize(grouped.join(least, "root").select("fp", "n", "component_id"))
    return joined_to_groups(rows, named, "fp", "n").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def common_items(docs: DataFrame, k: int) -> np.ndarray:
    """Shingles that several of some COMMON_SAMPLE texts have, at most COMMON_MOST
    of them, as rows (hash, rank by number of texts), by hash. They only set the
    order of shingles, and any order finds every link."""
    share = max(1, docs.count() // COMMON_SAMPLE)

    def run(batches):
        for batch in batches:
            for part in pieces_of(batch, rows=512):
                own = [x for x, _ in hashed_shingles(part.column("text"), k)]
                items, n = np.unique(np.concatenate(own).astype(np.uint64), return_counts=True)
                yield pa.record_batch([pa.array(items.view(np.int64)), pa.array(n)], ["item", "n"])

    picked = docs.select(F.coalesce("text", F.lit("")).alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(share)) == 0)
    found = picked.mapInArrow(tidy(run), "item long, n long").groupBy("item").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON_LEAST)
    rows = found.orderBy(F.desc("n"), "item").limit(COMMON_MOST).collect()
    items = np.array([r.item for r in rows], np.int64).view(np.uint64)
    order = np.argsort(items)
    return np.stack([items[order], (len(items) - order).astype(np.uint64)], 1)


def prefix(own: np.ndarray, common: np.ndarray, similarity: float) -> np.ndarray:
    """The first items of a set (distinct, by hash), common ones last, of which
    every set of that similarity has one among its own first."""
    n = len(own) - int(np.ceil(similarity * len(own) - 1e-9)) + 1
    if not len(common) or not len(own):
        return own[:n]
    at = np.minimum(np.searchsorted(common[:, 0], own), len(common) - 1)
    late = common[at, 0] == own
    first = own[~late]
    if len(first) < n:
        first = np.concatenate([first, own[late][np.argsort(common[at[late], 1])]])
    return first[:n]


def profiles(docs: DataFrame, k: int, similarity: float) -> DataFrame:
    """doc_id, t0, t1 (two hashes of the text), set_id (digest of the shingle
    set, as 2 longs), f0.. (wide fingerprint of the words), c0.. (counted()
    shingles and their number), first (the set's prefix)."""
    common = common_items(docs, k)

    def run(batches):
        for batch in batches:
            for part in pieces_of(batch, rows=2048):
                ids, wide, sizes, first = [], [], [], []
                for own, h in hashed_shingles(part.column("text"), k):
                    ids.append(xxhash.xxh3_128_digest(own.tobytes()))
                    sizes.append(np.append(counted(own), np.uint64(len(own))))
                    first.append(prefix(own, common, similarity).view(np.int64))
                    wide.append(packed(majority(spread(h, WIDE_WORDS))) if len(h) else np.zeros(WIDE_WORDS, np.uint64))
                longs = np.concatenate([np.stack(wide), np.stack(sizes)], 1).view(np.int64)
                pair = np.frombuffer(b"".join(ids), np.int64).reshape(-1, 2)
                same = [part.column(c) for c in ("doc_id", "t0", "t1")]
                yield pa.record_batch([*same, pa.array(pair[:, 0]), pa.array(pair[:, 1]), *[pa.array(longs[:, i]) for i in range(longs.shape[1])], pa.array(first, pa.list_(pa.int64()))], [*names, "first"])

    names = ["doc_id", "t0", "t1", "s0", "s1", *WIDE, *COUNTED]
    id_type = docs.schema["doc_id"].dataType.simpleString()
    given = docs.select("doc_id", *text_key(), "text")
    return given.mapInArrow(tidy(run), f"doc_id {id_type}, " + ", ".join(f"{n} long" for n in names[1:]) + ", first array<long>")


WIDE = tuple(f"f{i}" for i in range(WIDE_WORDS))
COUNTED = tuple(f"c{i}" for i in range(COUNT_WORDS + 1))


def text_key() -> list:
    """Columns t0, t1: two hashes of the text, which tell rows of one doc_id, or
    of none, apart."""
    return [F.xxhash64(text_bytes()).alias("t0"), F.xxhash64(F.lit(1), text_bytes()).alias("t1")]


def equal_bits(nodes: int) -> int:
    """Bits of a key that are taken as they are: with the index, enough that a
    key's rows stay few when there are more nodes."""
    return max(EQUAL_BITS, int(nodes).bit_length() - 11)


def sliced(keys: np.ndarray, n: int) -> np.ndarray:
    """The slice, of n, that each key belongs to."""
    return (spread(keys.view(np.uint64), 1)[:, 0] % np.uint64(n)).astype(np.int64)


def table_keys(nodes: DataFrame, n_rows: int, slice_: int = 0, slices: int = 1) -> DataFrame:
    """Rows key, node for the keys of the wide fingerprint and of the prefix: those
    of one slice."""
    bits_taken = equal_bits(n_rows)
    tables = min(TABLES, WIDE_WORDS * 64 // (bits_taken + SEGMENT))

    def run(batches):
        for batch in batches:
            node = batch.column("node").to_numpy()
            first = batch.column("first").flatten().to_numpy().view(np.uint64)
            owner = node[batch.column("first").value_parent_indices().to_numpy()] if len(first) else node[:0]
            yield own(((first >> np.uint64(2)) | np.uint64(TOKEN)).view(np.int64), owner)
            wide = np.stack([batch.column(c).to_numpy() for c in WIDE], 1).view(np.uint64)
            bits = np.unpackbits(np.ascontiguousarray(wide.astype(">u8")).view(np.uint8).reshape(len(wide), -1), axis=1)
            number = lambda part: part.astype(np.int64) @ (1 << np.arange(part.shape[1], dtype=np.int64))
            for t in range(tables):
                at = t * (bits_taken + SEGMENT)
                middle = at + bits_taken
                equal, index = number(bits[:, at:middle]), list_keys(number(bits[:, middle : middle + SEGMENT]))
                row, column = np.nonzero(index >= 0)
                yield own((np.int64(t) << 56) | (equal[row] << 12) | index[row, column], node[row])

    def own(key, node):
        if slices > 1:
            mine = sliced(key, slices) == slice_
            key, node = key[mine], node[mine]
        return pa.record_batch([pa.array(key), pa.array(node)], ["key", "node"])

    return nodes.select("node", "first", *WIDE).mapInArrow(tidy(run), "key long, node long")


def shared_keys(wide: DataFrame, n_rows: int, n_keys: int, slices: int = SLICES) -> DataFrame:
    """The rows of table_keys() that two nodes or more have, some of them twice. Keys
    of the same nodes are one: the new key is a digest of its nodes. Rows of a key
    meet in a task for it, a slice of the keys at a time; those of hot keys are
    summed map-side instead, and get it by a join."""
    keyed = table_keys(wide, n_rows)
    mixed = F.sum(F.xxhash64("node", F.lit(5)).cast("decimal(38,0)"))
    hot = materialize(heavy(keyed, "key", HOT_KEY, F.count("*").alias("_sum"), mixed.alias("_mixed"), n_rows=n_keys).select(F.col("key").alias("_hot"), F.xxhash64("_mixed", "_sum").alias("_digest")))
    found, own = [], None
    if not hot.isEmpty():  # fewer than the rows by HOT_KEY times
        own = F.broadcast(hot) if hot.count() <= 100_000 else hot
        found.append(keyed.join(own, keyed["key"] == hot["_hot"]).select(F.col("_digest").alias("key"), "node"))

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(c).to_numpy() for c in ("key", "node")], 1)
            rows = rows[np.r_[True, (rows[1:] != rows[:-1]).any(1)]]
            rows = rows if held is None else np.concatenate([held, rows])
            cut = len(rows) - int((rows[:, 0] == rows[-1, 0]).sum())
            held = rows[cut:]
            yield digest(rows[:cut])
        if held is not None:
            yield digest(held)

    def digest(rows):
        rows = rows[np.r_[True, (rows[1:] != rows[:-1]).any(1)]] if len(rows) else rows  # rows of equal sets
        key, node = rows[:, 0], np.ascontiguousarray(rows[:, 1])
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.r_[start, len(key)])
        sums = np.add.reduceat(spread(node.view(np.uint64), 1)[:, 0], start) if len(key) else np.zeros(0, np.uint64)
        many = np.repeat(size > 1, size)
        return pa.record_batch([pa.array(np.repeat(sums, size)[many].view(np.int64)), pa.array(node[many])], ["key", "node"])

    for i in range(slices):
        keyed = table_keys(wide, n_rows, i, slices)
        if own is not None:
            keyed = keyed.join(own, keyed["key"] == hot["_hot"], "left_anti")
        found.append(keyed.repartition("key").sortWithinPartitions("key", "node").mapInArrow(tidy(run), "key long, node long"))
    return in_turn(found)


def similar_forest(nodes: np.ndarray, sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links with a Jaccard similarity of at least
    `similarity`: from each set that was reached on to those that were not. The
    sets that hold an item are listed by item, and a set's intersections with
    all others are counted from the lists of its items. The lists are made anew
    when half of the sets in them are reached."""
    size = np.array([len(x) for x in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), size)
    item = np.unique(np.concatenate(sets), return_inverse=True)[1].ravel() if len(owner) else np.zeros(0, np.int64)
    n_items = int(item.max(initial=-1)) + 1
    at = offsets(size)
    by_item = np.argsort(item, kind="stable")
    left, listed = np.ones(len(sets), bool), -1
    links, todo = [], []
    while left.any():
        if 2 * int(left.sum()) <= listed or listed < 0:
            listed = int(left.sum())
            own = by_item[left[owner[by_item]]]
            lists_at, members = offsets(np.bincount(item[own], minlength=n_items)), owner[own]
        if not todo:
            todo = [int(np.argmax(left))]
            left[todo[0]] = False
        i = todo.pop()
        own = item[at[i] : at[i + 1]]
        both = np.bincount(members[runs(lists_at[own], lists_at[own + 1] - lists_at[own])], minlength=len(sets))
        near = left & (both >= similarity * (size[i] + size - both) - 1e-9)
        found = np.flatnonzero(near)
        left[found] = False
        todo += found.tolist()
        links.append(np.stack([np.full(len(found), i), found], 1))
    pairs = np.concatenate([np.zeros((0, 2), np.int64), *links])
    return nodes[pairs[:, 0]], nodes[pairs[:, 1]]


def numbered(sets: DataFrame) -> tuple[DataFrame, bool]:
    """Adds `node`, a number of 64 bits for each (s0, s1): a hash, and whether
    any number is another one, as all sets whose hash is not theirs alone get."""
    nodes, seed = materialize(sets.withColumn("node", F.xxhash64("s0", "s1"))), 0
    while True:
        twice = materialize(nodes.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select(F.col("node").alias("_twice")))
        if twice.isEmpty():
            return nodes, seed > 0
        seed += 1
        again = nodes.join(twice, nodes["node"] == twice["_twice"], "left")
        nodes = materialize(again.withColumn("node", F.when(F.col("_twice").isNull(), F.col("node")).otherwise(F.xxhash64("s1", "s0", F.lit(seed)))).drop("_twice"))


def _sets_of(group: pa.Table) -> list[np.ndarray]:
    items = group.column("items").combine_chunks()
    return np.split(items.flatten().to_numpy(), np.cumsum(pc.list_value_length(items).to_numpy())[:-1]) if len(items) else []


def sketch(items: np.ndarray) -> np.ndarray:
    """Counts of a set of items by leading bits, modulo 256: a power of two of
    them, a quarter of the items or more, so that counts of sets that have little
    in common differ by more than similar sets can."""
    bits = max(7, int(len(items) // 4).bit_length())
    return np.bincount((items.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.uint8)


def sketched_forest(nodes: np.ndarray, size: np.ndarray, sketches: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the pairs whose sketches don't rule out `similarity`.
    Two sketches are compared at the shorter one's length; sets of sizes that can
    be similar have equally many counts, or one has twice as many."""
    width = np.array([len(x) for x in sketches])
    place, own, half = np.zeros(len(nodes), np.int64), {}, {}
    for w in np.unique(width):
        of = np.flatnonzero(width == w)
        place[of] = np.arange(len(of))
        own[w] = np.stack([sketches[i] for i in of])
        half[w] = own[w][:, 0::2] + own[w][:, 1::2]
    left, todo, links = np.ones(len(nodes), bool), [], []
    while left.any():
        if not todo:
            todo = [int(np.argmax(left))]
            left[todo[0]] = False
        i = todo.pop()
        fits = np.flatnonzero(left & (np.minimum(size, size[i]) >= similarity * np.maximum(size, size[i]) - 1e-9))
        w = width[i]
        for other, mine, theirs in ((w, own[w], own.get(w)), (w // 2, half[w], own.get(w // 2)), (2 * w, own[w], half.get(2 * w))):
            some = fits[width[fits] == other]
            if not len(some):
                continue
            d = theirs[place[some]] - mine[place[i]]
            apart = np.minimum(d, 256 - d.astype(np.int16)).sum(1, dtype=np.int64)
            found = some[apart <= (1 - similarity) / (1 + similarity) * (size[some] + size[i]) + 1e-9]
            left[found] = False
            todo += found.tolist()
            links.append(np.stack([np.full(len(found), i), found], 1))
    pairs = np.concatenate([np.zeros((0, 2), np.int64), *links])
    return nodes[pairs[:, 0]], nodes[pairs[:, 1]]


def sharpened(held: DataFrame, similarity: float, most: int) -> tuple[DataFrame, DataFrame]:
    """held with the roots that sketches leave, without nodes that are alone in
    theirs; and the links by which they were found."""

    def sketches(batches):
        for batch in batches:
            items = _sets_of(pa.Table.from_batches([batch]))
            made = [sketch(x) for x in items]
            yield pa.record_batch([batch.column("node"), batch.column("root"), pa.array([len(x) for x in items], pa.int64()), pa.array([x.tobytes() for x in made], pa.binary()), pa.array([len(x) + 100 for x in made], pa.int64())], ["node", "root", "size", "sketch", "n"])

    def near(group: pa.Table) -> pa.Table:
        a, b = sketched_forest(group.column("node").to_numpy(), group.column("size").to_numpy(), [np.frombuffer(x.as_buffer(), np.uint8) for x in group.column("sketch").combine_chunks()], similarity)
        return pa.table({"a": a, "b": b})

    small = held.select("node", "root", "items").mapInArrow(tidy(sketches), "node long, root long, size long, sketch binary, n long")
    edges = materialize(tiled(materialize(small), "root", "node", 8 * most, "n").groupBy("root", "unit").applyInArrow(near, "a long, b long").distinct())
    roots = materialize(components(edges)).withColumnsRenamed({"node": "_node", "root": "_new"})
    return held.join(roots, F.col("node") == F.col("_node")).select("node", F.col("_new").alias("root"), "items", "n"), edges


def verified(held: DataFrame, edges: DataFrame, similarity: float, most: int, first: bool = True) -> DataFrame:
    """held: node, root, items, n; edges: candidate links a, b. Links a, b that
    hold, enough of them to connect what any links within a root connect.

    A root of up to `most` items is one unit. A larger one is first cut by
    sketches of its sets. In one that is still larger, all nodes meet its hub, the
    node with most candidate links, in tiles. Those similar to it need not meet
    each other; the others, few in a group of near copies, meet all of the root's
    nodes in pairs of tiles."""

    def whole(group: pa.Table) -> pa.Table:
        a, b = similar_forest(group.column("node").to_numpy(), _sets_of(group), similarity)
        return pa.table({"a": a, "b": b})

    def starred(tile: pa.Table, hub: pa.Table) -> pa.Table:
        center, sets = hub.column("center").combine_chunks().flatten().to_numpy(), _sets_of(tile)
        size = np.array([len(x) for x in sets], np.int64)
        both = sums(np.isin(np.concatenate([np.zeros(0, np.int64), *sets]), center).astype(np.int64), size)
        near = both >= similarity * (size + len(center) - both) - 1e-9
        hubs = np.full(len(sets), hub.column("hub")[0].as_py())
        return pa.table([tile.column("root"), tile.column("node"), hubs, near], ["root", "node", "hub", "near"])

    big = materialize(heavy(held, "root", most, F.sum("n").alias("_sum")).select(F.col("root").alias("_big"), F.ceil(F.col("_sum") / (most // 2)).alias("_tiles")))
    if big.isEmpty():
        return held.groupBy("root").applyInArrow(whole, "a long, b long")
    small = held.join(big, held["root"] == big["_big"], "left_anti").groupBy("root").applyInArrow(whole, "a long, b long")
    if first:
        cut, edges = sharpened(held.join(big, held["root"] == big["_big"], "left_semi"), similarity, most)
        return small.unionAll(verified(materialize(cut), edges, similarity, most, False))
    dealt = held.join(big, held["root"] == big["_big"]).withColumn("tile", F.pmod(F.xxhash64("node", F.lit(11)), F.col("_tiles")))
    degree = edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("d"))
    hubs = dealt.select("node", "root").join(degree, "node").groupBy("root").agg(F.max(F.struct("d", F.col("node").alias("hub"))).alias("h")).select("root", "h.hub")
    centers = dealt.join(hubs.withColumnRenamed("root", "_root"), F.col("node") == F.col("hub")).select(F.col("root").alias("_of"), "hub", F.col("items").alias("center"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_tiles") - 1)).alias("_tile"))
    star = materialize(dealt.select("root", "tile", "node", "items").groupBy("root", "tile").cogroup(centers.groupBy("_of", "_tile")).applyInArrow(starred, "root long, node long, hub long, near boolean"))
    found = small.unionAll(star.where("near and node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")))
    apart = star.where("not near").select(F.col("node").alias("_apart"))
    if apart.isEmpty():
        return found
    rest = dealt.join(apart, F.col("node") == F.col("_apart"), "left_semi")
    parts = materialize(rest.groupBy("root").agg(F.ceil(F.sum("n") / (most // 2)).alias("_parts")).withColumnRenamed("root", "_rest"))
    all_ = dealt.join(parts, F.col("root") == F.col("_rest"))
    rest = rest.join(parts, F.col("root") == F.col("_rest"))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))
    ones = all_.select("root", "tile", each.alias("part"), "node", "items")
    others = rest.select("root", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_tiles") - 1)).alias("tile"), F.pmod(F.xxhash64("node", F.lit(12)), F.col("_parts")).alias("part"), "node", "items")
    return found.unionAll(ones.unionAll(others).groupBy("root", "tile", "part").applyInArrow(whole, "a long, b long"))


def near_sets(docs: DataFrame, k: int, similarity: float, tile: int, items: int) -> tuple[DataFrame, DataFrame]:
    """Per row of docs: doc_id, t0, t1, s0, s1; and per set s0, s1: root (of its
    group), least (its least doc_id)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    wide_of, shared_of, keys_of, sets_of = (Scratch(spark) for _ in range(4))
    with wide_of.open():
        profiled = materialize(profiles(docs, k, similarity))
    rows = materialize(profiled.select("doc_id", "t0", "t1", "s0", "s1"))
    one = F.min(F.struct("doc_id", "t0", "t1")).alias("one")
    nodes, moved = numbered(profiled.groupBy("s0", "s1").agg(F.min("doc_id").alias("least"), one, *[F.first(c).alias(c) for c in COUNTED]))
    wide = profiled.join(nodes.select("s0", "s1", "node"), ["s0", "s1"]) if moved else profiled.withColumn("node", F.xxhash64("s0", "s1"))
    counts = nodes.select("node", *[F.col(c).alias(f"f{i}") for i, c in enumerate(COUNTED)])
    n_rows, n_keys = profiled.agg(F.count("*"), F.coalesce(F.sum(F.size("first") + 3 * TABLES), F.lit(0))).first()
    with shared_of.open():
        shared = shared_keys(wide, n_rows, n_keys)
    wide_of.close()
    with keys_of.open():
        distinct = materialize(shared.distinct())
        shared_of.close()
        keyed = materialize(distinct.join(counts, "node"))
        found = bucket_links(keyed, len(COUNTED), 0, tile, lambda a, b: may_be_similar(a, b, similarity), SLICES)
    with sets_of.open():
        edges = materialize(found.distinct())
    keys_of.close()
    with sets_of.open():
        loose = materialize(components(edges))
        wanted = materialize(loose.join(nodes.select("node", "one"), "node").select("node", "root", F.col("one.doc_id").alias("_id"), F.col("one.t0").alias("t0"), F.col("one.t1").alias("t1")))

    def sets(batches):
        for batch in batches:
            for part in pieces_of(batch, rows=2048):
                own = [x.view(np.int64) for x, _ in hashed_shingles(part.column("text"), k)]
                yield pa.record_batch([part.column("node"), part.column("root"), pa.array(own, pa.list_(pa.int64())), pa.array([len(x) + 100 for x in own])], ["node", "root", "items", "n"])

    given = docs.select("doc_id", *text_key(), "text")
    maybe = among(given, "t0", wanted, "t0", "_maybe").where("_maybe").drop("_maybe")

    def slice_of(i: int) -> DataFrame:
        """A node has one (t0, t1): its rows are where the join has put them."""
        own = maybe.where(F.pmod("t0", F.lit(SLICES)) == i).join(wanted, ["t0", "t1"]).where(F.col("doc_id").eqNullSafe(F.col("_id")))
        texts = own.dropDuplicates(["t0", "t1", "node"]).select("node", "root", "text")
        return texts.mapInArrow(tidy(sets), "node long, root long, items array<long>, n long")

    with sets_of.open():
        held = in_turn([slice_of(i) for i in range(SLICES)])
        linked = components(materialize(verified(held, edges, similarity, items).distinct()))
    roots = materialize(linked)
    sets_of.close()
    grouped = nodes.select("s0", "s1", "node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return rows, grouped


def near_duplicates(docs: DataFrame, k: int = 5, similarity: float = 0.8, tile: int = TILE, items: int = TILE_ITEMS) -> DataFrame:
    """Per row of docs: doc_id, group_id (the least doc_id of its group)."""
    rows, grouped = near_sets(docs, k, similarity, tile, items)
    least = grouped.groupBy("root").agg(F.min("least").alias("group_id"))
    named = grouped.join(least, "root").select("s0", "s1", "group_id")
    return rows.join(named, ["s0", "s1"]).select("doc_id", "group_id")


def drop_near_duplicates(docs: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without the rows that are near-duplicates of a kept one: of each
    group one row stays, with the least doc_id (null only if all are); of several
    such rows, the one whose shingle set, then text, has the least digest. Rows
    are told apart by doc_id and text: a null or repeated doc_id links nothing.
    Columns are those of docs."""
    rows, grouped = near_sets(docs, k, similarity, TILE, TILE_ITEMS)
    order = F.struct(F.col("least").isNull().alias("none"), "least", "s0", "s1")
    kept = grouped.groupBy("root").agg(F.min(order).alias("kept")).select("kept.least", "kept.s0", "kept.s1")
    kept = rows.join(kept, ["s0", "s1"]).where(F.col("doc_id").eqNullSafe(F.col("least"))).groupBy("s0", "s1", "least", "t0", "t1").agg(F.count("*").alias("n"))
    kept = kept.groupBy("s0", "s1", "least").agg(F.min(F.struct("t0", "t1", "n")).alias("one"))
    kept = materialize(kept.select("s0", "s1", F.col("least").alias("_nd_id"), F.col("one.t0").alias("_nd_0"), F.col("one.t1").alias("_nd_1"), F.col("one.n").alias("n")))
    names = ["_nd_id", "_nd_0", "_nd_1"]
    same = F.col("doc_id").eqNullSafe(F.col("_nd_id")) & (F.col("t0") == F.col("_nd_0")) & (F.col("t1") == F.col("_nd_1"))
    drop = rows.join(kept, ["s0", "s1"], "left").where(~F.coalesce(same, F.lit(False))).select(*[F.col(c).alias(n) for c, n in zip(("doc_id", "t0", "t1"), names, strict=True)]).distinct()

    keyed = docs.withColumns(dict(zip(("_nd_2", "_nd_3"), text_key(), strict=True)))

    same_row = F.col("doc_id").eqNullSafe(F.col("_nd_id")) & (F.col("_nd_2") == F.col("_nd_0")) & (F.col("_nd_3") == F.col("_nd_1"))

    drop = materialize(drop)
    repeated = kept.where("n > 1").select(*names)
    if repeated.isEmpty():
        keyed = among(keyed, "_nd_2", drop, "_nd_0", "_nd_maybe")
        rest = keyed.where("not _nd_maybe")
        keyed = keyed.where("_nd_maybe")
        return rest.unionAll(keyed.join(drop, same_row, "left_anti")).select(*docs.columns)
    repeated = materialize(repeated)
    several = keyed.join(repeated, same_row, "left_semi").dropDuplicates(["doc_id", "_nd_2", "_nd_3"])
    gone = drop.unionAll(repeated)
    return keyed.join(gone, same_row, "left_anti").unionAll(several).select(*docs.columns)


def op5_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
