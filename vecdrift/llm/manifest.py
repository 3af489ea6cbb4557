"""Operator 11: a Merkle manifest of a dataset, its proofs and their check.

Every row is a leaf; the leaves of a group (a language), in the order of doc_id,
are hashed in runs of two up to the group's subroot, and the subroots likewise up
to the root. A tree of any size is cut into aligned subtrees of BITS levels of
hashing (a block of 2 ** BITS nodes). A block is one row: its digests lie in one
binary value in van Emde Boas order, i.e. the upper half of the levels first,
then each subtree of the lower half, both laid out so again. address() finds a
node's slot from its depth and place; building a block and reading siblings go
through it alone, and touch few cache lines at any line size. Block roots are the
nodes of the next table, BITS levels higher, until one is left. Paths are read
back from the highest table to the leaves.

A leaf's place in its group comes from sorted range partitions and one count for
each (partition, group), so that no group meets in one task; a block's rows and
its digests (2 ** (BITS + 6) bytes) are all that a task holds.

Results for odd input: a null lang is a group of its own, the first one; a null
doc_id comes before all others and is never tampered with; rows of one doc_id
are ordered by leaf digest (equal rows have equal digests, so that their order
does not matter); null and empty texts differ (`-` and `0:`); an empty table
gives no rows; other columns are not read and may have any name."""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize

BITS, MODULUS = 12, 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A path is one step of this many bytes for each level: where the sibling is
#: (0 none, 1 left, 2 right) and its digest.
STEP = 33


def leaf_digest(fields: list[Column]) -> Column:
    """sha256 of the fields, each `-` if null, else its length in bytes, `:` and
    its text; as 32 bytes."""
    text = [c.cast("string") for c in fields]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]).cast("binary"), 256))


def tampered_rows(doc_id: Column, modulus: int = MODULUS) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == 0, F.lit(False))


def address(levels: int, depth: int, place: np.ndarray) -> np.ndarray:
    """Slots of the nodes at `depth` (0: the root) of a full binary tree of so
    many levels of nodes, in van Emde Boas order."""
    if levels == 1:
        return np.zeros(len(place), np.int64)
    low = levels // 2
    high = levels - low
    if depth < high:
        return address(high, depth, place)
    below = depth - high
    inner = place & ((1 << below) - 1)
    return (1 << high) - 1 + (place >> below) * ((1 << low) - 1) + address(low, below, inner)


def levels_of(n: int, bits: int) -> int:
    """Levels of nodes in the blocks of a table of n nodes: all of a block, or
    up to the root if there is one block only."""
    return bits + 1 if n > 1 << bits else (n - 1).bit_length() + 1


def built(digests: np.ndarray, levels: int) -> np.ndarray:
    """digests (nodes, 32) of the lowest level: all slots (2 ** levels - 1, 32).
    A last node without a sibling is hashed alone."""
    store = np.zeros(((1 << levels) - 1, 32), np.uint8)
    for depth in range(levels - 1, -1, -1):
        store[address(levels, depth, np.arange(len(digests)))] = digests
        if depth:
            text = digests.tobytes().hex().encode()
            digests = np.frombuffer(b"".join(sha256(text[i : i + 128]).digest() for i in range(0, len(text), 128)), np.uint8).reshape(-1, 32)
    return store


def siblings(store: np.ndarray, levels: int, n: int, place: np.ndarray) -> np.ndarray:
    """(places, levels - 1, STEP): the paths of the lowest level's nodes to the
    block's root; n of them exist."""
    out = np.zeros((len(place), levels - 1, STEP), np.uint8)
    for k in range(levels - 1):
        other = (place >> k) ^ 1
        have = other < -(-n >> k)
        out[have, k, 0] = 1 + (other[have] & 1)
        out[have, k, 1:] = store[address(levels, levels - 1 - k, other[have])]
    return out


def folded(leaf: bytes, path: bytes) -> bytes:
    """The root that a leaf and its path give."""
    for k in range(0, len(path), STEP):
        own, other = leaf.hex(), path[k + 1 : k + STEP].hex()
        leaf = sha256((own if path[k] == 0 else other + own if path[k] == 1 else own + other).encode()).digest()
    return leaf


def proof_digest(path: bytes) -> str:
    """Hex sha256 of the siblings' hex digests, from the leaf to the root."""
    return sha256("".join(path[k + 1 : k + STEP].hex() for k in range(0, len(path), STEP) if path[k]).encode()).hexdigest()


def placed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds i (place in the group, from 0) and n (the group's rows). Written to
    the shared folder."""
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    sorted_rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    sorted_rows = materialize(sorted_rows).withColumn("_part", F.shiftright("_at", 33))
    ahead = Window.partitionBy(group).orderBy("_part")
    parts = sorted_rows.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    parts = parts.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), (F.sum("_n").over(ahead) - F.col("_n") - F.col("_first")).alias("_shift"), F.sum("_n").over(Window.partitionBy(group)).alias("n"))
    joined = sorted_rows.join(parts, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")))
    return joined.select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("i"), "n")


def _blocks(nodes: DataFrame, bits: int) -> DataFrame:
    """nodes: g, i, n, digest. g, block, n, store, root: one row for each block."""

    def block(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("i")
        n = table.column("n")[0].as_py()
        digests = np.frombuffer(b"".join(table.column("digest").to_pylist()), np.uint8).reshape(-1, 32)
        store = built(digests, levels_of(n, bits))
        first = table.slice(0, 1).select(["g", "block", "n"])
        return first.append_column("store", pa.array([store.tobytes()])).append_column("root", pa.array([store[0].tobytes()]))

    keyed = nodes.select("g", F.shiftright("i", bits).alias("block"), "i", "n", "digest")
    return keyed.groupBy("g", "block").applyInArrow(block, "g string, block long, n long, store binary, root binary")


@dataclass
class Tree:
    """The block tables of one forest, lowest first, and the root of each g."""

    levels: list[DataFrame]
    roots: DataFrame
    bits: int

    @classmethod
    def of(cls, nodes: DataFrame, bits: int = BITS) -> Tree:
        """nodes: g (string), i, n, digest."""
        levels = []
        while True:
            levels.append(materialize(_blocks(nodes, bits)))
            nodes = levels[-1].select("g", F.col("block").alias("i"), (F.shiftright(F.col("n") - 1, bits) + 1).alias("n"), F.col("root").alias("digest"))
            if nodes.where("n > 1").isEmpty():
                break
            # what is complete stays out of the next table
            levels[-1] = levels[-1].withColumn("whole", F.col("n") <= 1 << bits)
            nodes = nodes.where("n > 1")
        levels[-1] = levels[-1].withColumn("whole", F.lit(True))
        whole = [t.where("whole").select("g", "root") for t in levels]
        roots = whole[0]
        for t in whole[1:]:
            roots = roots.unionAll(t)
        return cls(levels, roots, bits)

    def paths_to_blocks(self, above: DataFrame) -> DataFrame:
        """above: g, up (the path on from the root of g). g, block, up of the
        lowest blocks: their roots' paths."""
        found = None
        for table in reversed(self.levels):
            ends = table.where("whole").select("g", "block").join(above, F.col("g").eqNullSafe(F.col("_g"))).select("g", "block", "up")
            here = ends if found is None else ends.unionAll(found)
            found = here if table is self.levels[0] else materialize(self._children(table, here))
        return found

    def _children(self, table: DataFrame, ups: DataFrame) -> DataFrame:
        bits = self.bits

        def run(batches):
            for batch in batches:
                for r in batch.to_pylist():
                    here = min(r["n"] - (r["block"] << bits), 1 << bits)
                    levels = levels_of(r["n"], bits)
                    store = np.frombuffer(r["store"], np.uint8).reshape(-1, 32)
                    own = siblings(store, levels, here, np.arange(here))
                    yield pa.record_batch({"g": pa.array([r["g"]] * here, pa.string()), "block": pa.array(np.arange(here) + (r["block"] << bits)), "up": pa.array([x.tobytes() + r["up"] for x in own], pa.binary())})

        other = ups.select(F.col("g").alias("_h"), F.col("block").alias("_b"), "up")
        rows = table.join(other, F.col("g").eqNullSafe(F.col("_h")) & (F.col("block") == F.col("_b"))).select("g", "block", "n", "store", "up")
        return rows.mapInArrow(run, "g string, block long, up binary")


@dataclass
class Manifest:
    """leaves: doc_id, lang, leaf, i, n and the columns kept; the trees of the
    languages and of their subroots; subroots: lang, subroot, up (path to root)."""

    leaves: DataFrame
    trees: Tree
    top: Tree
    subroots: DataFrame


def build_manifest(docs: DataFrame, keep: dict[str, Column] | None = None, bits: int = BITS) -> Manifest | None:
    """The manifest of a table with the columns of FIELDS; None if it has no
    rows. keep: more columns of the leaves. Texts are read once, by the scan."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), leaf_digest([F.col(c) for c in FIELDS]).alias("leaf"), *[c.alias(k) for k, c in (keep or {}).items()])
    leaves = materialize(placed(rows, "lang", ["doc_id", "leaf"]))
    if leaves.isEmpty():
        return None
    trees = Tree.of(leaves.select(F.col("lang").alias("g"), "i", "n", F.col("leaf").alias("digest")), bits)
    langs = trees.roots.select(F.lit("").alias("all"), F.col("g").alias("lang"), F.col("root").alias("subroot"))
    langs = materialize(placed(langs, "all", ["lang"]))
    top = Tree.of(langs.select(F.col("all").alias("g"), "i", "n", F.col("subroot").alias("digest")), bits)
    return Manifest(leaves, trees, top, langs)


def proven(manifest: Manifest, other: str | None = None, columns: tuple[str, ...] = ()) -> DataFrame:
    """columns of the leaves, leaf, path (to the root), root (folded from the
    column `other` of the leaves, where that is not null, else from leaf)."""
    bits = manifest.top.bits
    start = manifest.top.roots.select(F.col("g").alias("_g"), F.lit(b"").alias("up"))
    top = _with_paths(manifest.subroots.select(F.col("all").alias("g"), "i", "n", "lang", "subroot"), manifest.top, start, bits, ["lang", "subroot"])
    above = materialize(top.select(F.col("lang").alias("_g"), F.col("path").alias("up")))
    leaves = manifest.leaves.select(F.col("lang").alias("g"), "i", "n", *columns, "leaf", *([other] if other and other not in columns else []))
    return _with_paths(leaves, manifest.trees, above, bits, [c for c in leaves.columns if c not in ("g", "i", "n")])


def _with_paths(nodes: DataFrame, tree: Tree, above: DataFrame, bits: int, columns: list[str]) -> DataFrame:
    """nodes: g, i, n and columns. g, columns and path."""
    ups = tree.paths_to_blocks(above)
    low = tree.levels[0].select(F.col("g").alias("_h"), F.col("block").alias("_b"), "store")
    stores = ups.join(low, F.col("g").eqNullSafe(F.col("_h")) & (F.col("block") == F.col("_b"))).select("g", "block", "store", "up")

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.combine_chunks().sort_by("i")
        n, first = left.column("n")[0].as_py(), left.column("block")[0].as_py() << bits
        up = right.column("up")[0].as_py()
        store = np.frombuffer(right.column("store")[0].as_py(), np.uint8).reshape(-1, 32)
        own = siblings(store, levels_of(n, bits), min(n - first, 1 << bits), left.column("i").to_numpy() - first)
        return left.select(["g", *columns]).append_column("path", pa.array([x.tobytes() + up for x in own], pa.binary()))

    keyed = nodes.withColumn("block", F.shiftright("i", bits))
    return keyed.groupBy("g", "block").cogroup(stores.groupBy("g", "block")).applyInArrow(block, nodes.select("g", *columns).schema.add("path", "binary"))


def verified(manifest: Manifest) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; the leaves'
    column `tampered` (null: as it was) takes the leaf's place in the fold."""

    def run(batches):
        for batch in batches:
            proofs, roots = [], []
            for leaf, other, path in zip(*(batch.column(c).to_pylist() for c in ("leaf", "tampered", "path")), strict=True):
                proofs.append(proof_digest(path))
                roots.append(folded(other or leaf, path).hex())
            yield pa.record_batch([batch.column("doc_id"), batch.column("g"), pa.array([x.hex() for x in batch.column("leaf").to_pylist()], pa.string()), pa.array(proofs, pa.string()), pa.array(roots, pa.string())], names=["doc_id", "lang", "leaf", "proof_sha256", "folded_root"])

    rows = proven(manifest, "tampered", ("doc_id",)).mapInArrow(run, "doc_id long, lang string, leaf string, proof_sha256 string, folded_root string")
    root = manifest.top.roots.select(F.lower(F.hex("root")).alias("root"))  # one row
    langs = manifest.subroots.select(F.col("lang").alias("_lang"), F.lower(F.hex("subroot")).alias("subroot"))
    out = rows.join(langs, F.col("lang").eqNullSafe(F.col("_lang"))).crossJoin(F.broadcast(root))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def check_manifest(docs: DataFrame, bits: int = BITS, modulus: int = MODULUS) -> DataFrame:
    """Builds the manifest of docs and verifies each row's proof, with 1 added to
    n_chars (nulls stay) where modulus divides crc32 of the decimal doc_id."""
    changed = [F.try_add(F.col("n_chars").cast("long"), F.lit(1)) if c == "n_chars" else F.col(c) for c in FIELDS]
    manifest = build_manifest(docs, {"tampered": F.when(tampered_rows(F.col("doc_id"), modulus), leaf_digest(changed))}, bits)
    if manifest is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return verified(manifest)


def op11_veb_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check_manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _tree_sql(name: str, base: str) -> str:
    """base: g, i, d (hex). name: g, h (height), i, d."""
    return f"""{name} AS (
          SELECT g, 0 AS h, i, d, count(*) OVER (PARTITION BY g) AS c FROM {base}
          UNION ALL
          SELECT g, h + 1, i // 2, sha256(string_agg(d, '' ORDER BY i)), (any_value(c) + 1) // 2 FROM {name} WHERE c > 1 GROUP BY g, h, i // 2)"""


SQL = f"""
    WITH RECURSIVE
    docs AS (SELECT row_number() OVER () AS k, doc_id, source, lang, n_chars, text FROM documents),
    bits AS (SELECT k, doc_id, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
               lambda c, x: list_reduce(list_concat([xor(c, x)], [0::BIGINT, 1, 2, 3, 4, 5, 6, 7]), lambda a, b: xor(a >> 1, 3988292384 * (a & 1)))) AS crc FROM docs),
    texts AS (SELECT d.*, d.doc_id IS NOT NULL AND xor(b.crc, 4294967295) % 7 = 0 AS hit,
               coalesce(strlen(d.doc_id::VARCHAR) || ':' || d.doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS a,
               coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS b, coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') AS b2, coalesce(strlen(text) || ':' || text, '-') AS c
             FROM docs d JOIN bits b USING (k)),
    hashed AS (SELECT k, doc_id, lang, sha256(a || b || c) AS d, CASE WHEN hit THEN sha256(a || b2 || c) ELSE sha256(a || b || c) END AS t FROM texts),
    leaves AS (SELECT k, doc_id, lang AS g, d, t, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, d) - 1 AS i FROM hashed),
    {_tree_sql("tree", "leaves")},
    subroots AS (SELECT '' AS g, g AS lang, d, row_number() OVER (ORDER BY encode(g) NULLS FIRST) - 1 AS i FROM tree WHERE c = 1),
    {_tree_sql("top", "subroots")},
    total AS (SELECT d AS root FROM top WHERE c = 1),
    up AS (
      SELECT k, g, 0 AS h, i, t AS f, '' AS p, (SELECT max(x.h) FROM tree x WHERE x.g IS NOT DISTINCT FROM l.g) AS most FROM leaves l
      UNION ALL
      SELECT u.k, u.g, u.h + 1, u.i // 2, sha256(CASE WHEN s.d IS NULL THEN u.f WHEN u.i % 2 = 1 THEN s.d || u.f ELSE u.f || s.d END), u.p || coalesce(s.d, ''), u.most
      FROM up u LEFT JOIN tree s ON s.g IS NOT DISTINCT FROM u.g AND s.h = u.h AND s.i = xor(u.i, 1) WHERE u.h < u.most),
    over AS (
      SELECT u.k, 0 AS h, r.i, u.f, u.p, r.d AS subroot, (SELECT max(h) FROM top) AS most FROM up u JOIN subroots r ON r.lang IS NOT DISTINCT FROM u.g WHERE u.h = u.most
      UNION ALL
      SELECT u.k, u.h + 1, u.i // 2, sha256(CASE WHEN s.d IS NULL THEN u.f WHEN u.i % 2 = 1 THEN s.d || u.f ELSE u.f || s.d END), u.p || coalesce(s.d, ''), u.subroot, u.most
      FROM over u LEFT JOIN top s ON s.h = u.h AND s.i = xor(u.i, 1) WHERE u.h < u.most)
    SELECT l.doc_id, l.d AS leaf, o.subroot, root, sha256(o.p) AS proof_sha256, o.f AS folded_root, o.f = root AS verified
    FROM leaves l JOIN over o ON o.k = l.k AND o.h = o.most, total"""
