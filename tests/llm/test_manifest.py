"""The Merkle manifest against a plain loop, its layout, and odd rows."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest

from vecdrift.llm import manifest as M
from vecdrift.llm.queries import ORACLE_SQL

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, i long, up string, _at long"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(r, more=0):
    n = None if r[4] is None else r[4] + more
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], n, r[1])))


def plain(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of each row."""

    def up(nodes):
        levels = [nodes]
        while len(nodes) > 1:
            nodes = [sha("".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)]
            levels.append(nodes)
        return levels

    def path(levels, i):
        out = []
        for nodes in levels[:-1]:
            out.append((i ^ 1, nodes[i ^ 1]) if i ^ 1 < len(nodes) else (i, None))
            i //= 2
        return out

    def fold(x, steps, i):
        for at, other in steps:
            x = sha(x if other is None else other + x if at < i else x + other)
            i //= 2
        return x

    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    langs = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: (own := sorted(by[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))), up([leaf(r) for r in own])) for g in langs}
    top = up([trees[g][1][-1][0] for g in langs])
    out = []
    for k, g in enumerate(langs):
        for i, r in enumerate(trees[g][0]):
            low, high = path(trees[g][1], i), path(top, k)
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            root = fold(fold(leaf(r, int(hit)), low, i), high, k)
            out.append((r[0], leaf(r), trees[g][1][-1][0], top[-1][0], sha("".join(x for _, x in low + high if x)), root, root == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [2, 12])
def test_equals_a_plain_loop(spark, bits):
    rng = random.Random(bits)
    rows = [(i if rng.random() < 0.9 else None, rng.choice([None, "", "é日本", "x" * rng.randrange(50)]), rng.choice(["en"] * 5 + ["de", "", "é", None]), rng.choice(["s", None]), rng.choice([None, i]), 1, "u", 2) for i in range(90)]
    rows += [rows[3], rows[3], (5, "other text", "en", "s", 1, 1, "u", 2), (77, "y" * 200_000, "xx", None, 3, 1, "u", 2)]
    got = M.check_manifest(spark.createDataFrame(rows, SCHEMA), bits=bits).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rows)
    assert {r.verified for r in got} == {True, False}


def test_equals_its_sql(spark):
    rows = [(None if i == 3 else i, f"t{i}" if i % 4 else None, ("en", "de", None)[i % 3], None if i % 5 == 0 else "s", None if i % 6 == 0 else i, 0, "", 0) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    con = duckdb.connect()
    con.register("documents", df.toPandas().astype({"doc_id": "Int64", "n_chars": "Int64"}))
    want = con.sql(ORACLE_SQL["op11_veb_merkle_manifest"])
    got = M.check_manifest(df, bits=2).select(*want.columns).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(want.fetchall(), key=str)


def test_empty_and_single(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert M.check_manifest(none).collect() == []
    one = M.check_manifest(spark.createDataFrame([(1, "a", None, None, None, 0, "", 0)], SCHEMA)).first()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.proof_sha256 == sha("")


@pytest.mark.parametrize("levels", range(1, 12))
def test_addresses_are_a_layout_by_halves(levels):
    """Every slot once, and every subtree of the lower half lies together."""
    at = [M.address(levels, d, np.arange(1 << d)) for d in range(levels)]
    assert sorted(np.concatenate(at).tolist()) == list(range((1 << levels) - 1))
    low = levels // 2
    high = levels - low
    for tree in range(1 << high) if low else ():
        own = np.concatenate([at[high + d][tree << d : (tree + 1) << d] for d in range(low)])
        assert own.max() - own.min() + 1 == len(own) == (1 << low) - 1


def test_paths_lead_to_the_root_and_only_from_their_leaf():
    for n in (1, 2, 3, 7, 8, 13):
        leaves = np.frombuffer(b"".join(hashlib.sha256(bytes([i])).digest() for i in range(n)), np.uint8).reshape(-1, 32)
        levels = M.levels_of(n, 12)
        store = M.built(leaves, levels)
        for i, path in enumerate(M.siblings(store, levels, n, np.arange(n))):
            assert M.folded(leaves[i].tobytes(), path.tobytes()) == store[0].tobytes()
            assert n == 1 or M.folded(leaves[i - 1].tobytes(), path.tobytes()) != store[0].tobytes()
