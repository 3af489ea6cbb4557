"""Collocations against plain counts, at every chunk size, and odd rows."""

import collections
import random
import re

import duckdb
import numpy as np
import pytest

from vecdrift.llm import collocations as C
from vecdrift.llm.queries import ORACLE_SQL

SCHEMA = "doc_id long, text string, lang string, a long, phrase string"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def plain(rows, least, top=2000):
    f, n = collections.Counter(), collections.Counter()
    for r in rows:
        lang = "und" if r[2] is None else r[2]
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lower(r[1] or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 6):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i : i + m])] += 1
    cand = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    out = collections.defaultdict(list)
    for (lang, p), a in cand.items():
        inside = any(g == lang and len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for (g, q), b in cand.items())
        if not inside:
            score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, le, r, n[lang], -s) for lang, own in out.items() for i, (s, a, p, le, r) in enumerate(sorted(own)[:top]))


def corpus(seed, docs=60):
    rng = random.Random(seed)
    words = ["The", "cat", "sat", "on", "a", "mat", "é", "日本", "x\u00a0y", "\x1c"]
    join = lambda: rng.choice([" "] * 12 + [", ", ".", "\t", "\n", "  ", "! "])
    rows = [(i, "".join(rng.choice(words[: rng.randrange(2, 11)]) + join() for _ in range(rng.randrange(0, 60))), rng.choice(["en", "en", "de", None, ""]), 1, "p") for i in range(docs)]
    long = " ".join(rng.choice(words[:4]) for _ in range(400))
    return [*rows, rows[0], rows[0], (None, None, "en", 1, "p"), (1, "", None, 1, "p"), (2, long, "en", 1, "p"), (3, "w" * 5000, "en", 1, "p"), (4, "...", "xx", 1, "p")]


@pytest.mark.parametrize("size,head", [(1 << 20, 4096), (37, 3), (8, 0)])
def test_equals_plain_counts(spark, size, head):
    rows = corpus(size)
    got = C.collocations(spark.createDataFrame(rows, SCHEMA).repartition(3), min_count=4, size=size, head=head).collect()
    assert sorted(tuple(r) for r in got) == plain(rows, 4)


def test_top_and_ties(spark):
    rows = [(0, ". ".join(f"a{i} b{i}" for i in range(50)), "en", 1, "p")] * 3
    got = C.collocations(spark.createDataFrame(rows, SCHEMA), min_count=3, top=7).orderBy("rank").collect()
    assert [tuple(r) for r in got] == plain(rows, 3, 7) and len(got) == 7


def test_equals_its_sql(spark):
    rows = [(i, "one two three. one two Four\ttwo three one two", "en" if i % 2 else None, 1, "p") for i in range(230)]
    df = spark.createDataFrame(rows, SCHEMA)
    con = duckdb.connect()
    con.register("documents", df.select("text", "lang").toPandas())
    want = con.sql(ORACLE_SQL["op12_tiled_collocations"])
    got = C.collocations(df).select(*want.columns).collect()
    assert sorted(tuple(r) for r in got) == sorted(want.fetchall()) and got


def test_empty(spark):
    assert C.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert C.collocations(spark.createDataFrame([(1, None, None, 1, "p")], SCHEMA)).collect() == []


@pytest.mark.parametrize("ids,n", [(3000, 400_000), (100, 200_000), (5000, 10)])
def test_tiles_and_coordinates_count_all_pairs(ids, n):
    rng = np.random.default_rng(ids)
    counter, got = C.Counter({b"%d" % i: i for i in range(min(ids, 2500))}), collections.Counter()
    want = collections.Counter()
    for _ in range(2):
        left, right = (rng.zipf(1.3, n) % ids for _ in range(2))
        want.update(zip(left.tolist(), right.tolist(), strict=True))
        counter.add(left, right)
        assert not counter.full()
    dense = len(counter.tiles)
    for left, right, counts in counter.counted():
        for a, b, c in zip(left.tolist(), right.tolist(), counts.tolist(), strict=True):
            got[a, b] += c
    assert got == want and (dense > 0) == (n > 10)


def test_a_full_counter_gives_its_rows(monkeypatch):
    monkeypatch.setattr(C, "MOST_PAIRS", 10)
    counter, got, want = C.Counter({b"a": 0, b"b": 1}), collections.Counter(), collections.Counter()
    rng = np.random.default_rng(0)
    for _ in range(30):
        left, right = rng.integers(0, 6, 5), rng.integers(0, 6, 5)
        names = [b"a", b"b", b"c", b"d", b"e", b"f"]
        ids = np.array([counter.ids[x] for x in names])
        counter.add(ids[left], ids[right])
        want.update(f"{names[a].decode()} {names[b].decode()}" for a, b in zip(left, right, strict=True))
        if counter.full():
            for b in counter.rows("en"):
                got.update(dict(zip(b["phrase"].to_pylist(), b["a"].to_pylist(), strict=True)))
    for b in counter.rows("en"):
        got.update(dict(zip(b["phrase"].to_pylist(), b["a"].to_pylist(), strict=True)))
    assert got == want


@pytest.mark.parametrize("size", [1, 3, 10, 1000])
def test_blocks_of_a_text_hold_its_words(size):
    text = "One, two  three\tfour!five\nsix seventeen".encode()
    whole = [w for b in C.word_blocks(text) for w in b]
    assert whole == b"one \xff two three four \xff five \xff six seventeen".split()
    assert [w for b in C.word_blocks(text, size) for w in b] == whole
