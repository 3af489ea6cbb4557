"""Each operator against brute force and its library on small tables, and on
null, empty, long, repeated and tied rows."""

import collections
import hashlib
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vecdrift.llm import bpe_codec, common, exact_dedup, golay, graph, langid, lattice, lattice_lm, mixing, pii, quality_rank, queries, rules_forest, simhash, textstats, token_counts, vocab

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, block long, held_out string"
ODD = [None, "", " ", "\n\n", "a", "same text here", "same text here", "SAME text here", "é日本 \U0001f600", "x " * 3000, "word" * 2000, "1.2.3.4 a@b.cd", "<|endoftext|> hi<|endoftext|>"]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, null ids, langs and sources, a repeated row, and columns whose
    names the operators use themselves."""
    rows = [(i, t, ("en", "de", None)[i % 3], ("s1", "s2", None)[i % 3], None, 1.0, 2, "z") for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[5], (None, "no id", "en", "s1", 1, 0.0, 0, "")], SCHEMA).cache()


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet").cache()


@pytest.fixture(scope="module")
def labels(spark, small):
    return spark.read.parquet(f"{small}/labels.parquet")


def texts(df):
    return {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}


# 1 and 3: tokens


def test_bpe_codec_equals_the_library(odd, docs):
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab.ranks(vocab.path(bpe_codec.FILE)), special_tokens={})
    for df in (odd, docs):
        given = texts(df)
        for r in bpe_codec.encode_decode(df, digests=True).collect():
            ids = enc.encode_ordinary(given[r.doc_id])
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(given[r.doc_id].encode()).hexdigest())


def test_bpe_long_words_take_the_general_query():
    import tiktoken

    ranks = vocab.ranks(vocab.path(bpe_codec.FILE))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(0)
    words = ["".join(rng.choice(["th", "e", "in", "er", "a", "aa", "q", "é"]) for _ in range(n)) for n in (1, 5, 40, 90, 400, 3000, 100_000)] + ["=" * 501, "a" * 999, "a" * 100_000, "ab" * 40]
    codec = bpe_codec.BpeCodec(vocab.path(bpe_codec.FILE))
    ids = codec.encode([w.encode() for w in words])
    assert ids == [enc.encode_ordinary(w) for w in words]
    assert codec.decode(ids) == [w.encode() for w in words]


def _hard_texts(seed=3):
    """Texts whose spaces, marks and words are hard to cut, and one of over 1 MB."""
    rng = random.Random(seed)
    some = [" ", "  ", "\n", "\t", "a", "b", "'s", "'", "1", ".", "é", "日", "\u00a0", "\u3000", "\x1c", "x" * 70, " the", "<|endoftext|>", "!!"]
    out = ["".join(rng.choice(some) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    return [*out, "".join(rng.choice(["th", "e", "in", "er", "a", "on", "q", "é", " ", " "]) for _ in range(800_000))]


def test_hard_and_long_texts_equal_the_libraries():
    import pyarrow as pa
    import tiktoken
    from tokenizers import Tokenizer

    given = _hard_texts()
    assert len(given[-1].encode()) > 1e6
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab.ranks(vocab.path(bpe_codec.FILE)), special_tokens={})
    codec = bpe_codec.TextCodec(vocab.path(bpe_codec.FILE), public_tokenizers.PATTERN)
    ids, n, data = codec.run(pa.array(given))
    for text, own, k, back in zip(given, ids.to_pylist(), n.to_pylist(), data.to_pylist(), strict=True):
        want = enc.encode_ordinary(text)
        assert (own, k, back) == (" ".join(map(str, want)), len(want), text.encode())
    tokenizer = Tokenizer.from_file(vocab.path("byte_bpe_50k.json"))
    count = lambda x: len(tokenizer.encode(x, add_special_tokens=False).ids)
    totals, leads = token_counts._counts(pa.array(given), token_counts._counter(vocab.path("byte_bpe_50k.json")), 20)
    for text, total, lead in zip(given, totals, leads, strict=True):
        assert total == count(text) and count(text.encode()[:lead].decode()) <= 20 and (total > 20) == (lead < len(text.encode()))


def test_known_forgets_and_finds():
    import pyarrow as pa

    from vecdrift.llm import pretoken

    known = pretoken.Known(pa.schema([("key", pa.string()), ("n", pa.int64())]), most=5, longest=3)
    asked = []

    def make(keys):
        asked.extend(keys.to_pylist())
        return pa.table([keys, pa.array([len(k) for k in keys.to_pylist()], pa.int64())], names=["key", "n"])

    for own in (["a", "bb"], ["bb", "a", "cccc"], [], ["d", "ee", "fff", "bb"], ["a", "bb", "gg"]):
        assert known.get(pa.array(own, pa.string()), make).column("n").to_pylist() == [len(k) for k in own]
        assert len(known.table) <= 6
    assert asked.count("bb") == 1 and asked.count("cccc") == 1


def test_encode_keeps_columns_and_decode_reverses(odd, none):
    made = bpe_codec.encode_decode(odd)
    assert made.columns == [*odd.columns, "ids", "decoded"]
    again = bpe_codec.decode_ids(made.select("doc_id", "ids", "decoded").withColumnRenamed("decoded", "was"))
    assert again.where("was <> decoded").count() == 0 and again.count() == odd.count()
    assert bpe_codec.encode_decode(none).count() == 0


def test_token_counts_equal_the_library(odd, docs, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocab.path("byte_bpe_50k.json"))
    count = lambda x: len(tokenizer.encode(x, add_special_tokens=False).ids)
    for df in (odd, docs):
        given = texts(df)
        for r in token_counts.token_counts(df, limit=64).collect():
            t = given[r.doc_id]
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), count(t), count(t) > 64)
            lead = t.encode()[: r.bytes_in_limit].decode()
            assert count(lead) <= 64 and (r.over_limit or lead == t)
    assert token_counts.token_counts(none).count() == 0


def test_every_prefix_has_its_count():
    from tokenizers import Tokenizer

    file = vocab.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(file)
    counter = token_counts.PrefixCounter(file)
    for word in (" thinedtion", "aaaaaaaaaaab", "ingtionthered", " onesenth"):
        assert list(counter.prefix_counts(word)) == [len(tokenizer.encode(word[:i], add_special_tokens=False).ids) for i in range(len(word) + 1)]
    text = "Then onwh, the <|endoftext|>edst."
    for end, n in token_counts.prefix_table(text, file):
        assert n == len(tokenizer.encode(text[:end], add_special_tokens=False).ids)


# 2 and 9: quality


def test_quality_learns_and_holds_out(docs, labels, spark, odd, none):
    got = {r.doc_id: r for r in quality_rank.quality_scores(docs, labels).collect()}
    assert len(got) == docs.count()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got.values())
    assert np.mean([got[i].predicted == q for i, q in truth.items()]) > 0.9
    assert min(got[i].predicted for i, q in truth.items() if q == 1) == 1
    assert quality_rank.quality_scores(odd, labels).count() == odd.count()
    assert quality_rank.quality_scores(none, labels).count() == 0
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality_rank.quality_scores(odd, empty).collect()} == {0.5}
    assert quality_rank.keep_good(odd, labels).columns == odd.columns


def test_held_out_labels_do_not_matter(docs, labels):
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a = {r.doc_id: r.score for r in quality_rank.quality_scores(docs, labels).collect()}
    assert a == {r.doc_id: r.score for r in quality_rank.quality_scores(docs, flipped).collect()}


def _counts(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        dup += line in seen and bool(re.search(r"[^\x20\x09-\x0D]", line))
        seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(inside)


def test_rule_counts_and_verdicts(docs, labels, odd, none, spark):
    for df in (docs, odd):
        given = texts(df)
        for r in rules_forest.rule_verdicts(df, labels).collect():
            n = _counts(given[r.doc_id])
            assert tuple(r[c] for c in textstats.COUNTS) == n
            assert r.base_failed == (n[0] < 10 or 100 * n[4] > 20 * n[0])
            assert not (r.kept and r.base_failed)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    got = {r.doc_id: r for r in rules_forest.rule_verdicts(docs, labels).collect()}
    assert np.mean([got[i].kept for i, q in truth.items() if q == 1 and not got[i].base_failed]) > 0.97
    assert np.mean([got[i].kept for i, q in truth.items() if q == 0]) < 0.5
    assert rules_forest.rule_verdicts(none, labels).count() == 0
    assert rules_forest.rule_verdicts(odd, spark.createDataFrame([], "doc_id long, quality int")).count() == odd.count()


def test_bradley_terry_reaches_the_optimum_and_its_threshold():
    rng = np.random.default_rng(4)
    n, k = 300, len(textstats.RATIOS)
    good = rng.random(n) < 0.7
    x = rng.random((n, k)) + 0.4 * good[:, None] * (np.arange(k) < 3)
    model = quality_rank.learn(x, good, pairs=500)
    z = np.clip((quality_rank._wide(x) - model["center"]) / model["scale"], -8, 8)
    draw = np.random.default_rng(5)
    m = min(500, 20 * n)
    d = z[draw.choice(np.flatnonzero(good), m)] - z[draw.choice(np.flatnonzero(~good), m)]
    loss = lambda w: np.log1p(np.exp(-(d @ w))).sum() + 1e-3 * m * (w @ w) / 2
    best = loss(model["weight"])
    for _ in range(40):
        assert loss(model["weight"] + rng.normal(size=len(model["weight"])) * 10.0 ** -rng.integers(1, 5)) >= best
    worth = z @ model["weight"]
    low, high, steps = quality_rank.QUANTILES
    cost = lambda c: sum(quality_rank.GOOD_COST * (w < c) if g else (w >= c) for w, g in zip(worth, good, strict=True))
    assert cost(model["at"]) == min(cost(np.quantile(worth, min(1, q * (1 - good.mean())))) for q in np.linspace(low, high, steps))
    assert ((quality_rank.score(model, x) >= quality_rank.THRESHOLD - 1e-12) == (worth >= model["at"] - 1e-12)).all()


def test_labelled_rows_with_nulls_repeats_and_several_texts(spark):
    docs = spark.createDataFrame([(1, "good text here"), (1, "a text before"), (2, None), (3, "bad | | !"), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (2, 0), (3, 0), (9, 1), (None, 1), (3, None), (2, 7)], "doc_id long, quality int")
    x, good = quality_rank.labelled_ratios(docs, labels, 100, F.lit(True))
    first = np.array(textstats.ratios("a text before", *textstats.counts("a text before")))
    assert len(x) == 5 and sorted(good.tolist()) == [False, False, False, True, True] and sum(np.allclose(r, first) for r in x) == 3
    assert len(quality_rank.labelled_ratios(docs, labels, 2, F.lit(True))[0]) <= 2
    odd = docs.withColumn("_qr_score", F.lit(1)).withColumn("_score", F.lit(2))
    assert quality_rank.keep_good(odd, labels).columns == odd.columns


def test_forest_paths_and_threshold_by_recursion():
    rng = np.random.default_rng(7)
    x = rng.random((120, 3))
    x[:4] += 3
    forest = rules_forest.fit(x, trees=20, per_tree=40, depth=5)

    def path(t, row, node=0, level=0):
        f = forest["what"][t, node]
        if f < 0:
            return forest["length"][t, node]
        assert level < 5
        return path(t, row, 2 * node + 1 + int(row[f] >= forest["value"][t, node]), level + 1)

    h = lambda n: sum(1 / i for i in range(1, n))
    assert forest["expected"] == pytest.approx(2 * h(40) - 2 * 39 / 40, rel=0.02)
    want = [2 ** (-np.mean([path(t, row) for t in range(20)]) / forest["expected"]) for row in x]
    got = rules_forest.anomaly(forest, x)
    assert np.allclose(got, want) and set(np.argsort(-got)[:4]) == {0, 1, 2, 3}
    good = np.arange(120) >= 6
    limit = rules_forest.calibrate(forest, x, good)
    cuts = np.quantile(got[good], np.append(np.linspace(0.95, 0.999, 50), 1.0))
    cost = lambda c: sum(rules_forest.WEIGHT * (a > c) if g else a <= c for a, g in zip(got, good, strict=True))
    assert cost(limit) == min(map(cost, cuts))
    assert {"word_length", "symbols", "dup_lines", "repeats"} <= set(rules_forest.RULES)


# 4: personal data


def _luhn(d):
    return sum(v - 9 * (v > 9) for v in (int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(d)))) % 10 == 0


def _base(t):
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and _luhn(digits(m))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    ]
    return [(m.start(), k, m.end()) for k, (p, ok) in enumerate(kinds) for m in re.finditer(p, t) if ok(m[0])]


def test_pii_base_spans(spark, tmp_path, docs, odd, none):
    more = ["a@b.c@d.e a@b.c.d@e.f a@b.c_d@e.f x@y", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.4 00000000000.1.1.1 99999999999999999999.1.1.1", "4111 1111 1111 1111, 4111-1111-1111-1112", "+1 (017) 555-7713 ++49 30 1234567. é日本 +4930123456789 +12", "\U0001f600 q@r.st", "7" * 5000]
    extra = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(more)], "doc_id long, text string")
    given = docs.select("doc_id", "text").unionAll(extra)
    given.write.parquet(f"{tmp_path}/documents.parquet")
    want = texts(given)
    for r in pii.op4_weak_supervision_pii(spark, str(tmp_path)).collect():
        spans = sorted(_base(want[r.doc_id]))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == k for s in spans) for k in range(4)]
        named = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans]
        assert r.base_sha256 == hashlib.sha256(",".join(named).encode()).hexdigest()
        assert set(named) <= set(filter(None, r.spans.split(",")))
    assert pii.find_pii(odd).count() == odd.count()
    assert pii.find_pii(none).count() == 0


def test_pii_adds_what_the_labelers_agree_on(spark):
    rows = [(i, f"please mail joe{i}@site.com or call +1 212 555 {1000 + i} today") for i in range(60)] + [(100 + i, f"contact: joe{i} (at) site (dot) com") for i in range(30)]
    got = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(len(got[i].base) == 2 for i in range(60))
    assert sum(len(got[100 + i].added) for i in range(30)) == 30
    other = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string"), domains="xyz", cues={k: "never" for k in pii.KINDS})
    assert sum(len(r.added) for r in other.collect()) == 0


def test_reliabilities_equal_a_plain_loop(spark):
    rng = random.Random(5)
    rows = [(k, 1 if rng.random() < 0.6 else rng.choice([0, -1]), rng.choice([0, 1, 1]), rng.choice([-1, 0, 1])) for k in (0, 0, 1, 2, 3) for _ in range(60)]
    df = spark.createDataFrame([((k, a, b, c),) for k, a, b, c in rows], "c struct<k:int,v1:int,v2:int,v3:int>")
    got = pii.reliabilities(df).first().m
    prior, hit, miss = [0.5] * 4, [0.9, 0.8, 0.7], [0.1, 0.4, 0.3]

    def posterior(row):
        yes, no = prior[row[0]], 1 - prior[row[0]]
        for v, h, m in zip(row[1:], hit, miss, strict=True):
            if v >= 0:
                yes, no = yes * (h if v else 1 - h), no * (m if v else 1 - m)
        return yes / (yes + no)

    for _ in range(pii.STEPS):
        p = [posterior(r) for r in rows]
        rate = lambda j, side, a, b: (sum(w for r, w in zip(rows, side, strict=True) if r[j] == 1) + a) / (sum(w for r, w in zip(rows, side, strict=True) if r[j] >= 0) + a + b)
        no = [1 - x for x in p]
        prior = [(sum(x for r, x in zip(rows, p, strict=True) if r[0] == k) + 1) / (sum(r[0] == k for r in rows) + 2) for k in range(4)]
        hit, miss = [rate(j, p, 2, 1) for j in (1, 2, 3)], [rate(j, no, 1, 2) for j in (1, 2, 3)]
    assert np.allclose([*got.prior, *got.hit, *got.miss], [*prior, *hit, *miss])


# 5: near duplicates


def test_golay_lists_meet_within_two_bits():
    rng = np.random.default_rng(0)
    v = rng.integers(0, 1 << 23, 2000)
    for errors in (0, 1, 2):
        u = v.copy()
        for i in range(len(u)):
            for b in rng.choice(23, errors, replace=False):
                u[i] ^= 1 << int(b)
        a, b = golay.list_keys(v), golay.list_keys(u)
        assert ((a[:, :, None] == b[:, None, :]) & (a[:, :, None] >= 0)).any((1, 2)).all()


def _groups(n, links):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    return [root(i) for i in range(n)]


def test_fingerprint_links(spark, docs, odd, none):
    import xxhash

    near = spark.createDataFrame([(5000 + i, " ".join(f"w{j % (97 + (i == j))}" for j in range(400))) for i in range(30)], "doc_id long, text string")
    for df in (docs.select("doc_id", "text").unionAll(near), odd.where("doc_id is not null").select("doc_id", "text")):
        rows = sorted(simhash.near_fingerprints(df).collect(), key=lambda r: r.doc_id)
        given = texts(df)
        fps = []
        for r in rows:
            w = given[r.doc_id].encode().lower().split()
            s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
            h = [xxhash.xxh64_intdigest(x, 42) for x in s]
            fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
            assert r.fingerprint == f"{fps[-1]:016x}"
        roots = _groups(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
        assert [r.component_id for r in rows] == [rows[k].doc_id for k in roots]
    assert simhash.near_fingerprints(none).count() == 0
    assert simhash.near_fingerprints(odd).count() == odd.count()


def test_hot_key_in_tiles_loses_no_link(spark):
    base = random.Random(1).getrandbits(64)
    rng = random.Random(2)
    fps = list({base} | {base ^ (1 << rng.randrange(30, 64)) ^ (1 << rng.randrange(30, 64)) for _ in range(150)})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    keyed = simhash.golay_keys(spark.createDataFrame([(x,) for x in signed], "fp long"))
    for tile in (16, 2000):
        links = simhash.bucket_links(keyed, 1, 2, tile).distinct().collect()
        place = {x: i for i, x in enumerate(signed)}
        want = _groups(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
        assert _groups(len(fps), [(place[r.a], place[r.b]) for r in links]) == want


def test_near_duplicates_by_similarity(spark, docs, odd, none):
    rng = random.Random(3)
    rows = []
    for g in range(12):
        words = [f"g{g}w{rng.randrange(400)}" for _ in range(250)]
        for c in range(5):
            own = words.copy()
            for _ in range(c):
                own[rng.randrange(250)] = f"new{rng.random()}"
            rows.append((g * 10 + c, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    given = texts(df)
    ids = sorted(given)
    sets = {i: {tuple(given[i].split()[k : k + 5]) for k in range(246)} for i in ids}
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8
    want = _groups(len(ids), [(i, j) for i in range(len(ids)) for j in range(i) if like(ids[i], ids[j])])
    for tile in (4, 2000):
        got = {r.doc_id: r.group_id for r in simhash.near_duplicates(df, tile=tile, items=tile * 250).collect()}
        assert [got[i] for i in ids] == [ids[k] for k in want]
    kept = simhash.drop_near_duplicates(df)
    assert kept.count() == len(set(want)) and kept.columns == df.columns
    assert simhash.drop_near_duplicates(none).count() == 0
    assert simhash.drop_near_duplicates(odd).columns == odd.columns


def test_near_duplicates_with_passages(spark):
    """Passages appended, cut off and replaced, at similarities of 0.78 to 0.9."""
    rng = random.Random(5)
    rows = []
    line = [f"license{i}" for i in range(30)]
    for g in range(60):
        n = (100, 200, 600)[g % 3]
        words = [f"g{g}w{i}" for i in range(n)] + line
        m = int(n * rng.choice((0.1, 0.15, 0.2, 0.24)))
        new = [f"g{g}new{i}" for i in range(m)]
        at = rng.randrange(n - m)
        for kind, own in enumerate((words, words + new, words[m:], words[:at] + new[: m // 2] + words[at + m // 2 :])):
            rows.append((g * 10 + kind, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    like = [[len(a & b) / len(a | b) >= 0.8 for b in sets[:i]] for i, a in enumerate(sets)]
    want = _groups(len(rows), [(i, j) for i, own in enumerate(like) for j, yes in enumerate(own) if yes])
    assert len(rows) // 4 < len(set(want)) < len(rows)
    got = {r.doc_id: r.group_id for r in simhash.near_duplicates(df).collect()}
    assert [got[i] for i, _ in rows] == [rows[k][0] for k in want]


def test_bound_never_rejects_a_similar_pair():
    rng = np.random.default_rng(6)
    for n in (3, 40, 300, 5000):
        x = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
        row = lambda s: np.append(simhash.counted(s), np.uint64(len(s)))
        for share in (0.8, 0.9, 1.0):
            part = x[: int(np.ceil(share * n))]
            assert simhash.may_be_similar(row(x)[None], row(part), 0.8).all()
        other = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
        assert n > 2000 or not simhash.may_be_similar(row(x)[None], row(other), 0.8).any()


def test_sketches_rule_out_no_similar_pair_and_most_others():
    rng = np.random.default_rng(6)
    for n in (3, 200, 700, 5000):
        base = rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2)
        sets = [np.unique(base)]
        for _ in range(12):
            drop, add = int(rng.integers(0, n // 9 + 1)), int(rng.integers(0, n // 9 + 1))
            sets.append(np.unique(np.concatenate([rng.choice(base, n - drop, replace=False), rng.integers(0, 1 << 63, add).astype(np.uint64)])))
        others = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2)) for _ in range(5)]
        some = sets + others
        nodes, size = np.arange(len(some)), np.array([len(x) for x in some])
        exact = {(i, j) for i in nodes for j in nodes if i < j and len(np.intersect1d(some[i], some[j])) >= 0.8 * len(np.union1d(some[i], some[j]))}
        joined = lambda pairs: {frozenset(x) for x in _connected(range(len(some)), pairs)}
        a, b = simhash.similar_forest(nodes, some, 0.8)
        assert joined(zip(a.tolist(), b.tolist(), strict=True)) == joined(exact)
        a, b = simhash.sketched_forest(nodes, size, [simhash.sketch(x) for x in some], 0.8)
        loose = joined(zip(a.tolist(), b.tolist(), strict=True))
        assert all(any(g <= h for h in loose) for g in joined(exact))
        assert n < 200 or all(frozenset([i]) in loose for i in range(len(sets), len(some)))


def _connected(nodes, pairs):
    root = {i: i for i in nodes}

    def of(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        root[of(int(a))] = of(int(b))
    out = collections.defaultdict(set)
    for i in nodes:
        out[of(i)].add(i)
    return list(out.values())


def test_near_duplicates_with_null_and_repeated_ids(spark):
    text = lambda g, n=60: " ".join(f"g{g}w{i}" for i in range(n))
    rows = [
        (1, text(1)), (None, text(1, 58)), (None, text(2)), (None, text(3)), (None, text(3, 57)),  # null near an id, alone, near null
        (5, text(4)), (5, text(5)), (5, text(5).upper()), (6, text(6)), (6, text(6)), (4, text(5, 59)), (7, text(7)),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = sorted(((r.doc_id, r.text) for r in simhash.drop_near_duplicates(df).collect()), key=repr)
    threes = [x for x in left if x[1] in (text(3), text(3, 57))]
    assert len(threes) == 1
    rest = [(1, text(1)), (None, text(2)), (5, text(4)), (6, text(6)), (4, text(5, 59)), (7, text(7))]
    assert [x for x in left if x not in threes] == sorted(rest, key=repr)
    nulls = spark.createDataFrame([(None, t) for _, t in rows[2:5]], "doc_id long, text string")
    assert simhash.drop_near_duplicates(nulls).count() == 2


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(50))


# 6: mixing


def _targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        new = {s for s in open_ if share[s] > most * sizes[s]}
        if not new:
            return {s: most * sizes[s] if s in full else share[s] for s in names}
        full |= new


def test_mix_plan(spark, docs, odd, none):
    skewed = spark.createDataFrame([(i, "w " * (1 + i % 50 * 20), "big" if i % 3 == 0 else f"s{i % 7}") for i in range(900)], "doc_id long, text string, source string")
    for df in (docs, odd, skewed):
        rows = mixing.mix_plan(df).collect()
        assert len(rows) == df.count()
        sizes = collections.Counter()
        for r in rows:
            sizes[r.source] += r["size"]
        want = _targets(dict(sizes))
        taken = collections.Counter()
        for r in rows:
            assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], rel=1e-9)
            assert 0 <= r.taken <= 3 * r["size"] and r.taken == r.copies * r["size"] + r.part_words
            taken[r.source] += r.taken
        assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
        assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_plan(df).collect()))
    assert mixing.mix_plan(none).count() == 0


def test_mix_is_unbiased_and_takes_effect(docs, odd):
    shares = collections.defaultdict(list)
    small = docs.where("source in ('src0', 'src1', 'src2')")
    for seed in range(6):
        for r in mixing.mix_plan(small, seed=seed).collect():
            shares[r.doc_id].append((r.taken / r["size"], r.target / r.source_size))
    off = [np.mean([a for a, _ in v]) - v[0][1] for v in shares.values()]
    assert abs(np.mean(off)) < 0.1
    plan = {r.doc_id: r for r in mixing.mix_plan(docs).collect()}
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    words = {r.doc_id: r.n for r in out.groupBy("doc_id").agg(F.sum(mixing.n_words(F.col("text"))).alias("n")).collect()}
    assert words == {i: r.taken for i, r in plan.items() if r.taken}
    assert mixing.mix(odd).columns == odd.columns


# 7: exact duplicates


def test_exact_duplicates(odd, docs, none):
    for df in (odd, docs):
        want = collections.defaultdict(list)
        rows = [(r.doc_id, exact(r.text)) for r in df.select("doc_id", "text").collect()]
        for i, t in rows:
            want[t].append(i)
        got = exact_dedup.exact_duplicates(df).collect()
        key = {hashlib.sha256(t.encode()).hexdigest(): t for _, t in rows}
        assert len(got) == len(rows)
        for r in got:
            ids = want[key[r.text_sha256]]
            top = max((i for i in ids if i is not None), default=None)
            assert (r.keep_id, r.group_size, r.kept) == (top, len(ids), r.doc_id == top) and r.doc_id in ids
        assert exact_dedup.drop_exact_duplicates(df).count() == len(want)
        assert exact_dedup.drop_exact_duplicates(df).columns == df.columns
    assert exact_dedup.exact_duplicates(none).count() == 0


def test_hot_groups_are_broadcast(spark):
    rows = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 7000)).alias("key"))
    groups = rows.groupBy("key").agg(F.max("doc_id").alias("last"), F.count("*").alias("n"))
    got = common.joined_to_groups(rows, groups, "key", "n")
    want = rows.join(groups, "key")
    assert got.exceptAll(want.select(*got.columns)).count() == 0 and got.count() == 30_000
    texts_ = rows.withColumn("text", F.col("key"))
    assert {tuple(r) for r in exact_dedup.exact_duplicates(texts_).groupBy("kept").count().collect()} == {(True, 7001), (False, 22_999)}


def exact(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_ambiguous_identifiers_are_widened(docs):
    assert not exact_dedup.ambiguous_identifiers(docs, 1).isEmpty()
    assert exact_dedup.verified_width(docs, 1) > 1
    assert {tuple(r) for r in exact_dedup.exact_duplicates(docs, 1).collect()} == {tuple(r) for r in exact_dedup.exact_duplicates(docs).collect()}


def test_chunks_depend_on_their_text_alone():
    rng = random.Random(4)
    long = bytes(rng.randrange(256) for _ in range(60_000))
    alone = exact_dedup.cut_points([long])[0]
    assert exact_dedup.cut_points([b"abc", long, b"", long])[1] == alone and len(alone) > 3
    assert alone[-1] == len(long) and all(exact_dedup.MIN_CHUNK <= b - a <= exact_dedup.MAX_CHUNK for a, b in zip([0, *alone], alone[:-1], strict=False))


# 8 and 10: lattices


def test_lattice_sums_all_segmentations():
    model = lattice.lattice(vocab.path(lattice.FILE))
    logp = model.start()

    def brute(w):
        m = lattice.MARK + w

        def rest(i):
            if i == len(m):
                return 1.0
            total = 0.0
            for j in range(i + 1, len(m) + 1):
                k = model.ids.get(m[i:j])
                if k is not None:
                    total += math.exp(logp[k]) * rest(j)
                elif j == i + 1:
                    total += math.exp(sum(logp[model.bytes[b]] for b in m[i].encode())) * rest(j)
            return total

        return math.log(rest(0))

    words = ["the", "onesen", "q", "日本", "naïve", "\U0001f600x", "a" * 40]
    got = model.forward(words, np.stack([logp, logp], 1))
    assert np.allclose(got[:6, 0], [brute(w) for w in words[:6]]) and np.allclose(got[:, 0], got[:, 1]) and np.isfinite(got).all()
    assert model.forward(["ab" * 2000, "x"], logp[:, None]).shape == (2, 1) and model.forward([], logp[:, None]).shape == (0, 1)


def plain(model, w, logp):
    """log P(w) and the expected pieces, by loops over characters."""
    m = lattice.MARK + w
    cells = []
    for i in range(len(m)):
        own = [(i, j, [model.ids[m[i:j]]]) for j in range(i + 1, min(len(m), i + 40) + 1) if m[i:j] in model.ids]
        cells += own if any(j == i + 1 for _, j, _ in own) else [(i, i + 1, [model.bytes[b] for b in m[i].encode()]), *own]
    p = [sum(logp[k] for k in ks) for _, _, ks in cells]
    alpha, beta = [0.0] + [-math.inf] * len(m), [-math.inf] * len(m) + [0.0]
    plus = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b))) if min(a, b) > -math.inf else max(a, b)
    for (i, j, _), q in sorted(zip(cells, p, strict=True), key=lambda x: x[0][1]):
        alpha[j] = plus(alpha[j], alpha[i] + q)
    for (i, j, _), q in sorted(zip(cells, p, strict=True), key=lambda x: -x[0][0]):
        beta[i] = plus(beta[i], beta[j] + q)
    n = collections.Counter()
    for (i, j, ks), q in zip(cells, p, strict=True):
        for k in ks:
            n[k] += math.exp(alpha[i] + q + beta[j] - alpha[-1])
    return alpha[-1], n


def plain_em(model, words, logp):
    """Expected pieces of counted words."""
    n = np.zeros(len(logp))
    for w, c in words.items():
        for k, x in plain(model, w, logp)[1].items():
            n[k] += c * x
    return n


def test_expected_counts_equal_enumeration():
    model = lattice.lattice(vocab.path(lattice.FILE))
    logp = model.start()

    def every(m):
        if not m:
            yield ()
        for j in range(1, len(m) + 1):
            own = [model.ids[m[:j]]] if m[:j] in model.ids else [model.bytes[b] for b in m[:j].encode()] if j == 1 else None
            if own:
                yield from ((*own, *rest) for rest in every(m[j:]))

    words, weight = ["ab", "there", "q日", "naïve", "ab"], np.array([2.0, 1.0, 3.0, 1.0, 5.0])
    column = np.array([0, 1, 0, 1, 1])
    got = model.expected_counts(words, column, weight, np.stack([logp, logp[::-1]], 1))
    want = np.zeros_like(got)
    for w, c, n in zip(words, column, weight, strict=True):
        own = logp if c == 0 else logp[::-1]
        ways = list(every(lattice.MARK + w))
        p = np.array([math.exp(sum(own[k] for k in way)) for way in ways])
        for way, share in zip(ways, p / p.sum(), strict=True):
            for k in way:
                want[k, c] += n * share
    assert np.allclose(got, want)


def test_lattice_lm_scores_equal_plain_loops(docs, odd):
    model = lattice.lattice(vocab.path(lattice.FILE))
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", exact(t))
    for df in (odd, docs.where("doc_id < 60")):
        rows = df.select("doc_id", "text").collect()
        train = [r for r in rows if zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 != 1]
        count, logp = collections.Counter(w for r in train for w in words(r.text)), model.start()
        for _ in range(lattice_lm.STEPS):
            n = plain_em(model, count, logp)
            whole = n.sum() + lattice_lm.SMOOTH * len(n) + len(train)
            logp = np.log((n + lattice_lm.SMOOTH) / whole)
        end = math.log(len(train) / whole)
        want = {(r.doc_id, len(words(r.text))): (sum(plain(model, w, logp)[0] for w in words(r.text)) + end) / math.log(10) for r in rows}
        for r in lattice_lm.scores(df).collect():
            assert r.score == pytest.approx(want[r.doc_id, r.n_tokens - 1], rel=1e-9)


def test_langid_equals_plain_loops(docs, odd, spark):
    model = lattice.lattice(vocab.path(lattice.FILE))
    one = spark.createDataFrame([(7, "only one language", "en", "s"), (4, "only", None, "s"), (None, None, "en", "s")], "doc_id long, text string, lang string, source string")
    for df in (odd, docs.where("doc_id < 60"), one):
        rows = df.select("doc_id", "text", "lang").collect()
        words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        count = collections.defaultdict(collections.Counter)
        for r in rows:
            if zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 3 != 1 and r.lang is not None and r.text is not None:
                count[r.lang].update(words(r.text))
        logp = {}
        for lang in sorted(x for x in count if count[x]):
            n = plain_em(model, count[lang], model.start()) + langid.SMOOTH
            logp[lang] = np.log(n / n.sum())
        got = {(r.doc_id, i): r for i, r in enumerate(langid.identify(df).collect())}
        given = {}
        for r in rows:
            given.setdefault(r.doc_id, r.text)
        for r in got.values():
            t = given[r.doc_id] or ""
            if not any(map(str.isalpha, t)) or not logp:
                assert (r.lang_pred, r.score) == ("und", 0.0)
                continue
            mean = {lang: np.mean([plain(model, w, own)[0] for w in words(t)]) for lang, own in logp.items()}
            best = max(mean.values())
            assert mean[r.lang_pred] == pytest.approx(best, rel=1e-9) and r.score == pytest.approx(1 / sum(math.exp(x - best) for x in mean.values()))


def test_lattice_lm(docs, odd, none):
    for df in (docs, odd):
        rows = df.select("doc_id", "text").collect()
        count, ends = collections.Counter(), 0
        words = lambda t: (t or "").encode().lower().split()
        out = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 5 == 1
        for r in rows:
            if not out(r.doc_id):
                count.update(words(r.text))
                ends += 1
        n, v = sum(count.values()) + ends, len(count) + 1
        got = lattice_lm.scores(df).collect()
        assert len(got) == len(rows)
        given = {r.doc_id: r.text for r in rows}
        for r in got:
            w = words(given[r.doc_id])
            base = sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w) + math.log10((ends + 0.5) / (n + 0.5 * (v + 1)))
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out(r.doc_id), len(w) + 1, sum(count[x] > 0 for x in w) + 1, n)
            assert r.base_score == pytest.approx(base) and r.score < 0
    assert lattice_lm.scores(none).count() == 0


def test_em_raises_the_likelihood(docs):
    one, three = (lattice_lm.scores(docs, steps=s).where("not held_out").agg(F.sum("score")).first()[0] for s in (1, 3))
    assert three > one


def test_langid(docs, odd, none):
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = langid.identify(docs).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in got if r.held_out]) > 0.97
    flipped = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, "xx").otherwise(F.col("lang")))
    assert {(r.doc_id, r.lang_pred) for r in langid.identify(flipped).collect()} == {(r.doc_id, r.lang_pred) for r in got}
    odd_got = langid.identify(odd).collect()
    given = texts(odd)
    assert len(odd_got) == odd.count() and all((r.lang_pred == "und") == (not any(map(str.isalpha, given[r.doc_id]))) for r in odd_got)
    assert langid.identify(none).count() == 0


# the pipeline and the registry


def test_pipeline(spark, small, docs):
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        before = kept.count()
        kept = common.materialize(stage(spark, kept, small))
        assert set(docs.columns) <= set(kept.columns) and (name == "tokenize" or kept.columns == docs.columns)
        assert kept.count() <= before or name == "source_mixing"
    assert kept.where("cast(text as binary) <> decoded").count() == 0
    assert corpus_pipeline.run(spark, small).count() == kept.count()


def test_exact_dedup_sql(spark, small):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS FROM '{small}/documents.parquet'")
    name = "op7_chunk_exact_dedup"
    got = {tuple(r) for r in queries.QUERIES[name](spark, small).collect()}
    assert got == set(db.execute(queries.ORACLE_SQL[name]).fetchall())
    assert len(queries.QUERIES) == 10




def test_quality_learns_from_every_labelled_row(spark, monkeypatch):
    """no bound on the labelled rows; every one takes part in pairs and threshold."""
    rng = np.random.default_rng(6)
    good = rng.random(9000) < 0.99
    x = rng.random((len(good), len(textstats.RATIOS))) + 0.5 * good[:, None]
    rows = spark.createDataFrame([(i, int(g), 1, v.tolist()) for i, (g, v) in enumerate(zip(good, x, strict=True))], "doc_id long, quality int, n long, ratios array<double>")
    packed = list(quality_rank._buckets_in(quality_rank.buckets(rows).toArrow().to_batches()))
    assert len(packed) == 3 and sum(int(b.own.sum()) for b in packed) == len(good)
    assert min(int((~b.good).sum()) for b in packed) > 30
    model = quality_rank.learn_all(rows)
    for b in packed:
        assert sum(int(n.sum()) for _, n in b.pairs(model)) == quality_rank.PER_ROW * int(b.own.sum())
    z = quality_rank._wide(x)
    assert np.allclose(model["center"], z.mean(0)) and np.allclose(model["scale"], z.std(0))
    terms = [quality_rank._terms(d, model["weight"], n)[0] for b in packed for d, n in b.pairs(model)]
    assert np.abs(sum(terms) - 1e-3 * quality_rank.PER_ROW * len(good) * model["weight"]).max() < 1e-2
    worth = quality_rank._standard(model, x) @ model["weight"]
    cost = lambda c: quality_rank.GOOD_COST * (worth[good] < c).sum() + (worth[~good] >= c).sum()
    cuts = np.quantile(worth, np.linspace(0.5, 1.2, 71) * (1 - good.mean()))
    assert cost(model["at"]) <= min(map(cost, cuts))
    assert model["at"] == quality_rank.learn_all(rows.repartition(7))["at"]


def test_forest_and_its_threshold_come_from_every_labelled_row(spark):
    """trees draw from all rows, and all are counted for the threshold."""
    rng = np.random.default_rng(8)
    good = np.arange(30_000) % 10 > 0
    x = rng.random((len(good), len(textstats.RATIOS))) * np.where(good, 1, 3)[:, None]
    x[:, textstats.RATIOS.index("upper")] = np.arange(len(good))
    rows = spark.createDataFrame([(i, int(g), 1, v.tolist()) for i, (g, v) in enumerate(zip(good, x, strict=True))], "doc_id long, quality int, n long, ratios array<double>").cache()
    forest = rules_forest.fit_all(rows, trees=60, per_tree=64, depth=6)
    assert forest["what"].shape == (60, 127) and forest["expected"] == rules_forest._expected(64)
    upper = rules_forest.RULES.index("upper")
    cuts = forest["value"][forest["what"] == upper]
    assert cuts.min() < 3000 and cuts.max() > 27_000
    seen = x[:, [textstats.RATIOS.index(r) for r in rules_forest.RULES]]
    a = rules_forest.anomaly(forest, seen)
    limit = rules_forest.calibrate_all(forest, rows)
    cost = lambda c: rules_forest.WEIGHT * (a[good] > c).sum() + (a[~good] <= c).sum()
    options = np.quantile(a[good], np.append(np.linspace(0.95, 0.999, 50), 1.0))
    assert cost(limit) <= min(map(cost, options)) + 5 and (a[good] <= limit).mean() >= 0.95
    again = rules_forest.fit_all(rows.repartition(5), trees=60, per_tree=64, depth=6)
    assert all(np.array_equal(forest[c], again[c]) for c in ("what", "value", "length"))


def test_near_duplicates_leave_no_tables_of_keys(spark, monkeypatch):
    """The pipeline's near_dedup: the tables of keys are gone when links are found, and
    the setting that deletes shuffles is as before."""
    made = []
    write = common.materialize

    def noted(df):
        table = write(df)
        made.append((set(df.columns), table))
        return table

    monkeypatch.setattr(simhash, "materialize", noted)
    before = spark.conf.get(common.CLEANUP)
    docs = spark.createDataFrame([(i, " ".join(f"w{j + i // 2}" for j in range(40))) for i in range(8)], "doc_id long, text string")
    simhash.near_sets(docs, 5, 0.8, simhash.TILE, simhash.TILE_ITEMS)
    keyed = [t for c, t in made if {"key", "node"} <= c]
    assert len(keyed) == 2 and spark.conf.get(common.CLEANUP) == before
    for t in keyed:
        with pytest.raises(Exception, match="(?i)not exist|not found|path"):
            t.count()


def test_near_duplicates_shuffle_keys_in_slices(spark, monkeypatch):
    """Each slice's rows are shuffled and written on their own: no shuffle holds all
    keys, or all texts of candidates. Every key is in one slice, and the profiles are gone when candidates meet."""
    rng, held, slices, turns = random.Random(5), [], [], []
    texts = [" ".join(rng.choice("abcdefghij") * 3 for _ in range(60)) for _ in range(30)]
    docs = spark.createDataFrame([(i, t + " end" * (i % 2)) for i, t in enumerate([t for t in texts for _ in range(2)])], "doc_id long, text string")
    write, in_turn, keys = simhash.materialize, common.in_turn, simhash.table_keys

    def noted(df):
        out = write(df)
        held.append((df.columns, out.inputFiles()))
        return out

    def turned(parts):
        turns.append(len(parts))
        out = in_turn(parts)
        held.append((out.columns, out.inputFiles()))
        return out

    def sliced(*given):
        slices.append(keys(*given))
        return slices[-1]

    monkeypatch.setattr(simhash, "materialize", noted)
    monkeypatch.setattr(simhash, "in_turn", turned)
    monkeypatch.setattr(simhash, "table_keys", sliced)
    _, grouped = simhash.near_sets(docs, 5, 0.8, simhash.TILE, simhash.TILE_ITEMS)
    assert grouped.groupBy("root").count().count() == 30
    exists = [(columns, os.path.exists(files[0].removeprefix("file:"))) for columns, files in held if files]
    assert all(not there for columns, there in exists if "first" in columns or columns in (["key", "node"], ["a", "b"]) or "items" in columns)
    assert turns == [simhash.SLICES] * 3 and simhash.SLICES > 1 and len(slices) == simhash.SLICES + 1


def test_slices_hold_every_key_once():
    keys = np.arange(-5000, 5000, dtype=np.int64) << 12
    n = np.bincount(simhash.sliced(keys, 4), minlength=4)
    assert n.sum() == len(keys) and n.min() > 2300
