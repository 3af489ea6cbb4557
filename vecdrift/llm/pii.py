"""Personal data by weak-supervision aggregation (operator 4), in DataFrame
operations only.

Candidates are the spans of fixed patterns (base spans) and those of looser
ones. Three labelers vote on each candidate: the pattern (yes for a base span; for
a loose card or phone whether its digits hold; it abstains on other loose forms,
which have no check), a gazetteer (top-level domains, calling prefixes, issuer
digits, address ranges) and the context (cue words before the span; it may
abstain). Expectation-maximisation over the counts of vote patterns estimates how
reliable each labeler is, and with it the probability of every vote pattern. The
final classifier is naive Bayes over the span's form, its surroundings and the
votes of the gazetteer and the context, trained with these probabilities as soft
labels on all candidates. Loose spans that it accepts are added; base spans stay
whatever it says. Gazetteer and cues are parameters.

One pass over the texts writes the candidates, of which there are few; the
model is one row of at most a few hundred numbers, as the vote patterns and
feature values are bounded by their form, and is broadcast to a second pass
over the candidates. No text is shuffled and no rows are joined.

Defined results: a null text is the empty text, without spans; positions are
code points; repeated rows are rows of their own; further columns do not matter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

KINDS = ("email", "ip", "card", "phone")

#: The base patterns. Possessive and anchored forms of the given
#: ones: none of their repeats can give back a character to a later match.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"[^\x20\x09-\x0D@,;:<>()]{1,64}(?:@|\x20?[(\[]at[)\]]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[]dot[)\]]\x20?)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}+:){7}+[0-9A-Fa-f]{1,4}+(?![0-9A-Fa-f:.])",
    "card": r"(?<![0-9])[0-9]{4}(?:[\x20.-][0-9]{4}){3}(?![0-9])|(?<![0-9])[0-9]{13,19}+",
    "phone": r"(?<![0-9+])(?:\([0-9]{2,4}\)|[0-9]{2,4}+)[\x20.-][0-9]{3,4}+[\x20.-][0-9]{4}+(?![0-9])",
}
CUES = {
    "email": "mail|contact|write|address|correo|courriel|schreib",
    "ip": r"\bip\b|server|host|address|login|adresse",
    "card": "card|visa|master|amex|credit|debit|tarjeta|carte|karte|pay",
    "phone": r"\btel|phone|call|fax|mobile|cell|m[oó]vil|anruf|appel",
}
NOT_CUES = r"order|invoice|version|\bid\b|isbn|serial|part|ref|page|total|#"
DOMAINS = "com|org|net|edu|gov|info|io|de|fr|es|uk|us|eu|it|nl|ch|at|ru|cn|jp|br|in|ca|au"
STEPS = 40
ACCEPT = 0.9


def _located(text: Column, pattern: str) -> Column:
    """array<struct<s, e, t>>: the matches with their places in code points."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.transform(F.split(text, pattern, -1), F.length)
    zipped = F.filter(F.arrays_zip(found.alias("t"), gaps.alias("g")), lambda x: x["t"].isNotNull())
    none = F.array().cast("array<struct<s:int,e:int,t:string>>")

    def step(state, x):
        s = state["at"] + x["g"]
        e = s + F.length(x["t"])
        return F.struct(e.alias("at"), F.concat(state["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["t"].alias("t")))).alias("out"))

    return F.aggregate(zipped, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda x: x["out"])


def _digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def _luhn(t: Column) -> Column:
    def step(total, i):
        d = F.try_element_at(F.split(F.reverse(_digits(t)), ""), i).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(_digits(t))), F.lit(0), step) % 10 == 0


def _holds(kind: str, t: Column) -> Column:
    """Whether a match of the base pattern is a base span."""
    n = F.length(_digits(t))
    if kind == "ip":
        return F.forall(F.split(t, r"\."), lambda x: F.coalesce(F.concat(F.lit("0"), F.ltrim(x, F.lit("0"))).try_cast("int"), F.lit(256)) <= 255)
    if kind == "card":
        return F.when(n.between(14, 19), _luhn(t)).otherwise(False)
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def _maybe(kind: str, text: Column) -> Column:
    """A cheap test that a text without candidates of the kind mostly fails."""
    if kind == "email":
        return F.contains(text, F.lit("@")) | F.contains(text, F.lit("at)")) | F.contains(text, F.lit("at]"))
    return text.rlike("[0-9]")


def _test(kind: str):
    return lambda x: _holds(kind, x["t"])


def _named(k: int, kind: str, spans: Column, text: Column) -> Column:
    named = F.transform(spans, lambda x: F.struct(F.lit(k).alias("k"), x["s"].alias("s"), x["e"].alias("e"), x["t"].alias("t")))
    return F.when(_maybe(kind, text), named).otherwise(F.array().cast("array<struct<k:int,s:int,e:int,t:string>>"))


def base_spans(text: Column) -> Column:
    """array<struct<k, s, e, t>>, k the place in KINDS."""
    return F.concat(*[_named(k, kind, F.filter(_located(text, BASE[kind]), _test(kind)), text) for k, kind in enumerate(KINDS)])


def loose_spans(text: Column) -> Column:
    """The same for the looser patterns."""
    return F.concat(*[_named(k, kind, _located(text, LOOSE[kind]), text) for k, kind in enumerate(KINDS)])


def _by_kind(k: Column, each: dict[str, Column]) -> Column:
    out = F.when(k == 0, each[KINDS[0]])
    for i, kind in enumerate(KINDS[1:], 1):
        out = out.when(k == i, each[kind])
    return out


def _gazetteer(k: Column, t: Column, domains: str) -> Column:
    return _by_kind(
        k,
        {
            "email": t.rlike(rf"(?i)[.\])\x20](?:{domains})$"),
            "ip": t.rlike(r"^(?:[1-9]|[1-9][0-9]|1[0-9][0-9]|2[0-1][0-9]|22[0-3])\.") | t.rlike("^[23][0-9A-Fa-f]{3}:"),
            "card": _digits(t).rlike("^(?:3[47]|4|5[1-5]|2[2-7]|6)"),
            "phone": t.rlike(r"^\+(?:1|7|2[0-9]|3[0-9]|4[0-9]|5[0-9]|6[0-9]|8[0-9]|9[0-9])") | t.rlike(r"^\([2-9]"),
        },
    ).cast("int")


def _context(k: Column, before: Column, cues: dict[str, str], not_cues: str) -> Column:
    """1, 0, or -1 for none."""
    cue = _by_kind(k, {kind: before.rlike(f"(?i){cues[kind]}") for kind in KINDS})
    return F.when(cue, 1).when(before.rlike(f"(?i){not_cues}"), 0).otherwise(-1)


def _pattern(k: Column, t: Column, n: Column) -> Column:
    """Of a loose candidate with n digits: 1, 0, or -1 where its form has no check."""
    return F.when(k == 2, F.when(n.between(14, 19), _luhn(t)).otherwise(False).cast("int")).when(k == 3, n.between(10, 15).cast("int")).otherwise(-1)


def _described(text: Column, x: Column, strict: bool, domains: str, cues: dict[str, str], not_cues: str) -> Column:
    """A candidate with its votes and features."""
    before = F.substring(text, F.greatest(x["s"] - 23, F.lit(1)), F.least(x["s"], F.lit(24)))
    after = F.substring(text, x["e"] + 1, F.lit(1))
    n = F.length(_digits(x["t"]))
    features = F.array(
        F.concat(F.lit("digits="), F.least(n, F.lit(20)).cast("string")),
        F.concat(F.lit("length="), F.least(F.floor((x["e"] - x["s"]) / 4), F.lit(10)).cast("string")),
        F.concat(F.lit("separated="), x["t"].rlike(r"[\x20().-]").cast("string")),
        F.concat(F.lit("luhn="), F.when((x["k"] == 2) & n.between(1, 40), _luhn(x["t"])).otherwise(False).cast("string")),
        F.concat(F.lit("left="), before.rlike(r"(?:^|[\x20\x09-\x0D(])$").cast("string")),
        F.concat(F.lit("right="), ((after == "") | after.rlike(r"[\x20\x09-\x0D,.;:)]")).cast("string")),
    )
    return F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"), (F.lit(1) if strict else _pattern(x["k"], x["t"], n)).alias("v1"), _gazetteer(x["k"], x["t"], domains).alias("v2"), _context(x["k"], before, cues, not_cues).alias("v3"), features.alias("f"))


def candidates(docs: DataFrame, domains: str = DOMAINS, cues: dict[str, str] = CUES, not_cues: str = NOT_CUES) -> DataFrame:
    """doc_id, base and loose: arrays of candidates with votes and features."""
    text = F.coalesce("text", F.lit(""))
    found = docs.select("doc_id", text.alias("text")).withColumn("b", base_spans(F.col("text"))).withColumn("l", loose_spans(F.col("text")))
    apart = F.filter("l", lambda x: ~F.exists("b", lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"])))
    describe = lambda strict: lambda x: _described(F.col("text"), x, strict, domains, cues, not_cues)
    return found.select("doc_id", F.transform("b", describe(True)).alias("base"), F.transform(apart, describe(False)).alias("loose"))


def _posterior(m: Column, x: Column) -> Column:
    """P(personal | votes) under m: arrays `prior` by kind, `hit` and `miss` by
    labeler (the share of 1-votes on personal and on other candidates)."""

    def side(rate: Column, prior: Column) -> Column:
        p = prior
        for j, v in enumerate(("v1", "v2", "v3")):
            p = p * F.when(x[v] == 1, rate[j]).when(x[v] == 0, 1 - rate[j]).otherwise(1.0)
        return p

    prior = F.element_at(m["prior"], x["k"] + 1)
    yes, no = side(m["hit"], prior), side(m["miss"], 1 - prior)
    return yes / (yes + no)


def reliabilities(rows: DataFrame) -> DataFrame:
    """rows: c (candidates). One row `m`: priors by kind, hit and miss rates by
    labeler, by expectation-maximisation on the counts of vote patterns (at most
    four kinds x 3 x 2 x 3)."""
    patterns = rows.groupBy("c.k", "c.v1", "c.v2", "c.v3").agg(F.count("*").cast("double").alias("n"))
    one = patterns.agg(F.sort_array(F.collect_list(F.struct("k", "v1", "v2", "v3", "n"))).alias("ps"))
    start = F.struct(F.array(*[F.lit(0.5)] * 4).alias("prior"), F.array(F.lit(0.9), F.lit(0.8), F.lit(0.7)).alias("hit"), F.array(F.lit(0.1), F.lit(0.4), F.lit(0.3)).alias("miss"))

    def step(m: Column, _: Column) -> Column:
        soft = F.transform("ps", lambda x: F.struct(x.alias("x"), (x["n"] * _posterior(m, x)).alias("yes"), (x["n"] * (1 - _posterior(m, x))).alias("no")))

        def next_model(s: Column) -> Column:
            total = lambda keep, side: F.aggregate(F.filter(s, lambda y: keep(y["x"])), F.lit(0.0), lambda a, y: a + y[side])
            of = [lambda x, k=k: x["k"] == k for k in range(4)]
            prior = [(total(f, "yes") + 1) / (total(f, "yes") + total(f, "no") + 2) for f in of]
            rate = lambda v, side, a, b: (total(lambda x: x[v] == 1, side) + a) / (total(lambda x: x[v] >= 0, side) + a + b)
            hit = [rate(v, "yes", 2, 1) for v in ("v1", "v2", "v3")]
            miss = [rate(v, "no", 1, 2) for v in ("v1", "v2", "v3")]
            return F.struct(F.array(*prior).alias("prior"), F.array(*hit).alias("hit"), F.array(*miss).alias("miss"))

        return F.transform(F.array(soft), next_model)[0]

    return one.select(F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step).alias("m"))


def span_classifier(rows: DataFrame, model: DataFrame) -> DataFrame:
    """One row: m, and w: the log odds of each feature value of each kind, from
    soft counts over all candidates ("kind" itself holds the prior odds)."""
    soft = rows.crossJoin(F.broadcast(model)).select("c", _posterior(F.col("m"), F.col("c")).alias("p"))
    votes = F.array(F.concat(F.lit("gazetteer="), F.col("c.v2").cast("string")), F.concat(F.lit("context="), F.col("c.v3").cast("string")))
    named = F.transform(F.concat(F.array(F.lit("kind")), F.col("c.f"), votes), lambda f: F.concat(F.col("c.k").cast("string"), F.lit(":"), f))
    table = soft.select("p", F.explode(named).alias("f")).groupBy("f").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no"))
    split = F.split("f", "[:=]")
    prior = table.where(F.col("f").endswith(":kind")).select(split[0].alias("k"), F.col("yes").alias("all_yes"), F.col("no").alias("all_no"))
    odds = table.withColumn("k", split[0]).join(F.broadcast(prior), "k")
    own = F.when(F.col("f").endswith(":kind"), F.log((F.col("yes") + 0.5) / (F.col("no") + 0.5))).otherwise(F.log((F.col("yes") + 0.5) / (F.col("all_yes") + 1)) - F.log((F.col("no") + 0.5) / (F.col("all_no") + 1)))
    return odds.agg(F.map_from_entries(F.collect_list(F.struct("f", own))).alias("w")).crossJoin(F.broadcast(model))


def _accepted(w: Column, x: Column) -> Column:
    votes = F.array(F.concat(F.lit("gazetteer="), x["v2"].cast("string")), F.concat(F.lit("context="), x["v3"].cast("string")))
    named = F.concat(F.array(F.lit("kind")), x["f"], votes)
    total = F.aggregate(named, F.lit(0.0), lambda a, f: a + F.coalesce(F.try_element_at(w, F.concat(x["k"].cast("string"), F.lit(":"), f)), F.lit(0.0)))
    return total > math.log(ACCEPT / (1 - ACCEPT))


def _joined(spans: Column) -> Column:
    """kind:start:end by start, then kind."""
    order = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))))
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(order, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"], x["e"])), ",")


def find_pii(docs: DataFrame, **how) -> DataFrame:
    """Per row of docs: doc_id, base (spans), added (spans): arrays of
    struct<k, s, e>, k the place in KINDS. how: see candidates()."""
    found = materialize(candidates(docs, **how))
    rows = found.where((F.size("base") > 0) | (F.size("loose") > 0)).select(F.explode(F.concat("base", "loose")).alias("c"))
    model = materialize(span_classifier(rows, materialize(reliabilities(rows))))
    short = lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"))
    added = F.filter("loose", lambda x: _accepted(F.col("w"), x))
    return found.crossJoin(F.broadcast(model)).select("doc_id", F.transform("base", short).alias("base"), F.transform(added, short).alias("added"))


def op4_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    of = lambda k: F.filter("base", lambda x: x["k"] == k)
    counts = [F.size(of(k)).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.concat("base", "added")).alias("spans"))
