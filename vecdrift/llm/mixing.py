"""Mixing sources to target weights by pivotal dependent rounding (operator 6).

A document of a source with target T and size S starts with T / S copies: a
whole part that it keeps and a fractional part. Fractional parts are rounded in
pairs: the words that one document gives up go to the other, in the direction
drawn at random so that each expected number of copies stays as it was, until
one of the two is whole (0 or 1). Words are conserved by every step. The rows
of a source are dealt to nodes of at most FAN_IN rows by a hash; each node
folds its rows in pairs and passes on the one that is still fractional, with
its share; the nodes of the next level do the same, until one document of each
source is left. That one gives its fractional part as a leading passage, so
that a source's total differs from its target by rounding to words only.

All of it is DataFrame operations: sums that aggregate map-side, and per level
one shuffle of (doc_id, size, share), of FAN_IN times fewer rows each time.

Defined results: null and blank texts have size 0 and take 0 words; a null
source is a source of its own, the last; repeated rows are rows of their own;
an empty table gives an empty result; further columns do not matter to
mix_plan() and pass through mix().
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize

WEIGHTS = (5.0, 2.0, 1.0)
FAN_IN = 64
MOST_COPIES = 3.0


def n_words(text: Column) -> Column:
    """Words in the text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """Per source: source, source_size, target, by water-filling: a source whose
    share is above `most` times its size stops there, and the rest is shared
    anew. With r = size / weight, sources fill up in the order of r, so the
    result is closed: with the sources sorted by r, the level that the others
    reach is (total - most * filled sizes) / remaining weight, and the filled
    ones are those with most * r at or below it.

    Windows over the sources: their number is that of distinct names, one small
    row each after a map-side sum."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    given = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("_w", F.element_at(given, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("_r", F.col("source_size") / F.col("_w"))
    up = Window.orderBy("_r", F.col("source").asc_nulls_last())
    before, whole = up.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = (
        s.withColumn("_total", F.sum("source_size").over(whole).cast("double"))
        .withColumn("_filled", F.coalesce(F.sum("source_size").over(before), F.lit(0)).cast("double"))
        .withColumn("_open", F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
        .withColumn("_level", (F.col("_total") - most * F.col("_filled")) / F.col("_open"))
        .withColumn("_full", most * F.col("_r") <= F.col("_level"))
    )
    level = F.max(F.when(~F.col("_full"), F.col("_level"))).over(whole)
    target = F.least(most * F.col("source_size"), F.coalesce(F.col("_w") * level, most * F.col("source_size")))
    return s.select("source", "source_size", target.alias("target"))


def _let(value: Column, use) -> Column:
    return F.transform(F.array(value), use)[0]


def _draw(a: Column, b: Column, level: int, seed: int) -> Column:
    """Uniform in [0, 1), the same for the same two documents and level."""
    key = F.xxhash64(a["doc_id"], a["copy"], b["doc_id"], b["copy"], F.lit(level), F.lit(seed))
    return F.shiftrightunsigned(key, 11).cast("double") / float(1 << 53)


def _fold(rows: Column, level: int, seed: int) -> Column:
    """Pairs the open document with the next one, again and again. Returns
    struct(open, done): done has those that became whole."""
    eps = 1e-12

    def settled(d: Column, p: Column) -> Column:
        return F.struct(d["doc_id"].alias("doc_id"), d["copy"].alias("copy"), d["size"].alias("size"), d["whole"].alias("whole"), p.alias("p"))

    def step(state: Column, new: Column) -> Column:
        old = state["open"]

        def moved(m: Column) -> Column:
            is_open = lambda d: (d["p"] > eps) & (d["p"] < 1 - eps)
            end = lambda d: settled(d, F.round(d["p"]))
            a, b = m["a"], m["b"]
            stays = F.when(is_open(a), a).when(is_open(b), b)
            out = F.when(is_open(a), F.array(end(b))).when(is_open(b), F.array(end(a))).otherwise(F.array(end(a), end(b)))
            return F.struct(stays.alias("open"), F.concat(state["done"], out).alias("done"))

        ratio = new["size"] / old["size"]
        up = F.least(1 - old["p"], new["p"] * ratio)  # words go to the old one
        down = F.least(old["p"], (1 - new["p"]) * ratio)
        by = F.when(_draw(old, new, level, seed) * (up + down) < down, up).otherwise(-down)
        pair = _let(by, lambda x: F.struct(settled(old, old["p"] + x).alias("a"), settled(new, new["p"] - x / ratio).alias("b")))
        return F.when(old.isNull(), F.struct(new.alias("open"), state["done"].alias("done"))).otherwise(_let(pair, moved))

    first = F.struct(F.when(F.lit(False), rows[0]).alias("open"), F.slice(rows, 1, 0).alias("done"))
    return F.aggregate(rows, first, step)


def _round_level(rows: DataFrame, level: int, seed: int) -> DataFrame:
    """rows: source, node, d(doc_id, size, whole, p). Adds `f`, a node's fold."""
    order = F.sort_array(F.collect_list(F.struct(F.xxhash64("d.doc_id", "d.copy", "d.size", F.lit(seed)).alias("_h"), F.col("d").alias("d"))))
    nodes = rows.groupBy("source", "node").agg(F.transform(order, lambda x: x["d"]).alias("ds"))
    return nodes.select("source", "node", _fold(F.col("ds"), level, seed).alias("f"))


def _small(targets: DataFrame, most: int = 10_000) -> DataFrame:
    """Broadcast one row per source if there are few sources, else leave the
    join to the planner."""
    return F.broadcast(targets) if targets.count() <= most else targets


def mix_plan(docs: DataFrame, weights: tuple = WEIGHTS, most: float = MOST_COPIES, seed: int = 7) -> DataFrame:
    """Per document: doc_id, size, source, source_size, target, copies (whole
    copies taken), part_words (words of a leading passage taken besides), taken."""
    sizes = materialize(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")))
    targets = materialize(source_targets(sizes, weights, most))
    per = sizes.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(each + 1e-12).cast("long")
    # equal rows are counted first and numbered, so that each is dealt on its own
    rows = sizes.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    small = _small(targets)
    rows = rows.join(small, rows["source"].eqNullSafe(targets["source"])).select(
        rows["source"],
        F.struct("doc_id", "copy", "size", whole.alias("whole"), F.greatest(each - whole, F.lit(0.0)).alias("p")).alias("d"),
    )
    # sizes of 0 take nothing, and documents whose share is whole need no rounding
    shared = (F.col("d.p") > 1e-12) & (F.col("d.size") > 0)
    fixed = rows.where(~shared)
    level, parts, left = 0, [fixed.select("source", "d")], per
    rows = rows.where(shared)
    while True:
        nodes = max(1, -(-left // (FAN_IN // 2)))
        node = F.pmod(F.xxhash64("d.doc_id", "d.copy", "d.size", F.lit(seed + level)), F.lit(nodes))
        folded = materialize(_round_level(rows.withColumn("node", node), level, seed))
        parts.append(folded.select("source", F.explode("f.done").alias("d")))
        rows = folded.where(F.col("f.open").isNotNull()).select("source", F.col("f.open").alias("d"))
        level += 1
        if nodes == 1:
            break
        left = nodes
    parts.append(rows)
    d = F.col("d")
    taken = F.round(d["size"] * (d["whole"] + d["p"])).cast("long")
    done = reduce(DataFrame.unionAll, parts).select("source", d["doc_id"].alias("doc_id"), d["size"].alias("size"), F.floor(d["whole"] + d["p"] + 1e-9).alias("copies"), taken.alias("taken"))
    done = done.withColumn("part_words", F.greatest(F.col("taken") - F.col("copies") * F.col("size"), F.lit(0)))
    return done.join(small, done["source"].eqNullSafe(targets["source"])).select("doc_id", "size", done["source"], "source_size", "target", "copies", "part_words", "taken")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, most: float = MOST_COPIES, seed: int = 7) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken whole, and the
    leading passage of the one row of each source that is taken in part. The
    columns are those of docs. Documents that share a doc_id, source and size
    are interchangeable: the i-th of them gets the i-th of their decisions."""
    plan = materialize(mix_plan(docs, weights, most, seed))
    plan = plan.where("taken > 0").select("doc_id", "size", "source", "copies", "part_words")
    keyed = docs.withColumn("_mx_size", n_words(F.col("text")))
    twice = plan.groupBy("doc_id", "size", "source").count().where("count > 1")
    plan = plan.select(F.col("doc_id").alias("_mx_id"), F.col("size").alias("_mx_n"), F.col("source").alias("_mx_source"), "copies", "part_words").withColumnsRenamed({"copies": "_mx_copies", "part_words": "_mx_part"})
    on = F.col("doc_id").eqNullSafe(F.col("_mx_id")) & (F.col("_mx_size") == F.col("_mx_n")) & F.col("source").eqNullSafe(F.col("_mx_source"))
    if not twice.isEmpty():
        one = Window.partitionBy("doc_id", "_mx_size", "source").orderBy("text")
        two = Window.partitionBy("_mx_id", "_mx_n", "_mx_source").orderBy("_mx_copies", "_mx_part")
        keyed, plan = keyed.withColumn("_mx_i", F.row_number().over(one)), plan.withColumn("_mx_j", F.row_number().over(two))
        on = on & (F.col("_mx_i") == F.col("_mx_j"))
    words = F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0))
    lead = F.array_join(F.slice(words, F.lit(1), F.col("_mx_part").cast("int")), " ")
    made = F.filter(F.concat(F.array_repeat(F.col("text"), F.col("_mx_copies").cast("int")), F.when(F.col("_mx_part") > 0, F.array(lead)).otherwise(F.array().cast("array<string>"))), lambda x: x.isNotNull())
    return keyed.join(plan, on).withColumn("text", F.explode(made)).select(*docs.columns)
