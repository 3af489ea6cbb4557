"""Operator 13: allow or block web addresses by rules, and what no rule fits by a
tree of path templates.

DataFrame functions only. Addresses are counted by (host, shape), a shape being
the path's first LEVELS segments with digits as `#`; labels (by default the rules'
verdicts) are counted with them. Then, level by level from the host down:

1. Variable segments become wildcards: of a node with more than MOST_KIDS
   different next segments, those with less than 1 / MOST_KIDS of its rows are `*`.
   So a node has at most MOST_KIDS literal branches.
2. Statistically similar branches of a node become one: going from the largest to
   the smallest, a branch joins the first one before it from which no share
   differs by more than Hoeffding's bound: of labelled rows, of blocked rows, and
   of each next segment. Branches of fewer than MIN_BRANCH rows prove nothing and
   stay apart. (As the labelled share is among them, a branch without labels does
   not take over those of a labelled one.)

A template (the path through the merged tree) is blocked if its smoothed purity,
(blocked + SMOOTH / 2) / (labelled + SMOOTH), is at least REJECT; one without labels
has 1/2 and is allowed.

Tables of shapes are sums, made map-side first; no host meets in one task. An
address meets its template by joined_to_groups(), so that hot shapes' rows stay
where they are; rows with a rule are not shuffled.

Results for odd input: a null address, or one without `://`, has an empty host and
path; no rule fits it, and it is judged as a template of its own. Of rules that fit
with equal length, the first in code-point order wins. Repeated rows count each;
an empty table gives no rows; columns other than page_id and url are not read and
may have any name."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, joined_to_groups, materialize

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
LEVELS, MOST_KIDS, MIN_BRANCH, ALPHA = 4, 20, 50, 0.05
SMOOTH, REJECT = 2.0, 0.8
LONGEST, MOST_RULES = 64, 1000
END, REST, ANY = "$", "**", "*"


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url)))
    part = lambda k: F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", k), F.lit(""))
    return ascii_lower(part(1)), part(2)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """(the longest rule that fits or null, its verdict or null). Rules are a
    parameter of at most MOST_RULES entries, part of the plan."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MOST_RULES}")
    named, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1]), reverse=True):
        own, start = rule[: rule.index("/")], rule[rule.index("/") :]
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        named, verdict = F.when(fits, F.lit(rule)).otherwise(named), F.when(fits, F.lit(kind)).otherwise(verdict)
    return named, verdict


def shape(path: Column, levels: int = LEVELS) -> Column:
    """The path's first segments as an array: runs of digits are `#`, a segment of
    over LONGEST characters is `*`; one `**` stands for all segments beyond."""
    parts = F.split(F.regexp_replace(path, r"^/|/$", ""), "/", levels + 1)
    one = lambda s, i: F.when(i == levels, F.lit(REST)).when(F.length(s) > LONGEST, F.lit(ANY)).otherwise(F.regexp_replace(s, "[0-9]+", "#"))
    return F.transform(parts, one)


def _next(k: int) -> Column:
    return F.coalesce(F.get("t", F.lit(k)), F.lit(END))


def _with(k: int, value: Column) -> Column:
    """t with its k-th entry (if it has one) set to value."""
    return F.transform("t", lambda s, i: F.when(i == k, value).otherwise(s))


def generalised(shapes: DataFrame, levels: int = LEVELS, most: int = MOST_KIDS) -> DataFrame:
    """shapes: host, key, t, n, labelled, blocked. t with variable segments as
    wildcards."""
    for k in range(levels):
        node = [F.col("host"), F.slice("t", 1, k).alias("p")]
        kids = shapes.where(F.size("t") > k).groupBy(*node, _next(k).alias("s")).agg(F.sum("n").alias("n"))
        wide = kids.groupBy("host", "p").agg(F.count("*").alias("kids"), F.sum("n").alias("total")).where(F.col("kids") > most)
        # at most `most` branches of a wide node have so large a share
        stay = kids.join(wide, ["host", "p"]).groupBy("host", "p").agg(F.collect_list(F.when(F.col("n") * most >= F.col("total"), F.col("s"))).alias("stay"))
        shapes = shapes.withColumn("p", F.slice("t", 1, k)).join(stay, ["host", "p"], "left")
        shapes = materialize(shapes.withColumn("t", F.when(F.col("stay").isNotNull() & ~F.array_contains("stay", _next(k)), _with(k, F.lit(ANY))).otherwise(F.col("t"))).drop("p", "stay"))
    return shapes


def _clusters(branches: str, alpha: float, least: int) -> Column:
    """An array of branches (n, s, labelled, blocked, kids), the largest first, to
    clusters (one: the branch that leads it, names: of all in it)."""
    bound = math.sqrt(0.5 * math.log(2 / alpha))

    def similar(a: Column, b: Column) -> Column:
        most = bound * (1 / F.sqrt(a["n"]) + 1 / F.sqrt(b["n"]))
        near = lambda x, y: F.abs(F.coalesce(x, F.lit(0)) / a["n"] - F.coalesce(y, F.lit(0)) / b["n"]) <= most
        names = F.array_union(F.map_keys(a["kids"]), F.map_keys(b["kids"]))
        shares = F.forall(names, lambda s: near(a["kids"][s], b["kids"][s]))
        return (a["n"] >= least) & (b["n"] >= least) & near(a["labelled"], b["labelled"]) & near(a["blocked"], b["blocked"]) & shares

    def add(acc: Column, b: Column) -> Column:
        at = F.array_position(F.transform(acc, lambda c: similar(c["one"], b)), True)
        grown = F.transform(acc, lambda c, i: F.when(i + 1 == at, F.struct(c["one"].alias("one"), F.array_append(c["names"], b["s"]).alias("names"))).otherwise(c))
        alone = F.array(F.struct(b.alias("one"), F.array(b["s"]).alias("names")))
        return F.when(at > 0, grown).otherwise(F.concat(acc, alone))

    return F.aggregate(F.slice(branches, 2, MOST_KIDS + 2), F.transform(F.slice(branches, 1, 1), lambda b: F.struct(b.alias("one"), F.array(b["s"]).alias("names"))), add)


def merged(shapes: DataFrame, levels: int = LEVELS, alpha: float = ALPHA, least: int = MIN_BRANCH) -> DataFrame:
    """shapes after generalised(): similar branches of a node share one name,
    `{largest+others}`."""
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]
    for k in range(levels - 1):
        node = ["host", "p"]
        kids = shapes.where(F.size("t") > k).groupBy("host", F.slice("t", 1, k).alias("p"), _next(k).alias("s"), _next(k + 1).alias("kid")).agg(*sums)
        # a node has at most MOST_KIDS + 1 branches, a branch as many kids and an end
        branches = kids.groupBy(*node, "s").agg(*sums, F.map_from_entries(F.collect_list(F.struct("kid", "n"))).alias("kids"))
        branches = branches.groupBy(*node).agg(F.collect_list(F.struct("n", "s", "labelled", "blocked", "kids")).alias("b")).where(F.size("b") > 1)
        order = lambda x, y: F.when((x["n"] > y["n"]) | ((x["n"] == y["n"]) & (x["s"] < y["s"])), -1).otherwise(1)
        branches = branches.withColumn("b", F.array_sort("b", order))
        found = branches.select(*node, F.explode(_clusters("b", alpha, least)).alias("c")).where(F.size("c.names") > 1)
        names = found.select(*node, F.concat(F.lit("{"), F.col("c.one.s"), F.lit("+"), (F.size("c.names") - 1).cast("string"), F.lit("}")).alias("name"), F.explode("c.names").alias("s"))
        shapes = shapes.withColumn("p", F.slice("t", 1, k)).withColumn("s", _next(k)).join(names, [*node, "s"], "left")
        shapes = materialize(shapes.withColumn("t", F.when(F.col("name").isNotNull(), _with(k, F.col("name"))).otherwise(F.col("t"))).drop("p", "s", "name"))
    return shapes


def templates(labelled: DataFrame, smooth: float = SMOOTH, reject: float = REJECT) -> DataFrame:
    """labelled: host, t (shape), label (allow, block or null). key (host and
    shape), n, template, purity, method (allow or block)."""
    key = F.concat("host", F.lit("/"), F.array_join("t", "/"))
    shapes = labelled.groupBy("host", "t").agg(F.count("*").alias("n"), F.count("label").alias("labelled"), F.count_if(F.col("label") == "block").alias("blocked")).withColumn("key", key)
    shapes = merged(generalised(materialize(shapes)))
    template = F.concat("host", F.lit("/"), F.array_join("t", "/"))
    shapes = shapes.withColumn("template", template)
    sums = shapes.groupBy("template").agg(F.sum("labelled").alias("_l"), F.sum("blocked").alias("_b"))
    purity = (F.col("_b") + smooth / 2) / (F.col("_l") + smooth)
    sums = sums.select("template", purity.alias("purity"), F.when(purity >= reject, "block").otherwise("allow").alias("method"))
    return shapes.select("key", "n", "template").join(sums, "template")


def judged(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, labels: DataFrame | None = None) -> DataFrame:
    """pages: page_id, url. page_id, host, path, rule, verdict, template, purity (of
    rows without a rule). labels: page_id, label (allow or block), one row per
    page; by default the rules' verdicts are the labels."""
    host, path = host_and_path()
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("verdict", verdict).withColumn("t", shape(F.col("path")))
    marked = rows.withColumn("label", F.col("verdict")) if labels is None else rows.join(labels.select("page_id", "label"), "page_id", "left")
    groups = materialize(templates(marked.select("host", "t", "label")))
    open_rows = rows.where("rule is null").withColumn("key", F.concat("host", F.lit("/"), F.array_join("t", "/")))
    found = joined_to_groups(open_rows.select("page_id", "host", "path", "key"), groups, "key", "n")
    found = found.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.col("method").alias("verdict"), "template", "purity")
    return rows.where("rule is not null").select("page_id", "host", "path", "rule", "verdict", F.lit(None).cast("string").alias("template"), F.lit(None).cast("double").alias("purity")).unionAll(found)


def op13_path_template_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"))
