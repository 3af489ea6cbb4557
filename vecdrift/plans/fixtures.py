"""The driver's tables as the library's inputs, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIM, LAYERS, EVERY, BETA = 16, 4, 8, 10.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sliced(e: DataFrame, out: str) -> DataFrame:
    parts = F.array(*[F.transform(F.slice("embedding", i * DIM + 1, DIM), lambda x: x.cast("double")) for i in range(LAYERS)])
    return e.select("vec_id", F.posexplode(parts).alias("layer", out))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, layer, position, r: five vectors a sample, the first its
    reference; each vector is four layers of 16."""
    e = _sliced(table(spark, sf_dir, "embeddings"), "r")
    return e.select(F.floor(F.col("vec_id") / 5).alias("sample_id"), "layer", (F.col("vec_id") % 5).cast("int").alias("position"), "r")


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """layer, pattern_id, weights: every eighth vector."""
    e = table(spark, sf_dir, "embeddings").where(F.col("vec_id") % EVERY == 0)
    return _sliced(e, "weights").withColumnRenamed("vec_id", "pattern_id")


def sample_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, y: 1 if the reference's label is 5 or more."""
    e = table(spark, sf_dir, "embeddings").where(F.col("vec_id") % 5 == 0)
    return e.select(F.floor(F.col("vec_id") / 5).alias("sample_id"), (F.col("label") >= 5).cast("int").alias("y"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, position, logits, chosen, from events."""
    e = table(spark, sf_dir, "events")
    logits = F.array((F.col("value") / 100).cast("double"), *[(F.col("event_id") % k).cast("double") for k in (7, 5, 3, 2)])
    return e.select(F.col("user_id").alias("sample_id"), F.col("event_id").alias("position"), logits.alias("logits"), (F.col("event_id") % 5).cast("int").alias("chosen"))


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, y, full, base, category, idx (from 0 in the order of id)."""
    from ..operators.selection import with_position

    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    rows = d.select(F.col("doc_id").alias("sample_id"), F.col("quality").cast("int").alias("y"), F.col("n_chars").cast("double").alias("full"), F.size(F.split("text", " ", -1)).cast("double").alias("base"), F.col("lang").alias("category"), "source")
    return with_position(rows, "sample_id").withColumnRenamed("_pos", "idx")


def qa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, question, answer: a user turn and the assistant's next."""
    c = table(spark, sf_dir, "conversations")
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question")).join(a, ["conv_id", "turn"])


#: Common table expressions with the same inputs, one row per number.
SQL = """
e AS (SELECT vec_id, label, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
pts AS (SELECT vec_id // 5 AS sample_id, (vec_id % 5)::INT AS position, (i // 16)::INT AS layer, (i % 16)::INT AS dim, x FROM e),
bk AS (SELECT (i // 16)::INT AS layer, vec_id AS pattern_id, (i % 16)::INT AS dim, x FROM e WHERE vec_id % 8 = 0),
nrm AS (SELECT layer, pattern_id, sqrt(sum(x * x)) AS row_norm FROM bk GROUP BY ALL),
mh AS (SELECT layer, pattern_id, dim, x / greatest(row_norm, 1e-12) AS m, row_norm FROM bk JOIN nrm USING (layer, pattern_id)),
sc AS (SELECT sample_id, p.position, p.layer, pattern_id, sum(p.x * m) AS s FROM pts p JOIN mh ON p.layer = mh.layer AND p.dim = mh.dim GROUP BY ALL),
quad AS (SELECT sample_id, position, layer, 0.5 * sum(x * x) AS quadratic_term FROM pts GROUP BY ALL),
lab AS (SELECT vec_id // 5 AS sample_id, (label >= 5)::INT AS y FROM embeddings WHERE vec_id % 5 = 0)"""


def dist_sql(beta: str = "10.0::DOUBLE") -> str:
    """ex: exponentials and their sums; p: the distributions."""
    return f"""
mx AS (SELECT sample_id, position, layer, max({beta} * s) AS mx FROM sc GROUP BY ALL),
ex AS (SELECT sc.*, exp({beta} * s - mx) AS ex, mx FROM sc JOIN mx USING (sample_id, position, layer)),
z AS (SELECT sample_id, position, layer, sum(ex) AS z, any_value(mx) AS mx, count(*) AS k FROM ex GROUP BY ALL),
pr AS (SELECT ex.sample_id, ex.position, ex.layer, pattern_id, ex / z AS p FROM ex JOIN z USING (sample_id, position, layer)),
scal AS (SELECT z.sample_id, z.position, z.layer, any_value(-(mx + ln(z)) / {beta}) AS lse_term, any_value(quadratic_term) AS quadratic_term,
  -sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) AS entropy, any_value(k) AS k
  FROM z JOIN pr USING (sample_id, position, layer) JOIN quad USING (sample_id, position, layer) GROUP BY z.sample_id, z.position, z.layer),
divs AS (SELECT g.sample_id, g.position, g.layer,
  greatest(sum(0.5 * g.p * ln(2 * g.p / (g.p + r.p)) + 0.5 * r.p * ln(2 * r.p / (g.p + r.p))), 0) AS js, 0.5 * sum((sqrt(g.p) - sqrt(r.p)) ** 2) AS hellinger_sq,
  sum(sqrt(g.p * r.p)) AS bc, sum(g.p * ln(g.p / r.p)) AS kl
  FROM pr g JOIN pr r ON g.sample_id = r.sample_id AND g.layer = r.layer AND g.pattern_id = r.pattern_id AND r.position = 0 WHERE g.position > 0 GROUP BY ALL),
traj AS (SELECT scal.*, entropy / ln(k) AS norm_entropy, js, hellinger_sq, bc, kl FROM scal LEFT JOIN divs USING (sample_id, position, layer)),
feat AS (SELECT sample_id, layer,
  avg(lse_term + quadratic_term) FILTER (position > 0) - max(lse_term + quadratic_term) FILTER (position = 0) AS delta_energy,
  avg(norm_entropy) FILTER (position > 0) - max(norm_entropy) FILTER (position = 0) AS delta_norm_entropy,
  avg(js) AS mean_js, avg(hellinger_sq) AS mean_hellinger_sq,
  avg(entropy) FILTER (position > 0) - max(entropy) FILTER (position = 0) AS delta_entropy,
  avg(lse_term + quadratic_term) FILTER (position > 0) AS gen_energy_mean, avg(norm_entropy) FILTER (position > 0) AS gen_norm_entropy_mean
  FROM traj GROUP BY ALL)"""
