"""Locked splits and folds, drawn by md5 order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import keyed_order

RATIOS = (0.70, 0.15, 0.15)
MOST_IDS = 20_000_000


def place_in_class(rows: DataFrame, seed: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds _p: the row's place, from 1, in the md5 order of its class (of each value
    of `by`). The md5's leading digits are the bucket, whose size is known beforehand;
    a class of any size is dealt over 4096 of them."""
    keyed = rows.withColumn("_o", keyed_order(seed, "sample_id")).withColumn("_b", F.conv(F.substring("_o", 1, 3), 16, 10).cast("int"))
    keys = ["y", *by]
    names = [f"_y{i}" for i in range(len(keys))]
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = keyed.groupBy(*keys, "_b").count().select(*[F.col(c).alias(n) for c, n in zip(keys, names, strict=True)], F.col("_b").alias("_c"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("y", "_b", *by).orderBy("_o", "sample_id"))
    same = [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(keys, names, strict=True)]
    placed = keyed.withColumn("_in", inside).join(F.broadcast(starts), [*same, F.col("_b") == F.col("_c")])
    return placed.withColumn("_p", F.col("_start") + F.col("_in")).drop("_o", "_b", "_in", "_start", *names, "_c")


def id_set_hash(ids: DataFrame) -> DataFrame:
    """One row: the sha256 of the sorted ids joined by commas. The hash is of one
    string, so that the ids of the split meet in one row; more than MOST_IDS of
    them raise."""
    if ids.limit(MOST_IDS + 1).count() > MOST_IDS:
        raise ValueError(f"more than {MOST_IDS} ids cannot be hashed as one string")
    return ids.agg(F.sha2(F.concat_ws(",", F.sort_array(F.collect_list(F.col("sample_id").cast("string")))), 256).alias("hash"))


def _quota(sizes: DataFrame, total: int, size: str, out: str) -> DataFrame:
    """Adds `out`: shares of `total` by size with the largest remainders (the
    smaller y on ties). One row per class."""
    whole = F.sum(size).over(Window.partitionBy())
    exact = F.lit(float(total)) * F.col(size) / whole
    base = sizes.withColumn("_f", F.floor(exact).cast("long")).withColumn("_r", exact - F.floor(exact))
    order = Window.orderBy(F.col("_r").desc(), "y")
    left = F.lit(total) - F.sum("_f").over(Window.partitionBy())
    return base.withColumn(out, F.col("_f") + (F.row_number().over(order) <= left).cast("long")).drop("_f", "_r")


def stratified_split(rows: DataFrame, seed: int = 42, ratios: tuple[float, float, float] = RATIOS, forced: DataFrame | None = None) -> DataFrame:
    """rows: sample_id, y. sample_id, y, split, forced. n_test and n_val are
    rounded (half to even) shares of all rows, dealt to the classes of the pool
    by largest remainder; forced ids are in train and not in the pool."""
    if abs(sum(ratios) - 1) > 1e-9:
        raise ValueError(f"ratios sum to {sum(ratios)}")
    n = rows.count()
    n_test, n_val = round(ratios[2] * n), round(ratios[1] * n)
    marked = rows.withColumn("forced", F.lit(False))
    if forced is not None:
        known = forced.select("sample_id").distinct().withColumn("_f", F.lit(True))
        marked = rows.join(known, "sample_id", "left").withColumn("forced", F.coalesce("_f", F.lit(False))).drop("_f")
    pool = marked.where("not forced")
    sizes = pool.groupBy("y").agg(F.count("*").alias("n"))
    quotas = _quota(_quota(sizes, n_test, "n", "_test"), n_val, "n", "_val").select("y", "_test", "_val")
    dealt = place_in_class(pool, seed).join(F.broadcast(quotas), "y")
    split = F.when(F.col("_p") <= F.col("_test"), "test").when(F.col("_p") <= F.col("_test") + F.col("_val"), "val").otherwise("train")
    return dealt.select("sample_id", "y", split.alias("split"), "forced").unionByName(marked.where("forced").select("sample_id", "y", F.lit("train").alias("split"), "forced"))


def check_locked(split: DataFrame, test_hash: str) -> DataFrame:
    """A stored split as it is; raises if its test ids have changed."""
    now = id_set_hash(split.where("split = 'test'")).first()[0]
    if now != test_hash:
        raise ValueError("the stored split's test ids do not match its hash")
    return split


def locked_split(rows: DataFrame, path: str, seed: int = 42, ratios: tuple[float, float, float] = RATIOS, forced: DataFrame | None = None) -> DataFrame:
    """The split stored at path, verified; made and stored on the first call.
    Later seeds and ratios do not matter."""
    spark = rows.sparkSession
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(f"{path}/hash/_SUCCESS")
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        split = stratified_split(rows, seed, ratios, forced)
        split.write.mode("overwrite").parquet(f"{path}/ids")
        id_set_hash(spark.read.parquet(f"{path}/ids").where("split = 'test'")).write.mode("overwrite").json(f"{path}/hash")
    stored = spark.read.parquet(f"{path}/ids")
    return check_locked(stored, spark.read.json(f"{path}/hash").first()["hash"])


def kfold(rows: DataFrame, k: int, seed: int = 42, out: str = "fold", by: tuple[str, ...] = ()) -> DataFrame:
    """rows: sample_id, y. Adds a stratified fold from 0 to k-1 (in each value of
    `by`)."""
    return place_in_class(rows, seed, by).withColumn(out, F.pmod(F.col("_p") - 1, F.lit(k)).cast("int")).drop("_p")


def rows_of_split(rows: DataFrame, split: DataFrame, *names: str) -> DataFrame:
    """The rows of the named splits; ids without a row are dropped."""
    return rows.join(split.where(F.col("split").isin(*names)).select("sample_id"), "sample_id", "left_semi")
