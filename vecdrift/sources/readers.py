"""Readers. A missing or empty source and torn lines have defined results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BANK_COLUMNS = ("layer", "pattern_id", "m_hat", "row_norm")
META_SCHEMA = "sample_id string, source string, category string, question string, gold_answers array<string>, generated_text string, n_prompt_tokens int, n_tokens_generated int, beta_star double, bank_id string, failed boolean, error string"
LABEL_SCHEMA = "sample_id string, is_hallucination int, judge_raw_response string, judge_model string, judge_prompt_sha256 string, labelled_at double"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whatever store it names."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def _stripped(answers: Column) -> Column:
    return F.filter(F.transform(answers, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))


def best_and_correct(rows: DataFrame, name: str = "truthfulqa") -> DataFrame:
    """rows: idx (the row's place in the source), question, best_answer,
    correct_answers, category. The best answer comes first unless it is among
    the correct ones; rows without an answer go; blank categories are null."""
    gold, best = _stripped(F.coalesce("correct_answers", F.array().cast("array<string>"))), F.trim(F.coalesce("best_answer", F.lit("")))
    rows = rows.withColumn("_g", gold).withColumn("_b", best)
    rows = rows.withColumn("gold_answers", F.when((F.col("_b") != "") & ~F.array_contains("_g", F.col("_b")), F.concat(F.array("_b"), "_g")).otherwise(F.col("_g")))
    return rows.where(F.size("gold_answers") > 0).select(F.concat(F.lit(f"{name}_"), F.col("idx").cast("string")).alias("sample_id"), "question", "gold_answers", F.nullif(F.trim("category"), F.lit("")).alias("category"), F.lit(name).alias("source"))


def aliases(rows: DataFrame, name: str = "triviaqa") -> DataFrame:
    """rows: idx, question, answer (struct with aliases). Rows without a
    non-blank alias go; there is no category."""
    rows = rows.withColumn("gold_answers", _stripped(F.coalesce("answer.aliases", F.array().cast("array<string>"))))
    return rows.where(F.size("gold_answers") > 0).select(F.concat(F.lit(f"{name}_"), F.col("idx").cast("string")).alias("sample_id"), "question", "gold_answers", F.lit(None).cast("string").alias("category"), F.lit(name).alias("source"))


ADAPTERS: dict[str, Callable[[DataFrame], DataFrame]] = {"truthfulqa": best_and_correct, "triviaqa": aliases}


def load_samples(rows: DataFrame, name: str, num_samples: int | None = None, seed: int = 42) -> DataFrame:
    """Samples by the adapter of that name, perhaps a seeded subset."""
    from ..operators.selection import subsample

    if name not in ADAPTERS:
        raise ValueError(f"unknown dataset {name!r}; known: {', '.join(sorted(ADAPTERS))}")
    return subsample(ADAPTERS[name](rows), num_samples, seed)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank and torn lines are left out, a missing file is empty."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return _parsed(spark.read.text(path).where("trim(value) <> ''"), schema)


def _parsed(rows: DataFrame, schema: str) -> DataFrame:
    """rows: value (JSON) and others. The fields of those that parse."""
    one = F.from_json("value", f"{schema}, _torn string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_torn"})
    rows = rows.withColumn("_j", one).where("_j is not null and _j._torn is null")
    return rows.select(*[c for c in rows.columns if c not in ("value", "_j")], "_j.*").drop("_torn")


def read_metadata(spark: SparkSession, path: str, schema: str = META_SCHEMA) -> DataFrame:
    """One JSON file per sample; a sample is complete if its file parses. Its id
    comes from the file name."""
    rows = spark.read.option("wholetext", True).text(path).withColumn("_file", F.input_file_name())
    return _parsed(rows, schema).withColumn("sample_id", F.regexp_extract("_file", r"([^/]+)\.json$", 1)).drop("_file")


def complete_ids(spark: SparkSession, path: str) -> DataFrame:
    return read_metadata(spark, path).select("sample_id").distinct()


def read_bank(spark: SparkSession, path: str) -> DataFrame:
    bank = spark.read.parquet(path)
    missing = [c for c in BANK_COLUMNS if c not in bank.columns]
    if missing:
        raise ValueError(f"bank lacks {', '.join(missing)}")
    return bank


def read_trajectories(spark: SparkSession, path: str, metadata: str | None = None) -> DataFrame:
    """Trajectory rows; with a metadata path, those of complete samples."""
    rows = spark.read.parquet(path)
    return rows if metadata is None else rows.join(complete_ids(spark, metadata), "sample_id", "left_semi")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Verdicts that are not null, as int."""
    return read_jsonl(spark, path, LABEL_SCHEMA).where("is_hallucination is not null").select("sample_id", F.col("is_hallucination").cast("int").alias("is_hallucination"))


def read_human_labels(spark: SparkSession, path: str) -> DataFrame:
    """Rows whose trimmed human_label is 0 or 1, as int."""
    rows = spark.read.schema("sample_id string, human_label string").option("header", True).csv(path)
    return rows.where(F.trim("human_label").isin("0", "1")).select("sample_id", F.trim("human_label").cast("int").alias("human_label"))


def read_features(spark: SparkSession, path: str, label: str = "is_hallucination") -> DataFrame:
    """Labelled rows of a feature table (parquet, or CSV with a header)."""
    rows = spark.read.option("header", True).option("inferSchema", True).csv(path) if path.rstrip("/").endswith(".csv") else spark.read.parquet(path)
    return rows.dropna(subset=[label])


def read_score_cache(spark: SparkSession, path: str) -> DataFrame:
    if not exists(spark, path):
        raise ValueError(f"no score cache at {path}")
    rows = spark.read.parquet(path)
    if rows.isEmpty():
        raise ValueError(f"the score cache at {path} is empty")
    return rows


def override_labels(rows: DataFrame, labels_json: str, label: str = "is_hallucination") -> DataFrame:
    """Labels from one JSON object {id: label}; other rows get null."""
    spark = rows.sparkSession
    one = spark.createDataFrame([(labels_json,)], "j string").select(F.explode(F.from_json("j", "map<string,int>")).alias("sample_id", label))
    return rows.drop(label).join(one, "sample_id", "left")
