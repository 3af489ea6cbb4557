"""A corpus pipeline of five stages, each applying one operator of vecdrift.llm.

A stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.
All but the last return the columns of documents; the last adds to them the
token ids and the bytes that they decode to.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from vecdrift.llm.bpe_codec import encode_decode
from vecdrift.llm.common import Scratch, materialize
from vecdrift.llm.exact_dedup import drop_exact_duplicates
from vecdrift.llm.mixing import mix
from vecdrift.llm.quality_rank import keep_good
from vecdrift.llm.simhash import drop_near_duplicates


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_scratch: list[Scratch] = []


def stage(work: Stage) -> Stage:
    """When a stage begins, its predecessor's result is written: the tables that
    the predecessor worked with are deleted."""

    @wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _scratch:
            _scratch.pop().close()
        own = Scratch(spark)
        with own.open():
            out = work(spark, docs, sf_dir)
        _scratch.append(own)
        return out

    return run_stage


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise quality score accepts."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@stage
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the largest doc_id stays."""
    return drop_exact_duplicates(docs)


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose sets of five-word shingles have a similarity of 0.8
    or more, linked over any number of steps, the least doc_id stays."""
    return drop_near_duplicates(docs, k=5, similarity=0.8)


@stage
def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of the sources take them."""
    return mix(docs)


@stage
def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with `ids` and `decoded`."""
    return encode_decode(docs)


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("source_mixing", source_mixing),
    ("tokenize", tokenize),
]

#: The quality stage learns a model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, apply) in enumerate(STAGES):
        docs = apply(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
