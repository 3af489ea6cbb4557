"""The registered queries of this subpackage: opN_<name>(spark, sf_dir), each over
its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe_codec import op1_bpe_codec
from .collocations import SQL as COLLOCATIONS_SQL
from .collocations import op12_tiled_collocations
from .exact_dedup import exact_duplicates
from .langid import op10_lattice_langid
from .lattice_lm import op8_lattice_lm
from .manifest import SQL as MANIFEST_SQL
from .manifest import op11_veb_merkle_manifest
from .mixing import mix_plan
from .pii import op4_weak_supervision_pii
from .quality_rank import op2_pairwise_quality
from .rules_forest import op9_rules_isolation_forest
from .simhash import op5_golay_simhash
from .token_counts import op3_prefix_token_counts
from .url_filter import op13_path_template_filter


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op6_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix_plan(_documents(spark, sf_dir))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "copies", "part_words")


def op7_chunk_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe_codec": op1_bpe_codec,
    "op2_pairwise_quality": op2_pairwise_quality,
    "op3_prefix_token_counts": op3_prefix_token_counts,
    "op4_weak_supervision_pii": op4_weak_supervision_pii,
    "op5_golay_simhash": op5_golay_simhash,
    "op6_pivotal_mixing": op6_pivotal_mixing,
    "op7_chunk_exact_dedup": op7_chunk_exact_dedup,
    "op8_lattice_lm": op8_lattice_lm,
    "op9_rules_isolation_forest": op9_rules_isolation_forest,
    "op10_lattice_langid": op10_lattice_langid,
    "op11_veb_merkle_manifest": op11_veb_merkle_manifest,
    "op12_tiled_collocations": op12_tiled_collocations,
    "op13_path_template_filter": op13_path_template_filter,
}

ORACLE_SQL: dict[str, str] = {
    "op11_veb_merkle_manifest": MANIFEST_SQL,
    "op12_tiled_collocations": COLLOCATIONS_SQL,
    "op7_chunk_exact_dedup": """
        WITH t AS (
          SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS n
          FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(n) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY n)""",
}
