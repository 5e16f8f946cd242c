"""The queries of this subpackage, one for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarryline.llm import sql
from quarryline.llm.ann import search_every
from quarryline.llm.audit import audit
from quarryline.llm.bpe import encode_digest
from quarryline.llm.codes import compress
from quarryline.llm.common import table
from quarryline.llm.dart import near_classes
from quarryline.llm.fingerprint import fingerprint
from quarryline.llm.linededup import removed_lines
from quarryline.llm.mtree import search_every as top_every
from quarryline.llm.packing import pack
from quarryline.llm.quality import score as quality_score
from quarryline.llm.sharding import shard
from quarryline.llm.sitetree import extract
from quarryline.llm.toxicity import score as toxicity_score


def op1_one_permutation_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint(table(spark, sf_dir, "documents"))


def op2_rotated_one_bit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_every(table(spark, sf_dir, "embeddings"))


def op3_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_lines(table(spark, sf_dir, "documents"))


def op5_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_dart_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))


def op8_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digest(table(spark, sf_dir, "documents"))


def op9_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op10_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_mtree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_every(table(spark, sf_dir, "embeddings"))


def op13_ball_tree_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))


_ALL = (
    op1_one_permutation_minhash, op2_rotated_one_bit_codes, op3_minimax_shards, op4_line_dedup, op5_compression_quality, op6_weak_toxicity, op7_dart_near_duplicates, op8_chunked_bpe, op9_site_style_tree, op10_pattern_packing,
    op11_filter_audit, op12_mtree_top_k, op13_ball_tree_codes,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    """Of the queries that SQL can express; the others are held against other implementations in tests/llm."""
    return {"op11_filter_audit": sql.FILTER_AUDIT, "op12_mtree_top_k": sql.TOP_K, "op13_ball_tree_codes": sql.CODES}
