"""The queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact, langid, lines, lm, mix, near, packing, pii, quality, sql, vectors
from .shared import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix": lambda spark, d: mix.mix_counts(read(spark, d, "documents")),
    "op2_embedding_dedup": lambda spark, d: vectors.near_vectors(read(spark, d, "embeddings")),
    "op3_pack": lambda spark, d: packing.packed_digests(packing.pack(read(spark, d, "documents"))),
    "op4_line_dedup": lambda spark, d: lines.dedup_lines(read(spark, d, "documents")),
    "op5_quality": lambda spark, d: quality.quality_scores(read(spark, d, "documents"), read(spark, d, "labels")),
    "op6_language": lambda spark, d: langid.languages(read(spark, d, "documents")),
    "op7_lm_score": lambda spark, d: lm.lm_scores(read(spark, d, "documents")),
    "op8_exact_dedup": lambda spark, d: exact.exact_groups(read(spark, d, "documents")),
    "op9_near_dedup": lambda spark, d: near.near_duplicates(read(spark, d, "documents")),
    "op10_pii": lambda spark, d: pii.span_digests(pii.personal_data(read(spark, d, "documents"))),
}

ORACLE_SQL: dict[str, str] = {"op1_mix": sql.MIX, "op4_line_dedup": sql.LINES, "op8_exact_dedup": sql.EXACT}
