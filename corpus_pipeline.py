"""A corpus pipeline: filter by quality, drop exact and near copies, mix sources to target weights, pack.

Every stage reads all rows that its predecessor kept, written as Parquet to the folder that driver and
executors share, and returns a DataFrame; all but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import exact, mix, near, packing, quality
from tessera.llm.shared import cut, read, release, scratch

#: Near copies share 80 of 100 word shingles; 28 of 64 minima miss a pair of that similarity about 4 times in 10^6.
SIMILARITY, DISTANCE = 80, 28


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.3 or more."""
    return quality.keep_quality(docs, read(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id."""
    return exact.unique_rows(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the row with the smallest doc_id."""
    return near.distinct_rows(docs, similarity=SIMILARITY, distance=DISTANCE)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix of sources takes it."""
    return mix.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences, as op3_pack returns them."""
    return packing.packed_digests(packing.pack(docs))


STAGES = [
    ("quality", quality_filter),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix", source_mix),
    ("pack", pack),
]

#: SQL can't fit the classifier, find near duplicates or plan sequences.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the last stage; what the stages before it wrote on the way is deleted as soon as it is used up."""
    docs = before = None
    for _, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            docs = cut(stage(spark, read(spark, sf_dir, "documents") if docs is None else docs, sf_dir))
            keep.append(docs)
        if before is not None:
            release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
