"""Exact deduplication by skew-safe combining (native: DataFrame functions only).

Copies are combined three times: inside each input partition, then over salted digest groups, then
over the winners of the salts. Every stage groups by the digest and the whole normalised text, so
equality always means equal content and a digest alone never decides. A group of any size reaches
the last stage as at most SALTS rows, and rows of a hot group are told its winner in SALTS tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, lower_ascii, packed, salted, sweep

#: Salts per digest. The salt comes from the input partition, so a text's local winners spread over this many tasks.
SALTS = 16


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS,
                 digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty. Texts are equal when identical after lower-casing A-Z. The largest id of
    a group stays; a null id never stays beside a real one. Rows that repeat one id and one text can't be
    told apart and all bear kept = true (unique_rows() leaves one). An empty table gives an empty result.
    Other columns are ignored, whatever their names. Any digest gives the same groups.
    """
    norm = lower_ascii(F.coalesce(F.col(text_col), F.lit("")))
    base = docs.select(F.col(id_col).alias("_id"), norm.alias("_norm"))
    base = base.withColumn("_key", digest(F.col("_norm")))
    parts = base.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    # The partial half of this aggregation is the local stage; the exchange carries a row per text and partition.
    second = parts.groupBy("_key", "_norm", "_salt").agg(F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
    third = second.groupBy("_key", "_norm").agg(F.max("_keep").alias("_keep"), F.sum("_n").alias("_n"))
    # A digest with two contents needs its text to tell rows apart; any other is settled by the digest.
    by_digest = third.groupBy("_key").agg(
        F.max("_keep").alias("_keep"), F.sum("_n").alias("_n"), F.count(F.lit(1)).alias("_texts")
    )
    groups = cut(by_digest)
    sha = F.col("_key") if digest is sha256 else F.sha2("_norm", 256)
    rows = base.select("_id", "_key", sha.alias("_sha"))
    out = salted(rows, groups.where("_texts = 1"), "_key", "_n", F.col("_id")).select("_id", "_sha", "_keep", "_n")
    if not groups.where("_texts > 1").isEmpty():
        clashing = groups.where("_texts > 1").select("_key")
        winners = third.join(clashing, "_key", "left_semi")
        apart = base.join(clashing, "_key", "left_semi").join(winners, ["_key", "_norm"])
        out = out.unionByName(apart.select("_id", F.sha2("_norm", 256).alias("_sha"), "_keep", "_n"))
    return out.select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_n").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def unique_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns, whatever their names.

    Of equal texts the row with the largest id stays; of rows that repeat a staying id and text one stays.
    Nulls and empty tables as in exact_groups().
    """
    groups = exact_groups(docs, id_col, text_col)
    kept = groups.where("kept").groupBy(F.col(id_col).alias("id"), F.col("text_sha256").alias("sha")).agg(F.count(F.lit(1)).alias("n"))
    kept = cut(kept)
    sweep(docs.sparkSession)
    sha = F.sha2(lower_ascii(F.coalesce(F.col(text_col), F.lit(""))), 256)
    rows = docs.select(packed(docs), F.col(id_col).alias("id"), sha.alias("sha"))
    on = lambda some: rows["id"].eqNullSafe(some["id"]) & (rows["sha"] == some["sha"])
    if kept.where("n > 1").isEmpty():
        return rows.join(kept.hint("merge"), on(kept), "left_semi").select("row.*")
    once, repeated = kept.where("n = 1"), kept.where("n > 1")
    single = rows.join(once.hint("merge"), on(once), "left_semi")
    first = rows.join(repeated.hint("merge"), on(repeated), "left_semi").dropDuplicates(["id", "sha"])
    return single.unionByName(first).select("row.*")
