"""Mixing sources to target weights by systematic sampling.

Each document of a source expects target / source_size copies. The prefix sum of these, plus one random offset
per source, crosses integers; a document comes out once for each integer it crosses. Documents are ordered by
size first, which makes the sample systematic over sizes too, so the words taken stay within about one document
of the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, cut, packed

#: Hashed bins within a size class. The ranks of a hot source are computed over its classes and bins in parallel.
BINS = 64
#: Leading bits of a size that name its class, beside its bit length.
LEADING = 5
#: A source's words come at most so many times.
MOST = 3


def uniform(text: Column) -> Column:
    """A number in [0, 1) that depends on the text alone, so that reruns agree."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def source_targets(sizes: DataFrame, most: int = MOST, cycle: int = 3) -> DataFrame:
    """source, source_size, target for a table of (source, size).

    Sources weigh 1, 2, ..., cycle, repeating by code point, null last. Targets share the sum of all sizes
    by weight; those over most * source_size stop there and the rest is shared again, until none is above.
    In closed form, target = min(cap, weight * level), where level is the first that its own order allows.
    A task holds a row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("weight", (F.row_number().over(order) - 1) % cycle + 1)
    per = per.withColumn("cap", F.col("source_size") * most)
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "weight", F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy(F.lit(1))
    below = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    per = per.withColumn("total", F.sum("source_size").over(all_rows))
    per = per.withColumn(
        "level", (F.col("total") - F.coalesce(F.sum("cap").over(below), F.lit(0))) / F.sum("weight").over(rest)
    )
    fits = F.col("level") <= F.col("cap") / F.col("weight")
    per = per.withColumn("final", F.max(F.when(fits, F.col("level"))).over(all_rows))
    share = F.coalesce(F.col("final") * F.col("weight"), F.col("cap").cast("double"))
    return per.select("source", "source_size", F.least(F.col("cap").cast("double"), share).alias("target"))


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, bins: int, seed: str, *more: Column) -> DataFrame:
    """id, source, size, the source as a name that is never null, size class and bin of each row, and more."""
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        *more,
    )
    bits = F.bin("size")
    key = F.coalesce(F.col("id").cast("string"), F.lit(""))
    return rows.withColumns({
        "name": F.coalesce(F.concat(F.lit("="), "source"), F.lit("")),
        # Size class: the number's bit length and its leading bits.
        "class": F.concat(F.lpad(F.length(bits).cast("string"), 2, "0"), F.substring(bits, 1, LEADING)),
        "bin": F.floor(uniform(F.concat(F.lit(f"{seed}:bin:"), key)) * bins),
    })


def _crossed(rows: DataFrame, counted: DataFrame, seed: str, *ties: Column) -> DataFrame:
    """rows with source_size, target and copies; counted has (at least) the source, name, class, bin and size of the same rows."""
    per = cut(counted.groupBy("source", "name", "class", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")))
    before = Window.partitionBy("name").orderBy("class", "bin").rowsBetween(Window.unboundedPreceding, -1)
    per_bin = per.select("name", "class", "bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    targets = source_targets(per).select(
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("name"), "source_size", "target",
        uniform(F.concat(F.lit(f"{seed}:offset:"), F.coalesce("source", F.lit("")))).alias("offset"))
    of_bin = cut(per_bin.join(targets, "name"))
    within = Window.partitionBy("name", "class", "bin").orderBy("size", "id", *ties)
    # The join's keys are the window's, so ranked rows stay where they are.
    placed = rows.withColumn("at", F.row_number().over(within)).join(of_bin.hint("merge"), ["name", "class", "bin"])
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    crossed = lambda rank: F.floor(rank * ratio + F.col("offset"))
    rank = F.col("before") + F.col("at")
    return placed.withColumn("copies", crossed(rank) - crossed(rank - 1))


def mix_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
               bins: int = BINS, seed: str = "mix") -> DataFrame:
    """One row per row of docs: id, source, size, source_size, target, copies, taken.

    size: words of the text (null or empty: 0). A source of size 0 has target 0 and takes nothing. Null is a
    source of its own. Rows with equal ids, sizes and sources tie; which of them is taken is then immaterial,
    as they take equal words. An empty table gives an empty result; other columns are ignored.
    """
    rows = cut(_keyed(docs, id_col, text_col, source_col, bins, seed))
    out = _crossed(rows, rows, seed).withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))
    return out.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "copies", "taken")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        bins: int = BINS, seed: str = "mix") -> DataFrame:
    """The rows of docs with their columns, whatever their names, each as often as the mix takes it.

    mix_counts() says how often. Rows that tie on id, size and source are told apart by their text; wholly equal
    rows are interchangeable. A null or empty text has no words, expects as many copies as any row of its
    source and takes no words. An empty table gives an empty result.
    """
    digest = F.md5(F.coalesce(F.col(text_col), F.lit("")))
    rows = _keyed(docs, id_col, text_col, source_col, bins, seed, packed(docs), digest.alias("digest"))
    out = _crossed(rows, _keyed(docs, id_col, text_col, source_col, bins, seed), seed, F.col("digest"))
    return out.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
