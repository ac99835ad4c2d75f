"""Line deduplication over content-defined chunks (native: DataFrame functions only).

A rolling hash over the hashes of the last two lines chooses chunk ends, so a boundary depends on the lines
around it and not on their place: an inserted line shifts no boundary further on. A text is chunked DIVISOR
times side by side: in chunking r, chunks end where the rolling hash is r modulo DIVISOR. Every place is thus an
end in one of them, and a repeated passage of a few lines is more likely to hold a whole chunk. Multi-line
chunks that occur more than once anywhere are removed but for their first occurrence, after comparing their
bytes; a line goes where any of its chunks goes. Each removal leaves equal lines at an earlier place, so no line
is lost altogether.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, salted, sweep

#: Chunk ends of chunking r: after a line where (h[i] + 31 h[i-1]) mod DIVISOR = r; h: the first 32 bits of a line's MD5.
DIVISOR = 3
MULTIPLIER = 31
#: Chunks of fewer lines are never removed.
MIN_LINES = 2


def line_chunks(lines: Column, divisor: int = DIVISOR) -> Column:
    """Array of (chunking, first line, lines, text) of the chunks of all chunkings; the last chunk of each ends with the text."""
    hashes = F.transform(lines, lambda x: F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long"))
    both = F.struct(lines.alias("l"), hashes.alias("h"))

    def chunks(b: Column) -> Column:
        n = F.size(b["l"])
        residues = F.transform(b["h"], lambda h, i: F.when(i > 0, (h + MULTIPLIER * F.get(b["h"], i - 1)) % divisor))
        return F.flatten(F.transform(F.array(residues), lambda r: F.flatten(F.array(*[one(b, r, n, c) for c in range(divisor)]))))

    def ends(r: Column, n: Column, c: int) -> Column:
        return F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == n - 1) | F.coalesce(F.get(r, i) == c, F.lit(False)))

    def one(b: Column, r: Column, n: Column, c: int) -> Column:
        return F.transform(F.array(ends(r, n, c)), lambda e: of(b, e, c))[0]

    def of(b: Column, e: Column, c: int) -> Column:
        first = lambda k: F.coalesce(F.get(e, k - 1), F.lit(-1)) + 1
        return F.transform(e, lambda end, k: F.struct(F.lit(c).alias("r"), first(k).alias("first"), (end - first(k) + 1).alias("n"), F.array_join(F.slice(b["l"], first(k) + 1, end - first(k) + 1), "\n").alias("chunk")))

    return F.transform(F.array(both), chunks)[0]


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", divisor: int = DIVISOR,
                min_lines: int = MIN_LINES, digest: Callable[[Column], Column] = F.md5) -> DataFrame:
    """One row per row of docs: id, text without repeated chunks, n_lines, n_chunks, removed_chunks, removed_lines.

    Chunks are counted over all chunkings. The first occurrence by (id, first line) stays, nulls first. Null
    text counts as empty and comes back empty. Rows that repeat one id and one text count as one occurrence and
    come out alike. A text all of whose lines repeat earlier chunks becomes empty. An empty table gives an empty
    result; other columns are ignored. Any digest of chunks gives the same result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = rows.withColumn("digest", F.md5("t")).withColumn("lines", F.split("t", "\n", -1))
    some = rows.where(F.size("lines") >= min_lines)
    occ = some.select("id", "digest", F.explode(line_chunks(F.col("lines"), divisor)).alias("c")).where(F.col("c.n") >= min_lines)
    occ = occ.select("id", "digest", "c.r", "c.first", "c.n", digest(F.col("c.chunk")).alias("h"))
    # Only hashes travel until one is seen in two places; then each text comes to its candidates once.
    places = occ.groupBy("h").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    repeated = cut(places)
    again = salted(occ, repeated, "h", "times", F.xxhash64("id", "digest"))
    again = again.groupBy("id", "digest").agg(F.collect_set(F.struct("r", "first", "n", "h")).alias("cs"))
    # A text is smaller than its lines while it travels.
    met = rows.select("id", "digest", "t").alias("r").join(again.hint("merge").alias("g"), F.expr("r.id <=> g.id and r.digest = g.digest"))
    met = met.select("r.id", "r.digest", F.split("t", "\n", -1).alias("lines"), F.explode("cs").alias("c"))
    seen = cut(met.select("id", "digest", "c.r", "c.first", "c.n", "c.h", F.array_join(F.slice("lines", F.col("c.first") + 1, F.col("c.n")), "\n").alias("chunk")))
    sweep(docs.sparkSession)
    here = F.struct("id", "digest", "first")
    # Grouping by the chunk itself is the byte comparison: a hash of one content settles the rest without the text.
    contents = seen.groupBy("h", "chunk").agg(F.min(here).alias("least"), F.count(F.lit(1)).alias("times"))
    by_hash = cut(contents.groupBy("h").agg(F.min("least").alias("least"), F.sum("times").alias("times"), F.count(F.lit(1)).alias("contents")))
    sure = salted(seen.drop("chunk"), by_hash.where("contents = 1 and times > 1"), "h", "times", F.xxhash64("id", "digest"))
    gone = sure.where(~here.eqNullSafe(F.col("least"))).select("id", "digest", "r", "first", "n")
    if not by_hash.where("contents > 1").isEmpty():
        clashing = seen.join(by_hash.where("contents > 1").select("h"), "h", "left_semi")
        apart = clashing.join(clashing.groupBy("h", "chunk").agg(F.min(here).alias("least")), ["h", "chunk"])
        gone = gone.unionByName(apart.where(~here.eqNullSafe(F.col("least"))).select("id", "digest", "r", "first", "n"))
    gone = cut(gone.groupBy("id", "digest").agg(F.collect_set(F.struct("r", "first", "n")).alias("spans")))
    sweep(docs.sparkSession)
    joined = rows.select("id", "digest", "t").alias("r").join(gone.hint("merge").alias("g"), F.expr("r.id <=> g.id and r.digest = g.digest"), "left")
    none = F.array().cast("array<struct<r:int,first:int,n:int>>")
    joined = joined.select("r.id", F.split("t", "\n", -1).alias("lines"), F.coalesce("spans", none).alias("spans"))
    removed = F.flatten(F.transform("spans", lambda s: F.sequence(s["first"], s["first"] + s["n"] - 1)))
    joined = joined.withColumn("left", F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), removed))
    return joined.select(
        F.col("id").alias(id_col),
        F.array_join(F.transform("left", lambda i: F.get("lines", i)), "\n").alias(text_col),
        F.size("lines").cast("long").alias("n_lines"),
        _count(F.col("lines"), divisor).alias("n_chunks"),
        F.size("spans").cast("long").alias("removed_chunks"),
        (F.size("lines") - F.size("left")).cast("long").alias("removed_lines"),
    )


def _count(lines: Column, divisor: int) -> Column:
    """Chunks of all chunkings: one for each, and one more for each end before the last line."""
    return (F.greatest(F.size(lines) - 2, F.lit(0)) + divisor).cast("long")
