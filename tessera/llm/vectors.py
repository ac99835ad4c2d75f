"""Near-duplicate embeddings by iterative quantisation and multi-index Hamming tables.

Unit vectors are centred, projected on their principal directions and rotated so that signs make balanced
binary codes of little quantisation error (ITQ). Codes are split into CHUNKS chunks. Two codes within RADIUS
bits differ by at most FLIPS = 2 bits in some chunk (pigeonhole); each side enumerates its chunk with up to one
bit flipped, so such a pair meets in a table, and is taken where it meets first. Pairs within RADIUS are reranked by the cosine of the
original vectors in double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import cut

BITS, CHUNKS, FLIPS = 64, 5, 2
#: Codes within this many bits always meet: CHUNKS * (FLIPS + 1) - 1.
RADIUS = CHUNKS * (FLIPS + 1) - 1
COSINE = 0.93
#: The rotation is fitted on at most so many vectors per dimension.
SAMPLE, ROUNDS = 4000, 30


def fit_itq(x: np.ndarray, bits: int = BITS, rounds: int = ROUNDS, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection (dimensions x bits). With fewer dimensions than bits, several rotations side by side."""
    mean = x.mean(axis=0)
    values, vectors = np.linalg.eigh(np.cov((x - mean).T).reshape(x.shape[1], x.shape[1]) if len(x) > 1 else np.eye(x.shape[1]))
    principal = vectors[:, ::-1]
    rng, parts, left = np.random.default_rng(seed), [], bits
    while left > 0:
        k = min(left, x.shape[1])
        basis = principal[:, :k]
        v = (x - mean) @ basis
        rotation = np.linalg.qr(rng.normal(size=(k, k)))[0]
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(v @ rotation >= 0, 1.0, -1.0).T @ v)
            rotation = (u @ w).T
        parts.append(basis @ rotation)
        left -= k
    return mean, np.concatenate(parts, axis=1)


def _coder(shared):
    def run(batches):
        models = shared.value
        for batch in batches:
            lists = batch.column(1).to_numpy(zero_copy_only=False)
            codes = np.zeros(batch.num_rows, np.int64)
            dims = np.array([len(v) for v in lists])
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                x = np.stack([lists[i] for i in at]).astype(np.float64)
                x /= np.sqrt((x**2).sum(axis=1, keepdims=True))
                mean, projection = models[int(d)]
                codes[at] = np.packbits((x - mean) @ projection >= 0, axis=1).view(">u8").astype(np.uint64).view(np.int64).reshape(-1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes)], names=["rep", "code"])

    return run


EDGES = [round(i * BITS / CHUNKS) for i in range(CHUNKS + 1)]


def chunk_keys(code: Column) -> Column:
    """key and mask for every chunk of a code, as it is and with each bit flipped; the chunk's number is part of the key."""
    keys = []
    for i, (a, b) in enumerate(zip(EDGES, EDGES[1:], strict=False)):
        masks = F.array([F.lit(m) for m in [0, *(1 << k for k in range(b - a))]]).cast("array<bigint>")
        value = F.shiftrightunsigned(code, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).bitwiseOR(F.lit(i << 32))
        keys.append(F.transform(masks, _flipped(value)))
    return F.flatten(F.array(*keys))


def _flipped(value: Column):
    return lambda m: F.struct(value.bitwiseXOR(m).alias("key"), m.alias("mask"))


def first_meeting(differ: Column, key: Column, left: Column, right: Column) -> Column:
    """Of the ways two codes meet, holds for one: in the first chunk that may, with the fewest flips, the left one's lower."""
    fewest = (right == 0) | ((left != 0) & (left < right))
    chunk = F.shiftright(key, 32)
    for i, (a, b) in enumerate(zip(EDGES[:-2], EDGES[1:], strict=False)):
        fewest &= (chunk <= i) | (F.bit_count(F.shiftrightunsigned(differ, a).bitwiseAND(F.lit((1 << (b - a)) - 1))) > FLIPS)
    return fewest


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE) -> DataFrame:
    """One row per row: id, n_links (other rows linked directly), component_id (smallest id reachable), kept.

    Rows are compared only where labels are equal and not null and vectors equally long. Null, empty or zero
    vectors and those with null or non-finite components link with nothing, nor do rows with a null id. Equal
    vectors of a label are one while pairs are searched, and count each in n_links. Rows that share an id count
    as rows of their own in n_links and share a component. An empty table gives an empty result; other columns
    are ignored.
    """
    spark = rows.sparkSession
    base = rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    # Scaled by the largest component, so that squares neither overflow nor vanish.
    largest = F.aggregate("v", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.coalesce(finite, F.lit(False)) & (largest > 0)
    usable = base.where(valid)
    groups = cut(usable.groupBy("label", "v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    scaled = groups.select("label", "rep", "copies", F.transform("v", lambda x: x / largest).alias("v")).withColumn("d", F.size("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    # A rep names a vector: rows that share an id but not a vector need a number of their own.
    unit = cut(scaled.withColumn("unit", F.transform("v", lambda x: x / length)).withColumn("rep", F.col("rep").cast("long")).withColumn("node", F.struct("rep", F.xxhash64("label", "v").alias("h"))).drop("v"))
    models = {}
    for r in unit.groupBy("d").count().collect():  # a row for each number of dimensions
        some = unit.where(F.col("d") == r.d).orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("unit").collect()
        models[r.d] = fit_itq(np.array([x.unit for x in some]))
    shared = spark.sparkContext.broadcast(models)
    both = unit.select(F.struct("node", "label", "d", "copies").alias("rep"), "unit")
    kind = both.schema["rep"].dataType.simpleString()
    coded = cut(both.mapInArrow(_coder(shared), f"rep {kind}, code long").select("rep.*", "code"))
    keyed = coded.select("label", "d", "node", "code", F.explode(chunk_keys(F.col("code"))).alias("k")).select("label", "d", "node", "code", "k.key", "k.mask")
    left = keyed.select("label", "d", "key", F.col("node").alias("a"), F.col("code").alias("ca"), F.col("mask").alias("ma"))
    right = keyed.select(F.col("label").alias("l2"), F.col("d").alias("d2"), F.col("key").alias("key2"), F.col("node").alias("b"), F.col("code").alias("cb"), F.col("mask").alias("mb"))
    differ = F.col("ca").bitwiseXOR(F.col("cb"))
    on = (F.col("key") == F.col("key2")) & (F.col("label") == F.col("l2")) & (F.col("d") == F.col("d2")) & (F.col("a") < F.col("b"))
    on &= (F.bit_count(differ) <= RADIUS) & first_meeting(differ, F.col("key"), F.col("ma"), F.col("mb"))
    pairs = left.hint("merge").join(right, on).select("a", "b")
    ends = [unit.select(F.col("node").alias(x), F.col("unit").alias(f"u{x}"), F.col("copies").alias(f"n{x}")) for x in "ab"]
    dot = F.aggregate(F.zip_with("ua", "ub", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    links = cut(pairs.join(ends[0].hint("merge"), "a").join(ends[1].hint("merge"), "b").where(dot >= cosine).select("a", "b", "na", "nb"))
    others = links.select(F.col("a").alias("node"), F.col("nb").alias("n")).unionByName(links.select(F.col("b").alias("node"), F.col("na").alias("n")))
    others = others.groupBy("node").agg(F.sum("n").alias("n"))
    found = components(links.select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b")))
    counted = unit.select("node", "copies").join(others, "node", "left").select(F.col("node.rep").alias("rep"), F.col("node.h").alias("h"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("links"))
    named = cut(counted.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("rep", "h", "links", F.coalesce("component", "rep").alias("component")))
    hashed = groups.select("label", "v", F.col("rep").cast("long").alias("rep"), F.xxhash64("label", F.transform("v", lambda x: x / largest)).alias("h"))
    of_vectors = cut(hashed.join(named, ["rep", "h"]).select("label", "v", "links", "component"))
    joined = usable.join(of_vectors.hint("merge"), ["label", "v"]).select("id", "links", "component")
    rest = base.where(~F.coalesce(valid, F.lit(False))).select("id", F.lit(0).cast("long").alias("links"), F.col("id").cast("long").alias("component"))
    out = joined.unionByName(rest)
    return out.select(F.col("id").alias(id_col), F.col("links").cast("long").alias("n_links"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))
