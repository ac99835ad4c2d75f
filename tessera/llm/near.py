"""MinHash near-duplicates by a multi-index Hamming join.

A document's signature holds HASHES minima of its shingle set, 16 bits each; the distance of two signatures
is the number of minima that differ. Sets with Jaccard similarity s differ in a share 1 - s of them on
average, so DISTANCE = 23 of 64 misses a pair of similarity 0.85 once in about 10^5 and higher ones less
often. The join itself is exact: the signature is split into CHUNKS chunks that are allowed e_1, ..., e_m
errors with sum(e_i + 1) = DISTANCE + 1, and two signatures within DISTANCE agree in some chunk up to its
errors. Each way to leave out e_i minima of chunk i is a key, so every such pair shares a key.

Documents with equal shingle sets meet first and only one of them goes on. A shingle that no other candidate
has can't be in an intersection, and each bit in which two sets' bitmaps differ is a shingle that only one of
them has; both bound a pair's similarity from above before its sets are fetched. In a bucket
all members are compared with its smallest member; where a bucket then still holds several components, the
pairs that lie across components and pass that bound are compared as well, each in the first bucket that it
shares, so no link between components is lost. Links are confirmed on the full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import cut, packed
from .text import Hasher, constants, mix64, slices

HASHES, DISTANCE, CHUNKS, WORDS = 64, 23, 16, 5
#: Longs of a set's bitmap.
BITMAP = 16
#: Links have 100 * intersection >= SIMILARITY * union.
SIMILARITY = 85


def shingle_sets(column: pa.Array, hasher: Hasher, words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; with fewer words the whole sequence is one shingle."""
    weights = constants(5, words)
    for lo, hi, data, offsets in slices(column):
        _, _, doc, h = hasher.words(data, offsets)
        counts = np.bincount(doc, minlength=hi - lo) if len(doc) else np.zeros(hi - lo, np.int64)
        bounds = np.concatenate([[0], np.cumsum(counts)])
        whole = sum((h[k : len(h) - words + 1 + k] * weights[k] for k in range(words)), np.zeros(max(0, len(h) - words + 1), np.uint64)) if len(h) >= words else h[:0]
        whole = mix64(whole)
        for i in range(hi - lo):
            a, b = bounds[i], bounds[i + 1]
            if b - a >= words:
                yield np.unique(whole[a : b - words + 1])
            elif b > a:
                yield mix64(np.array([(h[a:b] * weights[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64))
            else:
                yield h[:0]


def signatures(sets: list[np.ndarray], hashes: int = HASHES) -> np.ndarray:
    """uint16 minima, a row for each set; none may be empty."""
    times, plus = constants(7, hashes), constants(11, hashes)
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    least = np.stack([np.minimum.reduceat((flat ^ plus[k]) * times[k], starts) for k in range(hashes)], axis=1)
    return (mix64(least) >> np.uint64(48)).astype(np.uint16)


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """A bitmap of 64 * BITMAP bits for each set, as longs; a shingle's bit is given by its low bits."""
    bits = np.zeros((len(sets), 64 * BITMAP), bool)
    for row, s in zip(bits, sets, strict=True):
        row[s & np.uint64(64 * BITMAP - 1)] = True
    return np.packbits(bits, axis=1).view(np.int64)


def layout(hashes: int = HASHES, distance: int = DISTANCE, chunks: int = CHUNKS) -> list[tuple[list[int], int]]:
    """(minima of the chunk, errors allowed in it) of each chunk, by the pigeonhole principle."""
    each, more = divmod(distance + 1, chunks)
    if not each:
        raise ValueError("more chunks than the distance allows")
    errors = [each - 1 + (i < more) for i in range(chunks)]
    ends = np.rint(np.cumsum([e + 2 for e in errors]) * hashes / sum(e + 2 for e in errors)).astype(int)
    return [(list(range(a, b)), e) for a, b, e in zip([0, *ends[:-1]], ends, errors, strict=True)]


def keys_of(signs: np.ndarray, plan: list[tuple[list[int], int]]) -> np.ndarray:
    """int64 keys, a row for each signature: every way to leave out as many minima of a chunk as may differ."""
    weights = constants(13, signs.shape[1])
    wide, out = signs.astype(np.uint64) + np.uint64(1), []
    for i, (columns, errors) in enumerate(plan):
        for k, gone in enumerate(combinations(columns, errors)):
            rest = [c for c in columns if c not in gone]
            out.append(mix64((wide[:, rest] * weights[rest]).sum(axis=1, dtype=np.uint64) + np.uint64((i << 20) + k)))
    return np.stack(out, axis=1).view(np.int64)


def key_masks(plan: list[tuple[list[int], int]]) -> list[int]:
    """The minima that each key covers, as bits of a signed long placed as in difference()."""
    masks = []
    for columns, errors in plan:
        for gone in combinations(columns, errors):
            bits = sum(1 << (16 * (c % 4) + c // 4) for c in columns if c not in gone)
            masks.append(bits - (1 << 64) if bits >> 63 else bits)
    return masks


def difference(a: Column, b: Column) -> Column:
    """A long with a bit for each of the 64 minima, set where two signatures (16 longs of 4 minima) differ."""

    def lanes(x: Column) -> Column:
        for n in (8, 4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, n))
        return x.bitwiseAND(F.lit(0x0001000100010001))

    return reduce(lambda x, y: x.bitwiseOR(y), [F.shiftleft(lanes(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))), i) for i in range(HASHES // 4)])


def _sketch(words: int, hashes: int, full: bool):
    def run(batches):
        hasher = Hasher()
        for batch in batches:
            ids, size = batch.column(0), 0
            held: list[np.ndarray] = []
            at = 0
            for s in shingle_sets(batch.column(1), hasher, words):
                held.append(s)
                size += len(s)
                if size > 200_000:
                    yield emit(ids.slice(at, len(held)), held)
                    at, size, held = at + len(held), 0, []
            if held:
                yield emit(ids.slice(at, len(held)), held)

    def emit(ids, sets):
        n = pa.array([len(s) for s in sets], pa.int64())
        filled = [s for s in sets if len(s)]
        if full:
            flat = np.concatenate([*filled, np.zeros(0, np.uint64)]).view(np.int64)
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            return pa.RecordBatch.from_arrays([ids, n, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["id", "n", "shingles"])
        signs = iter(signatures(filled, hashes).view(np.int64)) if filled else iter(())
        bits = iter(bitmaps(filled))
        digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
        return pa.RecordBatch.from_arrays([ids, n, pa.array(digests, pa.binary()), pa.array([next(signs) if len(s) else None for s in sets], pa.list_(pa.int64())),
                                            pa.array([next(bits) if len(s) else None for s in sets], pa.list_(pa.int64()))], names=["id", "n", "digest", "sign", "bits"])

    return run


def _keys(distance: int, chunks: int):
    def run(batches):
        plan = layout(HASHES, distance, chunks)
        for batch in batches:
            if batch.num_rows:
                signs = np.stack(batch.column(1).to_numpy(zero_copy_only=False)).astype(np.int64).view(np.uint16)
                keys = keys_of(signs, plan)
                ids = np.repeat(batch.column(0).to_numpy(), keys.shape[1])
                which = np.tile(np.arange(keys.shape[1], dtype=np.int32), len(keys))
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(which), pa.array(ids)], names=["key", "which", "rep"])

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: int = SIMILARITY, words: int = WORDS,
                    distance: int = DISTANCE, chunks: int = CHUNKS) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id (smallest id reachable by links), kept (id = component_id).

    Words are lower-cased (A-Z) runs of anything but ASCII white space; sets hold 64-bit hashes of shingles. A
    null or wordless text has an empty set and is linked with nothing. Rows that share an id share its links.
    A null id joins the component of documents with its very set, and has none (null, kept) where there is no
    such document. An empty table gives an empty result; other columns are ignored.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = cut(texts.mapInArrow(_sketch(words, HASHES, False), "id long, n long, digest binary, sign array<long>, bits array<long>"))
    sets = cut(rows.where("n > 0").groupBy("digest").agg(F.min("id").alias("rep"), F.first(F.struct("sign", "bits")).alias("s")))
    sets = sets.select("digest", "rep", "s.sign", "s.bits")
    reps = sets.where("rep is not null").select("rep", "sign", "bits")
    keyed = reps.select("rep", "sign").mapInArrow(_keys(distance, chunks), "key long, which int, rep long")
    shared = cut(keyed.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("key"))
    met = cut(keyed.join(shared.hint("merge"), "key"))
    involved = cut(met.select(F.col("rep").alias("id")).distinct())
    full = cut(texts.join(involved, "id", "left_semi").mapInArrow(_sketch(words, HASHES, True), "id long, n long, shingles array<long>").where("n > 0"))

    # own: shingles that no other candidate has. Ids of several rows are never ruled out by it.
    single = full.select("id", F.explode("shingles").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("id")).where("c = 1")
    single = single.groupBy("id").agg(F.count(F.lit(1)).alias("own"))
    sizes = full.groupBy("id").agg(F.min("n").alias("n"), F.count(F.lit(1)).alias("c")).join(single, "id", "left")
    sizes = sizes.select(F.col("id").alias("rep"), F.when(F.col("c") == 1, F.col("n")).alias("n"), F.when(F.col("c") == 1, F.coalesce("own", F.lit(0))).alias("own"))
    hopeful = F.col("n").isNull() | (100 * (F.col("n") - F.col("own")) >= similarity * F.col("n"))
    sizes = cut(sizes.where(hopeful))

    def possible(x: str, y: str) -> Column:
        (nx, ox), (ny, oy) = ((F.col(f"n{k}"), F.col(f"own{k}")) for k in (x, y))
        bound = 100 * F.least(nx - ox, ny - oy) >= similarity * (ox + oy + F.greatest(nx - ox, ny - oy))
        return nx.isNull() | ny.isNull() | bound

    def alike() -> Column:
        """Whether the bitmaps of two sets of known size allow a link: |a + b - 2 ab| <= (100 - s) / (100 + s) * (|a| + |b|)."""
        odd = reduce(lambda x, y: x + y, [F.bit_count(F.get("ma", F.lit(i)).bitwiseXOR(F.get("mb", F.lit(i)))) for i in range(BITMAP)])
        return F.col("na").isNull() | F.col("nb").isNull() | (odd * (100 + similarity) <= (100 - similarity) * (F.col("na") + F.col("nb")))

    def confirmed(pairs: DataFrame) -> DataFrame:
        a = full.select(F.col("id").alias("a"), F.col("n").alias("fa"), F.col("shingles").alias("sa"))
        b = full.select(F.col("id").alias("b"), F.col("n").alias("fb"), F.col("shingles").alias("sb"))
        both = F.size(F.array_intersect("sa", "sb"))
        joined = pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b")
        return joined.where(100 * both >= similarity * (F.col("fa") + F.col("fb") - both)).select("a", "b").distinct()

    met = cut(met.join(sizes, "rep"), [met])
    pivots = cut(met.groupBy("key").agg(F.min(F.struct("rep", "n", "own")).alias("p"), F.max("rep").alias("hi")).where("p.rep < hi").select(
        "key", F.col("p.rep").alias("a"), F.col("p.n").alias("na"), F.col("p.own").alias("owna")))
    members = cut(met.join(pivots.hint("merge"), "key").withColumnsRenamed({"rep": "b", "n": "nb", "own": "ownb"}))
    stars = members.where((F.col("a") != F.col("b")) & possible("a", "b")).select("a", "b").distinct()
    links = cut(confirmed(cut(stars)))
    found = cut(components(links))
    # Buckets whose members don't form one component yet.
    named = cut(members.where("a <> b").select("key", "which", "b", "nb", "ownb").join(found.select(F.col("id").alias("b"), "component"), "b", "left").withColumn("c", F.coalesce("component", "b")).drop("component"))
    several = cut(named.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key"))
    rest = cut(named.join(several.hint("merge"), "key").join(reps.withColumnRenamed("rep", "b"), "b"))
    left = rest.select("key", "which", F.col("b").alias("a"), F.col("nb").alias("na"), F.col("ownb").alias("owna"), F.col("c").alias("ca"), F.col("sign").alias("ga"), F.col("bits").alias("ma"))
    right = rest.select(F.col("key").alias("key2"), "b", "nb", "ownb", F.col("c").alias("cb"), F.col("sign").alias("gb"), F.col("bits").alias("mb"))
    masks = F.array([F.lit(m) for m in key_masks(layout(HASHES, distance, chunks))])
    apart = difference(F.col("ga"), F.col("gb"))
    near = F.bit_count(apart) <= distance
    # A pair comes out of the first of the keys that it shares.
    earlier = F.exists(F.array(apart), lambda x: F.exists(F.slice(masks, F.lit(1), F.col("which")), lambda m: x.bitwiseAND(m) == 0))
    across = left.hint("merge").join(right, (F.col("key") == F.col("key2")) & (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb"))
                                     & possible("a", "b") & alike() & near & ~earlier)
    more = cut(confirmed(cut(across.select("a", "b").distinct())))
    if not more.isEmpty():
        found = cut(components(links.unionByName(more)))
    of_sets = cut(sets.select("digest", "rep").join(found, sets["rep"] == found["id"], "left").select("digest", F.coalesce("component", "rep").alias("component")))
    out = rows.select("id", "n", "digest").join(of_sets.hint("merge"), "digest", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def distinct_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: int = SIMILARITY, distance: int = DISTANCE) -> DataFrame:
    """The rows of docs, with all their columns, whatever their names, but for those whose component has a smaller id.

    A smaller similarity needs a larger distance, or more of its pairs are missed. Rows that repeat a staying id
    all stay, as do rows without words; nulls, ties and empty tables as in near_duplicates().
    """
    kept = cut(near_duplicates(docs, id_col, text_col, similarity, distance=distance).where("kept").select(F.col(id_col).alias("id")).distinct())
    rows = docs.select(packed(docs), F.col(id_col).alias("id"))
    return rows.join(kept.hint("merge"), rows["id"].eqNullSafe(kept["id"]), "left_semi").select("row.*")
