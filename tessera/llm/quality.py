"""Quality classifier: naive Bayes support vectors.

Features are indicators of byte n-grams, of word pairs and of runs of one word, hashed to BUCKETS. Each is scaled by its log-count
ratio between the classes, rows are scaled to length 1, and a linear model with hinge loss is fitted by dual
coordinate descent. Margins become probabilities by a logistic fit on rows that the model hasn't seen.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import Hasher, constants, mix64, slices

#: The model is fitted on at most so many labelled rows, the first by a hash of their ids.
SAMPLE = 4000
BUCKETS = 1 << 18
ORDERS = (1, 2, 3, 4)
#: Runs of one word that are features.
RUNS = (2, 3, 4, 5, 6, 8, 12, 16)
EPOCHS, COST, SMOOTHING = 8, 1.0, 1.0
FOLDS, THRESHOLD = 5, 0.3


def fold(id_col: str, folds: int) -> Column:
    """crc32(id as text) mod folds; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds


def features(column: pa.Array, hasher: Hasher):
    """The distinct buckets (int32) of each text, in no particular order."""
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    times = constants(17, max(ORDERS) + 3)
    stamp = np.zeros(BUCKETS, np.int32)
    for lo, hi, data, offsets in slices(column):
        _, _, doc, words = hasher.words(data, offsets)
        bounds = np.searchsorted(doc, np.arange(hi - lo + 1))
        pairs = mix64(words[:-1] * times[-1] + words[1:] * times[-2]) if len(words) > 1 else words[:0]
        same = words[:-1] == words[1:]
        runs = []  # any word said n times in a row is an n-gram of its own
        for n in RUNS:
            ok = np.ones(max(0, len(words) - n + 1), bool)
            for k in range(n - 1):
                ok &= same[k : k + len(ok)]
            at = np.flatnonzero(ok)
            runs.append((doc[at[doc[at] == doc[np.minimum(at + n - 1, len(doc) - 1)]]], np.uint64(n)))
        said = [[] for _ in range(hi - lo)]
        for docs_with, n in runs:
            for i in np.unique(docs_with):
                said[i].append(n)
        pairs = (pairs * times[-3]) >> shift
        grams, codes = [], np.zeros(len(data), np.uint64)
        for n in range(1, max(ORDERS) + 1):
            codes = codes[: len(data) - n + 1] * np.uint64(256) + data[n - 1 :] if len(data) >= n else codes[:0]
            if n in ORDERS:
                grams.append((n, (((codes + np.uint64(n << 40)) * times[n]) ^ np.uint64(0x5BD1E995)) * times[0] >> shift))
        for i in range(hi - lo):
            a, b = offsets[i], offsets[i + 1]
            parts = [g[a : max(a, b - n + 1)] for n, g in grams] + [pairs[bounds[i] : max(bounds[i], bounds[i + 1] - 1)], mix64(np.array(said[i], np.uint64)) >> shift]
            every = np.concatenate(parts).astype(np.int64)
            order = np.arange(len(every), dtype=np.int32)
            stamp[every] = order
            yield every[stamp[every] == order].astype(np.int32)


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    counts = np.full((2, BUCKETS), SMOOTHING)
    for x, k in zip(rows, y, strict=True):
        counts[k, x] += 1
    counts /= counts.sum(axis=1, keepdims=True)
    return np.log(counts[1] / counts[0])


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, ratios: np.ndarray, cost: float = COST, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss model over rows scaled by ratios to length 1; classes weigh alike."""
    sign = np.where(y > 0, 1.0, -1.0)
    caps = cost * len(y) / 2 / np.maximum(1, np.bincount(y, minlength=2))[y]
    w, bias = np.zeros(BUCKETS), 0.0
    values = [ratios[x] / max(1e-12, np.sqrt((ratios[x] ** 2).sum())) for x in rows]
    alpha = np.zeros(len(y))
    rng = np.random.default_rng(3)
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            x, v, s = rows[i], values[i], sign[i]
            gradient = s * (w[x] @ v + bias) - 1
            new = min(max(alpha[i] - gradient / 2.0, 0.0), caps[i])  # a row and its bias have squared length 2
            if new != alpha[i]:
                step = (new - alpha[i]) * s
                w[x] += step * v
                bias += step
                alpha[i] = new
    return w, bias


def logistic(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(1 | margin), with smoothed targets, by Newton's method."""
    n1 = y.sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (len(y) - n1 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        q = p * (1 - p) + 1e-9
        g = np.array([((p - target) * margins).sum() + 1e-3 * a, (p - target).sum()])
        h = np.array([[(q * margins**2).sum() + 1e-3, (q * margins).sum()], [(q * margins).sum(), q.sum()]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def margin(x: np.ndarray, w: np.ndarray, ratios: np.ndarray, bias: float) -> float:
    r = ratios[x]
    return float(w[x] @ r / max(1e-12, np.sqrt(r @ r)) + bias)


def fit(rows: list[np.ndarray], y: np.ndarray) -> dict:
    """Weights, log-count ratios, bias, slope and offset. One class only: its smoothed share for every text."""
    if len(np.unique(y)) < 2:
        p = (y.sum() + 1) / (len(y) + 2)
        return {"w": np.zeros(BUCKETS), "r": np.zeros(BUCKETS), "bias": 0.0, "slope": 1.0, "offset": float(np.log(p / (1 - p)))}
    unseen = np.arange(len(y)) % 5 == 4
    train = [x for x, u in zip(rows, unseen, strict=True) if not u]
    if len(np.unique(y[~unseen])) < 2 or not unseen.any():
        unseen[:] = True
        train, kept = rows, y
    else:
        kept = y[~unseen]
    ratios = log_count_ratios(train, kept)
    w, bias = dual_coordinate_descent(train, kept, ratios)
    margins = np.array([margin(x, w, ratios, bias) for x, u in zip(rows, unseen, strict=True) if u])
    slope, offset = logistic(margins, y[unseen])
    return {"w": w, "r": ratios, "bias": bias, "slope": slope, "offset": offset}


def _trainer(batches):
    hasher, rows, y = Hasher(seed=23, lower=False), [], []
    for batch in batches:
        rows += features(batch.column(0), hasher)
        y += batch.column(1).to_pylist()
    if y:
        model = fit(rows, np.array(y, np.int64))
        head = json.dumps({k: model[k] for k in ("bias", "slope", "offset")})
        packed = np.concatenate([model["w"], model["r"]]).astype("<f4").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([head]), pa.array([packed], pa.binary())], names=["head", "packed"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = FOLDS, held_out: int = 0) -> dict:
    """The model from rows of docs with labels(doc_id, quality) outside the held-out fold.

    Rows whose quality isn't 0 or 1, or whose id is null, teach nothing; of an id's rows the one with the least
    text does, so reruns agree. Without any row every score is 0.5.
    """
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id", folds) != held_out))
    order = F.md5(F.col("doc_id").cast("string"))
    chosen = usable.groupBy("doc_id").agg(F.max("quality").cast("long").alias("y")).orderBy(order, "doc_id").limit(sample)
    # The sample's bound makes it fit to broadcast and to be one task's input.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    rows = rows.repartition(1).sortWithinPartitions(order, "doc_id").select("text", "y")
    found = rows.mapInArrow(_trainer, "head string, packed binary").collect()
    if not found:
        return {"w": np.zeros(BUCKETS, np.float32), "r": np.zeros(BUCKETS, np.float32), "bias": 0.0, "slope": 1.0, "offset": 0.0}
    packed = np.frombuffer(found[0].packed, "<f4")
    return {"w": packed[:BUCKETS], "r": packed[BUCKETS:], **json.loads(found[0].head)}


def _scorer(shared):
    def run(batches):
        m, hasher = shared.value, Hasher(seed=23, lower=False)
        weights = (m["w"] * m["r"]).astype(np.float32)
        squares = (m["r"] ** 2).astype(np.float32)
        for batch in batches:
            margins = np.array([weights[x].sum(dtype=np.float64) / max(1e-12, np.sqrt(squares[x].sum(dtype=np.float64))) for x in features(batch.column(batch.num_columns - 1), hasher)]) + m["bias"]
            p = 1 / (1 + np.exp(-np.clip(m["slope"] * margins + m["offset"], -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64())], names=["id", "score"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """One row per row of docs: id, held_out, score (0 to 1, higher: quality 1 likelier), predicted (score >= 0.3).

    Null and empty texts have no n-grams and get the score of margin = bias. Repeated rows score alike; other
    columns are ignored; an empty table gives an empty result.
    """
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(train(named, labels, sample))
    scored = named.mapInArrow(_scorer(model), f"id {dict(named.dtypes)['doc_id']}, score double")
    return scored.select(F.col("id").alias(id_col), (fold("id", FOLDS) == 0).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """The rows of docs, with all their columns, whatever their names, whose text isn't rejected (score >= 0.3).

    Null and empty texts get the score of margin = bias; repeated rows and ties of scores stay or go together; an
    empty table gives an empty result.
    """
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(train(named, labels, sample))
    place, score = docs.columns.index(text_col), _scorer(model)
    # Columns go by their place, so any name will do.
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])

    def run(batches):
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([batch.column(place), batch.column(place)], names=["id", "text"])
            scores = next(score(iter([texts]))).column(1).to_numpy()
            yield batch.filter(pa.array(scores >= THRESHOLD))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
