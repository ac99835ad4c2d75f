"""Language-model scoring: a causal self-attention model over subword ids, and a unigram base over words.

The model predicts a subword from the ones before it: one attention layer whose queries, keys and values are
tables by id plus a bias by distance, a hidden layer, and a two-level softmax over SLOTS outputs. Slot 0 is the
text's end (and start), another one escapes to the ids outside the vocabulary by their smoothed counts; slots whose
neighbours are alike share a group of the softmax, by counts of all pairs of training subwords. Texts are
cut into blocks of HALF tokens; a block attends to itself and the block before, so windows of 2 * HALF tokens
overlap and each token is scored once, in batches with a causal mask.

Texts are encoded once, to the shared folder. Subwords are counted over all training documents. Training in
numpy starts in one task on INIT_ROWS training documents; from there each shard of the training documents
trains on all its blocks in one pass (every step moves the output side's tables, every INPUTS-th the input side's), and the shards' weights are averaged by tokens, in two levels, so that no
task holds more than the square root of the shards. Shards hold about SHARD tokens and are dealt by a hash of id and
text: neither files nor partitions change the model. The base's word counts cover all training documents. Words
with at least N / FREQUENT occurrences, at most FREQUENT of them, are broadcast; all others are joined by their
hash.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import groupby
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import Encoder, default_tokenizer
from .quality import fold
from .shared import LOWER, UPPER, cut
from .text import Hasher, slices

FOLDS, HELD_OUT = 5, 1
SLOTS, GROUP, DIM, HIDDEN, HALF = 1024, 32, 16, 32, 16
GROUPS = SLOTS // GROUP
#: Rows that the first weights are trained on, passes over them at most BATCH blocks a step, and the rates of both phases.
INIT_ROWS, INIT_STEPS, INIT_RATE, RATE = 1500, 1800, 2e-2, 3e-3
#: A step takes BATCH blocks; the pass over a shard mixes about POOL blocks at a time and moves the input side every INPUTS steps.
BATCH, POOL, INPUTS = 256, 1 << 14, 4
#: Training tokens of a shard.
SHARD = 4_000_000
#: Rows that a set of weights travels in.
PARTS = 64
FREQUENT = 4_000_000
#: Bytes of text encoded at a time.
ENCODED = 1 << 22
#: Tokens scored at a time.
SCORED = 1 << 13
_LOWERED = bytes.maketrans(UPPER.encode(), LOWER.encode())
_FAR = np.float32(-1e9)
_SCALE = np.float32(DIM**-0.5)
SHAPES = {"q": (SLOTS, DIM), "kv": (SLOTS, 2 * DIM), "u": (SLOTS, HIDDEN), "o": (DIM, HIDDEN), "b": (HIDDEN,), "far": (2 * HALF,),
          "c": (GROUPS, HIDDEN + 1), "m": (GROUPS, GROUP, HIDDEN + 1)}
SIZE = sum(int(np.prod(s)) for s in SHAPES.values())
#: Where the tables of the output side begin.
OUTPUT = SIZE - sum(int(np.prod(SHAPES[k])) for k in ("c", "m"))
_ENDS = np.cumsum([int(np.prod(s)) for s in SHAPES.values()]).tolist()


def tables(flat: np.ndarray) -> dict[str, np.ndarray]:
    """The model's tables, as parts of one array; c and m with their biases as last column."""
    return {name: flat[a:b].reshape(shape) for (name, shape), a, b in zip(SHAPES.items(), [0, *_ENDS], _ENDS, strict=False)}


def views(flat: np.ndarray) -> dict[str, np.ndarray]:
    """The model's tables and biases, each by itself."""
    out = tables(flat)
    c, m = out.pop("c"), out.pop("m")
    return out | {"c": c[:, :HIDDEN], "c0": c[:, HIDDEN], "m": m[:, :, :HIDDEN], "m0": m[:, :, HIDDEN]}


def keep_memory() -> None:
    """Lets the C library reuse the memory of freed arrays of up to 32 MB, 64 MB at most; to get it from the system anew costs as much as many of the sums."""
    try:
        change = ctypes.CDLL(None).mallopt
    except (OSError, AttributeError, TypeError):  # another C library
        return
    change(-3, 1 << 25)
    change(-1, 1 << 26)


def _hidden_inputs(w: dict) -> tuple[np.ndarray, np.ndarray]:
    """u and o such that take(u) + (values @ o) is the hidden layer before its cut at 0, with a one as last column."""
    u, o = np.ones((SLOTS, HIDDEN + 1), np.float32), np.zeros((DIM, HIDDEN + 1), np.float32)
    np.add(w["u"], w["b"], out=u[:, :HIDDEN])
    o[:, :HIDDEN] = w["o"]
    return u, o


def _held_below(x: np.ndarray, top: int) -> None:
    if x.size and not x.max() <= top:
        np.minimum(x, np.float32(top), out=x)


def start_weights(seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    flat = np.zeros(SIZE, np.float32)
    for name, table in views(flat).items():
        if table.ndim > 1:
            table[:] = rng.normal(size=table.shape) * (0.1 if name in ("c", "m") else 0.3)
    views(flat)["m0"][:] = 0
    return flat


_DISTANCE = np.minimum(2 * HALF - 1, np.maximum(0, HALF + np.arange(HALF)[:, None] - np.arange(2 * HALF)[None, :]))
_CAUSAL = np.where(np.arange(2 * HALF)[None, :] <= HALF + np.arange(HALF)[:, None], np.float32(0), _FAR)
_FIRST = np.where(np.arange(2 * HALF) < HALF, _FAR, np.float32(0))


def prepared(flat: np.ndarray) -> dict:
    """Tables for scoring: p, the attention of any two slots; v, values and a one side by side; exp of the distances' biases, 0 where masked."""
    w = tables(flat)
    one = np.ones((SLOTS, 1), np.float32)
    p = (w["q"] * _SCALE) @ w["kv"][:, :DIM].T
    _held_below(p, 60)
    bias = np.exp(np.minimum(w["far"][_DISTANCE], 20)) * (_CAUSAL == 0)
    u, o = _hidden_inputs(w)
    return w | {"p": np.exp(p).reshape(-1), "v": np.concatenate([w["kv"][:, DIM:], one], axis=1), "bias": bias.astype(np.float32), "u": u, "o": o}


def log_probabilities(w: dict, x: np.ndarray, y: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Natural log P(y) of each place, from prepared weights. x, y: (blocks, HALF); first: whether a block begins its text."""
    n, ones = len(x), np.ones(GROUP, np.float32)
    keys = np.empty((n, 2 * HALF), np.int64)
    keys[:, HALF:] = x
    keys[1:, :HALF], keys[:1, :HALF] = x[:-1], x[:1]
    s = w["p"].take((keys[:, HALF:] * SLOTS)[:, :, None] + keys[:, None, :], mode="clip")
    s *= w["bias"]
    s[first, :, :HALF] = 0
    o = (s @ w["v"].take(keys, axis=0, mode="clip")).reshape(-1, DIM + 1)
    t = y.reshape(-1)
    group = (t // GROUP).astype(np.int16)
    order = np.argsort(group, kind="stable")
    edges = np.searchsorted(group[order], np.arange(GROUPS + 1)).tolist()
    o = o.take(order, axis=0, mode="clip")
    z = (o[:, :DIM] / o[:, DIM:]) @ w["o"]
    z += w["u"].take(x.reshape(-1)[order], axis=0, mode="clip")
    np.maximum(z, np.zeros_like(z), out=z)
    c = z @ w["c"].T
    m = np.empty((len(t), GROUP), np.float32)
    for g in range(GROUPS):
        a, b = edges[g], edges[g + 1]
        if a < b:
            np.matmul(z[a:b], w["m"][g].T, out=m[a:b])
    _held_below(c, 80)
    _held_below(m, 80)
    rows = np.arange(len(t)) * GROUP
    inner = c.reshape(-1).take(rows // GROUP * GROUPS + group[order], mode="clip") + m.reshape(-1).take(rows + t[order] % GROUP, mode="clip")
    for e in (c, m):
        np.exp(e, out=e)
        inner -= np.log(e @ ones[: e.shape[1]])
    out = np.empty(len(t))
    out[order] = inner
    return out.reshape(y.shape)


def _summed(ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The sums of each id's rows."""
    order = np.argsort(ids.astype(np.int16), kind="stable")
    ids = ids[order]
    at = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    out = np.zeros((SLOTS, rows.shape[1]), np.float32)
    out[ids[at]] = np.add.reduceat(rows.take(order, axis=0), at, axis=0)
    return out


def gradients(flat: np.ndarray, x: np.ndarray, y: np.ndarray, first: np.ndarray, before: np.ndarray, valid: np.ndarray, inputs: bool = True, out: np.ndarray | None = None) -> np.ndarray:
    """Derivatives of the mean loss over valid places, laid out as the weights; those of the input side only if asked for.

    out: an array to use for the result, whose input side stays as it is if not asked for.
    """
    w, grad = tables(flat), np.zeros(SIZE, np.float32) if out is None else out
    g, n, ones = tables(grad), len(x), np.ones(max(GROUPS, GROUP, 2 * HALF), np.float32)
    keys = np.concatenate([before, x], axis=1)
    q = w["q"].take(x, axis=0, mode="clip")
    q *= _SCALE
    kv = np.concatenate([w["kv"], np.ones((SLOTS, 1), np.float32)], axis=1).take(keys, axis=0, mode="clip")
    k, v = kv[:, :, :DIM], kv[:, :, DIM : 2 * DIM]
    a = _weights(q @ k.transpose(0, 2, 1), w["far"], first)
    o = a @ kv[:, :, DIM:]
    total = o[:, :, DIM:]
    o = (o[:, :, :DIM] / total).reshape(-1, DIM)
    t = y.reshape(-1)
    group = (t // GROUP).astype(np.int16)
    order = np.argsort(group, kind="stable")
    group, ts, rows = group[order], t[order] % GROUP, np.arange(len(t))
    edges = np.searchsorted(group, np.arange(GROUPS + 1)).tolist()
    hidden_u, hidden_o = _hidden_inputs(w)
    z = o.take(order, axis=0, mode="clip") @ hidden_o
    z += hidden_u.take(x.reshape(-1)[order], axis=0, mode="clip")
    np.maximum(z, np.zeros_like(z), out=z)
    scale = (valid.reshape(-1)[order] / max(1, valid.sum())).astype(np.float32)

    def toward(e: np.ndarray, want: np.ndarray) -> None:
        """Turns logits into the loss's derivatives by them."""
        _held_below(e, 40)
        np.exp(e, out=e)
        e *= (scale / (e @ ones[: e.shape[1]]))[:, None]
        e.reshape(-1)[rows * e.shape[1] + want] -= scale

    c = z @ w["c"].T
    toward(c, group)
    np.matmul(c.T, z, out=g["c"])
    m = np.empty((len(t), GROUP), np.float32)
    parts = [(i, slice(edges[i], edges[i + 1])) for i in range(GROUPS) if edges[i] < edges[i + 1]]
    for i, at in parts:
        np.matmul(z[at], w["m"][i].T, out=m[at])
    toward(m, ts)
    g["m"][:] = 0
    for i, at in parts:
        np.matmul(m[at].T, z[at], out=g["m"][i])
    if not inputs:
        return grad
    a /= total
    wc, wm, ones = w["c"][:, :HIDDEN], w["m"][:, :, :HIDDEN], np.ones(max(len(t), 2 * HALF), np.float32)
    dz = c @ wc
    for i, at in parts:
        dz[at] += m[at] @ wm[i]
    dz *= z[:, :HIDDEN] > 0
    back = np.empty_like(order)
    back[order] = rows
    dz = dz.take(back, axis=0)
    g["b"][:], g["o"][:] = ones[: len(dz)] @ dz, o.T @ dz
    do = (dz @ w["o"].T).reshape(n, HALF, DIM)
    da = do @ v.transpose(0, 2, 1)
    da *= a
    da -= a * (da @ ones[: 2 * HALF])[:, :, None]
    g["far"][:] = np.bincount(_DISTANCE.reshape(-1), ones[:n] @ da.reshape(n, -1), minlength=2 * HALF)
    of_x = _summed(x.reshape(-1), np.concatenate([dz, (da @ k).reshape(-1, DIM) * _SCALE], axis=1))
    g["u"][:], g["q"][:] = of_x[:, :HIDDEN], of_x[:, HIDDEN:]
    g["kv"][:] = _summed(keys.reshape(-1), np.concatenate([da.transpose(0, 2, 1) @ q, a.transpose(0, 2, 1) @ do], axis=2).reshape(-1, 2 * DIM))
    return grad


def _weights(s: np.ndarray, far: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Attention weights from the scores s, yet to be divided by their sums: biased by distance, causal, within the text."""
    _held_below(s, 60)
    np.exp(s, out=s)
    s *= (np.exp(np.minimum(far, 20))[_DISTANCE] * (_CAUSAL == 0)).astype(np.float32)
    s[first, :, :HALF] = 0
    return s


class Adam:
    """Steps of Adam on one array, in place."""

    def __init__(self, flat: np.ndarray):
        self.flat, self.n = flat, 0
        self.one, self.two = np.zeros_like(flat), np.zeros_like(flat)

    def step(self, grad: np.ndarray, rate: float) -> None:
        self.n += 1
        self.one *= np.float32(0.9)
        self.one += np.float32(0.1) * grad
        np.square(grad, out=grad)
        grad *= np.float32(0.01)
        self.two *= np.float32(0.99)
        self.two += grad
        size = np.sqrt(self.two)
        size += np.float32(1e-7)
        np.divide(self.one, size, out=size)
        size *= np.float32(rate * np.sqrt(1 - 0.99**self.n) / (1 - 0.9**self.n))
        self.flat -= size


def train(flat: np.ndarray, texts: list[np.ndarray], steps: int, seed: int = 0, rate: float = INIT_RATE) -> np.ndarray:
    """The weights after so many steps of Adam over random blocks of texts (slots); flat itself stays."""
    flat = flat.copy()
    if not texts:
        return flat
    x, y, first, valid, _ = blocks(texts)
    before = np.concatenate([x[:1], x[:-1]])
    rng, adam = np.random.default_rng(seed), Adam(flat)
    for n in range(1, steps + 1):
        at = rng.integers(0, len(x), BATCH)
        adam.step(gradients(flat, x[at], y[at], first[at], before[at], valid[at]), rate * (1 - 0.95 * n / steps))
    return flat


def train_pass(flat: np.ndarray, texts: Iterable[np.ndarray], seed: int = 0, rate: float = RATE) -> tuple[np.ndarray, int]:
    """The weights after one pass of Adam over every block of texts (slots), and the tokens learned from, ends included.

    Every step moves the tables of the output side, every INPUTS-th those of the input side too.
    """
    flat, grad = flat.copy(), np.zeros(SIZE, np.float32)
    adams, rng, learned = (Adam(flat[:OUTPUT]), Adam(flat[OUTPUT:])), np.random.default_rng(seed), 0

    def learn(pool: list[np.ndarray]) -> int:
        x, y, first, valid, _ = blocks(pool)
        before = np.concatenate([x[:1], x[:-1]])
        order = rng.permutation(len(x))
        for a in range(0, len(x), BATCH):
            at = order[a : a + BATCH]
            inputs = adams[1].n % INPUTS == 0
            gradients(flat, x[at], y[at], first[at], before[at], valid[at], inputs, grad)
            slower = rate / np.sqrt(1 + adams[1].n / 100)
            if inputs:
                adams[0].step(grad[:OUTPUT], slower)
            adams[1].step(grad[OUTPUT:], slower)
        return int(valid.sum())

    pool, size = [], 0
    for t in texts:
        pool.append(t)
        size += len(t) // HALF + 1
        if size >= POOL:
            learned, pool, size = learned + learn(pool), [], 0
    return flat, learned + (learn(pool) if pool else 0)


def blocks(texts: list[np.ndarray]):
    """Inputs and targets of texts (slots) in blocks, which blocks begin a text, which places count, first block of each."""
    sizes = np.array([len(t) + 1 for t in texts])
    counts = -(-sizes // HALF)
    begins = np.concatenate([[0], np.cumsum(counts)])
    x, y = np.zeros((2, begins[-1] * HALF), np.int32)
    valid = np.zeros(begins[-1] * HALF, bool)
    for t, n, b in zip(texts, sizes, begins[:-1] * HALF, strict=True):
        x[b + 1 : b + n] = t
        y[b : b + n - 1] = t
        valid[b : b + n] = True
    first = np.zeros(begins[-1], bool)
    first[begins[:-1]] = True
    return x.reshape(-1, HALF), y.reshape(-1, HALF), first, valid.reshape(-1, HALF), begins[:-1]


def slots_of(counts: np.ndarray) -> np.ndarray:
    """Slots of subword ids by their counts: 2, 3, ... for the most frequent, 1 for the rest."""
    order = np.argsort(-counts, kind="stable")[: SLOTS - 2]
    of = np.ones(len(counts), np.int32)
    of[order] = np.arange(2, 2 + len(order))
    return of


def escapes(counts: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Natural log of each id's share among the ids of slot 1, 0 for ids with slots of their own."""
    rest = np.where(of == 1, counts + 0.5, 0)
    return np.log(np.where(of == 1, rest / max(rest.sum(), 1e-300), 1))


def alike(pairs: np.ndarray) -> np.ndarray:
    """A place for every slot, so that the GROUP slots of a group have alike neighbours; slot 0 stays. pairs[a, b]: how often b follows a.

    Slots are halved along the main direction of their neighbours' shares until a half is a group.
    """
    often = pairs.sum(axis=0) + pairs.sum(axis=1)
    shares = np.concatenate([np.sqrt(x / np.maximum(x.sum(axis=1, keepdims=True), 1)) for x in (pairs, pairs.T)], axis=1)

    def halved(some: np.ndarray) -> Iterator[np.ndarray]:
        if len(some) <= GROUP:
            yield some
            return
        weight = (often[some] + 1)[:, None]
        x = shares[some] - (shares[some] * weight).sum(axis=0) / weight.sum()
        x *= np.sqrt(weight)
        v = np.random.default_rng(0).normal(size=x.shape[1])
        for _ in range(30):
            v = x.T @ (x @ v)
            v /= np.linalg.norm(v) + 1e-12
        by = np.argsort((x @ v) / np.sqrt(weight[:, 0]), kind="stable")
        yield from halved(some[by[: len(some) // 2]])
        yield from halved(some[by[len(some) // 2 :]])

    place = np.empty(SLOTS, np.int32)
    place[np.concatenate(list(halved(np.arange(SLOTS))))] = np.arange(SLOTS)
    # The end's slot is 0, so its group comes first and it comes first there.
    place = (place - place[0] // GROUP * GROUP) % SLOTS
    at_0 = np.flatnonzero(place == 0)[0]
    place[at_0], place[0] = place[0], 0
    return place


def stored(size: int) -> str:
    """How ids below size are stored."""
    return "<u2" if size <= 1 << 16 else "<u4"


def _slots(batches, of: np.ndarray) -> Iterator[np.ndarray]:
    dtype = stored(len(of))
    for batch in batches:
        for ids in batch.column(batch.num_columns - 1):
            yield of[np.frombuffer(ids.as_buffer(), dtype)]


def _subword_counts(size: int):
    dtype = stored(size)

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            some = [np.frombuffer(ids.as_buffer(), dtype) for ids in batch.column(0)]
            total += np.bincount(np.concatenate([*some, np.zeros(0, dtype)]), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["token", "n"])

    return run


def _pair_counts(shared):
    def run(batches):
        keep_memory()
        total = np.zeros(SLOTS * SLOTS, np.int64)
        held, size = [], 0

        def add() -> None:
            flat = np.concatenate([np.zeros(1, np.int32), *held])
            total[:] += np.bincount(flat[:-1].astype(np.int64) * SLOTS + flat[1:], minlength=len(total))

        for s in _slots(batches, shared.value):
            held += [s, np.zeros(1, np.int32)]
            size += len(s) + 1
            if size > 4_000_000:
                add()
                held, size = [], 0
        add()
        total[0] -= total[0] > 0
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["pair", "n"])

    return run


def _emitted(shard: int, flat: np.ndarray, weight: float) -> pa.RecordBatch:
    parts = [p.astype("<f4").tobytes() for p in np.array_split(flat, PARTS)]
    return pa.RecordBatch.from_arrays([pa.array([shard] * PARTS, pa.int64()), pa.array(np.arange(PARTS, dtype=np.int32)), pa.array(parts, pa.binary()), pa.array([weight] * PARTS)],
                                      names=["shard", "part", "values", "weight"])


def _starter(shared, steps: int):
    def run(batches):
        keep_memory()
        of, flat = shared.value
        texts = list(_slots(batches, of))
        if texts:
            yield _emitted(0, train(flat, texts, steps), 1.0)

    return run


def _trainer(shared):
    """Trains on each shard of a partition sorted by shard."""
    def run(batches):
        keep_memory()
        _tools.cache_clear()
        of, start = shared.value
        dtype = stored(len(of))
        rows = ((shard, of[np.frombuffer(ids.as_buffer(), dtype)]) for b in batches for shard, ids in zip(b.column(0).to_pylist(), b.column(1), strict=True))
        for shard, some in groupby(rows, key=lambda r: r[0]):
            flat, weight = train_pass(start, (s for _, s in some), shard)
            yield _emitted(shard, flat, float(weight))

    return run


def _total(pdf: pd.DataFrame) -> pd.DataFrame:
    """Weights times tokens, summed in the order of shards."""
    pdf = pdf.sort_values("shard")
    total = sum(np.frombuffer(v, "<f4").astype(np.float64) * n for v, n in zip(pdf["values"], pdf.weight, strict=True))
    return pd.DataFrame({"shard": [pdf.bucket.iloc[0]], "part": [pdf.part.iloc[0]], "values": [total.tobytes()], "weight": [pdf.weight.sum()]})


def _mean(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("shard")
    total = sum(np.frombuffer(v, np.float64) for v in pdf["values"])
    return pd.DataFrame({"part": [pdf.part.iloc[0]], "values": [(total / pdf.weight.sum()).astype("<f4").tobytes()]})


def _averaged(learned: DataFrame, shards: int, otherwise: np.ndarray) -> np.ndarray:
    """The shards' weights averaged by tokens: sums of isqrt(shards) shards first, then of these."""
    bucket = (F.col("shard") % max(1, isqrt(shards))).alias("bucket")
    sums = learned.select("*", bucket).groupBy("bucket", "part").applyInPandas(_total, "shard long, part int, values binary, weight double")
    found = sums.groupBy("part").applyInPandas(_mean, "part int, values binary").collect()
    return np.concatenate([np.frombuffer(r["values"], "<f4") for r in sorted(found, key=lambda r: r.part)]).copy() if found else otherwise


def fit_model(training: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of ids, log shares of escaped ids, weights. training: id, ids (binary) of every training document; size: ids there are."""
    spark = training.sparkSession
    # At most as many counts as there are ids, and as many pairs as SLOTS squared.
    counted = training.select("ids").mapInArrow(_subword_counts(size), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(size)
    counts[[r.token for r in counted]] = [r.n for r in counted]
    of, flat = slots_of(counts), start_weights()
    shared = spark.sparkContext.broadcast(of)
    paired = training.select("ids").mapInArrow(_pair_counts(shared), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    pairs = np.zeros(SLOTS * SLOTS)
    pairs[paired.column("pair").to_numpy()] = paired.column("n").to_numpy()
    rare = of == 1
    of = alike(pairs.reshape(SLOTS, SLOTS))[of]
    order = F.xxhash64("id", "ids")
    start = training.orderBy(order, "ids").limit(INIT_ROWS).select("ids")
    shared = spark.sparkContext.broadcast((of, flat))
    schema = "shard long, part int, values binary, weight double"
    flat = _averaged(start.mapInArrow(_starter(shared, INIT_STEPS), schema), 1, flat)
    shards = max(1, round(counts.sum() / SHARD))
    shared = spark.sparkContext.broadcast((of, flat))
    dealt = training.select(F.pmod(order, F.lit(shards)).alias("shard"), order.alias("at"), "ids").repartitionByRange(shards, "shard").sortWithinPartitions("shard", "at", "ids")
    flat = _averaged(cut(dealt.select("shard", "ids").mapInArrow(_trainer(shared), schema)), shards, flat)
    return of, escapes(counts, np.where(rare, 1, 0)), flat


def _merge(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(h, kind="stable")
    h, c = h[order], c[order]
    at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, int)
    return h[at], np.add.reduceat(c, at) if len(at) else c


def _word_counts(batches):
    keep_memory()
    hasher = Hasher()
    held: list[np.ndarray] = []
    size = 0

    def out():
        h, c = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], names=["h", "c"])

    for batch in batches:
        for _, _, data, offsets in slices(batch.column(0)):
            held.append(hasher.words(data, offsets)[3])
            size += len(held[-1])
            if size > 6_000_000:
                yield out()
                held, size = [], 0
    if held:
        yield out()


@cache
def _tools(path: str) -> tuple[Encoder, Hasher]:
    """Made once in a Python worker, not in each of its tasks."""
    return Encoder(path), Hasher()


def _encoder(path: str, shared, divisor: float, dtype: str):
    """Subword ids and base scores by frequent words; hashes of the other words."""
    def run(batches):
        keep_memory()
        known, counts = shared.value
        encoder, hasher = _tools(path)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for begin, end, data, offsets in slices(batch.column(2), ENCODED):
                ids, ends = encoder.encode_all(data.tobytes().translate(_LOWERED), offsets)
                coded = pa.Array.from_buffers(pa.binary(), end - begin, [None, pa.py_buffer((ends * np.dtype(dtype).itemsize).astype(np.int32)), pa.py_buffer(ids.astype(dtype))])
                some = batch.slice(begin, end - begin)
                for lo, hi, data, offsets in slices(some.column(2)):
                    _, _, doc, h = hasher.words(data, offsets)
                    n = hi - lo
                    at = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
                    often = known[at] == h if len(known) else np.zeros(len(h), bool)
                    value = np.log10((counts[at[often]] + 0.5) / divisor) if often.any() else np.zeros(0)
                    base = np.bincount(doc[often], value, minlength=n).astype(np.float64)
                    found = np.bincount(doc[often], minlength=n)
                    words = np.bincount(doc, minlength=n)
                    rare, rare_of = h[~often].view(np.int64), doc[~often]
                    edges = np.searchsorted(rare_of, np.arange(n + 1)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.arange(row, row + n)), some.column(0).slice(lo, n), some.column(1).slice(lo, n), pa.array(words.astype(np.int64) + 1), pa.array(found.astype(np.int64)),
                        pa.array(base), pa.ListArray.from_arrays(pa.array(edges), pa.array(rare)), coded.slice(lo, n)], names=["row", "id", "train", "n_tokens", "found", "base", "rare", "ids"])
                    row += n

    return run


def _scorer(shared):
    """Rows with the model's score in place of their ids."""
    def run(batches):
        keep_memory()
        of, tail, flat = shared.value
        dtype = stored(len(of))
        w = prepared(flat)
        for batch in batches:
            last = batch.num_columns - 1
            scores, a, size = np.zeros(batch.num_rows), 0, 0
            coded, tails = [], []
            for i, ids in enumerate(batch.column(last)):
                ids = np.frombuffer(ids.as_buffer(), dtype)
                coded.append(of[ids])
                tails.append(tail[ids].sum())
                size += len(ids) + HALF
                if size >= SCORED or i == batch.num_rows - 1:
                    scores[a : i + 1] = np.array(tails) + _score(w, coded)
                    coded, tails, size, a = [], [], 0, i + 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], pa.array(scores / np.log(10))], names=[*batch.schema.names[:last], "score"])

    return run


def _score(w: dict, coded: list[np.ndarray]) -> np.ndarray:
    x, y, first, valid, begins = blocks(coded)
    out = np.empty(x.shape)
    step = SCORED // HALF
    for a in range(0, len(x), step):  # a very long text in parts, each with the block before it
        b = max(0, a - 1)
        out[a : a + step] = log_probabilities(w, x[b : a + step], y[b : a + step], first[b : a + step])[a - b :]
    out *= valid
    return np.add.reduceat(out.sum(axis=1), begins)


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """One row per row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null text counts as empty: its only token is the end. Without training documents all base probabilities are 1
    and the model is its random start. Repeated rows score alike; an empty table gives an empty result; other
    columns are ignored. Words are told apart by 64-bit hashes. The same rows in other files or partitions score
    alike, up to rounding.
    """
    spark, path = docs.sparkSession, tokenizer or default_tokenizer()
    size = _vocabulary(path)
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("train", fold("id", FOLDS) != HELD_OUT)
    # The hashes and the encoder fold A-Z themselves.
    raw = named.where("train")
    vocabulary = cut(raw.select("text").mapInArrow(_word_counts, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")))
    ends = raw.select("id").count()
    sums = vocabulary.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, distinct = (sums.n or 0) + ends, sums.v + (ends > 0)
    divisor = total + 0.5 * (distinct + 1)
    often = vocabulary.where(F.col("c") * FREQUENT >= total).toArrow()
    h = often.column("h").to_numpy().view(np.uint64) if often.num_rows else np.zeros(0, np.uint64)
    order = np.argsort(h)
    shared = spark.sparkContext.broadcast((h[order], (often.column("c").to_numpy() if often.num_rows else np.zeros(0, np.int64))[order]))
    schema = f"row long, id {dict(named.dtypes)['id']}, train boolean, n_tokens long, found long, base double, rare array<long>, ids binary"
    encoded = cut(named.select("id", "train", "text").mapInArrow(_encoder(path, shared, divisor, stored(size)), schema))
    model = spark.sparkContext.broadcast(fit_model(encoded.where("train").select("id", "ids"), size))
    scored = encoded.select("row", "id", "n_tokens", "found", "base", "ids").mapInArrow(_scorer(model), f"row long, id {dict(named.dtypes)['id']}, n_tokens long, found long, base double, score double")
    probability = F.log10((F.coalesce("c", F.lit(0)) + 0.5) / divisor)
    rest = vocabulary.where(F.col("c") * FREQUENT < total)
    rare = encoded.select("row", F.explode("rare").alias("h")).join(rest.hint("merge"), "h", "left")
    rare = cut(rare.groupBy("row").agg(F.sum(probability).alias("more"), F.count("c").alias("also")))
    end = F.lit(float(np.log10((ends + 0.5) / divisor)))
    out = scored.join(rare.hint("merge"), "row", "left")
    return out.select(
        F.col("id").alias(id_col), (fold("id", FOLDS) == HELD_OUT).alias("held_out"), "n_tokens",
        (F.col("found") + F.coalesce("also", F.lit(0)) + int(ends > 0)).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) + end).alias("base_score"), "score")


def _vocabulary(path: str) -> int:
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab().values()) + 1
