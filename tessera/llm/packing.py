"""Packing documents into sequences by order-preserving dynamic programming.

The documents of an input partition form one stream of tokens in their order. Sequences are windows of it;
they may end after a document (free), after a sentence (SENTENCE_COST) or, inside a sentence longer than a
sequence, every STEP tokens (FORCED_COST). With c the places where a window may end, best[j] is the least
padding plus penalties of the stream up to c[j]:

    best[j] = cost[j] + min(best[i] + padding(c[j] - c[i])), c[j] - c[i] <= length

Padding is length - (c[j] - c[i]), so the minimum over i is that of best[i] + c[i] over a sliding window,
kept in a monotone queue; lengths that are powers of two need no padding and are looked up one by one.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH = 2048
SENTENCE_COST, FORCED_COST, STEP = 8, 64, 64
#: Shorter sequences than this don't count as unpadded.
LEAST_POWER = 256
#: Tokens after which the plan is fixed but for its last window.
BLOCK = 1 << 18
END_ID = 1
#: Texts with runs of white space as long as this are left to the `tokenizers` library.
LONG_SPACE = 50_000
_LONG_SPACE = re.compile(r"\s{%d}" % LONG_SPACE)
#: How the tokenizer file splits texts before it merges bytes (fixed value, the byte-level pattern).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Classes of characters in PATTERN; UNSURE: what editions of Unicode don't agree on, or what is rare.
LETTER, NUMBER, SPACE, OTHER, UNSURE = range(5)
_SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Pieces of text that an encoder remembers, and how many bytes one of them has at most.
REMEMBERED, REMEMBERED_BYTES = 1 << 19, 64


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next free one from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


@cache
def character_classes() -> np.ndarray:
    """The class of each code point; sure is what has had its category since Unicode 3.2."""
    out = np.full(0x110000, UNSURE, np.uint8)
    for i in range(0x10000):
        now = unicodedata.category(chr(i))
        if now == unicodedata.ucd_3_2_0.category(chr(i)) and now != "Cn":
            out[i] = LETTER if now[0] == "L" else NUMBER if now[0] == "N" else OTHER
    out[_SPACES] = SPACE
    return out


def piece_starts(points: np.ndarray, kinds: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """For each code point, whether one of PATTERN's matches starts there. kinds: their classes; begins: whether a text does."""
    n = len(points)
    space = kinds == SPACE
    starts = begins.copy()
    starts[1:] |= kinds[1:] != kinds[:-1]
    runs = starts.copy()
    # The last white space before something else is by itself or, if a blank, starts what follows.
    inner = ~begins[1:]
    last = space[:-1] & ~space[1:] & inner
    starts[:-1] |= last
    joined = np.zeros(n, bool)
    joined[1:] = last & (points[:-1] == 32)
    starts &= ~joined
    for i in np.flatnonzero((points == 39) & runs & ~joined).tolist():
        end = i + 1
        while end < min(n, i + 3) and not begins[end]:
            end += 1
        after = points[i + 1 : end].tolist()
        k = 1 if after[:1] and after[0] in _SHORT else 2 if tuple(after) in _LONGER else 0
        if k:
            starts[i + 1 : i + 1 + k] = False
            if i + 1 + k < n:
                starts[i + 1 + k] |= kinds[i + 1 + k] == LETTER
    return starts


#: What is a piece by itself after an apostrophe.
_SHORT, _LONGER = set(b"sdmt"), {tuple(b"ll"), tuple(b"ve"), tuple(b"re")}


class Encoder:
    """Ids of whole texts, those that the tokenizer file gives through the `tokenizers` library.

    Merging runs in tiktoken, several times as fast, on the ranks read from that file: a token's id is its
    merge's rank. Texts with a special token's string or very long white space go to the library itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in word): i for word, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if word not in self.special}
        self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[bytes, bytes] = {}

    def encode(self, text: str) -> np.ndarray:
        if any(x in text for x in self.special) or (len(text) > LONG_SPACE and _LONG_SPACE.search(text)):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.uint32, copy=False)

    def encode_all(self, data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many texts in a row, the same as encode's, and where each text's begin, the end last. offsets: of each text in data (UTF-8).

        Texts are cut as PATTERN does, all at once, and each distinct piece is merged once. Texts with characters whose
        class isn't sure, special tokens or bytes that are not UTF-8 go through encode.
        """
        try:
            points = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
        except UnicodeDecodeError:
            return self._apart(data, offsets, np.ones(len(offsets) - 1, bool))
        if not len(points):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        kinds = character_classes().take(points)
        at = None  # the byte of each code point, if not its number
        places = offsets
        if len(points) < len(data):
            at = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
            places = np.searchsorted(at, offsets)
        odd = np.zeros(len(offsets) - 1, bool)
        odd[np.searchsorted(places, np.flatnonzero(kinds == UNSURE), side="right") - 1] = True
        for x in self.special:
            if x.encode() in data:
                odd |= [x.encode() in data[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        if odd.any():
            return self._apart(data, offsets, odd)
        begins = np.zeros(len(points) + 1, bool)
        begins[places] = True
        starts = np.flatnonzero(piece_starts(points, kinds, begins[:-1]))
        cuts = np.append(starts if at is None else at[starts], len(data))
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        which = pieces.indices.to_numpy()
        distinct = self._pieces(pieces.dictionary)
        sizes = np.fromiter(map(len, distinct), np.int64, len(distinct)) // 4
        flat = np.frombuffer(b"".join(distinct), np.uint32)
        taken = sizes.take(which)
        ends = np.concatenate([[0], np.cumsum(taken)])
        at = (np.cumsum(sizes) - sizes).take(which)
        at -= ends[:-1]
        at = np.repeat(at, taken)
        at += np.arange(len(at))
        return flat.take(at), ends[np.searchsorted(cuts[:-1], offsets)]

    def _pieces(self, pieces: pa.Array) -> list[bytes]:
        """The ids of each piece, as bytes of uint32."""
        _, edges, raw = pieces.buffers()
        edges, raw = np.frombuffer(edges, np.int32)[pieces.offset : pieces.offset + len(pieces) + 1].tolist(), raw.to_pybytes()
        known, merge, out = self.known, self.fast._core_bpe.encode_single_piece, []
        for a, b in zip(edges, edges[1:], strict=False):
            piece = raw[a:b]
            ids = known.get(piece)
            if ids is None:
                ids = array("I", merge(piece)).tobytes()
                if b - a <= REMEMBERED_BYTES:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[piece] = ids
            out.append(ids)
        return out

    def _apart(self, data: bytes, offsets: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """encode_all, odd texts by encode."""
        texts = [data[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        plain = [t for t, o in zip(texts, odd.tolist(), strict=True) if not o]
        ids, edges = self.encode_all(b"".join(plain), np.cumsum([0, *map(len, plain)]))
        others = iter(np.split(ids, edges[1:-1]))
        each = [self.encode(t.decode(errors="replace")) if o else next(others) for t, o in zip(texts, odd.tolist(), strict=True)]
        return np.concatenate([*each, np.zeros(0, np.uint32)]), np.cumsum([0, *map(len, each)])

    def sentence_ends(self) -> np.ndarray:
        """For each id, whether its text ends a sentence or line."""
        out = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        for i in range(len(out) - 1):
            out[i] = (self.tokenizer.id_to_token(i) or "").endswith((".", "!", "?", "Ċ"))
        return out


def plan(places: np.ndarray, costs: np.ndarray, length: int = LENGTH) -> list[int]:
    """The places where windows end, the last included. places: ascending, no gap over length; costs: of ending there."""
    c, cost = [0, *places.tolist()], [0, *costs.tolist()]
    n = len(c)
    best, back = [0] * n, [0] * n
    at = dict(zip(c, range(n), strict=True))
    powers = [p for p in (1 << k for k in range(length.bit_length())) if LEAST_POWER <= p < length]
    queue, head = [0], 0
    value = [0] * n
    for j in range(1, n):
        here = c[j]
        while c[queue[head]] < here - length:
            head += 1
        i = queue[head]
        b = value[i] + length - here
        for p in powers:
            k = at.get(here - p)
            if k is not None and best[k] < b:
                b, i = best[k], k
        best[j] = b = b + cost[j]
        back[j] = i
        value[j] = v = b + here
        while len(queue) > head and value[queue[-1]] >= v:
            queue.pop()
        queue.append(j)
    ends, j = [], n - 1
    while j:
        ends.append(c[j])
        j = back[j]
    return ends[::-1]


def pack_stream(docs: Iterator[tuple[object, np.ndarray]], ends_sentence: np.ndarray, length: int = LENGTH) -> Iterator[tuple]:
    """(id, start, ids, tokens of the document, window, offset) of each piece. docs: (id, ids without end id)."""
    held: list[list] = []  # id, ids, place in the document, tokens of the document
    tokens = window = 0

    def windows(last: bool) -> Iterator[tuple]:
        nonlocal held, tokens, window
        ids = np.concatenate([h[1] for h in held])
        doc_ends = np.cumsum([len(h[1]) for h in held])
        may = ends_sentence[ids]
        cost = np.full(len(ids), SENTENCE_COST)
        may[doc_ends - 1] = True
        cost[doc_ends - 1] = 0
        places = np.flatnonzero(may) + 1
        gaps = np.diff(places, prepend=0)
        wide = np.flatnonzero(gaps > length)
        forced = [np.arange(places[k] - gaps[k] + STEP, places[k], STEP) for k in wide]
        if forced:
            forced = np.concatenate(forced)
            cost[forced - 1] = FORCED_COST
            places = np.sort(np.concatenate([places, forced]))
        ends = plan(places, cost[places - 1], length)
        if not last:
            ends.pop()
        a = k = 0
        base = 0  # where held[k] begins
        for e in ends:
            start = a
            while a < e:
                doc_id, own, place, total = held[k]
                stop = min(e, base + len(own))
                yield doc_id, place + a - base, own[a - base : stop - base], total, window, a - start
                a = stop
                if a == base + len(own):
                    base, k = a, k + 1
            window += 1
        held = held[k:]
        if held and a > base:
            doc_id, own, place, total = held[0]
            held[0] = [doc_id, own[a - base :], place + a - base, total]
        tokens = len(ids) - a

    for doc_id, own in docs:
        own = np.append(own, np.uint32(END_ID))
        held.append([doc_id, own, 0, len(own)])
        tokens += len(own)
        if tokens >= BLOCK:
            yield from windows(False)
    if held:
        yield from windows(True)


def _texts(batches, encoder: Encoder) -> Iterator[tuple[object, np.ndarray]]:
    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            yield i, encoder.encode(text.as_py() or "")


def _packer(path: str, length: int) -> Callable:
    names = ["id", "start", "ids", "doc_tokens", "sequence_id", "offset"]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches):
        encoder = Encoder(path)
        first = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []
        size = 0
        for i, start, ids, total, window, offset in pack_stream(_texts(batches, encoder), encoder.sentence_ends(), length):
            rows.append((i, start, ids.astype("<u4").tobytes(), total, first + window, offset))
            size += len(ids)
            if size > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, length: int = LENGTH) -> DataFrame:
    """Pieces of documents: id, start, ids (binary, little-endian uint32), doc_tokens, sequence_id, offset.

    A document's ids are the tokenizer's, without special tokens, then END_ID; null and empty texts are END_ID
    alone. Documents stay in the order of their input partition and a partition's last sequence may be short;
    nothing is shuffled. Rows that repeat an id are packed each; a null id stays null. sequence_id is the
    partition's number times 2^32 plus the sequence's number there. An empty table gives an empty result;
    other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(_packer(tokenizer or default_tokenizer(), length), "id long, start long, ids binary, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)


def packed_digests(pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return pieces.select(id_col, "start", (F.octet_length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
