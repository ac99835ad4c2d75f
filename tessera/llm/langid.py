"""Language identification by cross-parsing entropy.

Each language has a suffix automaton of a sample of its text. A text is parsed against it into the longest
phrases that occur in the sample, each from where the last one ends. Phrases times the bits that name one (the
logarithm of the sample's length, but at least that of the alphabet, so that a tiny sample names nothing
cheaply) are the text's cost in that language, and the language of least cost wins.

Automata are stored as displaced rows: a state is the place where its row begins in one shared array, an entry
lies at state + letter and names the state that owns it. Their size follows the sample, whatever the alphabet:
a sample of 40,000 characters of 5,000 letters takes about 2 MB. They are built once, on the driver.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quality import fold

#: A language's sample: pieces of this many characters, as many as the sample's characters allow, from all its texts.
SAMPLE_CHARS, PIECE = 40_000, 500
#: Long texts are parsed in segments of this many characters side by side, then corrected where they meet.
SEGMENT = 256
#: Rounds of correction; texts that still change are parsed from end to end.
ROUNDS = 4
#: Characters worked on at a time; a text counts as a segment at least.
CHUNK = 1 << 20
#: Cells of full rows, 4 bytes each, that a worker holds at most.
DENSE = 1 << 25
FOLDS, HELD_OUT = 4, 2
_LETTER = re.compile(r"[^\W\d_]")


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton that reads every substring of codes; state 0 is the start."""
    moves, link, length = [{}], [-1], [0]
    last = 0
    for c in codes:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return moves


def displaced(moves: list[dict[int, int]], width: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The automaton's rows in one array: entries (owner << 32 | next state), next state by letter from the start, and a state without entries.

    Letters that the sample lacks lead from the start to that last state.
    """
    size = 2 * sum(map(len, moves)) + 4 * width + len(moves) + 64
    used, owned = np.zeros(size, bool), np.zeros(size, bool)
    place = np.zeros(len(moves), np.int64)
    low = 0
    several = sorted((s for s in range(1, len(moves)) if len(moves[s]) > 1), key=lambda s: -len(moves[s]))
    for s in several:
        letters = np.fromiter(moves[s], np.int64)
        at = low
        while True:
            bases = np.arange(at, at + 128)
            if bases[-1] + width >= size:
                used, owned = (np.concatenate([x, np.zeros(size, bool)]) for x in (used, owned))
                size *= 2
            fits = np.flatnonzero(~owned[bases] & ~used[bases[:, None] + letters].any(axis=1))
            if len(fits):
                break
            # Where no row of this size fits, the search goes on behind; states of one letter fill the gaps later.
            at = low = at + 128
        place[s] = base = bases[fits[0]]
        owned[base] = used[base + letters] = True
    alone = [s for s in range(1, len(moves)) if len(moves[s]) == 1]
    room = size + len(moves) + width
    used, owned = (np.concatenate([x, np.zeros(room, bool)]) for x in (used, owned))
    free = iter(np.flatnonzero(~used[width:]) + width)
    kept: list[int] = []
    for s in alone:
        (letter,) = moves[s]
        for k, x in enumerate(kept):
            if not owned[x - letter]:
                entry = kept.pop(k)
                break
        else:
            entry = next(free)
            while owned[entry - letter]:
                if len(kept) < 64:
                    kept.append(entry)
                entry = next(free)
        place[s] = entry - letter
        owned[entry - letter] = used[entry] = True
    spare = iter(np.flatnonzero(~owned))
    for s in range(1, len(moves)):
        if not moves[s]:
            place[s] = base = next(spare)
            owned[base] = True
    between = int(next(spare))
    top = int(max(place.max(), between)) + width + 1
    entries = np.full(top, -1, np.int64)
    for s in range(1, len(moves)):
        for c, to in moves[s].items():
            entries[place[s] + c] = place[s] << 32 | place[to]
    start = np.full(width, between, np.int64)
    for c, to in moves[0].items():
        start[c] = place[to]
    return entries, start, between


def build(samples: dict[str, str]) -> dict:
    """Plain arrays of a Parser. Class 0 is anything but letters, 1 a letter that no sample has."""
    letters = sorted({c for s in samples.values() for c in s.lower() if c.isalpha()})
    classes = np.zeros(0x110000, np.int16 if len(letters) < 32_000 else np.int32)
    classes[[k for k in range(0x110000) if chr(k).isalpha()]] = 1
    for k, c in enumerate(letters):
        classes[ord(c)] = k + 2
    for k, c in enumerate(letters):
        if len(c.upper()) == 1 and classes[ord(c.upper())] == 1:
            classes[ord(c.upper())] = k + 2
    model = {"langs": sorted(samples), "classes": classes, "automata": [], "bits": []}
    coder = Parser(model)
    for lang in model["langs"]:
        codes = coder.codes(samples[lang])
        model["automata"].append(displaced(suffix_automaton(codes.tolist()), len(letters) + 2))
        model["bits"].append(float(np.log2(max(len(codes), len(letters) + 2))))
    return model


class Parser:
    """Parses texts against the samples of all languages.

    Where all languages' states times letters are DENSE at most, rows are laid out in full, which is faster; the parse
    is the same.
    """

    def __init__(self, model: dict):
        self.langs, self.classes, self.automata, self.bits = (model[k] for k in ("langs", "classes", "automata", "bits"))
        cells = sum((np.count_nonzero(np.unique(a[0][a[0] >= 0] >> 32)) + 2) * len(a[1]) for a in self.automata)
        self.steps = [(_full(*a) if cells <= DENSE else _sparse(*a)) for a in self.automata]

    def codes(self, text: str) -> np.ndarray:
        """Classes, runs of class 0 shortened to one."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        out = self.classes[points]
        odd = out == 0
        again = odd[1:] & odd[:-1]
        return out[np.concatenate([[True], ~again])] if again.any() else out

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text in each language."""
        counts = np.array([-(-len(t) // SEGMENT) for t in texts])
        owner = np.repeat(np.arange(len(texts)), counts)
        n = len(owner)
        sizes = np.full(n, SEGMENT)
        filled = counts > 0
        sizes[(np.cumsum(counts) - 1)[filled]] = [len(t) - (c - 1) * SEGMENT for t, c in zip(texts, counts, strict=True) if c]
        flat = np.concatenate([*texts, np.zeros(SEGMENT, np.int16)])
        begins = np.cumsum(sizes) - sizes
        # Segments lie side by side, the longest first.
        order = np.argsort(-sizes, kind="stable")
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        before = np.where(order > 0, place[order - 1], 0)  # where the segment before one's own lies
        follows = np.flatnonzero((order > 0) & (owner[order] == owner[order - 1])) if n else order
        owner, sizes = owner[order], sizes[order]
        codes = flat[begins[order] + np.arange(SEGMENT)[:, None]].astype(np.int32)
        alive = np.searchsorted(-sizes, -np.arange(SEGMENT), side="left").tolist()  # segments longer than k
        out = np.zeros((len(texts), len(self.langs)))
        for j, (step, start) in enumerate(self.steps):
            state, new = np.full(n, start, np.int32), np.zeros((SEGMENT, n), bool)
            for k, m in enumerate(alive):
                if not m:
                    break
                state[:m], new[k, :m] = step(state[:m], codes[k, :m])
            found = new.sum(axis=0)
            if len(follows):
                found = self._corrected(j, codes, sizes, follows, before, owner, texts, new, state, found)
            out[:, j] = np.bincount(owner, found, minlength=len(texts))
        return out

    def _corrected(self, j, codes, sizes, follows, before, owner, texts, new, ends, found):
        """Phrases that begin in each segment when the parse goes on from the segment before.

        A parse that goes on soon begins a phrase where the segment's own parse did; from there both agree.
        Where it doesn't before the segment's end, the next segment goes on from another state, and so on.
        """
        step, _ = self.steps[j]
        left = np.cumsum(new[::-1], axis=0, dtype=np.int32)[::-1]  # phrases that begin at k or later
        found, after = found.copy(), ends.copy()
        came = np.full(len(ends), -1, np.int64)  # the state a segment was last entered with
        for _ in range(ROUNDS):
            at = follows[came[follows] != after[before[follows]]]
            if not len(at):
                return found
            came[at] = state = after[before[at]]
            count, size = np.zeros(len(at), np.int64), sizes[at]
            for k in range(SEGMENT):
                if size[-1] <= k:  # the shortest come last
                    over = size <= k
                    found[at[over]], after[at[over]] = count[over], state[over]
                    at, state, count, size = at[~over], state[~over], count[~over], size[~over]
                    if not len(at):
                        break
                state, begins = step(state, codes[k, at])
                met = begins & new[k, at]
                if met.any():
                    found[at[met]], after[at[met]] = count[met] + left[k, at[met]], ends[at[met]]
                    more = ~met
                    at, state, count, size, begins = at[more], state[more], count[more], size[more], begins[more]
                    if not len(at):
                        break
                count += begins
            found[at], after[at] = count, state
        for i in np.unique(owner[follows[came[follows] != after[before[follows]]]]):
            mine = np.flatnonzero(owner == i)
            found[mine] = 0
            found[mine[0]] = whole_parse(self.automata[j], texts[i])
        return found

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        coded = [self.codes(t) for t in texts]
        cost = self.phrases(coded) * np.array(self.bits) * np.log(2)
        out = []
        for t, codes, row in zip(texts, coded, cost, strict=True):
            if not (codes > 0).any() and not _LETTER.search(t):
                out.append(("und", 0.0))
                continue
            best = int(row.argmin())
            out.append((self.langs[best], float(1 / np.exp(np.maximum(row[best] - row, -700)).sum())))
        return out


def _sparse(entries: np.ndarray, start: np.ndarray, between: int):
    """A step (the states after one more letter each, and whether it begins a phrase) on displaced rows, and its first state."""
    start = start.astype(np.int32)

    def step(state: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v = entries.take(state + codes)
        begins = (v >> 32) != state
        return np.where(begins, start.take(codes), v.astype(np.int32)), begins

    return step, between


def _full(entries: np.ndarray, start: np.ndarray, between: int):
    """The same on full rows: an entry is the next state's row, times 2, plus 1 where a phrase begins."""
    width, held = len(start), np.flatnonzero(entries >= 0)
    owner, then = entries[held] >> 32, entries[held] & 0xFFFFFFFF
    names = np.unique(np.concatenate([owner, then, start, [between]]))
    row = np.zeros(names[-1] + 1, np.int64)
    row[names] = np.arange(len(names)) * width
    table = np.tile(row[start] * 2 + 1, len(names))
    table[row[owner] + held - owner] = row[then] * 2
    table = table.astype(np.int32)

    def step(state: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v = table.take(state + codes)
        return v >> 1, (v & 1).view(np.int32).astype(bool)

    return step, int(row[between])


def whole_parse(automaton: tuple, codes: np.ndarray) -> int:
    """Phrases of one text, letter by letter."""
    entries, start, state = automaton
    n, take, first = 0, entries.item, start.tolist()
    for c in codes.tolist():
        v = take(state + c)
        if v >> 32 == state:
            state = v & 0xFFFFFFFF
        else:
            n, state = n + 1, first[c]
    return n


def samples(docs: DataFrame, chars: int = SAMPLE_CHARS, piece: int = PIECE) -> dict[str, str]:
    """Text of each language: of all pieces of its texts outside the held-out fold, the first by a hash of id and place.

    A text of any length has ceil(length / piece) pieces, so each character is as likely to be taken as any other.
    """
    usable = docs.where(F.col("lang").isNotNull() & (F.length("text") > 0) & F.col("doc_id").isNotNull() & (fold("doc_id", FOLDS) != HELD_OUT))
    places = usable.select("lang", "doc_id", F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / piece).cast("int"))).alias("k"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64(F.col("doc_id").cast("string"), "k"), "doc_id", "k")
    # Ranks above the bound go before the exchange, so a hot language sends few rows.
    most = -(-chars // piece)
    chosen = places.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).groupBy("lang", "doc_id", "k").agg(F.min("rank").alias("rank"))
    cut_out = F.substring(F.col("text"), F.col("k") * piece + 1, F.lit(piece))
    taken = usable.join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("lang", "rank").agg(F.max(cut_out).alias("text"))
    out: dict[str, str] = {}
    for r in sorted(taken.collect(), key=lambda r: (r.lang, r["rank"])):
        out[r.lang] = f"{out.get(r.lang, '')} {r.text}"
    return out


def _predictor(shared):
    def run(batches):
        parser = Parser(shared.value)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            lo = 0
            while lo < batch.num_rows:
                some, size = [], 0
                while lo + len(some) < batch.num_rows and (not some or size < CHUNK):
                    some.append(texts[lo + len(some)].as_py() or "")
                    size += max(SEGMENT, len(some[-1]))
                said = parser.predict(some) if parser.langs else [("und", 0.0)] * len(some)
                yield pa.RecordBatch.from_arrays([ids.slice(lo, len(some)), pa.array([x[0] for x in said], pa.string()), pa.array([x[1] for x in said], pa.float64())], names=["id", "lang_pred", "score"])
                lo += len(some)

    return run


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", chars: int = SAMPLE_CHARS) -> DataFrame:
    """One row per row of docs: id, held_out, lang_pred, score (0 to 1).

    Null texts and those without a letter are 'und' with score 0, as is every text where no row has a language.
    A text is parsed whole, whatever its length. Equal costs go to the language that sorts first. Repeated rows
    come out alike; other columns are ignored; an empty table gives an empty result. The sample (chars for each
    language) is collected: the driver holds chars times the number of languages.
    """
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    shared = docs.sparkSession.sparkContext.broadcast(build(samples(named, chars)))
    out = named.select("doc_id", "text").mapInArrow(_predictor(shared), f"id {dict(named.dtypes)['doc_id']}, lang_pred string, score double")
    return out.select(F.col("id").alias(id_col), (fold("id", FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")
