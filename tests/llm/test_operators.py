"""Operators against brute force, and their defined results on odd input."""

import hashlib
import random
import re
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))
from oracle import same  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tessera.llm import exact, langid, lines, lm, mix, near, packing, pii, quality, vectors  # noqa: E402
from tessera.llm.components import components  # noqa: E402
from tessera.llm.queries import ORACLE_SQL, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
SF10 = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, rep string, size string"
WORD = "[^\x20\x09-\x0d]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(autouse=True)
def short_start(monkeypatch):
    """A short start of the language model, where its quality isn't looked at."""
    monkeypatch.setattr(lm, "INIT_STEPS", 30)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty, wordless and long texts, ties, repeated rows, clashing columns."""
    long = " ".join(f"w{i % 5003}" for i in range(30_000))
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", "a"), (4, "ABC def", "en", None), (5, "abc DEF", "en", "b"), (5, "abc DEF", "en", "b"),
            (None, "abc def", None, "b"), (None, None, None, None), (6, long, "en", "b"), (7, long + " x", "fr", "b"), (8, "ÄB ab\nÄB ab\n\n1", "fr", "b")]
    return spark.createDataFrame([(i, t, g, s, None, 9, "r", "s") for i, t, g, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(2, 1, 0), (3, 0, 0), (3, 1, 0), (6, 1, 0), (None, 1, 1), (99, None, 0)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    same(spark, QUERIES[name], ORACLE_SQL[name], SF)


def test_empty_tables(none, labels, spark):
    out = [exact.exact_groups(none), exact.unique_rows(none), mix.mix_counts(none), mix.mix(none), lines.dedup_lines(none), near.near_duplicates(none), packing.pack(none),
           quality.quality_scores(none, labels), quality.keep_quality(none, labels.limit(0)), langid.languages(none), lm.lm_scores(none), pii.personal_data(none),
           vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"))]
    assert [df.count() for df in out] == [0] * len(out)


def test_exact_odd(odd):
    got = {(r.doc_id, r.text_sha256): r for r in exact.exact_groups(odd).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert exact.exact_groups(odd).count() == 11
    assert (got[4, sha("abc def")].keep_id, got[4, sha("abc def")].group_size, got[4, sha("abc def")].kept) == (5, 4, False)
    assert got[2, sha("")].kept and not got[1, sha("")].kept and not got[None, sha("")].kept
    assert sha("Äb ab\nÄb ab\n\n1") == got[8, sha("Äb ab\nÄb ab\n\n1")].text_sha256
    kept = sorted(r.doc_id for r in exact.unique_rows(odd).collect())
    assert kept == [2, 3, 5, 6, 7, 8] and exact.unique_rows(odd).columns == odd.columns


def test_mix_targets_and_odd(odd, spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 200), (None, 5), ("d", 0)], "source string, size long")
    got = {r.source: r for r in mix.source_targets(sizes).collect()}
    weight, size = {"a": 1, "b": 2, "c": 3, "d": 1, None: 2}, {"a": 10, "b": 1000, "c": 200, "d": 0, None: 5}
    target, free, rest = {}, set(size), float(sum(size.values()))
    while over := [s for s in free if rest * weight[s] / sum(weight[x] for x in free) > 3 * size[s]]:
        for s in over:
            target[s] = 3.0 * size[s]
        free -= set(over)
        rest -= sum(target[s] for s in over)
    target |= {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
    assert {s: pytest.approx(t) for s, t in target.items()} == {s: r.target for s, r in got.items()}
    rows = mix.mix_counts(odd).collect()
    assert len(rows) == 11 and all(0 <= r.taken <= 3 * r.size for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, mix.mix_counts(odd).collect()))
    assert mix.mix(odd).count() == sum(r.copies for r in rows)


def test_mix_nears_targets(spark):
    rows = mix.mix_counts(spark.read.parquet(f"{SF}/documents.parquet"))
    per = rows.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("w"), F.max("size").alias("m")).collect()
    assert all(abs(r.t - r.w) <= r.m for r in per)


def test_lines(odd, spark):
    got = {r.doc_id: r for r in lines.dedup_lines(odd).collect()}
    assert got[1].text == "" and got[8].n_lines == 4
    body = "\n".join(f"line {i}" for i in range(40))
    docs = spark.createDataFrame([(1, body), (2, "new first\n" + body + "\nand last"), (3, body.replace("line 20", "other"))], "doc_id long, text string")
    rows = {r.doc_id: r for r in lines.dedup_lines(docs).collect()}
    assert rows[1].text == body and rows[2].removed_lines > 25 and rows[3].removed_lines > 20


def test_near_odd_and_brute_force(odd, spark):
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near.near_duplicates(odd).collect()]
    assert len(got) == 11 and (1, 0, 1, True) in got and (5, 1, 4, False) in got and (None, 1, 4, False) in got and (None, 0, None, True) in got
    assert [g[2] for g in got if g[0] == 7] == [6]
    rng = random.Random(5)
    texts = []
    for _ in range(30):
        base = [rng.choice("abcdefghijklmnop") * rng.randint(1, 4) for _ in range(rng.randint(1, 120))]
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = str(rng.random())
            texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)})
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    rows = near.near_duplicates(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == {i: (len(sets[i]), find(i)) for i in range(len(texts))}


def test_layout_meets_every_pair_within_distance():
    plan = near.layout()
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**16, (200, near.HASHES)).astype(np.uint16)
    b = a.copy()
    for row in b:
        row[rng.choice(near.HASHES, near.DISTANCE, replace=False)] ^= 1
    assert (near.keys_of(a, plan) == near.keys_of(b, plan)).any(axis=1).all()
    assert len(near.key_masks(plan)) == near.keys_of(a, plan).shape[1]


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (9, 3), (5, 6), (7, 7)], "a long, b long")
    assert {r.id: r.component for r in components(links).collect()} == {1: 1, 2: 1, 3: 1, 9: 1, 5: 5, 6: 5}


def check_pieces(pieces, texts):
    encoder = packing.Encoder(packing.default_tokenizer())
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == set(texts)
    for i, text in texts.items():
        ids = np.array(encoder.tokenizer.encode(text, add_special_tokens=False).ids + [packing.END_ID], "<u4")
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for some in by_sequence.values():
        at = 0
        for p in sorted(some, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= packing.LENGTH
    return by_sequence


def test_packing_round_trip(odd, spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    by_sequence = check_pieces(packing.packed_digests(packing.pack(docs)).collect(), texts)
    sizes = [sum(p.length for p in some) for some in by_sequence.values()]
    padding = sum(packing.LENGTH - n for n in sizes if n & (n - 1))
    assert padding < 0.02 * sum(sizes) + packing.LENGTH
    unique = odd.where("doc_id <> 5")
    check_pieces(packing.packed_digests(packing.pack(unique)).collect(), {r.doc_id: r.text or "" for r in unique.collect()})


def test_encoder_equals_library():
    encoder, rng = packing.Encoder(packing.default_tokenizer()), random.Random(2)
    for _ in range(2000):
        t = "".join(rng.choice("abcdé ñ.,\n\t 日😀’'s_=A1") for _ in range(rng.randint(0, 40)))
        assert encoder.encode(t).tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids
    for t in ("<|endoftext|> x", " " * 60_000 + "a"):
        assert encoder.encode(t).tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids


def test_plan_is_optimal():
    rng = np.random.default_rng(4)
    for _ in range(20):
        places = np.cumsum(rng.integers(1, 200, 30))
        costs = rng.integers(0, 9, 30)
        c, best = [0, *places.tolist()], [0]
        powers = {p for p in (256, 512) if p < 600}
        for j in range(1, 31):
            best.append(costs[j - 1] + min(best[i] + (0 if c[j] - c[i] in powers else 600 - (c[j] - c[i])) for i in range(j) if c[j] - c[i] <= 600))
        ends = packing.plan(places, costs, 600)
        total, a = 0, 0
        for e in ends:
            total += (0 if e - a in powers else 600 - (e - a)) + costs[list(places).index(e)]
            a = e
        assert total == best[-1]


def test_quality(odd, labels, spark):
    rows = quality.quality_scores(odd, labels).collect()
    assert len(rows) == 11 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert quality.keep_quality(odd, labels).columns == odd.columns
    assert {r.score for r in quality.quality_scores(odd, labels.limit(0)).collect()} == {0.5}
    sf = "/root/testdata/sf0.01"
    scored = QUERIES["op5_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (scored.predicted == scored.quality).mean() > 0.9


def test_languages(odd, spark):
    rows = {(r.doc_id, r.score): r for r in langid.languages(odd).collect()}
    assert len(rows) >= 9 and rows[1, 0.0].lang_pred == "und" and rows[3, 0.0].lang_pred == "und"
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op6_language"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97


def phrases(text, sample):
    """Greedy longest phrases by substring search."""
    n, i = 0, 0
    while i < len(text):
        j = i + 1
        while j <= len(text) and text[i:j] in sample:
            j += 1
        n, i = n + 1, max(j - 1, i + 1)
    return n


def test_phrases_equal_brute_force():
    rng = random.Random(8)
    samples = {"x": "abcabcd", "y": "bbbb", "z": "".join(rng.choice("abcde") for _ in range(3000)), "w": "aaaaaaa"}
    parser = langid.Parser(langid.build(samples))
    # Texts of many segments: random, periodic (never in step with a segment), verbatim pieces, and with unseen letters.
    texts = ["abcabcab", "bbbbbbbb", "dabzabc", "", "b" * 10_001, "a" * 9_000 + "b", "".join(rng.choice("abcde") for _ in range(12_000)), samples["z"][7:2900],
             "".join(rng.choice("abcdeqé") for _ in range(2_000)), "abc" * 4_000]
    found = parser.phrases([parser.codes(t) for t in texts])
    for k, lang in enumerate(parser.langs):
        assert found[:, k].tolist() == [phrases(t, samples[lang]) for t in texts]
        assert [langid.whole_parse(parser.automata[k], parser.codes(t)) for t in texts] == found[:, k].tolist()


def test_languages_of_long_rows_and_tiny_samples(spark):
    rng = random.Random(4)
    text = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(n))
    rows = [(i, text("abcdeimnrst", 6_000), "long") for i in range(8)] + [(100 + i, text("opqruvwxyz", 60), "short") for i in range(200)]
    # A language whose training texts are next to nothing wins nothing.
    rows += [(1000 + i, "ok", "tiny") for i in range(8)]
    got = langid.languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    said = {r.doc_id: r.lang_pred for r in got}
    assert all(said[i] == lang for i, _, lang in rows if lang != "tiny")


def test_automata_stay_small():
    rng = random.Random(2)
    letters = [chr(0x4E00 + i) for i in range(5_000)]
    model = langid.build({"zh": "".join(rng.choice(letters) for _ in range(20_000))})
    assert sum(a[0].nbytes + a[1].nbytes for a in model["automata"]) < 4_000_000


def test_lm_base_and_probabilities(odd, spark):
    rows = lm.lm_scores(odd).collect()
    assert len(rows) == 11 and all(r.score <= 0 for r in rows)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    words = {i: re.findall(WORD, (t or "").translate(LOWER)) + [None] for i, t in docs.items()}
    counts = {}
    for i, w in words.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            for x in w:
                counts[x] = counts.get(x, 0) + 1
    total = sum(counts.values())
    for r in QUERIES["op7_lm_score"](spark, SF).collect():
        base = sum(np.log10((counts.get(x, 0) + 0.5) / (total + 0.5 * (len(counts) + 1))) for x in words[r.doc_id])
        assert r.base_score == pytest.approx(base) and r.n_tokens == len(words[r.doc_id]) and r.n_known == sum(x in counts for x in words[r.doc_id]) and r.train_tokens == total
    w = lm.prepared(lm.start_weights())
    x = np.tile(np.arange(lm.HALF, dtype=np.int32), (lm.SLOTS, 1))
    y = np.repeat(np.arange(lm.SLOTS, dtype=np.int32)[:, None], lm.HALF, axis=1)
    p = np.exp(lm.log_probabilities(w, x, y, np.ones(lm.SLOTS, bool)))
    assert p.sum(axis=0) == pytest.approx(1, abs=1e-3)


BASE = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def base_spans(text):
    out = []
    for kind, pattern in BASE:
        for m in re.finditer(pattern, text):
            d = [int(c) for c in m[0] if c in "0123456789"]
            luhn = sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d[::-1])) % 10 == 0
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_pii(odd, spark):
    assert pii.span_digests(pii.personal_data(odd)).count() == 11
    rng = random.Random(3)
    parts = ["a", "b", "_", "@", ".", "-", "+", "1", "2", "25", "4111111111111111", " ", "\n", "é", "😀", "(", ")", "x@y.z", "1.2.3.4", "+1 (988) 555-2485"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(500)] + ["a" * 100_000, "1 " * 30_000, "a@b.c_x@y.z"]
    # Labels and words teach: 20 e-mails after "mail:", cards whose check fails beside them, secrets after "token =".
    n = len(texts)
    texts += [f"word{i} mail: u{i}@mail.example.com end" for i in range(20)] + [f"pay card=411111111111111{i} 4111 1111 1111 1111 ref" for i in (0, 2, 3)]
    texts += [f'x{i} token = "{hashlib.sha1(str(i).encode()).hexdigest()}" y' for i in range(15)] + ['say token = "Zk9_plain-Word7" y', "later Zk9_plain-Word7"]
    texts += ["see mail: person77-x. here", "again person77-x", "plain 1234567 text", "mail: 4111111111111112 no"]
    rows = pii.span_digests(pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()
    for r in rows:
        assert r.base_sha256 == hashlib.sha256(base_spans(texts[r.doc_id]).encode()).hexdigest()
    spans = {r.doc_id: r.spans for r in rows}
    at = texts.index("see mail: person77-x. here")
    assert spans[at] == "email:10:20" and spans[at + 1] == "email:6:16" and spans[at + 2] == "" and spans[at + 3] == ""
    assert spans[at - 2] == "secret:13:28" and spans[at - 1] == "secret:6:21"
    assert {i: x for i, x in spans.items() if x} == {i: x for i, x in bootstrapped(texts).items() if x}
    assert any(spans[i] != base_spans(texts[i]) for i in range(n, len(texts)))


def bootstrapped(texts):
    """Brute force: all spans of each text, by plain loops."""
    solid, space = "[^\x20\x09-\x0d]", "[\x20\x09-\x0d]"
    base_like = {"email": BASE[0][1], "ip": BASE[1][1], "card": BASE[2][1], "phone": BASE[3][1]}

    def pieces(pattern, text):
        found = list(re.finditer(pattern, text))
        edges = [0, *[x for m in found for x in m.span()], len(text)]
        gaps = [text[edges[2 * i] : edges[2 * i + 1]] for i in range(len(found) + 1)]
        for k, m in enumerate(found):
            before = ((gaps[k - 1][-80:] + found[k - 1][0] if k else "") + gaps[k][-80:])[-80:]
            after = (gaps[k + 1][:40] + (found[k + 1][0] if k + 1 < len(found) else ""))[:40]
            yield m.start(), m.end(), m[0], before, after

    def around(before, after):
        low = lambda x: re.sub(f"{space}+", " ", x).lower()
        left, out = re.sub(f"{solid}*$", "", before), set()
        for name, m in (("in", re.search(r"""([A-Za-z_][A-Za-z_.-]{1,30}[=:])["'(]*$""", before)), ("left", re.search(f"({solid}+){space}+$", left)),
                        ("two", re.search(f"({solid}+{space}+{solid}+){space}+$", left)), ("right", re.match(f"{solid}*{space}+({solid}+)", after))):
            if m:
                out.add((name, low(m[1])))
        return out

    seen = []
    for i, text in enumerate(texts):
        base = []
        for kind, (name, pattern) in enumerate(base_like.items()):
            valid = {tuple(map(int, s.split(":")[1:])) for s in base_spans(text).split(",") if s.startswith(f"{name}:")}
            base += [(i, a, b, s.lower(), kind, kind, False, around(x, y)) for a, b, s, x, y in pieces(pattern, text) if (a, b) in valid]
        for a, b, s, x, y in pieces(pii.TOKEN, text):
            core = re.search(pii.CORE.removeprefix("(?s)"), s, re.S)
            if not core or len(core[0]) < 6:
                continue
            label = re.match(pii.LABEL, core[0])
            skip = core.start() + (label.end() if label else 0)
            value = core[0][label.end() if label else 0 :]
            lo, hi = a + skip, a + skip + len(value)
            if len(value) >= 6 and all(p[2] <= lo or p[1] >= hi for p in base):
                secret = 4 if re.search(pii.SECRET, value) else None
                seen.append((i, lo, hi, value.lower(), None, secret, bool(re.search(pii.REFUSED, value)), around(x + s[:skip], s[skip + len(value) :] + y)))
        seen += base
    seeds = {}
    for r in seen:
        if r[5] is not None:
            seeds[r[3]] = min(r[5], seeds.get(r[3], 9))
    refused = {r[3] for r in seen if r[6]}
    edges = {}
    for r in seen:
        for p in r[7]:
            edges.setdefault(p, {}).setdefault(r[3], 0)
            edges[p][r[3]] += 1
    edges = {p: v for p, v in edges.items() if len(v) >= 3}
    new = {}
    for _ in range(3):
        known = seeds | new
        votes = {}
        for p, values in edges.items():
            total = sum(values.values())
            for kind in set(known.values()):
                mine = [n for v, n in values.items() if known.get(v) == kind]
                if len(mine) >= 3:
                    q, z = sum(mine) / total, 3.0
                    low = (q + z * z / (2 * total) - z * (q * (1 - q) / total + z * z / (4 * total * total)) ** 0.5) / (1 + z * z / total)
                    if low >= 0.5:
                        for v in values:
                            if v not in seeds and v not in refused:
                                votes[v, kind] = votes.get((v, kind), 1.0) * (1 - low)
        new = {}
        for (v, kind), doubt in sorted(votes.items(), key=lambda x: (x[1], x[0][1])):
            new.setdefault(v, kind)
    named = new | {v: k for v, k in seeds.items() if k == 4}
    out = {i: set() for i in range(len(texts))}
    for r in seen:
        if r[4] is not None:
            out[r[0]].add((r[4], r[1], r[2]))
        elif r[3] in named:
            out[r[0]].add((named[r[3]], r[1], r[2]))
    return {i: ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in sorted(x)) for i, x in out.items()}


def test_pii_adds_planted_secrets(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF10}/documents.parquet").collect()}
    rows = QUERIES["op10_pii"](spark, SF10).collect()
    planted = {(i, m.start(1), m.end(1)) for i, t in docs.items() for m in re.finditer('token = "([0-9a-f]{40})"', t)}
    added = {(r.doc_id, *map(int, s.split(":")[1:])) for r in rows for s in r.spans.split(",") if s and s not in base_spans(docs[r.doc_id]).split(",")}
    assert planted and planted <= added and len(added) <= 1.1 * len(planted)


def test_vectors(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(40, 64))
    rows = [(i * 5 + k, (base[i] + k * 0.06 * rng.normal(size=64)).tolist(), i % 3) for i in range(40) for k in range(5)]
    rows += [(500, rows[0][1], 0), (501, rows[0][1], 0), (502, rows[0][1], None), (503, None, 0), (504, [0.0] * 64, 0), (505, [float("nan")] * 64, 0), (506, [None] * 64, 0), (507, [1.0, 2.0], 0), (508, [2.0, 4.0], 0), (509, [], 0)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert len(got) == len(rows) and all(got[i] == (0, i) for i in range(502, 507)) and got[507] == (1, 507) and got[508] == (1, 507)
    ids = [r[0] for r in rows if r[0] < 502]
    x = np.array([r[1] for r in rows if r[0] < 502])
    label = np.array([r[2] for r in rows if r[0] < 502])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near_ = (x @ x.T >= 0.93) & (label[:, None] == label[None, :])
    want = near_.sum(axis=1) - 1
    found = np.array([got[i][0] for i in ids])
    assert (found <= want).all() and found.sum() >= 0.9 * want.sum()


def test_pipeline(spark):
    import corpus_pipeline

    docs, columns = spark.read.parquet(f"{SF}/documents.parquet"), None
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.cut(stage(spark, docs, SF))
        seen.append((name, docs, out))
        columns = columns or docs.columns
        assert name == "pack" or out.columns == columns
        docs = out
    by = {name: (a, b) for name, a, b in seen}
    a, b = by["exact_dedup"]
    keep = {}
    for r in a.collect():
        key = (r.text or "").translate(LOWER)
        keep[key] = max(keep.get(key, -1), r.doc_id)
    assert sorted(r.doc_id for r in b.collect()) == sorted(keep.values())
    a, b = by["near_dedup"]
    assert sorted(r.doc_id for r in b.collect()) == sorted(r.doc_id for r in near.near_duplicates(a, similarity=corpus_pipeline.SIMILARITY, distance=corpus_pipeline.DISTANCE).where("kept").collect())
    a, b = by["mix"]
    assert b.count() == mix.mix_counts(a).agg(F.sum("copies")).first()[0]
    a, b = by["pack"]
    assert b.agg(F.sum("length")).first()[0] == sum(r.doc_tokens for r in packing.pack(a).where("start = 0").collect())


def test_pipeline_near_stage_links_at_80(spark):
    import corpus_pipeline

    words = [f"w{i}" for i in range(104)]
    sets = lambda t: {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
    texts = [words, words[:52] + ["x", "y"] + words[54:], words[:30] + ["x"] + words[31:80] + ["y"] + words[81:]]
    similar = [len(sets(words) & sets(t)) / len(sets(words) | sets(t)) for t in texts[1:]]
    assert 0.85 < similar[0] and 0.8 <= similar[1] < 0.85
    far = words[:20] + ["x"] + words[21:50] + ["y"] + words[51:80] + ["z"] + words[81:]
    assert len(sets(words) & sets(far)) / len(sets(words) | sets(far)) < 0.8
    for other, kept in ((texts[1], [1]), (texts[2], [1]), (far, [1, 2])):
        docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other))], "doc_id long, text string")
        assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()) == kept


def small_blocks(n=6):
    rng = np.random.default_rng(3)
    x, y, first, valid, _ = lm.blocks([rng.integers(0, lm.SLOTS, rng.integers(1, 60)).astype(np.int32) for _ in range(n)])
    return x, y, first, np.concatenate([x[:1], x[:-1]]), valid


def test_lm_gradients_equal_differences():
    x, y, first, before, valid = small_blocks()
    flat = lm.start_weights().astype(np.float32)

    def loss(w):
        return -(lm.log_probabilities(lm.prepared(w.astype(np.float32)), x, y, first) * valid).sum() / valid.sum()

    grad = lm.gradients(flat, x, y, first, before, valid)
    rng = np.random.default_rng(1)
    for name, table in lm.views(np.arange(lm.SIZE)).items():
        direction = np.zeros(lm.SIZE)
        direction[table.reshape(-1)] = rng.normal(size=table.size)
        by = 2e-3 / np.linalg.norm(direction) * max(1, np.sqrt(table.size) / 50)
        measured = (loss(flat + by * direction) - loss(flat - by * direction)) / (2 * by)
        assert measured == pytest.approx(float(grad @ direction), rel=0.06, abs=0.02), name
    outer = lm.gradients(flat, x, y, first, before, valid, inputs=False)
    assert np.allclose(outer[lm.OUTPUT:], grad[lm.OUTPUT:]) and not outer[: lm.OUTPUT].any()


def test_lm_attention_equals_plain_loops():
    x, y, first, _, _ = small_blocks(3)
    w = lm.views(lm.start_weights())
    got = lm.log_probabilities(lm.prepared(lm.start_weights()), x, y, first)
    for block in range(len(x)):
        seen = x[block].tolist() if first[block] else [*x[block - 1].tolist(), *x[block].tolist()]
        lead = len(seen) - lm.HALF
        for i in range(lm.HALF):
            at = lead + i
            weights = np.array([np.exp(w["q"][seen[at]] @ w["kv"][seen[j]][: lm.DIM] / np.sqrt(lm.DIM) + w["far"][min(at - j, 2 * lm.HALF - 1)]) for j in range(at + 1)])
            o = sum(a * w["kv"][seen[j]][lm.DIM :] for j, a in enumerate(weights / weights.sum()))
            z = np.maximum(0, o @ w["o"] + w["u"][seen[at]] + w["b"])
            c, g = w["c"] @ z + w["c0"], y[block, i] // lm.GROUP
            m = w["m"][g] @ z + w["m0"][g]
            want = c[g] - np.log(np.exp(c).sum()) + m[y[block, i] % lm.GROUP] - np.log(np.exp(m).sum())
            assert got[block, i] == pytest.approx(want, abs=1e-4)


def test_lm_groups_hold_every_slot_once():
    place = lm.alike(np.random.default_rng(2).poisson(1.0, (lm.SLOTS, lm.SLOTS)).astype(float))
    assert sorted(place.tolist()) == list(range(lm.SLOTS)) and place[0] == 0
    assert sorted(lm.alike(np.zeros((lm.SLOTS, lm.SLOTS))).tolist()) == list(range(lm.SLOTS))


def test_lm_is_the_same_in_any_layout_and_beats_the_base(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD", 150_000)  # several shards
    monkeypatch.setattr(lm, "INIT_STEPS", 900)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    a, b = ({r.doc_id: r for r in lm.lm_scores(d).collect()} for d in (docs.repartition(7, "source"), docs.coalesce(1)))
    assert a.keys() == b.keys()
    assert all(a[i].score == pytest.approx(b[i].score, rel=1e-3) and a[i].base_score == pytest.approx(b[i].base_score) for i in a)
    held = [r for r in a.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_learns_from_all_training_documents(spark, monkeypatch):
    path, order = packing.default_tokenizer(), lambda i: hashlib.md5(str(i).encode()).hexdigest()
    encoder, size = packing.Encoder(path), lm._vocabulary(path)
    texts = {i: "zyxomma quorvat " * 40 if int(order(i)[:4], 16) % 16 else "plain words" for i in range(3000)}
    coded = [(i, encoder.encode(t).astype(lm.stored(size)).tobytes()) for i, t in texts.items()]
    docs = spark.createDataFrame(coded, "id long, ids binary").coalesce(1)
    monkeypatch.setattr(lm, "INIT_STEPS", 1)
    seen = []
    averaged = lm._averaged

    def watched(learned, shards, otherwise):
        seen.append(learned.where("part = 0").agg(F.sum("weight")).first()[0])
        return averaged(learned, shards, otherwise)

    monkeypatch.setattr(lm, "_averaged", watched)
    of, _, _ = lm.fit_model(docs, size)
    assert (of[encoder.encode("zyxomma quorvat ")] != of[-1]).all()
    assert seen[-1] == sum(len(ids) // 2 + 1 for _, ids in coded)


def test_lm_steps_use_one_array_for_gradients():
    x, y, first, before, valid = small_blocks()
    flat = lm.start_weights()
    again = np.full(lm.SIZE, np.float32(7))
    assert lm.gradients(flat, x, y, first, before, valid, out=again) is again
    assert np.array_equal(again, lm.gradients(flat, x, y, first, before, valid))
    before_ = again[: lm.OUTPUT].copy()
    lm.gradients(flat, x[:1], y[:1], first[:1], before[:1], valid[:1], inputs=False, out=again)
    assert np.array_equal(again[: lm.OUTPUT], before_)
    assert np.array_equal(again[lm.OUTPUT :], lm.gradients(flat, x[:1], y[:1], first[:1], before[:1], valid[:1], inputs=False)[lm.OUTPUT :])


def test_encoder_of_many_texts_gives_the_same_ids():
    encoder, rng = packing.Encoder(packing.default_tokenizer()), np.random.default_rng(4)

    def same_ids(texts):
        data = [t.encode() for t in texts]
        ids, ends = encoder.encode_all(b"".join(data), np.cumsum([0, *map(len, data)]))
        assert len(ends) == len(texts) + 1 and ends[-1] == len(ids)
        for i, t in enumerate(texts):
            assert np.array_equal(ids[ends[i] : ends[i + 1]], encoder.encode(t)), t

    some = ["'", "s", "ll", "l", "ve", "re", "t", "S", " ", "  ", "\n", "\t", "\u2003", "é", "漢", "1", "٣", "½", "!", "\u0301", "\0", "\x1c", "\x85", "😀", "<|endoftext|>"]
    for most in (9, len(some) - 2, len(some)):
        for n in (0, 1, 2, 5, 2000):
            same_ids(["".join(rng.choice(some[:most], rng.integers(0, 14))) for _ in range(n)])
    sure = [chr(i) for i in np.flatnonzero(packing.character_classes() != packing.UNSURE) if not 0xD800 <= i < 0xE000]
    assert len(sure) > 50_000
    same_ids([f"a{c}1 {c}{c}! \n{c}b'{c}" for c in sure])
    same_ids([" " * 60_000 + "a", "ab" * 30_000, "'s" * 20_000])
    ids, ends = encoder.encode_all(b"good \xff and", np.array([0, 5, 10]))
    assert np.array_equal(ids[: ends[1]], encoder.encode("good ")) and np.array_equal(ids[ends[1] :], encoder.encode("\ufffd and"))


def test_lm_merges_each_piece_once(monkeypatch):
    class Shared:
        value = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    class Context:
        def partitionId(self):
            return 3

    path, texts = packing.default_tokenizer(), ["The cat's hat\n", None, "", "the CAT's hat. " * 500, "é ß"]
    want = [packing.Encoder(path).encode((t or "").translate(LOWER)).tolist() for t in texts]
    monkeypatch.setattr(lm.TaskContext, "get", lambda: Context())
    monkeypatch.setattr(packing.Encoder, "encode", None)  # text by text
    lm._tools.cache_clear()
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array([True] * 5), pa.array(texts)], names=["id", "train", "text"])
    out = pa.Table.from_batches(lm._encoder(path, Shared, 1.0, "<u2")([batch.slice(0, 3), batch.slice(3)]))
    assert [np.frombuffer(i, "<u2").tolist() for i in out.column("ids").to_pylist()] == want
    assert out.column("row").to_pylist() == [(3 << 40) + i for i in range(5)] and out.column("id").to_pylist() == list(range(5))
    assert sorted(lm._tools(path)[0].known) == sorted([b"the", b" cat", b"'s", b" hat", b"\n", b".", b" the", b" ", "é".encode(), " ß".encode()])
    lm._tools.cache_clear()


def test_lm_large_weights_give_finite_scores():
    x, y, first, _, _ = small_blocks()
    assert np.isfinite(lm.log_probabilities(lm.prepared(lm.start_weights() * np.float32(20)), x, y, first)).all()
