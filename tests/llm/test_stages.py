"""Stages against plain Python: clashing names, hot groups, planted passages, the classifier's solver, the pipeline."""

import hashlib
import random
import re
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))
from pyspark.sql import functions as F  # noqa: E402

from tessera.llm import exact, lines, mix, near, packing, quality, shared  # noqa: E402

SF = "/root/testdata/sf0.001"
WORD = "[^\x20\x09-\x0d]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PRIVATE = ("_sha", "_id", "_norm", "_key", "_salt", "_salts", "_keep", "_n", "_texts", "_copies", "_times", "_copy", "_at", "_rows", "_mid", "_kid", "_bin", "row", "name", "class", "bin", "size", "source_size",
           "target", "offset", "before", "at", "copies", "digest", "id", "sha", "n", "rep", "component", "kept", "score", "y", "a.b")


def clashing(spark, rows):
    """doc_id, text, source and a column of every private name, which holds its name and the id."""
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    return frame.select("*", *[F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in PRIVATE])


def test_columns_of_any_name_survive(spark):
    long = " ".join(f"w{i}" for i in range(200))
    rows = [(1, "Ab c", "x", "en", 4), (2, "ab C", "x", None, 4), (3, None, None, "en", None), (4, "", "y", "en", 0), (5, long, "y", "en", 1), (6, long + " z", "y", "en", 1), (6, long + " z", "y", "en", 1), (None, "q", "x", None, 1)]
    docs = clashing(spark, rows)
    labels = spark.createDataFrame([(1, 1), (4, 0)], "doc_id long, quality int")
    for out in (exact.unique_rows(docs), mix.mix(docs), near.distinct_rows(docs), quality.keep_quality(docs, labels)):
        assert out.columns == docs.columns
        for r in out.collect():
            assert all(r[c] == f"{c}:{'-' if r.doc_id is None else r.doc_id}" for c in PRIVATE)
    assert sorted(str(r.doc_id) for r in exact.unique_rows(docs).collect()) == ["2", "4", "5", "6", "None"]
    assert Counter(r.doc_id for r in near.distinct_rows(docs).collect()) == {1: 1, 3: 1, 4: 1, 5: 1, None: 1}
    counts = Counter({str(r.doc_id): 0 for r in mix.mix_counts(docs).collect()})
    for r in mix.mix_counts(docs).collect():
        counts[str(r.doc_id)] += r.copies
    assert Counter(str(r.doc_id) for r in mix.mix(docs).collect()) == +counts


def test_digests_with_two_contents(spark):
    rng = random.Random(1)
    texts = [rng.choice(["a", "b", "c", "A", "dd", "", None]) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain = {r.doc_id: r for r in exact.exact_groups(docs).collect()}
    clash = {r.doc_id: r for r in exact.exact_groups(docs, digest=lambda t: F.length(t).cast("string")).collect()}
    assert plain == clash and len(plain) == 300
    for i, t in enumerate(texts):
        same = [j for j, u in enumerate(texts) if (u or "").lower() == (t or "").lower()]
        assert (plain[i].keep_id, plain[i].group_size, plain[i].kept) == (max(same), len(same), i == max(same))


def test_hot_keys_join_whole(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") < 4000, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    out = shared.salted(rows, groups, "k", "n", F.col("id"))
    assert out.count() == 5000 and out.where("k = 'hot' and n = 4000").count() == 4000 and set(out.columns) == {"id", "k", "n"}


def test_scratch_deletes_what_is_used_up(spark):
    with shared.scratch(spark) as keep:
        a, b = shared.cut(spark.range(3).toDF("x")), shared.cut(spark.range(4).toDF("x"))
        keep.append(b)
    assert b.count() == 4
    with pytest.raises(Exception):
        a.count()
    shared.release(b)


def passages(rng, n_docs, length):
    """Documents of lines of their own, half of which hold one passage of `length` lines; which lines the passage has."""
    passage = [f"shared {length} {i} {rng.random()}" for i in range(length)]
    docs = []
    for d in range(n_docs):
        own = [f"own {d} {i} {rng.random()}" for i in range(rng.randint(3, 12))]
        at = rng.randint(0, len(own))
        docs.append("\n".join(own[:at] + (passage if d % 2 == 0 else []) + own[at:]))
    return docs, passage


def test_passages_are_found_by_length(spark):
    """Share of repeated passages of which some part is removed, and nothing is lost: see the README's figures."""
    rng = random.Random(3)
    texts, planted = [], {}
    for length in (2, 3, 4, 5, 8, 12):
        for _ in range(25):
            docs, passage = passages(rng, 4, length)
            planted.setdefault(length, []).append((len(texts) + 2, passage))
            texts += docs
    rows = {r.doc_id: r for r in lines.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    kept = {line for r in rows.values() for line in r.text.split("\n")}
    assert kept >= {line for t in texts for line in t.split("\n")}
    for i, t in enumerate(texts):
        left = rows[i].text.split("\n")
        assert all(line.startswith("shared") for line in (Counter(t.split("\n")) - Counter(left)))
        assert rows[i].n_lines == len(t.split("\n")) and rows[i].removed_lines == rows[i].n_lines - (len(left) if rows[i].text else 0)
    found = {length: np.mean([any(x not in rows[i].text.split("\n") for x in p) for i, p in some]) for length, some in planted.items()}
    covered = {length: np.mean([np.mean([x not in rows[i].text.split("\n") for x in p]) for i, p in some]) for length, some in planted.items()}
    print("found", found, "covered", covered)
    assert found[12] >= 0.95 and found[8] >= 0.9 and found[5] >= 0.55 and covered[12] >= 0.6


def test_chunk_digests_with_two_contents(spark):
    rng = random.Random(9)
    docs = spark.createDataFrame([(i, "\n".join(rng.choice("abc") for _ in range(rng.randint(0, 12)))) for i in range(80)], "doc_id long, text string")
    plain = sorted(map(tuple, lines.dedup_lines(docs).collect()))
    assert plain == sorted(map(tuple, lines.dedup_lines(docs, digest=lambda c: F.length(c).cast("string")).collect())) and any(r[-1] for r in plain)


def test_quality_solver_and_ratios():
    rng = np.random.default_rng(4)
    y = (rng.random(40) < 0.4).astype(np.int64)
    rows = [np.unique(np.concatenate([rng.integers(0, 30, 6), rng.integers(30, 40, 4) + 10 * k])).astype(np.int32) for k in y]
    ratios = quality.log_count_ratios(rows, y)
    counts = [[1 + sum(b in rows[i] for i in range(40) if y[i] == k) for b in range(60)] for k in (0, 1)]
    totals = [sum(c) + quality.BUCKETS - 60 for c in counts]
    assert ratios[:60] == pytest.approx([np.log((counts[1][b] / totals[1]) / (counts[0][b] / totals[0])) for b in range(60)])
    w, bias = quality.dual_coordinate_descent(rows, y, ratios, cost=1.0, epochs=2000)
    x = np.zeros((40, 61))
    for i, r in enumerate(rows):
        x[i, r] = ratios[r] / np.linalg.norm(ratios[r])
    x[:, 60] = 1.0
    sign, caps = np.where(y > 0, 1.0, -1.0), 40 / 2 / np.bincount(y)[y]
    # Projected gradient on the dual, a solver of its own.
    q = (x * sign[:, None]) @ (x * sign[:, None]).T
    alpha, step = np.zeros(40), 1 / np.linalg.eigvalsh(q).max()
    for _ in range(20_000):
        alpha = np.clip(alpha + step * (1 - q @ alpha), 0, caps)
    optimum = alpha.sum() - alpha @ q @ alpha / 2
    mine = np.append(w[:60], bias)
    primal = mine @ mine / 2 + (caps * np.maximum(0, 1 - sign * (x @ mine))).sum()
    assert primal == pytest.approx(optimum, rel=2e-3) and not w[60:].any()
    assert quality.dual_coordinate_descent(rows, y, ratios)[1] == pytest.approx(bias, abs=0.2)


def test_training_takes_the_least_text_of_an_id(spark):
    docs = spark.createDataFrame([(i, t * 40, None) for i in range(20) for t in (("good " if i % 2 else "bad "), "zzz ")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    a, b = (quality.train(d.select("doc_id", "text"), labels) for d in (docs, docs.orderBy(F.desc("text")).repartition(3)))
    assert np.array_equal(a["w"], b["w"]) and a["w"].any()


def uniform(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16) / 4294967296.0


def mixed(docs):
    """doc_id to copies: systematic sampling by plain loops."""
    size = {i: len(re.findall(WORD, t or "")) for i, t, _ in docs}
    of = {}
    for i, _, s in docs:
        of.setdefault(s, []).append(i)
    names = sorted(of, key=lambda s: (s is None, s or ""))
    weight, total = {s: k % 3 + 1 for k, s in enumerate(names)}, {s: sum(size[i] for i in of[s]) for s in names}
    target, free, rest = {}, set(names), float(sum(total.values()))
    while over := [s for s in free if rest * weight[s] / sum(weight[x] for x in free) > 3 * total[s]]:
        for s in over:
            target[s] = 3.0 * total[s]
        free -= set(over)
        rest -= sum(target[s] for s in over)
    target |= {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
    out = {}
    for s in names:
        def place(i):
            bits = f"{size[i]:b}"
            return f"{len(bits):02d}" + bits[: mix.LEADING], int(uniform(f"mix:bin:{i}") * mix.BINS), size[i], i

        ratio, offset = (target[s] / total[s] if total[s] else 0.0), uniform(f"mix:offset:{s or ''}")
        for rank, i in enumerate(sorted(of[s], key=place), 1):
            out[i] = int(np.floor(rank * ratio + offset) - np.floor((rank - 1) * ratio + offset))
    return out, target, total, size


def test_mix_equals_plain_loops_and_nears_its_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out, target, _, _ = mixed([(r.doc_id, r.text, r.source) for r in docs.collect()])
    rows = mix.mix_counts(docs).collect()
    assert {r.doc_id: r.copies for r in rows} == out
    taken, largest = Counter(), {}
    for r in rows:
        taken[r.source] += r.taken
        largest[r.source] = max(largest.get(r.source, 0), r.size)
        assert r.target == pytest.approx(target[r.source]) and r.taken <= 3 * r.size
    assert all(abs(taken[s] - t) <= largest[s] for s, t in target.items())


def test_pipeline_equals_plain_python(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.quality_scores(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("score >= 0.3")
    good = {r.doc_id for r in model.collect()}
    labelled = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert np.mean([(i in good) == bool(k) for i, k in labelled.items()]) > 0.9
    text = {r.doc_id: r.text for r in docs.collect() if r.doc_id in good}
    source = {r.doc_id: r.source for r in docs.collect()}
    last = {}
    for i, t in text.items():
        last[(t or "").translate(LOWER)] = max(i, last.get((t or "").translate(LOWER), i))
    left = sorted(last.values())
    sets = {}
    for i in left:
        w = re.findall(WORD, (text[i] or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    group = {i: i for i in left}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in left:
        for j in left:
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                group[b] = a
    distinct = [i for i in left if root(i) == i]
    copies = {i: n for i, n in mixed([(i, text[i], source[i]) for i in distinct])[0].items() if n}
    pieces = corpus_pipeline.run(spark, SF).collect()
    encoder = packing.Encoder(packing.default_tokenizer())
    ids = {i: len(encoder.encode(text[i] or "")) + 1 for i in copies}
    tokens = Counter()
    for p in pieces:
        tokens[p.doc_id] += p.length
        assert p.doc_tokens == ids[p.doc_id]
    assert tokens == {i: n * ids[i] for i, n in copies.items()}
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for some in sequences.values():
        at = 0
        for offset, length in sorted(some):
            assert offset == at
            at += length
        assert at <= packing.LENGTH
