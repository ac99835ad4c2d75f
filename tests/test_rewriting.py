import copy
import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import coercion, jsontext
from tessera.operators import leases, preserve, resumes, similarity, store
from tessera.operators.preserve import faults, finalized, ungrounded

NAMES = st.sampled_from(["Acme", "acme ", "Beta", "", "Gamma"])
# An entry without id and names can't be told, so each has a name.
NAMED = st.sampled_from(["Acme", "acme ", "Beta", "Gamma"])
ROWS = st.lists(st.sampled_from(["Led a team of 5", "led a team of 5", "Cut cost by 20%", "Cut cost by 30%", "Wrote code", "Cooked soup", "", "- Wrote tests\nand docs"]), max_size=4)
STYLES = st.lists(st.sampled_from(["plain", "bullet", "odd"]), max_size=4)
# Entries have descriptions and styles, as conformed records do.
WORK = st.lists(st.fixed_dictionaries({"company": NAMED, "title": NAMES, "description": ROWS, "descriptionStyles": STYLES}, optional={"id": st.integers(0, 3), "years": NAMES, "location": NAMES}), max_size=4)
EDUCATION = st.lists(st.fixed_dictionaries({"institution": NAMED, "degree": NAMES, "description": st.one_of(st.none(), st.sampled_from(["good at 5 things", "good", " "]))}, optional={"id": st.integers(0, 2)}), max_size=3)
LISTS = st.fixed_dictionaries({}, optional={k: st.lists(st.sampled_from(["SQL", "sql", "Go ", "Java", 3]), max_size=4) for k in coercion.LISTS})
SECTION = st.one_of(st.fixed_dictionaries({"sectionType": st.just("itemList"), "items": st.lists(st.fixed_dictionaries({"title": NAMED, "description": ROWS, "descriptionStyles": STYLES}, optional={"id": st.integers(0, 2)}), max_size=3)}),
                    st.fixed_dictionaries({"sectionType": st.just("text"), "text": NAMES}), st.just("odd"))
RECORDS = st.fixed_dictionaries({}, optional={"summary": st.one_of(NAMES, st.just(["x"])), "personalInfo": st.just({"name": "A"}), "workExperience": WORK, "education": EDUCATION, "additional": LISTS,
                                              "customSections": st.dictionaries(st.sampled_from("ab"), SECTION, max_size=2)})


@settings(max_examples=150, deadline=None)
@given(RECORDS.map(coercion.conformed), RECORDS, st.booleans(), st.booleans())
def test_final_records_keep_the_contract(source, candidate, review, append):
    before = copy.deepcopy((source, candidate))
    out = finalized(source, candidate, review, append)
    assert (source, candidate) == before
    lists = [(k, source[k]) for k in preserve.KINDS] + [("items", s["items"] or []) for s in source["customSections"].values()]
    if all(len({preserve.names(e, k) for e in some}) == len(some) == len({e["id"] for e in some} - {0}) for k, some in lists):
        assert finalized(source, out, review, append) == out  # where names and ids tell entries apart, once is enough
    for kind in preserve.KINDS:
        was = [e for e in source.get(kind, []) if isinstance(e, dict)]
        # Every source entry is there once, with all that has to stay.
        kept = lambda e: json.dumps({k: e[k] for k in preserve.KEPT[kind] if k in e}, sort_keys=True)
        assert sorted(map(kept, was)) == sorted(map(kept, out[kind]))
    if not review and not append:
        text = lambda r: [x for e in r.get("workExperience", []) for x in e.get("description", [])]
        assert not [p for p in ungrounded(source, out) if not p.startswith("customSections")] or text(source) != text(out)


def test_contract_codes():
    source = {"summary": "s", "workExperience": [{"id": 1, "company": "A", "description": ["a", "b"], "descriptionStyles": ["plain"]}], "additional": {"technicalSkills": ["x"], "awards": ["y"]},
              "customSections": {"k": {"sectionType": "text", "text": "t"}, "i": {"sectionType": "itemList", "items": [{"title": "q"}]}}}
    assert faults(source, copy.deepcopy(source) | {"workExperience": [source["workExperience"][0] | {"descriptionStyles": ["plain", "bullet"]}]}) == []
    assert faults(source, {}) == ["summary", "workExperience.entries", "customSections", "additional.technicalSkills", "additional.awards"]
    new = copy.deepcopy(source)
    new["workExperience"][0] |= {"company": "B", "descriptionStyles": ["plain", "bullet"]}
    new["additional"]["awards"].append("z")
    new["additional"]["technicalSkills"].append("z")
    new["customSections"]["k"]["text"] = "u"
    new["customSections"]["i"]["sectionType"] = "text"
    assert faults(source, new) == ["workExperience.identity", "customSections.k.content", "customSections.i.sectionType", "additional.awards"]
    new["workExperience"][0] |= {"company": "A", "descriptionStyles": ["bullet", "plain"]}
    assert "workExperience.descriptions" in faults(source, new)
    new["workExperience"][0] |= {"description": ["a", "b", "c"], "descriptionStyles": ["plain", "bullet", "bullet"]}
    assert "workExperience.descriptions" in faults(source, new) and "workExperience.descriptions" not in faults(source, new, append=True)


def test_pairs_by_id_name_and_likeness():
    pair = lambda a, b: preserve.paired(a, b, "workExperience")
    assert pair([{"id": 1}, {"id": 2}], [{"id": 2}, {"id": 2}, {"id": 9, "company": "x"}]) == [1, None, None]
    twins = [{"company": "A", "description": ["x y z"]}, {"company": "a ", "description": ["led teams"]}]
    assert pair(twins, [{"company": "A", "description": ["led team"]}, {"company": "A"}]) == [1, 0]
    assert pair([{}], [{}]) == [None]


def test_grounding():
    source = {"summary": "Builds data platforms", "workExperience": [{"id": 1, "description": ["Led a team of engineers", "Wrote code"]}]}
    new = {"summary": "Cooks", "workExperience": [{"id": 1, "description": ["wrote  CODE", "Sang in a choir abroad", "Led a team of engineers"]}]}
    assert ungrounded(source, new) == ["summary", "workExperience[0].description[1]"]
    assert ungrounded(source, source) == []


@pytest.mark.parametrize("value,text,rows", [
    (None, "", []), (" a\nb ", "a\nb", ["a", "b"]), (5, "5", ["5"]), (True, "True", ["True"]), ({"x": "u", "name": "n", "text": ["t", {"label": "l"}]}, "t l n", ["t l n"]),
    ({"x": {"y": "deep"}, "z": ""}, "deep", ["deep"]), (["- one\r\n\n2. two", None, {"value": " v "}, ["p", "q"]], "- one\r\n\n2. two v p q", ["one", "two", "v", "p q"]), ({"text": " "}, "", [])])
def test_coercion(value, text, rows):
    assert coercion.as_text(value) == text and coercion.as_list(value) == rows and coercion.as_optional_text(value) == (text or None)


def test_coercion_depth_and_names():
    deep = "x"
    for _ in range(12):
        deep = [deep]
    assert coercion.as_text(deep) == "" and coercion.as_text(deep[0][0][0]) == "x"
    assert coercion.named_items([" a ", "", None, 4, {"name": "", "label": " b "}, {"value": " "}, {"other": 1}, {"name": 7}]) == (["a", "b"], 4)
    record = coercion.conformed({"workExperience": [{"id": True, "description": "a\nb", "descriptionStyles": ["plain"]}, "junk"], "education": [{"description": ["x", 1]}], "customSections": {"c": {"sectionType": "itemList", "items": ["t"]}, "d": 3}})
    assert [e["descriptionStyles"] for e in record["workExperience"]] == [["plain", "bullet"], []] and record["education"][0]["description"] == "x 1"
    assert record["customSections"]["c"]["items"][0]["title"] == "t" and record["customSections"]["c"]["items"][0]["id"] == 1 and "d" not in record["customSections"]
    assert coercion.conformed(coercion.conformed(record)) == record and len(record["sectionMeta"]) == 6 and coercion.conformed(None)["summary"] == ""
    assert coercion.clipped_json({"a": "x" * 3000, "b": list(range(50))}, 500) == json.dumps({"a": "x" * 250 + "...[truncated]", "b": [0, 1, 2, 3, 4]})


def test_echoes():
    draft = [{"id": 1, "name": "a", "years": ""}, {"id": 2, "name": "b", "years": ""}]
    merge = lambda echo: [(e.get("id"), e["name"]) for e in preserve.echoed(draft, echo, "personalProjects")]
    assert merge([{"id": 2, "name": "B2"}]) == [(1, "a"), (2, "B2")]
    assert merge([{"name": "B", "years": ""}]) == [(1, "a"), (2, "B")]
    assert merge([{"id": 0, "name": "b"}]) == [(1, "a"), (2, "b"), (0, "b")]
    assert merge([{"id": 0, "name": "b"}, {"name": "A"}]) == [(1, "A"), (2, "b")]
    assert merge([{"id": 7, "name": "c"}]) == [(1, "a"), (2, "b"), (0, "c")]
    out = preserve.section_merged({"workExperience": [{"id": 3, "title": "x"}], "summary": "s"}, {"workExperience": [{"title": "y"}], "summary": "t"}, "internships")
    assert [(e["id"], e["title"]) for e in out["workExperience"]] == [(3, "x"), (4, "y")] and out["summary"] == "s"
    assert preserve.section_merged({"additional": {"technicalSkills": ["SQL"]}}, {"additional": {"technicalSkills": ["sql", "Go"]}}, "skills", ["go", "C"])["additional"]["technicalSkills"] == ["SQL", "Go", "C"]
    assert preserve.section_merged({"personalInfo": {"name": "A"}}, {"personalInfo": {"name": " ", "email": "x@y"}}, "intro")["personalInfo"]["name"] == "A"


def test_items_by_place():
    record = {"workExperience": [{"title": "D", "company": "C", "description": "one"}], "personalProjects": [{"name": "P", "description": ["x"]}]}
    assert preserve.item_at(record, "exp_0")["current_description"] == ["one"] and preserve.item_at(record, "proj_0")["title"] == "P"
    assert all(preserve.item_at(record, x) == {} for x in ("exp_1", "exp_-1", "job_0", "exp", "exp_x", None))
    assert preserve.enhanced(record, {"exp_0": ["two"], "exp_9": ["no"]})["workExperience"][0]["description"] == ["one", "two"]
    twins = {"workExperience": [{"title": "D", "company": "C", "description": ["a"]}, {"title": "d ", "company": "c", "description": ["b"]}]}
    item = {"item_id": "exp_0", "title": "D", "subtitle": "", "original_content": ["B", " "], "new_content": ["n"]}
    assert [e["description"] for e in preserve.regenerated(twins, [item])["workExperience"]] == [["a"], ["n"]]
    assert preserve.regenerated(twins, [item, item | {"original_content": ["?"]}]) is None and preserve.regenerated(twins, [item | {"title": ""}]) is None


@pytest.mark.parametrize("head,inside", [
    ("", False), ("see [1] and ", False), ("[", True), ("[1, ", True), ('["a", [2], ', True), ("[1 ", False), ("[1,, ", False), ("[note: ", False), ('["open ', True), ('text "quoted" [', True),
    ("[] ", False), ("[[], ", True), ("[1,] ", False), ("[null, true, -1.5e3, ", True), ("[01, ", False), ('["\\"x", ', True), ("]", False), ("[1], [", True)])
def test_objects_in_arrays(head, inside):
    assert jsontext._within_array(head) is inside


def test_within_array_equals_parsing():
    rng = random.Random(7)
    for _ in range(4000):
        head = "".join(rng.choice(["[", "]", ",", " ", "1", '"a"', "x", "null", '"']) for _ in range(rng.randint(0, 9)))
        opened = [at for at, c in []]
        quoted = False
        for at, c in enumerate(head):
            quoted ^= c == '"'
            if not quoted and c == "[":
                opened.append(at)
            elif not quoted and c == "]" and opened:
                opened.pop()
        try:
            want = bool(opened) and isinstance(json.loads(head[opened[0]:] + "{}" + "]" * len(opened)), list)
        except ValueError:
            want = quoted
        assert jsontext._within_array(head) is want, head


@pytest.mark.parametrize("text,kinds", [
    ("Node.js 20 and java 17, v 3", []), ("convex 3", [("", 3)]), ("May 2020", []), ("maya 2020", [("", 2020)]), ("since 2019; in 2020 users", [("", 2020)]), ("2019 – present", []), ("$2,000.50", [("$", 2000.5)]),
    ("in 2020.", []), ("2018/2019", []), ("12018 - 2019", [("", 12018), ("", 2019)]), ("3 k", [("", 3000)]), ("2020x", [("x", 2020)]), ("2019-currently", [("", 2019)])])
def test_claims_by_neighbours(text, kinds):
    assert sorted((k, float(v)) for k, v in similarity.claims(text).elements()) == sorted((k, float(v)) for k, v in kinds)


def test_typed_records(spark):
    entry = "array<struct<id:int,company:string,title:string,years:string,description:array<string>,descriptionStyles:array<string>>>"
    old = [(1, "A", "T", "Jan 2020 - May 2021", ["did 5%", "x"], ["plain"]), (0, "B", None, "2019", [], None)]
    new = [(1, "A ", "T", "2020", ["did 9%", "x", "more words than there were before by far"], None), (0, "C", "U", "2019", [" "], ["plain"]), (0, " ", "", None, None, None)]
    frame = spark.createDataFrame([(old, new, ["SQL", "Go", "go"], ["sql", "Java", "java"])], f"old {entry}, new {entry}, a array<string>, b array<string>")
    o, n, a, b = map(F.col, ("old", "new", "a", "b"))
    r = frame.select(
        F.transform(resumes.restored_years(o, n), lambda e: e["years"]).alias("years"), resumes.change_warnings(o, n).alias("w"), F.transform(resumes.restored_styles(o, n), lambda e: e["descriptionStyles"]).alias("styles"),
        resumes.with_dropped(a, b).alias("dropped"), resumes.merged_list(a, b, False).alias("held"), resumes.merged_list(a, b, True).alias("gained"), resumes.same_entries(o, n).alias("same"),
        resumes.assigned_ids(F.array(F.lit(2), F.lit(0), F.lit(2), F.lit(None), F.lit(5))).alias("ids"), F.size(resumes.with_content(n)).alias("kept"), resumes.any_month(o).alias("m"), resumes.selected_text(n).alias("text")).head()
    assert r.years == ["Jan 2020 - May 2021", "2019", None] and r.styles == [["plain", "bullet", "bullet"], ["plain"], None]
    assert r.w == ["section_count", "identity:1.company", "word_count", "metric:9%"]
    assert r.dropped == ["sql", "Java", "java", "Go"] and r.held == ["sql", "Go", "go"] and r.gained == ["sql", "Java", "java", "Go", "go"]
    assert not r.same and r.ids == [2, 6, 7, 8, 5] and r.kept == 2 and r.m and r.text.startswith("T A  did 9%")


def test_lookups_and_writes(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", None), (2, "b", "x"), (2, "c", "x")], "id int, name string, note string")
    assert store.scan(rows, {"id": 2, "note": None}, ["name"]).count() == 2 and store.scan(rows, {"id": 9}).count() == 0
    assert [r.name for r in store.first_by(rows, ["id"], ["name"]).orderBy("id").collect()] == ["a", "b"]
    assert [r.id for r in store.listing(rows, F.col("name") == "b", "note", ["id"]).collect()] == [2, 1]
    base = rows.where("name <> 'c'").withColumn("updated_at", F.lit(None).cast("timestamp"))
    changes = spark.createDataFrame([(1, {"name": "z", "odd": "q"}), (7, {})], "id int, set map<string,string>")
    after, missing = store.updated(base, changes, "id", F.current_timestamp())
    assert {r.id: (r.name, r.updated_at is None) for r in after.collect()} == {1: ("z", False), 2: ("b", True)} and [r.id for r in missing.collect()] == [7]
    at = store.commit_together(spark, {"a": rows, "b": rows.limit(0)}, str(tmp_path / "s"))
    assert spark.read.parquet(f"{at}/a").count() == 3 and spark.read.parquet(f"{at}/b").columns == rows.columns
    with pytest.raises(Exception):
        store.commit_together(spark, {"a": rows, "bad": rows.select(F.raise_error(F.lit("no")).alias("x"))}, str(tmp_path / "t"))
    assert [p.name for p in (tmp_path / "t").iterdir() if not p.name.startswith(".")] == []
    assert store.inserted(rows, F.current_timestamp(), {}).select("id").distinct().count() == 3


def test_null_keys_stay(spark):
    from tessera.operators import board

    rows = spark.createDataFrame([("a", None, 1), ("a", 5, 2), (None, 7, 3), ("a", None, 4), (None, None, 5)], "g string, k int, t int")
    assert sorted((r.g or "", r.position, r.t) for r in board.placed(rows, "g", "k", "t").collect()) == [("", 0, 5), ("", 1, 3), ("a", 0, 1), ("a", 1, 4), ("a", 2, 2)]
    clustered = spark.range(5000).select(F.lit("x").alias("g"), F.when(F.col("id") < 4990, F.col("id") % 100).otherwise(10**12 + F.col("id")).alias("k"), F.col("id").alias("t"))
    placed = board.placed(clustered, "g", "k", "t").orderBy("position").collect()
    assert [r.position for r in placed] == list(range(5000)) and [(r.k, r.t) for r in placed] == sorted((r.k, r.t) for r in placed)


def test_finalize_compares_rows_once(spark, monkeypatch):
    import pickle

    entry = lambda rows: {"workExperience": [{"id": 1, "company": "A", "description": rows}]}
    source, candidate = entry(["sold 34 planted units", "kept the planted grade"]), entry(["kept a planted grade", "sold 34 planted units quickly"])
    compared, matcher = [], similarity.SequenceMatcher
    monkeypatch.setattr(similarity, "SequenceMatcher", lambda *a: compared.append(a) or matcher(*a))
    first = finalized(source, candidate, False, False)
    for _ in range(20):
        out = finalized(copy.deepcopy(source), copy.deepcopy(candidate), False, False)
        assert out == first and faults(source, out) == [] and finalized(source, out, False, False) == out
    assert 0 < len(compared) == len(set(compared))
    assert similarity.similarity.seen and not pickle.loads(pickle.dumps(similarity.Held(len))).seen
    out["workExperience"][0]["description"].append("x")
    assert source == entry(["sold 34 planted units", "kept the planted grade"])  # what comes out shares nothing
    rows = spark.createDataFrame([(json.dumps(source), json.dumps(candidate)), (None, "no record")], "source string, candidate string")
    done = preserve.finalize(rows, review=False, made=("final", "left", "again"))
    assert done.columns == ["source", "candidate", "final", "left", "again"]
    assert [(json.loads(r.final)["workExperience"], r.left, r.again) for r in done.collect()] == [(first["workExperience"], [], True), ([], [], True)]


def test_leases_on_a_stream(spark, tmp_path):
    from tessera.streaming.claims import claims_stream

    minutes = [0, 30, 59, 60, 90, 119, 121]
    frame = spark.createDataFrame([(1, "a", i, m) for i, m in enumerate(minutes)] + [(2, "a", 9, 61)], "user_id long, event_type string, event_id long, m int")
    frame.selectExpr("user_id", "event_type", "event_id", "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, m, 0) AS ts").repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id long, event_type string, event_id long, ts timestamp").parquet(str(tmp_path / "in"))
    q = claims_stream(stream).writeStream.format("memory").queryName("leased").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.user_id, r.event_id): r.outcome for r in spark.table("leased").collect()}
    assert [got[1, i] for i in range(7)] == ["granted", "busy", "busy", "granted", "busy", "busy", "granted"] and got[2, 9] == "granted"


def test_leases_of_keys_in_several_parts(spark, tmp_path):
    from tessera.streaming.claims import claims_stream

    minutes = [(i * 37) % 200 for i in range(200)]  # a part holds few rows of a key, in no order
    frame = spark.createDataFrame([(k, "a", i, m) for k in (1, 2) for i, m in enumerate(minutes)], "user_id long, event_type string, event_id long, m int")
    frame.selectExpr("user_id", "event_type", "event_id", "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, m, 0) AS ts").repartition(1).write.parquet(str(tmp_path / "in"))
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        stream = spark.readStream.schema("user_id long, event_type string, event_id long, ts timestamp").parquet(str(tmp_path / "in"))
        q = claims_stream(stream).writeStream.format("memory").queryName("parted").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    got = spark.table("parted").collect()
    assert len(got) == 400 and sorted((r.user_id, minutes[r.event_id]) for r in got if r.outcome == "granted") == [(k, m) for k in (1, 2) for m in (0, 60, 120, 180)]


def test_finish_needs_the_owner(spark):
    rows = spark.createDataFrame([(1, "processing", "t", "d", None), (2, "processing", None, "d", None), (3, "ready", "t", "d", None)], "id int, status string, token string, data string, updated_at timestamp")
    ends = spark.createDataFrame([(1, "x", "ready", "n"), (2, None, "failed", None), (3, "t", "failed", None), (4, "t", "ready", "n")], "id int, token string, status string, data string")
    after, outcomes = leases.finished(rows, ends, F.current_timestamp())
    assert {r.id: r.outcome for r in outcomes.collect()} == {1: "stale", 2: "committed", 3: "stale", 4: "missing"}
    assert {r.id: (r.status, r.token, r.data) for r in after.collect()} == {1: ("processing", "t", "d"), 2: ("failed", None, None), 3: ("ready", "t", "d")}


def test_passes(spark):
    from tessera.operators import passes

    texts = spark.createDataFrame([(1, "I use Python在 work, C++ and e-mail"), (2, "pythonic 机器学习 use"), (3, None), (4, "")], "key int, text string")
    terms = spark.createDataFrame([("Python",), ("c++",), ("学习",), ("e-mail",), (" ",), ("use",), ("work, C++",)], "term string")
    got = {(r.key, r.term) for r in passes.term_hits(texts, terms).collect()}
    assert got == {(1, "Python"), (1, "c++"), (1, "e-mail"), (1, "use"), (1, "work, C++"), (2, "学习"), (2, "use")}
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id int, t string")
    out = passes.refined(rows, "t", [("up", F.upper), ("none", lambda t: F.lit(None)), ("same", lambda t: t)])
    assert {r.id: (r.t, r.passes) for r in out.collect()} == {1: ("A", ["up"]), 2: (None, [])} and out.columns == ["id", "t", "passes"]
    done = []
    assert passes.measured("a", lambda: 3, done) == 3
    with pytest.raises(ZeroDivisionError):
        passes.measured("b", lambda: 1 / 0, done)
    assert [(r["stage"], r["ok"], r["error"]) for r in done] == [("a", True, None), ("b", False, "ZeroDivisionError")]
    board = spark.createDataFrame([(i, "x", i) for i in range(4)] + [(9, "y", 0)], "event_id long, event_type string, position long")
    asked = spark.createDataFrame([(3, 0), (1, 1), (3, 2), (77, 3)], "id long, place long")
    moved = sorted((r.event_type, r.position, r.event_id) for r in passes.moved_in_order(board, asked, "y").collect())
    assert moved == [("x", 0, 0), ("x", 1, 2), ("y", 0, 9), ("y", 1, 1), ("y", 2, 3)]
