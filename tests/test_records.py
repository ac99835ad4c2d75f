import copy
import json

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import board, monitor, patches, records, similarity, state

RECORD = {
    "summary": "Builds things", "personalInfo": {"name": "A"},
    "workExperience": [{"id": 1, "company": "Acme", "title": "Dev", "years": "2019 - 2021", "description": ["led team", "cut cost"]}],
    "education": [{"institution": "Uni", "degree": "BSc", "years": "2015 - 2018", "description": "good"}],
    "additional": {"technicalSkills": ["SQL", "Java", "sql"], "languages": ["French"]},
}


@pytest.mark.parametrize("change,ok", [
    ({"path": "summary", "action": "replace", "original": " builds THINGS ", "value": "x"}, True),
    ({"path": "summary", "action": "replace", "original": "other", "value": "x"}, False),
    ({"path": "summary", "action": "replace", "original": ["Builds things"], "value": "x"}, False),
    ({"path": "summary", "action": "replace", "original": None, "value": ["x"]}, False),
    ({"path": "summary", "action": "append", "value": "x"}, False),
    ({"path": "workExperience[0].description", "action": "append", "value": "more"}, True),
    ({"path": "workExperience[0].description", "action": "append", "value": "  "}, False),
    ({"path": "workExperience[0].description[1]", "action": "replace", "original": "cut cost", "value": "x"}, True),
    ({"path": "workExperience[0].description[2]", "action": "replace", "value": "x"}, False),
    ({"path": "workExperience[3].description", "action": "append", "value": "x"}, False),
    ({"path": "workExperience[0].company", "action": "replace", "value": "x"}, False),
    ({"path": "personalInfo.name", "action": "replace", "value": "x"}, False),
    ({"path": "additional.technicalSkills", "action": "add_skill", "value": "Go"}, True),
    ({"path": "additional.technicalSkills", "action": "add_skill", "value": "Rust"}, False),
    ({"path": "additional.technicalSkills", "action": "add_skill", "value": "JAVA"}, False),
    ({"path": "additional.languages", "action": "add_skill", "value": "Go"}, False),
    ({"path": "summary", "action": "burn", "value": "x"}, False), ({}, False), ({"path": 3, "action": "replace"}, False),
])
def test_gates(change, ok):
    before = copy.deepcopy(RECORD)
    out, done = patches.apply_changes(RECORD, [change], ["  go "])
    assert done == [ok] and RECORD == before and (out != RECORD) is ok


def reorder(value, path="additional.technicalSkills"):
    return patches.apply_changes(RECORD, [{"path": path, "action": "reorder", "value": value}], ["go"])[0]["additional"]


def test_reorder():
    assert reorder(["java", "SQL", "SQL"])["technicalSkills"] == ["Java", "SQL", "sql"]
    assert reorder(["Go", "Rust", "java", "go"])["technicalSkills"] == ["Go", "Java", "SQL", "sql"]
    assert reorder(["German", "french"], "additional.languages")["languages"] == ["French"]


def test_changes_see_those_before():
    _, done = patches.apply_changes(RECORD, [{"path": "summary", "action": "replace", "value": "x"}, {"path": "summary", "action": "replace", "original": "Builds things", "value": "y"}], [])
    assert done == [True, False]


@given(st.lists(st.fixed_dictionaries({"path": st.sampled_from(["summary", "additional.technicalSkills", "additional.languages", "workExperience[0].description"]),
                                       "action": st.sampled_from(["append", "reorder", "add_skill"]),
                                       "value": st.one_of(st.text(max_size=5), st.lists(st.sampled_from(["SQL", "Go", "french", "Rust", "led team"]), max_size=4))}), max_size=6))
def test_no_listed_item_is_lost(changes):
    out, done = patches.apply_changes(RECORD, changes, ["go"])
    assert len(done) == len(changes)
    for name in ("technicalSkills", "languages"):
        kept = [x.casefold() for x in out["additional"][name]]
        assert all(kept.count(x.casefold()) >= [y.casefold() for y in RECORD["additional"][name]].count(x.casefold()) for x in RECORD["additional"][name])
    assert out["personalInfo"] == RECORD["personalInfo"]


def test_differences():
    new = copy.deepcopy(RECORD)
    assert patches.differences(RECORD, new) == []
    new["workExperience"][0]["description"] = ["led teams", "cut cost", "sold"]
    new["additional"]["technicalSkills"] = ["java", "Go"]
    new["education"][0].update(description="", degree="MSc")
    new["personalProjects"] = [{"name": "P"}]
    assert patches.differences(RECORD, new) == [
        ("additional.technicalSkills", "skill", "added", None, "Go", "high"), ("additional.technicalSkills", "skill", "removed", "SQL", None, "medium"),
        ("workExperience[0].description", "description", "modified", "led team", "led teams", "medium"), ("workExperience[0].description", "description", "added", None, "sold", "medium"),
        ("education[0].description", "education", "removed", "good", None, "medium"),
        ("education[0]", "education", "modified", "BSc | Uni | 2015 - 2018", "MSc | Uni | 2015 - 2018", "medium"), ("personalProjects[0]", "project", "added", None, "P", "high")]


def dates(text, record=None):
    out = patches.restore_dates(record or RECORD, text)
    return out["workExperience"][0]["years"], out["education"][0]["years"]


def test_dates():
    assert dates("Acme, Dev  Jan 2019 – Mar 2021\nUni BSc\nSept. 2015 - June 2018") == ("Jan 2019 - Mar 2021", "2015 - 2018")
    assert dates("Uni BSc\nSep 2015 - Jun 2018\n") == ("2019 - 2021", "Sep 2015 - Jun 2018")
    twice = "Acme Dev Jan 2019 - Mar 2021\n" * 2
    assert dates(twice)[0] == "2019 - 2021"
    assert dates("Jan 2019 - Mar 2021")[0] == "2019 - 2021"
    alone = {"workExperience": RECORD["workExperience"], "education": []}
    assert patches.restore_dates(alone, "Jan 2019 - Mar 2021")["workExperience"][0]["years"] == "Jan 2019 - Mar 2021"
    assert patches.restore_dates({}, None) == {}


def test_record_frames(spark):
    rows = spark.createDataFrame([(json.dumps(RECORD), json.dumps([{"path": "summary", "action": "replace", "value": "x"}, 7]), None), (None, "{", ["a"])], "record string, changes string, allowed array<string>")
    got = patches.apply_patch(rows).collect()
    assert [r.applied for r in got] == [[True, False], []] and json.loads(got[0].patched)["summary"] == "x" and got[1].patched == "{}"
    assert patches.structural_diff(spark.createDataFrame([(json.dumps(RECORD), None)], "old string, new string")).head().diff
    assert patches.apply_patch(rows.limit(0)).count() == 0


@pytest.mark.parametrize("source,candidate,novel", [
    ("cut 20%", "cut 20 percent", 0), ("cut 20%", "cut 30%", 1), ("earned $1.5M", "earned $1,500,000", 0), ("5 teams", "5 teams, 5 sites", 1), ("", "Python 3.12 since 2019.", 0),
    ("", "2019-2021", 0), ("", "grew 2019 users", 1), ("3k users", "3,000 users", 0), ("2x", "2 times", 0), (None, None, 0), ("1 gb", "1 mb", 1),
])
def test_claims(source, candidate, novel):
    assert similarity.novel_claims(source, candidate) == novel


def test_similarity():
    assert similarity.similarity(" A b", "a  B") == 1.0 and similarity.similarity(None, "") == 1.0
    assert similarity.similarity("led the team", "cooked soup") < similarity.GROUNDED
    assert similarity.similarity("built search", "built search platform") < similarity.similarity("built search", "built searching")
    assert similarity.align(["b", "a", "z"], ["a", "b"])[:2] == [(1, 1.0), (0, 1.0)] and similarity.align(["x"], []) == [(-1, 0.0)]


def test_merge_rows():
    source = ["Led a team of 5 engineers", "Reduced cost by 20%"]
    assert similarity.merge_rows(source, ["Reduced costs by 20%", "Led a team of 9 engineers"]) == ["Reduced costs by 20%", source[0]]
    assert similarity.merge_rows(source, ["Reduced cost by 20%"]) == [source[1], source[0]]
    assert similarity.merge_rows(source, [*source, "Led a team of engineers"], append=True)[2:] == ["Led a team of engineers"]
    assert similarity.merge_rows(source, [*source, "Cooked"], append=True) == source and similarity.merge_rows([], ["x"]) == []


def test_moves(spark):
    rows = [(i, "a", i) for i in range(5)] + [(9, "b", 0)]
    frame = spark.createDataFrame(rows, "event_id long, event_type string, position long")
    for card, status, index, want in [(0, "a", 2, {"a": [1, 2, 0, 3, 4], "b": [9]}), (3, "b", None, {"a": [0, 1, 2, 4], "b": [9, 3]}), (3, "b", -4, {"a": [0, 1, 2, 4], "b": [3, 9]}),
                                      (4, "a", 0, {"a": [4, 0, 1, 2, 3], "b": [9]}), (1, "a", 99, {"a": [0, 2, 3, 4, 1], "b": [9]}), (77, "a", 0, {"a": [0, 1, 2, 3, 4], "b": [9]}), (9, "c", 0, {"a": [0, 1, 2, 3, 4], "c": [9]})]:
        out = sorted(board.moved(frame, card, status, index).collect(), key=lambda r: (r.event_type, r.position))
        got = {s: [r.event_id for r in out if r.event_type == s] for s in {r.event_type for r in out}}
        assert got == want and all([r.position for r in out if r.event_type == s] == list(range(len(got[s]))) for s in got), (card, status, index)


@pytest.mark.parametrize("row,want", [
    ((None, True, True, False, None, 5, True, None), "missing"), ((True, False, True, True, True, 5, True, None), "conflict"), ((True, True, False, True, True, 5, True, None), "invalid"),
    ((True, True, True, True, None, 0, False, None), "deleted"), ((True, True, True, True, True, 0, False, 9), "replay"), ((True, True, True, False, None, 3, True, None), "expired"),
    ((True, True, True, False, None, 4, None, None), "stale"), ((True, True, True, False, None, 4, True, 4), "busy"), ((True, True, True, None, None, 4, True, 3), "granted")])
def test_claim_outcome(spark, row, want):
    frame = spark.createDataFrame([row], "a boolean, b boolean, c boolean, d boolean, e boolean, f int, g boolean, h int")
    assert frame.select(state.claim_outcome(*[F.col(x) for x in "abcdefgh"], F.lit(3))).head()[0] == want


def test_regressions(spark):
    ddl = "key string, coverage double, score int, non_blank boolean"
    now = spark.createDataFrame([("a", 0.4, 1, False), ("b", 0.9, None, None), ("c", None, 4, True)], ddl)
    was = spark.createDataFrame([("a", 0.5, 4, True), ("b", 0.9, 3, True), ("d", 0.9, 3, True)], ddl)
    assert sorted(map(tuple, monitor.regressions(now, was).collect())) == [
        ("a", "blank_render"), ("a", "judge_drop"), ("a", "judge_floor"), ("a", "keyword_floor"), ("b", "judge_missing"), ("d", "missing_variation")]


def test_alignment(spark):
    ddl = "key int, value string"
    got = records.alignment(spark.createDataFrame([(1, "Python"), (1, "Rust"), (1, "SQL"), (2, "x")], ddl), spark.createDataFrame([(1, "python 3"), (1, "sql"), (3, "x"), (1, "")], ddl))
    assert sorted(map(tuple, got.collect())) == [(1, "python", "info"), (1, "rust", "critical"), (2, "x", "critical")]
