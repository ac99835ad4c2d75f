import io
import zipfile

import pytest

from tessera.functions import containers, phrases
from tessera.operators import scorers
from tessera.sources import files


def test_files(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.b.txt").write_text("x\ny\n")
    (tmp_path / "t" / "c.txt").write_text("")
    assert [tuple(r) for r in files.texts(spark, str(tmp_path / "t")).orderBy("key").collect()] == [("a.b", "x\ny\n"), ("c", "")]
    frame = spark.createDataFrame([(1, None), (2, "é\n")], "k int, v string")
    files.write_json_lines(frame, str(tmp_path / "j"))
    assert sorted(map(tuple, files.json_lines(spark, str(tmp_path / "j"), "k int, v string").collect())) == [(1, None, None), (2, "é\n", None)]
    (tmp_path / "bad.json").write_text('{"k": 1}\n{"k": \n')
    assert [r._corrupt for r in files.json_lines(spark, str(tmp_path / "bad.json"), "k int").collect()] == [None, '{"k": ']


def zipped(parts, encrypted=False):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(name, data)
    data = bytearray(out.getvalue())
    if encrypted:
        data[data.index(b"PK\1\2") + 8] |= 1
    return bytes(data)


def compound(version=3, shift=9, sectors=4, tables=1, first=0, fat=(1,), order=b"\xfe\xff"):
    head = bytearray(512)
    head[:8], head[26:28], head[28:30], head[30:32], head[32:34] = containers.SIGNATURE, version.to_bytes(2, "little"), order, shift.to_bytes(2, "little"), (6).to_bytes(2, "little")
    head[44:48], head[48:52] = tables.to_bytes(4, "little"), first.to_bytes(4, "little")
    for i in range(109):
        head[76 + 4 * i : 80 + 4 * i] = (fat[i] if i < len(fat) else 0xFFFFFFFF).to_bytes(4, "little")
    return bytes(head) + bytes((1 << shift) * sectors - 512)


WORD = {"[Content_Types].xml": "x", "word/document.xml": "y"}


def test_documents(spark, tmp_path):
    found = {"a.PDF": b"%PDF-1.7", "b.docx": zipped(WORD), "b2.docx": b"PK\3\4x", "b3.docx": zipped({"word/document.xml": "y"}), "b4.docx": zipped(WORD, encrypted=True), "b5.docx": zipped(WORD | {"big": b"0" * (containers.MOST_BYTES + 1)}),
             "c.doc": b"PK\3\4", "c2.doc": compound(), "d.pdf": b"", "e.txt": b"x", "f.pdf": b"%PDF-" + b"0" * files.MAX_UPLOAD, "g.pdf": b"PK"}
    for name, data in found.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: r.verdict for r in files.documents(spark, str(tmp_path)).collect()}
    assert got == {"a.PDF": "accepted", "b.docx": "accepted", "b2.docx": "invalid", "b3.docx": "invalid", "b4.docx": "encrypted", "b5.docx": "too_large", "c.doc": "invalid", "c2.doc": "accepted", "d.pdf": "empty",
                   "e.txt": "unsupported", "f.pdf": "too_large", "g.pdf": "invalid"}


@pytest.mark.parametrize("changes,ok", [({}, True), ({"version": 4}, False), ({"version": 4, "shift": 12}, True), ({"sectors": 2}, False), ({"tables": 0}, False), ({"tables": 9}, False), ({"first": 3}, False), ({"fat": ()}, False),
                                        ({"fat": (7,)}, False), ({"order": b"\xff\xfe"}, False)])
def test_compound_files(changes, ok):
    assert (containers.compound(compound(**changes)) == "accepted") is ok and containers.compound(compound()[:300]) == "invalid"


def test_settings(spark, tmp_path):
    path = tmp_path / "c.json"
    assert files.settings(spark, str(path), 0) == {}
    path.write_text('{"a": 1}')
    assert files.settings(spark, str(path), 10) == {} and files.settings(spark, str(path), 400) == {"a": 1}
    path.write_text("{broken")
    assert files.settings(spark, str(path), 500) == {"a": 1} and files.settings(spark, str(path), 800) == {}


@pytest.mark.parametrize("text,job,want", [
    ("Leveraged a Paradigm Shift in order to win", None, "used a change to win"), ("robust--holistic", "We want ROBUST", "robust, comprehensive"), ("plain", None, "plain"), ("", None, ""), (None, None, None)])
def test_phrases(spark, text, job, want):
    frame = spark.createDataFrame([(text, job)], "t string, j string")
    assert frame.select(phrases.plain_words(frame.t, frame.j) if job else phrases.plain_words(frame.t)).head()[0] == want


@pytest.mark.parametrize("record,want", [
    ({}, False), ({"summary": " "}, False), ({"summary": "x"}, True), ({"workExperience": [{"id": "7"}]}, False), ({"customSections": {"id": {"text": "x", "sectionType": "text"}}}, True),
    ({"customSections": {"a": {"sectionType": "text", "key": "k"}}}, False), ({"education": [{"description": "x"}]}, True), ({"other": "x"}, False), ({"additional": {"awards": [""]}}, False)])
def test_meaningful(record, want):
    assert scorers.meaningful(record) is want


def test_scorers():
    was = {"summary": "x", "customSections": {"a": {"text": "t"}}, "workExperience": [{"company": "Acme "}]}
    assert scorers.lost_sections(was, {**was, "summary": "", "customSections": {"a": {"sectionType": "text"}}}) == ["summary", "customSections.a"]
    now = {"workExperience": [{"company": "Zed"}, {"company": "ACME"}, {"company": "zed"}, {"company": "Bee"}, {"company": None}, 4]}
    assert scorers.made_up_employers(was, now) == ["Zed", "Bee"] and scorers.made_up_employers({}, {}) == []


def test_verified_skills(spark):
    held = spark.createDataFrame([(1, "SQL"), (1, " ")], "key int, skill string")
    wanted = spark.createDataFrame([(1, "Go Lang"), (1, "sql")], "key int, skill string")
    plan = spark.createDataFrame([(1, 0, "sql"), (1, 1, "go  lang"), (1, 2, "C++"), (1, 3, "c++"), (1, 4, "Java"), (2, 0, "x"), (1, 5, "")], "key int, place int, skill string")
    texts = spark.createDataFrame([(1, "wrote C++, javascript")], "key int, text string")
    assert sorted(map(tuple, scorers.verified_skills(plan, held, wanted, texts).collect())) == [
        (1, "C++", "supported_by_resume"), (1, "Go Lang", "jd_added"), (1, "Java", "unsupported"), (1, "SQL", "existing"), (2, "x", "unsupported")]
