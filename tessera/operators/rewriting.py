"""Queries over rewritten records: what is kept, guarded, merged, replaced and appended."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import aligned_styles
from tessera.operators import preserve
from tessera.operators.patches import _mapped, _parsed
from tessera.operators.resumes import _LINES, order_records
from tessera.plans.catalog import query
from tessera.sources.tables import table


def _as_json(entries) -> F.Column:
    return F.to_json(F.struct(F.lit("Sells things").alias("summary"), F.struct(F.lit("n").alias("name")).alias("personalInfo"), entries.alias("workExperience"),
                              F.struct(F.array(F.lit("SQL"), F.lit("sql")).alias("technicalSkills")).alias("additional")))


@query(f"""WITH {_LINES} SELECT id, count(*) AS entries, string_agg(company, ',' ORDER BY company) AS companies, string_agg(years, ',' ORDER BY years) AS years, 2 * count(*) AS rows, '' AS left, true AS again FROM r GROUP BY id""")
def finalize_records(spark, sf_dir):
    """Changed orders with everything their source asks for; doing it again changes nothing and breaks nothing."""
    old = F.transform("old", lambda e: e.withField("descriptionStyles", aligned_styles(e["description"], e["descriptionStyles"])))
    rows = order_records(spark, sf_dir).select("id", _as_json(old).alias("source"), _as_json(F.reverse("new")).alias("candidate"))
    done = preserve.finalize(rows, review=False, made=("final", "left", "again"))
    entries = F.from_json(F.get_json_object("final", "$.workExperience"), "array<struct<company:string,years:string,description:array<string>>>")
    out = done.select("id", entries.alias("e"), F.array_join("left", ",").alias("left"), "again")
    joined = lambda f: F.array_join(F.array_sort(F.transform("e", lambda x: x[f])), ",")
    return out.select("id", F.size("e").cast("long").alias("entries"), joined("company").alias("companies"), joined("years").alias("years"),
                      F.aggregate("e", F.lit(0), lambda n, x: n + F.size(x["description"])).cast("long").alias("rows"), "left", "again")


@query(f"""WITH {_LINES}, n AS (SELECT id, count(*) AS n, count(DISTINCT n) AS d, bool_or(company2 <> company OR years2 <> years) FILTER (i < 4) AS changed FROM r GROUP BY id)
SELECT id, CASE WHEN n > 4 THEN 'workExperience.entries' WHEN changed THEN 'workExperience.identity' ELSE '' END AS faults FROM n WHERE n = d""")
def contract_faults(spark, sf_dir):
    """What the changed form of orders breaks, where lines have ids of their own; styles aren't compared."""
    bare = lambda c: F.transform(c, lambda e: e.dropFields("descriptionStyles"))
    rows = order_records(spark, sf_dir).where(F.size(F.array_distinct(F.transform("old", lambda e: e["id"]))) == F.size("old"))
    rows = rows.where(~F.exists("old", lambda e: e["id"] == 0))
    out = preserve.finalize(rows.select("id", _as_json(bare("old")).alias("source"), _as_json(bare("new")).alias("candidate")), made=("faults",))
    return out.select("id", F.array_join("faults", ",").alias("faults"))


@query("""SELECT c_custkey, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN 'kept' ELSE 'rewritten' END AS text, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 1 END AS items, '' AS made_up,
CASE WHEN c_custkey % 4 = 0 THEN 'email,name' ELSE 'name' END AS mismatches, c_custkey % 5 <> 0 AS sound FROM customer""")
def guard_records(spark, sf_dir):
    """Rewritten customers: identity restored, lost sections back, items beyond the source's and made-up rows gone."""
    i, name = F.col("c_custkey"), F.col("c_name")
    item = lambda n: F.struct(F.lit(n).alias("title"), F.array().cast("array<string>").alias("description"))
    more = lambda n: F.struct(F.lit(n).alias("title"), F.array(F.lit("made up")).alias("description"))
    had = F.when(i % 2 == 0, F.array(item("a"), item("b"))).otherwise(F.array(item("a")))
    source = F.to_json(F.struct(F.struct(name.alias("name"), F.lit("x@y.z").alias("email")).alias("personalInfo"), F.struct(
        F.struct(F.lit("itemList").alias("sectionType"), had.alias("items")).alias("s"), F.struct(F.lit("text").alias("sectionType"), F.lit("kept").alias("text")).alias("t")).alias("customSections")))
    now = F.struct(F.lit("itemList").alias("sectionType"), F.array(more("a"), more("b"), more("c")).alias("items"))
    text = F.struct(F.lit("text").alias("sectionType"), F.lit("rewritten").alias("text"))
    person = F.struct(F.lit("Somebody").alias("name"), F.when(i % 4 == 0, "other").otherwise(" x@y.z ").alias("email"))
    record = lambda sections, work: F.to_json(F.struct(person.alias("personalInfo"), work.alias("workExperience"), sections.alias("customSections")))
    work = [F.array(F.lit("x")), F.lit("no list")]
    candidate = F.when(i % 15 == 0, record(F.struct(now.alias("s")), work[1])).when(i % 5 == 0, record(F.struct(now.alias("s"), text.alias("t")), work[1])).when(
        i % 3 == 0, record(F.struct(now.alias("s")), work[0])).otherwise(record(F.struct(now.alias("s"), text.alias("t")), work[0]))
    out = preserve.guard(table(spark, sf_dir, "customer").select("c_custkey", source.alias("source"), candidate.alias("candidate")))
    items = F.from_json(F.get_json_object("guarded", "$.customSections.s.items"), "array<struct<title:string,description:array<string>>>")
    at = lambda path: F.get_json_object("guarded", path)
    return out.select("c_custkey", at("$.personalInfo.name").alias("name"), at("$.customSections.t.text").alias("text"), F.size(items).alias("items"),
                      F.array_join(F.flatten(F.transform(items, lambda x: x["description"])), ",").alias("made_up"), F.array_join("mismatches", ",").alias("mismatches"), "sound")


@query("""WITH o AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, 'P' || o_orderkey AS name, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT o_custkey, string_agg(i || ':' || CASE WHEN i % 2 = 0 THEN 'new ' || name ELSE name END, ',' ORDER BY i) || ',' || max(n) + 1 || ':added' AS projects FROM o GROUP BY o_custkey""")
def merge_replies(spark, sf_dir):
    """Customers' orders as projects: a reply echoes every second one by its id and adds one without."""
    held = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("k"))
    entry = lambda i, name: F.struct(i.alias("id"), name.alias("name"))
    names = F.transform("k", lambda x, i: entry(i + 1, F.concat(F.lit("P"), x.cast("string"))))
    echo = F.transform(F.filter(names, lambda e: e["id"] % 2 == 0), lambda e: F.to_json(e.withField("name", F.concat(F.lit("new "), e["name"]))))
    reply = F.concat(F.lit('{"summary": "ignored", "personalProjects": ['), F.array_join(F.concat(echo, F.array(F.lit('{"name": "added"}'))), ","), F.lit("]}"))
    rows = held.select("o_custkey", F.to_json(F.struct(names.alias("personalProjects"))).alias("draft"), reply.alias("reply"), F.lit("personalProjects").alias("section"))
    merged = F.from_json(F.get_json_object("merged", "$.personalProjects"), "array<struct<id:int,name:string>>")
    return preserve.merge_turn(rows).select("o_custkey", F.array_join(F.transform(merged, lambda e: F.concat_ws(":", e["id"].cast("string"), e["name"])), ",").alias("projects"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN 'new rows|other' ELSE 'old|new rows' END AS rows FROM customer""")
def regenerate_entries(spark, sf_dir):
    """Rows replaced where the entry is found by its place, or by its names elsewhere; one that isn't found leaves the record alone."""
    i = F.col("c_custkey")
    record = F.to_json(F.struct(F.array(F.struct(F.lit("Dev").alias("title"), F.lit("A").alias("company"), F.array(F.lit("old")).alias("description")), F.struct(
        F.lit("Lead").alias("title"), F.lit("B").alias("company"), F.array(F.lit("other")).alias("description"))).alias("workExperience")))
    item = lambda title, place: F.struct(F.lit(place).alias("item_id"), F.lit(title).alias("title"), F.array(F.lit(" OLD "), F.lit("")).alias("original_content"), F.array(F.lit("new rows")).alias("new_content"))
    items = F.when(i % 3 == 0, F.to_json(F.array(item("Dev", "exp_0"), item("Nobody", "exp_1")))).when(i % 3 == 1, F.to_json(F.array(item(" dev", "exp_0")))).otherwise(F.to_json(F.array(item("LEAD", "exp_7"))))
    out = preserve.regenerate(table(spark, sf_dir, "customer").select("c_custkey", record.alias("record"), items.alias("items")))
    entries = F.from_json(F.get_json_object("regenerated", "$.workExperience"), "array<struct<description:array<string>>>")
    return out.select("c_custkey", F.when(F.col("regenerated").isNotNull(), F.array_join(F.transform(entries, lambda e: F.array_join(e["description"], "+")), "|")).alias("rows"))


def enhance(rows: DataFrame, record: str = "record", additions: str = "additions") -> DataFrame:
    """`rows` (JSON record, JSON object of rows by item id) with enhanced (JSON) and found, the titles of the items that are there."""
    def one(r: dict) -> tuple:
        given, more = _parsed(r[record], dict), _parsed(r[additions], dict)
        found = [preserve.item_at(given, k).get("title") for k in more]
        return json.dumps(preserve.enhanced(given, more), ensure_ascii=False), [t for t in found if t is not None]

    return _mapped(rows, "enhanced string, found array<string>", one)


@query("""SELECT p_partkey, p_type || CASE WHEN p_size % 3 = 0 THEN '' ELSE ',more of ' || p_brand END AS rows, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_name END AS found FROM part""")
def enhance_entries(spark, sf_dir):
    """Further rows for an entry that its id names; a third of the ids name nothing."""
    record = F.to_json(F.struct(F.array(F.struct(F.col("p_name").alias("name"), F.col("p_type").alias("description"))).alias("personalProjects")))
    more = F.to_json(F.create_map(F.when(F.col("p_size") % 3 == 0, "proj_1").otherwise("proj_0"), F.array(F.concat(F.lit("more of "), "p_brand"))))
    out = enhance(table(spark, sf_dir, "part").select("p_partkey", "p_type", record.alias("record"), more.alias("additions")))
    rows = F.get_json_object("enhanced", "$.personalProjects[0].description")
    return out.select("p_partkey", F.when(rows.startswith("["), F.array_join(F.from_json(rows, "array<string>"), ",")).otherwise(rows).alias("rows"), F.array_join("found", ",").alias("found"))
