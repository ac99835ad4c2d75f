"""Queries of the operators on whole records and documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import html, jsontext, phrases
from tessera.operators import patches, scorers, similarity
from tessera.plans.catalog import query
from tessera.sources.tables import table


@query()
def sanitize_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.sanitized("html").alias("html"))


@query("SELECT doc_id, sha256(nfc_normalize(text)) AS digest FROM documents")
def nfc_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", jsontext.nfc_hash("text").alias("digest"))


@query("SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN props END AS object FROM events")
def extract_json(spark, sf_dir):
    """Objects found again in answers: bare, after prose, fenced, after thinking; every fifth answer is an array."""
    props = F.col("props")
    answer = (F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("["), props, F.lit("]"))).when(F.col("event_id") % 5 == 1, F.concat(F.lit("Here it is [1]: "), props, F.lit(" and more")))
              .when(F.col("event_id") % 5 == 2, F.concat(F.lit("Sure\n```json\n"), props, F.lit("\n```\n"))).when(F.col("event_id") % 5 == 3, F.concat(F.lit("<think>{no}</think>"), props)).otherwise(props))
    return table(spark, sf_dir, "events").select("event_id", jsontext.extract_json(answer).alias("object"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE c_name END AS summary,
CASE WHEN c_nationkey > 10 THEN 'spark,sql,' || lower(c_mktsegment) ELSE 'spark,sql' END AS skills, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN c_nationkey > 10 THEN 2 ELSE 1 END AS applied FROM customer""")
def apply_patch(spark, sf_dir):
    """Three changes a customer: the summary where it is as expected, a skill where it is allowed, an order of skills."""
    c = table(spark, sf_dir, "customer")
    record = F.to_json(F.struct(F.col("c_name").alias("summary"), F.struct(F.array(F.lit("sql"), F.lit("spark")).alias("technicalSkills")).alias("additional")))
    skill = F.lower("c_mktsegment")
    change = lambda path, action, original, value: F.struct(F.lit(path).alias("path"), F.lit(action).alias("action"), original.alias("original"), value.alias("value"))
    texts = F.array(
        F.to_json(change("summary", "replace", F.when(F.col("c_custkey") % 2 == 0, F.upper("c_name")).otherwise(F.lit("other")), F.col("c_mktsegment"))),
        F.to_json(change(patches.SKILLS, "add_skill", F.lit(None).cast("string"), skill)),
        F.to_json(change(patches.SKILLS, "reorder", F.lit(None).cast("string"), F.array(F.lit("Spark"), F.lit("SQL")))))
    rows = c.select("c_custkey", record.alias("record"), F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]")).alias("changes"),
                    F.when(F.col("c_nationkey") > 10, F.array(skill)).alias("allowed"))
    out = patches.apply_patch(rows)
    done = F.from_json("patched", "summary string, additional struct<technicalSkills:array<string>>")
    return out.select("c_custkey", done["summary"].alias("summary"), F.array_join(done["additional"]["technicalSkills"], ",").alias("skills"), F.size(F.filter("applied", lambda x: x)).alias("applied"))


@query("""WITH c AS (SELECT c_custkey, unnest(CASE WHEN c_custkey % 3 = 0 THEN ['summary:modified', 'skill:added', 'skill:removed', 'description:modified', 'description:added']
 WHEN c_custkey % 3 = 1 THEN ['skill:added', 'description:removed', 'experience:modified'] ELSE [] END) AS change FROM customer) SELECT change, count(*) AS n FROM c GROUP BY ALL""")
def structural_diff(spark, sf_dir):
    """Changes of two versions of a record, counted by kind."""
    m = F.col("c_custkey") % 3

    def version(summary, skills, company, rows):
        job = F.array(F.struct(company.alias("company"), rows.alias("description")))
        return F.to_json(F.struct(summary.alias("summary"), F.struct(skills.alias("technicalSkills")).alias("additional"), job.alias("workExperience")))

    def texts(*values):
        return F.array(*[F.lit(v) for v in values])

    old = version(F.col("c_name"), texts("SQL", "Java"), F.col("c_mktsegment"), texts("led a team", "built it"))
    new = version(F.when(m == 0, F.lower("c_name")).otherwise(F.col("c_name")), F.when(m == 0, texts("Spark", "sql")).when(m == 1, texts("java", "sql", "Go")).otherwise(texts("sql", "JAVA")),
                  F.when(m == 1, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")), F.when(m == 0, texts("led two teams", "built it", "sold it")).when(m == 1, texts("built it")).otherwise(texts("led a team", "built it")))
    found = patches.structural_diff(table(spark, sf_dir, "customer").select(old.alias("old"), new.alias("new")))
    return found.select(F.explode("diff").alias("d")).groupBy(F.concat_ws(":", "d.kind", "d.change").alias("change")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, 'Jan 2019 - Mar 2021' AS job, CASE WHEN c_custkey % 2 = 0 THEN 'Feb 2015 - Present' ELSE '2015 - present' END AS other FROM customer")
def restore_dates(spark, sf_dir):
    """Years given back their months: two jobs, the second of which the text names every other time."""
    lines = F.concat_ws("\n", F.concat(F.lit("# "), F.col("c_name")), F.col("c_mktsegment"), F.lit("Jan 2019 – Mar 2021"), *[F.lit("-")] * 6,
                        F.when(F.col("c_custkey") % 2 == 0, F.lit("Elsewhere, clerk, Feb 2015-Present")).otherwise(F.lit("Feb 2015-Present")))
    jobs = F.array(F.struct(F.col("c_name").alias("company"), F.col("c_mktsegment").alias("title"), F.lit("2019 - 2021").alias("years")),
                   F.struct(F.lit("Elsewhere").alias("company"), F.lit("Clerk").alias("title"), F.lit("2015 - present").alias("years")))
    out = patches.with_dates(table(spark, sf_dir, "customer").select("c_custkey", F.to_json(F.struct(jobs.alias("workExperience"))).alias("record"), lines.alias("text")))
    dated = F.from_json("dated", "workExperience array<struct<years:string>>")["workExperience"]
    return out.select("c_custkey", dated[0]["years"].alias("job"), dated[1]["years"].alias("other"))


@query()
def turn_similarity(spark, sf_dir):
    """How like the turn before it a turn is, and how many numbers it claims anew."""
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", before.alias("before"))
    return rows.select("conv_id", "turn", similarity.likeness("before", "text").alias("likeness"), similarity.novel_number_count("before", "text").alias("novel"))


@query()
def merge_preserve(spark, sf_dir):
    """Turns of the assistant merged over those of the user, conversation by conversation."""
    def texts(role):
        turns = F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))
        return F.transform(F.array_sort(turns), lambda t: t["text"])

    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(texts("user").alias("source"), texts("assistant").alias("candidate"))
    return similarity.merge_preserve(rows, "source", "candidate").select("conv_id", F.size("merged").cast("long").alias("n_rows"), F.array_join("merged", "\n").alias("merged"))


def _sql_plain(column: str) -> str:
    for p in phrases.ORDER:
        column = f"regexp_replace({column}, '{p}', '{phrases.PHRASES[p]}', 'gi')"
    return column


@query(f"SELECT doc_id, {_sql_plain('text')} AS text FROM documents")
def phrase_cleanup(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", phrases.plain_words(F.col("text")).alias("text"))


@query("""WITH p AS (SELECT l_suppkey AS key, lower(p_type) AS k, min((l_orderkey, l_linenumber)) AS place, max(p_type) AS s FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber % 3 = 1 GROUP BY ALL),
h AS (SELECT DISTINCT l_suppkey AS key, lower(p_type) AS k FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber % 3 = 2),
w AS (SELECT DISTINCT l_suppkey AS key, lower(p_type) AS k FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber % 3 = 0)
SELECT p.key, CASE WHEN h.k IS NOT NULL THEN 'existing' WHEN w.k IS NOT NULL THEN 'jd_added' WHEN contains(lower(s_name) || ' standard economy', p.k) THEN 'supported_by_resume' ELSE 'unsupported' END AS verdict, count(*) AS n
FROM p JOIN supplier ON p.key = s_suppkey LEFT JOIN h ON p.key = h.key AND p.k = h.k LEFT JOIN w ON p.key = w.key AND p.k = w.k GROUP BY ALL""")
def skill_targets(spark, sf_dir):
    """What a supplier plans (first, fourth, ... lines of orders), holds (second, fifth, ...) and is asked for (the others)."""
    sold = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").join(table(spark, sf_dir, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    sold = sold.select(F.col("l_suppkey").alias("key"), F.struct("l_orderkey", "l_linenumber").alias("place"), F.col("p_type").alias("skill"), (F.col("l_linenumber") % 3).alias("n"))
    texts = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.concat("s_name", F.lit(" standard economy")).alias("text"))
    out = scorers.verified_skills(sold.where("n = 1"), sold.where("n = 2").select("key", "skill"), sold.where("n = 0").select("key", "skill"), texts)
    return out.groupBy("key", "verdict").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'workExperience,education' WHEN c_custkey % 3 = 0 THEN 'education' ELSE '' END AS lost, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 7 <> 0 THEN 'Elsewhere' ELSE '' END AS made_up,
c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 AS same_identity, c_custkey % 7 <> 0 AS is_meaningful FROM customer""")
def tailoring_scores(spark, sf_dir):
    """Records of which some lose a section, gain an employer, change their name or say nothing any more."""
    c, key = table(spark, sf_dir, "customer"), F.col("c_custkey")

    def record(name, education, *companies):
        jobs = F.array(*[F.struct(x.alias("company")) for x in companies])
        return F.to_json(F.struct(F.struct(name.alias("name")).alias("personalInfo"), education.alias("education"), jobs.alias("workExperience")))

    school = F.array(F.struct(F.lit("Uni").alias("institution")))
    old = record(F.col("c_name"), school, F.col("c_mktsegment"))
    new = record(F.when(key % 5 == 0, F.lower("c_name")).otherwise(F.col("c_name")), F.when(key % 3 == 0, F.slice(school, 1, 0)).otherwise(school),
                 F.lower("c_mktsegment"), F.when(key % 2 == 0, F.lit("Elsewhere")).otherwise(F.lit(" ")))
    blank = F.lit('{"summary": " ", "sectionMeta": [{"displayName": "x"}]}')
    out = scorers.score_pairs(c.select("c_custkey", old.alias("original"), F.when(key % 7 == 0, blank).otherwise(new).alias("tailored")))
    return out.select("c_custkey", F.array_join("lost", ",").alias("lost"), F.array_join("made_up", ",").alias("made_up"), "same_identity", "is_meaningful")
