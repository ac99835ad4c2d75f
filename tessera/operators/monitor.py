"""Counts, run summaries, limits and checks against a baseline."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import judge_score
from tessera.plans.catalog import query
from tessera.sources.tables import TABLES, table

FLOOR_COVERAGE, FLOOR_SCORE, TOLERANCE = 0.5, 2, 1


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in TABLES))
def system_stats(spark, sf_dir):
    counts = [table(spark, sf_dir, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("name"), "n") for t in TABLES]
    return reduce(lambda a, b: a.unionByName(b), counts)


def regressions(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """key, kind: one row per way in which a run falls behind.

    Both sides have key, coverage, score and non_blank, null where there was none, and one row per key.
    """
    now, was = current.alias("c"), baseline.alias("b")
    both = now.join(was, F.col("c.key") == F.col("b.key"), "full")
    cov, score, old = F.col("c.coverage"), F.col("c.score"), F.col("b.score")
    ran = F.col("c.key").isNotNull()
    kinds = F.array_compact(F.array(
        F.when(cov < FLOOR_COVERAGE, "keyword_floor"), F.when(ran & score.isNull() & old.isNotNull(), "judge_missing"), F.when(score < FLOOR_SCORE, "judge_floor"),
        F.when(~F.col("c.non_blank"), "blank_render"), F.when(old - score > TOLERANCE, "judge_drop"), F.when(~ran, "missing_variation")))
    return both.select(F.coalesce("c.key", "b.key").alias("key"), F.explode(kinds).alias("kind"))


def _halves(parity: int) -> str:
    return f"""SELECT source AS key, avg(quality)::DOUBLE AS coverage, CASE WHEN count(*) FILTER (toxic = 1) > 8 THEN NULL ELSE 5 - count(*) FILTER (toxic = 1) END AS score,
bool_or(length(text) > 2000) AS non_blank FROM documents JOIN labels USING (doc_id) WHERE doc_id % 2 = {parity} GROUP BY source"""


@query(f"""WITH c AS ({_halves(0)}), b AS ({_halves(1)}), j AS (SELECT coalesce(c.key, b.key) AS key, c.key IS NOT NULL AS ran, c.coverage, c.score, c.non_blank, b.score AS old FROM c FULL JOIN b ON c.key = b.key)
SELECT key, 'keyword_floor' AS kind FROM j WHERE coverage < {FLOOR_COVERAGE} UNION ALL SELECT key, 'judge_missing' FROM j WHERE ran AND score IS NULL AND old IS NOT NULL
UNION ALL SELECT key, 'judge_floor' FROM j WHERE score < {FLOOR_SCORE} UNION ALL SELECT key, 'blank_render' FROM j WHERE NOT non_blank
UNION ALL SELECT key, 'judge_drop' FROM j WHERE old - score > {TOLERANCE} UNION ALL SELECT key, 'missing_variation' FROM j WHERE NOT ran""")
def baseline_regressions(spark, sf_dir):
    """Sources by their documents of even ids against those of odd ids."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").alias("size")).join(table(spark, sf_dir, "labels"), "doc_id")

    def half(parity: int) -> DataFrame:
        toxic = F.count_if(F.col("toxic") == 1)
        return rows.where(F.col("doc_id") % 2 == parity).groupBy(F.col("source").alias("key")).agg(
            F.avg("quality").alias("coverage"), F.when(toxic <= 8, 5 - toxic).alias("score"), F.bool_or(F.col("size") > 2000).alias("non_blank"))

    return regressions(half(0), half(1))


@query("SELECT event_type AS stage, count(*) AS steps, min(value) AS least, max(value) AS most, count(DISTINCT user_id) AS users FROM events GROUP BY ALL")
def run_summary(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("stage")).agg(
        F.count(F.lit(1)).alias("steps"), F.min("value").alias("least"), F.max("value").alias("most"), F.countDistinct("user_id").alias("users"))


@query("""SELECT 'documents' AS name, count(*) FILTER (octet_length(encode(text)) > 2000) AS over, max(octet_length(encode(text))) AS largest FROM documents
UNION ALL SELECT 'pages', count(*) FILTER (octet_length(encode(html)) > 2000), max(octet_length(encode(html))) FROM pages""")
def size_limits(spark, sf_dir):
    def limits(name, column):
        size = F.octet_length(column).cast("long")
        return table(spark, sf_dir, name).agg(F.count_if(size > 2000).alias("over"), F.max(size).alias("largest")).select(F.lit(name).alias("name"), "over", "largest")

    return limits("documents", "text").unionByName(limits("pages", "html"))


@query("""WITH r AS (SELECT event_id, round(value / 10.0::DOUBLE, 2) AS v FROM events)
SELECT event_id, CASE WHEN floor(v + 0.5::DOUBLE) BETWEEN 1 AND 5 THEN floor(v + 0.5::DOUBLE)::INT END AS score FROM r""")
def score_normalizer(spark, sf_dir):
    """A judge's score as text, to 1..5 half up or null.

    Hundredths are rounded by scaling in doubles, as the SQL's engine does: 1.495 is 149.5 hundredths, so 1.5.
    """
    raw = (F.round(F.col("value") / 10.0 * 100.0) / 100.0).cast("string")
    return table(spark, sf_dir, "events").select("event_id", judge_score(raw).alias("score"))


@query("""SELECT source, count(*) AS docs, count(*) FILTER (coalesce(text, '') <> '') * 25.0::DOUBLE / count(*) + count(*) FILTER (coalesce(lang, '') <> '') * 25.0::DOUBLE / count(*)
+ count(*) FILTER (n_chars > 0) * 25.0::DOUBLE / count(*) + count(*) FILTER (source <> '') * 25.0::DOUBLE / count(*) AS complete FROM documents GROUP BY ALL""")
def section_completeness(spark, sf_dir):
    """Mean share of four fields that hold something, in per cent."""
    def share(full):
        return F.count_if(full) * 25.0 / F.count(F.lit(1))

    held = [F.coalesce("text", F.lit("")) != "", F.coalesce("lang", F.lit("")) != "", F.col("n_chars") > 0, F.col("source") != ""]
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("docs"), reduce(lambda a, b: a + b, map(share, held)).alias("complete"))
