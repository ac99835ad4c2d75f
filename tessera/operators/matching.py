"""Keyword matching, gaps, scores and text clean-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.text import STOP_WORDS, keywords, normalized
from tessera.plans.catalog import query
from tessera.sources.tables import table

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_KEY = f"length(t) >= 3 AND t NOT IN ({_STOP}) AND NOT regexp_matches(t, '^[0-9]+$')"
_KEYS = f"list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9-]+')), lambda t: {_KEY})"


def source_terms(spark: SparkSession, sf_dir: str, asked: DataFrame | None = None) -> DataFrame:
    """source, term: distinct, so a frequent word costs one row a source after the map side; of the terms asked for, if any."""
    terms = table(spark, sf_dir, "documents").select("source", F.explode(keywords(F.col("text"))).alias("term"))
    return (terms if asked is None else terms.join(asked.select("term").distinct(), "term", "left_semi").select("source", "term")).distinct()


def all_pairs(spark: SparkSession, sf_dir: str, found: DataFrame) -> DataFrame:
    """found (source, item_id, counts) with the pairs that have nothing in common, at 0; the items are the queries that each source is asked."""
    sources = table(spark, sf_dir, "documents").select("source").distinct()
    every = sources.join(F.broadcast(table(spark, sf_dir, "benchmark").select("item_id").distinct()))
    # A null source is one like any other.
    counts = [c for c in found.columns if c not in ("source", "item_id")]
    right = found.withColumnsRenamed({"source": "_s", "item_id": "_i"})
    both = every.join(right, F.col("source").eqNullSafe(F.col("_s")) & (F.col("item_id") == F.col("_i")), "left")
    return both.select("source", "item_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])


def item_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.explode(keywords(F.col("text"))).alias("term"))


_MATCHED = f"""
WITH d AS (SELECT DISTINCT source, unnest({_KEYS}) AS term FROM documents),
b AS (SELECT item_id, unnest({_KEYS}) AS term FROM benchmark),
n AS (SELECT x.item_id, count(term) AS total FROM benchmark x LEFT JOIN b USING (item_id) GROUP BY x.item_id),
f AS (SELECT source, item_id, count(*) AS matched FROM d JOIN b USING (term) GROUP BY source, item_id),
m AS (SELECT s.source, x.item_id, coalesce(matched, 0) AS matched FROM (SELECT DISTINCT source FROM documents) s CROSS JOIN (SELECT DISTINCT item_id FROM benchmark) x
LEFT JOIN f ON f.source IS NOT DISTINCT FROM s.source AND f.item_id = x.item_id)
"""


@query(f"{_MATCHED} SELECT source, item_id, matched, total, CASE WHEN total > 0 THEN floor(matched * 100.0::DOUBLE / total + 0.5::DOUBLE)::BIGINT ELSE 0 END AS pct FROM m JOIN n USING (item_id)")
def keyword_match_stats(spark, sf_dir):
    """How many of an item's keywords a source's documents have, and their whole percentage, halves up.

    Every pair is listed, also those without a common keyword and items without any, at 0.
    """
    both = _matched(spark, sf_dir)
    pct = F.when(F.col("total") > 0, F.floor(F.col("matched") * 100.0 / F.col("total") + 0.5)).otherwise(F.lit(0))
    return both.select("source", "item_id", "matched", "total", pct.cast("long").alias("pct"))


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, item_id, matched, total."""
    terms = item_terms(spark, sf_dir)
    totals = terms.groupBy("item_id").agg(F.count(F.lit(1)).alias("total"))
    found = source_terms(spark, sf_dir, terms).join(terms, "term").groupBy("source", "item_id").agg(F.count(F.lit(1)).alias("matched"))
    return all_pairs(spark, sf_dir, found).join(totals, "item_id", "left").withColumn("total", F.coalesce("total", F.lit(0)))


@query(f"""WITH u AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9-]+')) AS t FROM benchmark),
c AS (SELECT item_id, t AS term, count(*) AS uses FROM u WHERE {_KEY} GROUP BY ALL)
SELECT item_id, term, uses, row_number() OVER (PARTITION BY item_id ORDER BY uses DESC, term) AS place FROM c
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY uses DESC, term) <= 8""")
def keyword_extract_top(spark, sf_dir):
    """The eight most used keywords of an item; ties by term."""
    terms = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(T.TOKEN), 0)).alias("term"))
    kept = terms.where((F.length("term") >= 3) & ~F.col("term").isin(*STOP_WORDS) & ~F.col("term").rlike("^[0-9]+$"))
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("uses"), "term"))
    return kept.groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("uses")).withColumn("place", place).where("place <= 8")


_MARKED = ("lorem", "data", "system", "time", "model")


@query(f"""WITH p AS (SELECT doc_id, unnest(regexp_extract_all(text, '[a-zA-Z0-9-]+|[^a-zA-Z0-9-]+')) AS part FROM documents)
SELECT doc_id, regexp_matches(part, '^[a-zA-Z0-9-]') AND regexp_replace(lower(part), '^-+|-+$', '', 'g') IN ({", ".join(f"'{w}'" for w in _MARKED)}) AS is_match,
count(*) AS segments, sum(length(part))::BIGINT AS chars FROM p GROUP BY ALL""")
def keyword_segments(spark, sf_dir):
    """A text cut into words and gaps, with the marked words; nothing of it is lost."""
    words = F.array(*[F.lit(w) for w in _MARKED])
    parts = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.segments(F.col("text"), words)).alias("s"))
    return parts.groupBy("doc_id", F.col("s.is_match").alias("is_match")).agg(F.count(F.lit(1)).alias("segments"), F.sum(F.length("s.text")).alias("chars"))


TERMS = ("the", "license", "c++", "e-mail", "copyright")


def _sql_term(term: str) -> str:
    return rf"regexp_matches(lower(text), '(?:^|[^\p{{L}}\p{{N}}_]){term.replace('+', '[+]')}(?:$|[^\p{{L}}\p{{N}}_])')"


@query("SELECT doc_id, " + ", ".join(f"coalesce({_sql_term(t)}, false) AS t{i}" for i, t in enumerate(TERMS)) + " FROM documents")
def whole_term_hits(spark, sf_dir):
    """Which of a list of terms stand in a document as whole terms."""
    return table(spark, sf_dir, "documents").select("doc_id", *[T.has_term(F.col("text"), t).alias(f"t{i}") for i, t in enumerate(TERMS)])


_GAPS = f"""{_MATCHED}, h AS (SELECT x.item_id, count(y.term) AS held FROM benchmark x LEFT JOIN (SELECT item_id, term FROM b SEMI JOIN (SELECT DISTINCT term FROM d) z USING (term)) y USING (item_id) GROUP BY x.item_id)"""


@query(f"""{_GAPS} SELECT source, item_id, total - matched AS missing, held - matched AS injectable, total - held AS non_injectable,
CASE WHEN total > 0 THEN matched * 100.0::DOUBLE / total ELSE 100.0 END AS current_pct, CASE WHEN total > 0 THEN held * 100.0::DOUBLE / total ELSE 100.0 END AS potential_pct FROM m JOIN n USING (item_id) JOIN h USING (item_id)""")
def keyword_gap(spark, sf_dir):
    """Keywords of an item that a source lacks: those that the whole corpus could supply, and those it lacks too.

    An item without keywords lacks none: 100 per cent.
    """
    terms = item_terms(spark, sf_dir)
    known = source_terms(spark, sf_dir, terms).select("term").distinct()
    held = terms.join(known, "term", "left_semi").groupBy("item_id").agg(F.count(F.lit(1)).alias("held"))
    m, n, h = F.col("matched"), F.col("total"), F.coalesce("held", F.lit(0))
    return _matched(spark, sf_dir).join(held, "item_id", "left").select(
        "source", "item_id", (n - m).alias("missing"), (h - m).alias("injectable"), (n - h).alias("non_injectable"),
        F.when(n > 0, m * 100.0 / n).otherwise(100.0).alias("current_pct"), F.when(n > 0, h * 100.0 / n).otherwise(100.0).alias("potential_pct"))


#: Headings that tell of a section (fixed values).
SECTIONS = {
    "summary": ("summary", "objective", "profile", "about"),
    "experience": ("experience", "work history", "employment"),
    "education": ("education", "academic", "degree"),
    "skills": ("skills", "technologies", "competencies", "technical"),
}
WEIGHTS = {"keyword": 0.55, "skills": 0.25, "sections": 0.20}
LONG = 8  # keywords of so many letters stand for an item's skills
_HAS = [f"bool_or(regexp_matches(lower(coalesce(text, '')), '{'|'.join(p)}'))::INT" for p in SECTIONS.values()]
_COMPOSITE = f"""{_GAPS}, s AS (SELECT source, 25.0::DOUBLE * ({" + ".join(_HAS)}) AS sections FROM documents GROUP BY source),
kb AS (SELECT item_id, count(*) AS skills FROM b WHERE length(term) >= {LONG} GROUP BY item_id),
km AS (SELECT source, item_id, count(*) AS hits FROM d JOIN b USING (term) WHERE length(term) >= {LONG} GROUP BY source, item_id),
c AS (SELECT m.source, m.item_id, CASE WHEN total > 0 THEN matched * 100.0::DOUBLE / total ELSE 0.0 END AS keyword, total - matched AS lacking, held - matched AS injectable, coalesce(hits * 100.0::DOUBLE / skills, 0.0::DOUBLE) AS skills, sections
FROM m JOIN n USING (item_id) JOIN h USING (item_id) JOIN s ON s.source IS NOT DISTINCT FROM m.source LEFT JOIN kb USING (item_id) LEFT JOIN km ON km.source IS NOT DISTINCT FROM m.source AND km.item_id = m.item_id)"""


def weighted_score(keyword: Column, skills: Column, sections: Column) -> Column:
    """0 to 100 of three parts, unrounded; the keyword part is held to its bounds."""
    held = F.least(F.greatest(keyword, F.lit(0.0)), F.lit(100.0))
    return held * WEIGHTS["keyword"] + skills * WEIGHTS["skills"] + sections * WEIGHTS["sections"]


def advice(keyword: Column, skills: Column, sections: Column, missing: Column, injectable: Column) -> Column:
    """array of rule names that hold for the part scores and the counts of missing and injectable keywords; never empty."""
    rules = F.array_compact(F.array(
        F.when((keyword < 60) & (missing > 0), "add_missing"),
        F.when(injectable > 0, "use_master"),
        F.when(skills < 60, "expand_skills"),
        F.when(sections < 75, "add_sections"),
        F.when((keyword >= 80) & (skills >= 80), "quantify"),
    ))
    return F.when(F.size(rules) == 0, F.array(F.lit("aligned"))).otherwise(rules)


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, item_id, matched, total, injectable, keyword, skills, sections of every pair; one pass over the matches."""
    long = F.length("term") >= LONG
    terms = item_terms(spark, sf_dir)
    totals = terms.groupBy("item_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(long).alias("n_skills"))
    held = source_terms(spark, sf_dir, terms)
    hits = held.join(terms, "term").groupBy("source", "item_id").agg(F.count(F.lit(1)).alias("matched"), F.count_if(long).alias("hits"))
    anywhere = terms.join(held.select("term").distinct(), "term", "left_semi").groupBy("item_id").agg(F.count(F.lit(1)).alias("held"))
    text = F.lower(F.coalesce("text", F.lit("")))
    flags = [F.bool_or(text.rlike("|".join(p))).cast("int") for p in SECTIONS.values()]
    headed = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("_source")).agg((25.0 * sum(flags[1:], flags[0])).alias("sections"))
    skills = F.when(F.col("n_skills") > 0, F.col("hits") * 100.0 / F.col("n_skills")).otherwise(F.lit(0.0))
    keyword = F.when(F.col("total") > 0, F.col("matched") * 100.0 / F.col("total")).otherwise(F.lit(0.0))
    pairs = all_pairs(spark, sf_dir, hits).join(totals, "item_id", "left").join(anywhere, "item_id", "left").join(headed, F.col("source").eqNullSafe(F.col("_source")))
    total = F.coalesce("total", F.lit(0))
    return pairs.select("source", "item_id", "matched", total.alias("total"), (F.coalesce("held", F.lit(0)) - F.col("matched")).alias("injectable"), keyword.alias("keyword"), skills.alias("skills"), "sections")


@query(f"{_COMPOSITE} SELECT source, item_id, keyword, skills, sections, keyword * 0.55::DOUBLE + skills * 0.25::DOUBLE + sections * 0.2::DOUBLE AS score FROM c")
def composite_score(spark, sf_dir):
    """Keywords matched, long keywords covered and sections headed, in per cent, and their weighted sum."""
    return _parts(spark, sf_dir).select("source", "item_id", "keyword", "skills", "sections", weighted_score(F.col("keyword"), F.col("skills"), F.col("sections")).alias("score"))


@query(f"""{_COMPOSITE}, r AS (SELECT unnest(CASE WHEN len(list_filter(l, lambda x: x IS NOT NULL)) = 0 THEN ['aligned'] ELSE list_filter(l, lambda x: x IS NOT NULL) END) AS rule FROM
(SELECT [CASE WHEN keyword < 60 AND lacking > 0 THEN 'add_missing' END, CASE WHEN injectable > 0 THEN 'use_master' END, CASE WHEN skills < 60 THEN 'expand_skills' END,
CASE WHEN sections < 75 THEN 'add_sections' END, CASE WHEN keyword >= 80 AND skills >= 80 THEN 'quantify' END] AS l FROM c))
SELECT rule, count(*) AS pairs FROM r GROUP BY ALL""")
def recommendations(spark, sf_dir):
    """How often each piece of advice is given; the whole corpus is the master text."""
    rules = advice(F.col("keyword"), F.col("skills"), F.col("sections"), F.col("total") - F.col("matched"), F.col("injectable"))
    return _parts(spark, sf_dir).select(F.explode(rules).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("pairs"))


def _sql_each(column: str, patterns: tuple[str, ...], by: str) -> str:
    for p in patterns:
        flags = "gi" if p.startswith("(?i)") else "g"
        column = f"regexp_replace({column}, '{p.removeprefix('(?i)').replace(chr(39), chr(39) * 2)}', '{by}', '{flags}')"
    return column


@query(f"SELECT doc_id, {_sql_each('text', T.CREDENTIALS, '[REDACTED]')} AS text FROM documents")
def redact_secrets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.redacted(F.col("text")).alias("text"))


@query(f"SELECT doc_id, {_sql_each('text', T.MESSAGE_CREDENTIALS, '<redacted>')} AS text FROM documents")
def redact_messages(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.redacted_message(F.col("text")).alias("text"))


@query(f"SELECT conv_id, turn, {_sql_each('text', tuple('(?i)' + p for p in T.INJECTIONS), '[REDACTED]')} AS text FROM conversations")
def redact_injection(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.without_injections(F.col("text")).alias("text"))


_EDGE = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"


@query(rf"SELECT doc_id, regexp_matches(text, '{_EDGE[0]}(?:{T.MONTHS})[a-z]*{_EDGE[1]}', 'i') AS has_month FROM documents")
def month_presence(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.has_month(F.col("text")).alias("has_month"))


@query(rf"""WITH y AS (SELECT doc_id, regexp_extract_all(text, '[0-9]{{4}}') AS y, regexp_matches(text, '{_EDGE[0]}(?:present|current|now|ongoing){_EDGE[1]}', 'i') AS c FROM documents)
SELECT doc_id, CASE WHEN len(y) = 0 THEN '' WHEN c THEN array_to_string(y, ' - ') || ' - current' WHEN len(y) = 2 AND y[1] = y[2] THEN y[1] ELSE array_to_string(y, ' - ') END AS years
FROM y WHERE y IS NOT NULL""")
def year_keys(spark, sf_dir):
    """The years of a text as one key."""
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", T.date_key(F.col("text")).alias("years"))


@query(r"SELECT doc_id, array_to_string(regexp_extract_all(text, '[0-9]+%|[0-9]+x|[$][0-9]+'), ',') AS metrics FROM documents WHERE regexp_matches(text, '[0-9]+%|[0-9]+x|[$][0-9]+')")
def metrics_extracted(spark, sf_dir):
    """Percentages, factors and amounts of a text in their order."""
    return table(spark, sf_dir, "documents").where(F.col("text").rlike(T.METRIC)).select("doc_id", F.array_join(T.metrics(F.col("text")), ",").alias("metrics"))


@query(r"""SELECT conv_id, turn, coalesce(""" + ", ".join(f"nullif(regexp_replace(regexp_extract(text, '{p.replace(chr(39), chr(39) * 2)}', 1), '[.]+$', ''), '')" for p in T.INTRODUCTIONS) + """, '') AS name FROM conversations""")
def intro_names(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.intro_name(F.col("text")).alias("name"))


@query(r"SELECT doc_id, sha256(trim(regexp_replace(lower(text), '[\x20\x09-\x0D]+', ' ', 'g'), ' ')) AS fingerprint FROM documents")
def content_fingerprint(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(normalized(F.col("text")), 256).alias("fingerprint"))


@query(r"""WITH t AS (SELECT source, doc_id, unnest(list_distinct(regexp_extract_all(text, '[0-9]+'))) AS n FROM documents),
f AS (SELECT source, n, min(doc_id) AS first_doc FROM t GROUP BY ALL) SELECT t.doc_id, count(*) AS novel FROM t JOIN f ON t.source = f.source AND t.n = f.n AND t.doc_id = f.first_doc GROUP BY ALL""")
def novel_numbers(spark, sf_dir):
    """Numbers that no earlier document of the source has."""
    each = table(spark, sf_dir, "documents").select("source", "doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[0-9]+"), 0))).alias("n"))
    return each.groupBy("source", "n").agg(F.min("doc_id").alias("doc_id")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("novel"))


@query(r"""SELECT source, sum(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')))::BIGINT AS words, count(*) AS docs FROM documents GROUP BY ALL""")
def word_counts(spark, sf_dir):
    words = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), 0))
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(words).alias("words"), F.count(F.lit(1)).alias("docs"))


@query(r"""WITH l AS (SELECT doc_id, list_filter([trim(regexp_replace(x, '^[\x20\x09-\x0D]*(?:[-*•]+|[0-9]+[.)])[\x20\x09-\x0D]*', ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))
FOR x IN regexp_split_to_array(text, '\r?\n+')], lambda x: x <> '') AS l FROM documents)
SELECT doc_id, i AS place, line FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM l)""")
def split_bullets(spark, sf_dir):
    """Non-blank lines without bullets, with their places."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("k", "line"))
    return rows.select("doc_id", (F.col("k") + 1).cast("long").alias("place"), "line")


@query(f"""{_COMPOSITE}, p AS (SELECT m.source, m.item_id, b.term, d.term IS NOT NULL AS has, x.term IS NOT NULL AS anywhere FROM m JOIN b USING (item_id) LEFT JOIN d ON d.source IS NOT DISTINCT FROM m.source AND d.term = b.term
LEFT JOIN (SELECT DISTINCT term FROM d) x ON x.term = b.term), r AS (SELECT *, row_number() OVER (PARTITION BY source, item_id, anywhere ORDER BY term) AS k FROM p WHERE NOT has),
l AS (SELECT source, item_id, string_agg(term, ',' ORDER BY term) FILTER (NOT anywhere AND k <= 10) AS missing, string_agg(term, ',' ORDER BY term) FILTER (anywhere AND k <= 10) AS injectable FROM r GROUP BY ALL)
SELECT c.source, c.item_id, round_even(least(greatest(keyword, 0), 100) * 0.55::DOUBLE + skills * 0.25::DOUBLE + sections * 0.2::DOUBLE, 1) AS overall, coalesce(missing, '') AS missing, coalesce(l.injectable, '') AS injectable
FROM c LEFT JOIN l ON l.source IS NOT DISTINCT FROM c.source AND l.item_id = c.item_id""")
def match_report(spark, sf_dir):
    """The whole score to one place, and up to ten keywords each that no source has and that another source has, by alphabet."""
    parts = _parts(spark, sf_dir)
    score = F.bround(weighted_score(F.col("keyword"), F.col("skills"), F.col("sections")), 1)
    terms = item_terms(spark, sf_dir)
    held = source_terms(spark, sf_dir, terms).withColumn("has", F.lit(True))
    anywhere = held.select("term").distinct().withColumn("anywhere", F.lit(True))
    named = held.withColumnsRenamed({"source": "_s", "term": "_t"})
    lacking = parts.select("source", "item_id").join(terms, "item_id").join(named, F.col("source").eqNullSafe(F.col("_s")) & (F.col("term") == F.col("_t")), "left").where("has is null").join(anywhere, "term", "left")
    some = lambda c: F.array_join(F.slice(F.array_sort(F.collect_list(F.when(c, F.col("term")))), 1, 10), ",")
    lists = lacking.groupBy(F.col("source").alias("_source"), F.col("item_id").alias("_item")).agg(some(F.col("anywhere").isNull()).alias("missing"), some(F.col("anywhere").isNotNull()).alias("injectable"))
    both = parts.drop("injectable").join(lists, F.col("source").eqNullSafe(F.col("_source")) & (F.col("item_id") == F.col("_item")), "left")
    return both.select("source", "item_id", score.alias("overall"), F.coalesce("missing", F.lit("")).alias("missing"), F.coalesce("injectable", F.lit("")).alias("injectable"))


def with_cache(rows: DataFrame, text: str, cache: DataFrame, compute: Column, name: str) -> DataFrame:
    """rows with `name` and cached: taken from cache (hash, value) where a text's hash is there, computed elsewhere."""
    known = cache.select(F.col("hash").alias("_hash"), F.col("value").alias("_value"))
    both = rows.join(known, F.sha2(F.coalesce(text, F.lit("")), 256) == F.col("_hash"), "left")
    return both.withColumns({name: F.when(F.col("_hash").isNotNull(), F.col("_value")).otherwise(compute), "cached": F.col("_hash").isNotNull()}).drop("_hash", "_value")


@query(f"""WITH h AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(len({_KEYS}), -1) AS n FROM documents), c AS (SELECT DISTINCT t FROM h WHERE doc_id % 2 = 0)
SELECT doc_id, c.t IS NOT NULL AS cached, CASE WHEN c.t IS NOT NULL THEN 0 ELSE n END AS n FROM h LEFT JOIN c USING (t)""")
def keyword_cache(spark, sf_dir):
    """Keywords of documents, not worked out again for texts that even ids hold in the cache (which says 0 here)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cache = docs.where("doc_id % 2 = 0").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash")).distinct().withColumn("value", F.lit(0))
    return with_cache(docs, "text", cache, F.coalesce(F.size(keywords(F.col("text"))), F.lit(-1)), "n").select("doc_id", "cached", F.col("n").cast("long").alias("n"))
