"""Queries over small checks and roll-ups: paths, limits, keys, verdicts, prompts, run traces and grouped answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import coercion, scalars
from tessera.functions.text import STOP_WORDS
from tessera.operators.records import json_kind
from tessera.plans.catalog import query
from tessera.sources.tables import table

_PATHS = ("summary", "personalInfo.name", "personalInfoX", "customSections[0]", "workExperience[0].company", "workExperience[1].description", "workExperience[1].years[2]", "education[0].degree",
          "education[0].description", "education", "educationX.y", "additional.technicalSkills", "sectionMeta.x", "a.id[7]", "idx", "personalProjects[3].website")
_BLOCKED = (False, True, False, True, True, False, True, True, False, True, True, False, True, True, False, True)


@query("SELECT event_id, p.path, p.blocked FROM events JOIN (VALUES " + ", ".join(f"({i}, '{p}', {b})" for i, (p, b) in enumerate(zip(_PATHS, _BLOCKED))) + f") p(i, path, blocked) ON p.i = event_id % {len(_PATHS)}")
def blocked_paths(spark, sf_dir):
    """Whether paths of changes are closed to them."""
    paths = F.array(*[F.lit(p) for p in _PATHS])
    rows = table(spark, sf_dir, "events").select("event_id", F.get(paths, (F.col("event_id") % len(_PATHS)).cast("int")).alias("path"))
    return rows.select("event_id", "path", scalars.path_blocked(F.col("path")).alias("blocked"))


@query(r"""WITH s AS (SELECT doc_id, length(text) + 2 + len(regexp_extract_all(text, '["\\\x08\x09\x0A\x0C\x0D]')) + 5 * len(regexp_extract_all(text, '[\x00-\x07\x0B\x0E-\x1F]'))
+ 5 * len(regexp_extract_all(text, '[\x{80}-\x{ffff}]')) + 11 * len(regexp_extract_all(text, '[\x{10000}-\x{10ffff}]')) AS chars, length(text) AS n, octet_length(encode(text)) AS b, text FROM documents)
SELECT doc_id, chars, concat_ws(',', CASE WHEN chars > 200000 THEN 'record' END, CASE WHEN n > 100000 THEN 'job' END, CASE WHEN n > 512000 THEN 'prompt' END) AS over,
CASE WHEN trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' THEN 'empty' WHEN b > 4096 THEN 'too_large' ELSE 'accepted' END AS verdict FROM s""")
def input_limits(spark, sf_dir):
    """Characters of documents as escaped JSON, limits they break, and a verdict by bytes."""
    text = F.col("text")
    size = scalars.escaped_length(text)
    return table(spark, sf_dir, "documents").select("doc_id", size.cast("long").alias("chars"), F.array_join(scalars.too_long(size, text, text), ",").alias("over"), scalars.text_verdict(text, 4096).alias("verdict"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN (CASE WHEN event_id % 2 = 0 THEN 'questions' ELSE '' END) WHEN 1 THEN (CASE WHEN event_id % 2 = 0 THEN 'resume_questions,skill_gaps,talking_points' ELSE 'skill_gaps,talking_points' END) ELSE '' END AS missing FROM events""")
def required_keys(spark, sf_dir):
    """What answers of three kinds lack."""
    i = F.col("event_id")
    kind = F.when(i % 3 == 0, "enrichment").when(i % 3 == 1, "interview_prep").otherwise("resume")
    keys = F.when(i % 3 == 0, F.array(F.lit("items_to_enrich"))).when(i % 3 == 1, F.array(F.lit("role_fit_analysis"), F.lit("project_follow_ups")))
    more = F.when(i % 2 == 1, F.array(F.lit("questions"), F.lit("resume_questions"))).otherwise(F.array().cast("array<string>"))
    held = F.concat(F.coalesce(keys, F.array().cast("array<string>")), more)
    return table(spark, sf_dir, "events").select("event_id", F.array_join(scalars.missing_keys(kind, held), ",").alias("missing"))


@query("""SELECT page_id, length(html) >= 1000 AND page_id % 2 = 0 AND (page_id % 3 <> 0 OR html LIKE '%<p>%') AND NOT (page_id % 5 = 0) AS shown FROM pages""")
def page_verdicts(spark, sf_dir):
    """Pages by what is known of them: every second is of the right kind, a third were searched for text, a fifth have no page."""
    i = F.col("page_id")
    verdict = scalars.page_verdict(i % 2 == 0, F.length("html"), F.when(i % 5 == 0, 0).when(i % 5 == 1, 3), F.when(i % 3 == 0, F.contains("html", F.lit("<p>"))))
    return table(spark, sf_dir, "pages").select("page_id", verdict.alias("shown"))


@query("""SELECT a.event_id, coalesce(a.user_id = b.user_id AND a.event_type = b.event_type AND a.props = b.props, false) AS replay FROM events a LEFT JOIN events b ON b.event_id = a.event_id - 1""")
def identical_requests(spark, sf_dir):
    """Whether an event repeats the one before it in all that counts."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props")
    before = events.select((F.col("event_id") + 1).alias("event_id"), *[F.col(c).alias(f"was_{c}") for c in ("user_id", "event_type", "props")])
    same = scalars.identical([(F.col(c), F.col(f"was_{c}")) for c in ("user_id", "event_type", "props")])
    return events.join(before, "event_id", "left").select("event_id", same.alias("replay"))


_LISTS = """l AS (SELECT o_custkey AS id, list(o_orderpriority ORDER BY o_orderkey) FILTER (o_orderstatus = 'F') AS a, list(o_orderpriority ORDER BY o_orderkey) FILTER (o_orderstatus = 'O') AS b FROM orders GROUP BY o_custkey),
k AS (SELECT id, coalesce(a, CAST([] AS VARCHAR[])) AS a, coalesce(b, CAST([] AS VARCHAR[])) AS b FROM l)"""


def customer_keywords(spark, sf_dir) -> DataFrame:
    """id and two lists of order priorities of customers."""
    held = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus", "o_orderpriority"))).alias("l"))
    pick = lambda s: F.transform(F.filter("l", lambda x: x["o_orderstatus"] == s), lambda x: x["o_orderpriority"])
    return held.select("id", pick("F").alias("a"), pick("O").alias("b"))


@query(f"""WITH {_LISTS} SELECT id, array_to_string(CASE WHEN len(a) + len(b) = 0 THEN ['general'] ELSE list_concat([('skill:' || x) FOR x IN a[1:3]], [('duty:' || x) FOR x IN b[1:2]]) END, ',') AS suggestions,
CASE WHEN len(a) + len(b) = 0 THEN 'none' ELSE concat_ws(chr(10) || chr(10), CASE WHEN len(a) > 0 THEN 'required:' || chr(10) || '- ' || array_to_string(a, chr(10) || '- ') END,
CASE WHEN len(b) > 0 THEN 'other:' || chr(10) || '- ' || array_to_string(b, chr(10) || '- ') END) END AS block FROM k""")
def prompt_parts(spark, sf_dir):
    """Suggestions and the block of keywords for a prompt."""
    a, b = F.col("a"), F.col("b")
    return customer_keywords(spark, sf_dir).select("id", F.array_join(scalars.suggestions(a, b), ",").alias("suggestions"), scalars.keyword_block(a, F.array().cast("array<string>"), b).alias("block"))


@query("""SELECT c_custkey, CASE WHEN length(c_name) <= 8 THEN repeat('*', length(c_name)) ELSE left(c_name, 4) || repeat('*', length(c_name) - 8) || right(c_name, 4) END AS masked,
CASE WHEN length(s) = 0 THEN NULL WHEN length(s) <= 4 THEN repeat('*', length(s)) ELSE '...' || right(s, 4) END AS short, '```text' || chr(10) || coalesce(nullif(s, ''), '<empty>') || chr(10) || '```' AS block
FROM (SELECT *, left(c_name, c_custkey % 9) AS s FROM customer)""")
def masked_keys(spark, sf_dir):
    part = F.left("c_name", (F.col("c_custkey") % 9).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", scalars.masked(F.col("c_name")).alias("masked"), scalars.masked_short(part).alias("short"), scalars.code_block(part).alias("block"))


@query("""SELECT event_id, '{"api_key":"[REDACTED]","k":"' || json_extract_string(props, '$.k') || '","provider":"' || event_type || '"}' AS settings FROM events""")
def scrubbed_settings(spark, sf_dir):
    """Settings with their secrets hidden, keys kept."""
    given = F.map_concat(F.create_map(F.lit("api_key"), F.concat(F.lit("sk-"), "user_id")), F.from_json("props", "map<string,string>"), F.create_map(F.lit("provider"), F.col("event_type")))
    return table(spark, sf_dir, "events").select("event_id", F.to_json(scalars.scrubbed(given)).alias("settings"))


@query(r"""SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE regexp_replace(left(text, 200), '[\x20\x09-\x0D]+$', '') || chr(10) || chr(10) || '[truncated]' END AS text FROM documents""")
def bounded_prompts(spark, sf_dir):
    """Texts held to 200 characters, which show it."""
    return table(spark, sf_dir, "documents").select("doc_id", scalars.held_to(F.col("text"), 200).alias("text"))


@query("""SELECT event_id, least(greatest(event_id % 700 - 100, 1), CASE WHEN event_id % 4 = 0 THEN 256 ELSE 512 END) AS tokens,
floor(CASE event_type WHEN 'view' THEN 30 WHEN 'click' THEN 180 ELSE 120 END * greatest(1.0::DOUBLE, event_id % 9000 / 4096.0::DOUBLE) * CASE event_id % 3 WHEN 0 THEN 1.5::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END)::INT AS seconds,
[0.1::DOUBLE, 0.3::DOUBLE, 0.5::DOUBLE, 0.7::DOUBLE][least(event_id % 6, 3) + 1] AS temperature FROM events""")
def call_budgets(spark, sf_dir):
    """Tokens, seconds and temperature of calls to come."""
    i, kind = F.col("event_id"), F.col("event_type")
    operation = F.when(kind == "view", "health_check").when(kind == "click", "json").otherwise("other")
    provider = F.when(i % 3 == 0, "openrouter").when(i % 3 == 1, "ollama").otherwise("elsewhere")
    return table(spark, sf_dir, "events").select(
        "event_id", scalars.token_budget(i % 700 - 100, F.when(i % 4 == 0, F.lit(256)), 512).alias("tokens"), scalars.seconds_allowed(operation, i % 9000, provider).alias("seconds"),
        scalars.retry_temperature((i % 6).cast("int")).alias("temperature"))


@query("""SELECT conv_id, turn, 'Turn ' || turn || ' of {nobody}: ' || role || '{' AS label FROM conversations""")
def translated_labels(spark, sf_dir):
    """A label filled in from parameters; a name nobody gives stays."""
    params = F.create_map(F.lit("n"), F.col("turn").cast("string"), F.lit("who"), F.col("role"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", scalars.filled_in(F.lit("Turn {n} of {nobody}: {who}{"), params).alias("label"))


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


@query(rf"""WITH w AS (SELECT item_id, i, regexp_replace(w, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g') AS w FROM (SELECT item_id, unnest(regexp_split_to_array(text, '[\x20\x09-\x0D]+')) AS w,
generate_subscripts(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), 1) AS i FROM benchmark)), f AS (SELECT item_id, w, min(i) AS i FROM w WHERE regexp_matches(w, '^\p{{Lu}}\p{{Ll}}*$') AND lower(w) NOT IN ({_STOP}) GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY i) AS r FROM f) SELECT b.item_id, coalesce(string_agg(w, ',' ORDER BY r), '') AS words FROM benchmark b LEFT JOIN n ON n.item_id = b.item_id AND r <= 8 GROUP BY b.item_id""")
def title_keywords(spark, sf_dir):
    """Up to eight words of a text that are written like names."""
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(scalars.title_words(F.col("text"), STOP_WORDS), ",").alias("words"))


@query("""SELECT l.doc_id, CASE WHEN l.quality = 1 AND s.lang IS NOT NULL THEN 'structured' WHEN l.doc_id % 2 = 0 THEN 'json' END AS data, coalesce(nullif(s.lang, 'en'), CASE WHEN l.doc_id % 2 = 1 THEN s.source END) AS markdown,
CASE WHEN l.doc_id % 3 = 0 THEN NULL ELSE 'ok' END AS parsed, coalesce(nullif(trim(CASE WHEN l.doc_id % 4 = 0 THEN ' ' ELSE s.source END), ''), s.lang) AS role FROM labels l JOIN documents s USING (doc_id)""")
def source_fallbacks(spark, sf_dir):
    """Which form of a record is taken where several may be there."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    i = F.col("doc_id")
    data = F.coalesce(F.when((F.col("quality") == 1) & F.col("lang").isNotNull(), "structured"), F.when(i % 2 == 0, "json"))
    # Broken JSON is no record.
    parsed = F.from_json(F.when(i % 3 == 0, "{broken").otherwise('{"a": "ok"}'), "a string")["a"]
    return rows.select("doc_id", data.alias("data"), scalars.first_source(F.nullif("lang", F.lit("en")), F.when(i % 2 == 1, F.col("source"))).alias("markdown"), parsed.alias("parsed"),
                       F.coalesce(scalars.named_or_null(F.when(i % 4 == 0, " ").otherwise(F.col("source"))), F.col("lang")).alias("role"))


def trace(steps: DataFrame, run: str, stage: str, ok: str, score: str, shown: str, order: str) -> DataFrame:
    """One row a run: steps, failed ones (no verdict is a failure), whether all passed, failed stages in order, least whole score from 1 to 5, shown pages."""
    bad = ~F.coalesce(F.col(ok), F.lit(False))
    failed = F.array_sort(F.collect_list(F.when(bad, F.struct(F.col(order).alias("o"), F.col(stage).alias("s")))))
    out = steps.groupBy(run).agg(F.count(F.lit(1)).alias("total"), F.count_if(bad).alias("failed"), failed.alias("f"), F.min(score).alias("least_score"), F.count_if(F.coalesce(F.col(shown), F.lit(False))).alias("shown"))
    return out.select(run, "total", "failed", (F.col("failed") == 0).alias("all_passed"), F.transform("f", lambda x: x["s"]).alias("failed_stages"), "least_score", "shown")


@query("""WITH e AS (SELECT user_id, event_id, event_type, CASE WHEN event_type = 'view' THEN NULL ELSE value > 10 END AS ok, CASE WHEN floor(value) BETWEEN 1 AND 5 THEN floor(value)::INT END AS score FROM events WHERE user_id < 40)
SELECT user_id, count(*) AS total, count(*) FILTER (ok IS NOT TRUE) AS failed, count(*) FILTER (ok IS NOT TRUE) = 0 AS all_passed, coalesce(string_agg(event_type, ',' ORDER BY event_id) FILTER (ok IS NOT TRUE), '') AS failed_stages,
min(score) AS least_score, count(*) FILTER (ok) AS shown FROM e GROUP BY user_id""")
def flow_trace(spark, sf_dir):
    """Users' events as runs of a flow."""
    value, kind = F.col("value"), F.col("event_type")
    rows = table(spark, sf_dir, "events").where("user_id < 40").select("user_id", "event_id", "event_type", F.when(kind != "view", value > 10).alias("ok"), F.when(F.floor(value).between(1, 5), F.floor(value).cast("int")).alias("score"))
    return trace(rows, "user_id", "event_type", "ok", "score", "ok", "event_id").withColumn("failed_stages", F.array_join("failed_stages", ","))


def baseline_map(rows: DataFrame, key: str, metrics: list[str], order: str) -> DataFrame:
    """One row: a map from key to its metrics; of a key's rows the last stands. Meant for a run's variations."""
    last = rows.groupBy(key).agg(F.max_by(F.struct(*metrics), F.col(order)).alias("m"))
    return last.agg(F.map_from_entries(F.collect_list(F.struct(F.col(key), F.col("m")))).alias("variations"))


@query("""WITH l AS (SELECT event_type, arg_max(value, event_id) AS v, arg_max(user_id, event_id) AS u FROM events GROUP BY event_type) SELECT string_agg(event_type || '=' || u, ',' ORDER BY event_type) AS variations FROM l""")
def baseline_built(spark, sf_dir):
    """The last event of a type as its baseline."""
    built = baseline_map(table(spark, sf_dir, "events"), "event_type", ["value", "user_id"], "event_id")
    pairs = F.array_sort(F.transform(F.map_entries("variations"), lambda e: F.concat(e["key"], F.lit("="), e["value"]["user_id"].cast("string"))))
    return built.select(F.array_join(pairs, ",").alias("variations"))


def grouped_answers(answers: DataFrame, questions: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, title, answers in order: answers (question_id, answer, place) by the item their question is about; those without a question go."""
    both = answers.join(questions.select("question_id", "item_id"), "question_id").where("item_id <> ''")
    held = both.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("place", "answer"))).alias("a"))
    return held.join(items, "item_id", "left").select("item_id", "title", F.transform("a", lambda x: x["answer"]).alias("answers"))


@query("""SELECT n_nationkey AS item_id, n_name AS title, string_agg(c_mktsegment, ',' ORDER BY c_custkey) AS answers FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_nationkey % 4 <> 0 GROUP BY ALL""")
def answers_by_item(spark, sf_dir):
    """Customers answer questions of nations; some nations are asked nothing."""
    answers = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("question_id"), F.col("c_mktsegment").alias("answer"), F.col("c_custkey").alias("place"))
    nations = table(spark, sf_dir, "nation")
    questions = nations.where("n_nationkey % 4 <> 0").select(F.col("n_nationkey").alias("question_id"), F.col("n_nationkey").cast("string").alias("item_id"))
    items = nations.select(F.col("n_nationkey").cast("string").alias("item_id"), F.col("n_name").alias("title"))
    return grouped_answers(answers, questions, items).select(F.col("item_id").cast("int").alias("item_id"), "title", F.array_join("answers", ",").alias("answers"))


def key_paths(text: Column, levels: int = 6) -> Column:
    """array of (path, kind) of all keys of a JSON object given as text, objects entered, `levels` deep."""
    parsed = F.from_json(text, "map<string,string>")
    here = F.transform(F.map_entries(parsed), lambda e: F.struct(e["key"].alias("path"), e["value"].alias("value")))
    out = here
    for _ in range(levels - 1):
        inner = F.flatten(F.transform(F.filter(here, lambda e: F.coalesce(e["value"].startswith("{"), F.lit(False))), _inside))
        here = inner
        out = F.concat(out, inner)
    return F.transform(out, lambda e: F.struct(e["path"].alias("path"), json_kind(e["value"]).alias("kind")))


def _inside(e: Column) -> Column:
    return F.transform(F.map_entries(F.from_json(e["value"], "map<string,string>")), lambda c: F.struct(F.concat(e["path"], F.lit("."), c["key"]).alias("path"), c["value"].alias("value")))


def parity(reference: DataFrame, other: DataFrame) -> DataFrame:
    """name, path, problem of key paths (name, path, kind of other; path, kind of reference): missing, extra or mismatch."""
    names = other.select("name").distinct()
    wanted = names.join(F.broadcast(reference.select("path", F.col("kind").alias("wanted"))))
    both = wanted.join(other, ["name", "path"], "full")
    problem = F.when(F.col("kind").isNull(), "missing").when(F.col("wanted").isNull(), "extra").when(F.col("kind") != F.col("wanted"), "mismatch")
    return both.select("name", "path", problem.alias("problem")).where("problem is not null")


@query("""SELECT event_id % 50 AS name, path, problem FROM (SELECT DISTINCT event_id % 50 AS event_id FROM events), (VALUES ('a.b', 0, 'missing'), ('a.c', 1, 'mismatch'), ('z', 2, 'extra')) p(path, i, problem) WHERE event_id % 3 = i""")
def key_parity(spark, sf_dir):
    """Message files (one in fifty events) against a reference: some lack a key, some have one of another kind, some one more."""
    reference = spark.createDataFrame([('{"a": {"b": "x", "c": {"d": 1}}, "e": [1]}',)], "t string")
    i = F.col("name")
    text = F.when(i % 3 == 0, '{"a": {"c": {"d": 2}}, "e": []}').when(i % 3 == 1, '{"a": {"b": "y", "c": "no"}, "e": [2]}').otherwise('{"a": {"b": "y", "c": {"d": 2.5}}, "e": [], "z": null}')
    files = table(spark, sf_dir, "events").select((F.col("event_id") % 50).alias("name")).distinct()
    paths = lambda df, *keep: df.select(*keep, F.explode(key_paths(F.col("t"))).alias("p")).select(*keep, "p.*")
    found = parity(paths(reference), paths(files.withColumn("t", text), "name"))
    # What lies in a part of another kind is missing too; the part itself tells enough.
    return found.where("path <> 'a.c.d'")


@query("""WITH n AS (SELECT source, item_id, count(*) AS matched FROM (SELECT DISTINCT source, unnest(string_split(lower(text), ' ')) AS t FROM documents WHERE source < 'src5') JOIN (SELECT DISTINCT item_id, unnest(string_split(lower(text), ' ')) AS t FROM benchmark WHERE item_id % 4 <> 0) USING (t) GROUP BY ALL),
t AS (SELECT item_id, count(DISTINCT t) AS total FROM (SELECT item_id, unnest(string_split(lower(text), ' ')) AS t FROM benchmark) WHERE item_id % 4 <> 0 GROUP BY item_id),
p AS (SELECT s.source, b.item_id, coalesce(matched, 0) AS matched, coalesce(total, 0) AS total FROM (SELECT DISTINCT source FROM documents WHERE source < 'src5') s, benchmark b LEFT JOIN n ON n.source = s.source AND n.item_id = b.item_id LEFT JOIN t ON t.item_id = b.item_id)
SELECT source, item_id, matched, CASE WHEN total > 0 THEN matched * 100.0::DOUBLE / total ELSE 0.0 END AS match_pct, CASE WHEN total > 0 THEN matched * 100.0::DOUBLE / total ELSE 100.0 END AS gap_pct, CASE WHEN total > 0 THEN matched * 1.0::DOUBLE / total ELSE 1.0 END AS present FROM p""")
def empty_conventions(spark, sf_dir):
    """Shares of an item's words by three conventions, which part where an item has no words (every fourth): 0 %, 100 %, 1.

    Every pair of source and item is listed: the items are broadcast, their number is that of the keywords' lists.
    """
    words = lambda df, *keep: df.select(*keep, F.explode(F.split(F.lower("text"), " ")).alias("t")).distinct()
    docs, items = table(spark, sf_dir, "documents").where("source < 'src5'"), table(spark, sf_dir, "benchmark")
    asked = words(items.where("item_id % 4 <> 0"), "item_id")
    matched = words(docs, "source").join(asked, "t").groupBy("source", "item_id").agg(F.count(F.lit(1)).alias("m"))
    totals = asked.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    pairs = docs.select("source").distinct().join(F.broadcast(items.select("item_id")))
    both = pairs.join(matched, ["source", "item_id"], "left").join(totals, "item_id", "left").select("source", "item_id", F.coalesce("m", F.lit(0)).alias("matched"), F.coalesce("n", F.lit(0)).alias("total"))
    m, n = F.col("matched"), F.col("total")
    return both.select("source", "item_id", "matched", scalars.presence(m, n, 100.0, 0.0).alias("match_pct"), scalars.presence(m, n, 100.0, 100.0).alias("gap_pct"), scalars.presence(m, n, 1.0, 1.0).alias("present"))


# Coercion of open values.

_BULLETS = r"""list_filter([trim(regexp_replace(x, '^[\x20\x09-\x0D]*(?:[-*•]+|[0-9]+[.)])[\x20\x09-\x0D]*', ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) FOR x IN regexp_split_to_array(text, '\r?\n+')], lambda x: x <> '')"""


def _odd_values(spark, sf_dir) -> DataFrame:
    """doc_id and JSON of a document's text: bare, in a list beside other things, in objects, or of another kind."""
    i, text = F.col("doc_id"), F.col("text")
    rows = table(spark, sf_dir, "documents").where("text is not null")
    as_list = F.concat(F.lit("["), F.to_json(F.struct(text.alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(text.alias("x")))) - 6), F.lit(', {"name": " n ", "other": "o"}, 7, null, {"x": {"y": ["deep"]}}]'))
    as_object = F.concat(F.lit('{"zzz": "hidden", "label": "last", "text": "first", "value": ['), i.cast("string"), F.lit("]}"))
    bare = F.to_json(F.struct(text.alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(text.alias("x")))) - 6)
    return rows.select("doc_id", F.when(i % 4 == 0, bare).when(i % 4 == 1, as_list).when(i % 4 == 2, as_object).otherwise(F.lit("null")).alias("v"))


@query(rf"""WITH d AS (SELECT doc_id, {_BULLETS} AS l FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN len(l) WHEN 1 THEN len(l) + 3 WHEN 2 THEN 1 ELSE 0 END AS n, sha256(CASE doc_id % 4 WHEN 0 THEN array_to_string(l, '|') WHEN 1 THEN array_to_string(list_concat(l, ['n', '7', 'deep']), '|')
WHEN 2 THEN 'first ' || doc_id || ' last' ELSE '' END) AS digest FROM d""")
def coerced_lists(spark, sf_dir):
    """Open values as lists of text."""
    rows = _odd_values(spark, sf_dir).select("doc_id", coercion.coerced_list("v").alias("l"))
    return rows.select("doc_id", F.size("l").cast("long").alias("n"), F.sha2(F.array_join("l", "|"), 256).alias("digest"))


@query(r"""SELECT doc_id, sha256(CASE doc_id % 4 WHEN 0 THEN t WHEN 1 THEN CASE WHEN t = '' THEN 'n 7 deep' ELSE t || ' n 7 deep' END WHEN 2 THEN 'first ' || doc_id || ' last' ELSE '' END) AS digest
FROM (SELECT doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM documents WHERE text IS NOT NULL)""")
def coerced_texts(spark, sf_dir):
    """Open values as one text."""
    return _odd_values(spark, sf_dir).select("doc_id", F.sha2(coercion.coerced_text("v"), 256).alias("digest"))


@query("""SELECT c_custkey, c_name || ' ' || c_mktsegment || ' plain' AS everything, lower(c_name || ' ' || c_mktsegment || ' ' || c_nationkey || ' plain true') AS searched, c_name || ',' || c_mktsegment AS named FROM customer""")
def flat_records(spark, sf_dir):
    """All texts of a nested record, all its values in lower case, and the names of a list's items."""
    record = F.to_json(F.struct(F.struct(F.col("c_name").alias("a"), F.array("c_mktsegment").alias("b")).alias("p"), F.col("c_nationkey").alias("n"), F.struct(F.lit("plain").alias("t")).alias("q")))
    more = F.concat(F.left(record, F.length(record) - 1), F.lit(', "flag": null}'))
    searched = F.concat(F.left(record, F.length(record) - 1), F.lit(', "flag": "TRUE", "e": ""}'))
    named = F.concat(F.lit("["), F.to_json(F.struct(F.lit("").alias("name"), F.concat(F.lit(" "), "c_name").alias("label"))), F.lit(", null, 5, "), F.to_json(F.struct(F.col("c_mktsegment").alias("value"))), F.lit(', " "]'))
    return table(spark, sf_dir, "customer").select("c_custkey", coercion.flat_text(more).alias("everything"), coercion.flat_search(searched).alias("searched"), F.array_join(coercion.coerced_names(named), ",").alias("named"))


@query("""SELECT c_custkey, c_name AS name, '' AS phone, c_mktsegment || ',more' AS rows, 'plain,bullet' AS styles, 6 AS sections, 'Item ' || c_nationkey AS item FROM customer""")
def conformed_records(spark, sf_dir):
    """Records made whole: missing fields, described parts, styles, items given as bare texts, and default sections."""
    work = F.array(F.struct(F.concat(F.lit("- "), "c_mktsegment", F.lit("\n2) more")).alias("description"), F.array(F.lit("plain"), F.lit("odd"), F.lit("plain")).alias("descriptionStyles")))
    custom = F.struct(F.struct(F.lit("itemList").alias("sectionType"), F.array(F.concat(F.lit("Item "), "c_nationkey")).alias("items")).alias("x"))
    given = F.to_json(F.struct(F.struct(F.col("c_name").alias("name"), F.lit(5).alias("phone")).alias("personalInfo"), work.alias("workExperience"), custom.alias("customSections")))
    out = table(spark, sf_dir, "customer").select("c_custkey", coercion.conformed_json(given).alias("r"))
    at = lambda path: F.get_json_object("r", path)
    joined = lambda path: F.array_join(F.from_json(at(path), "array<string>"), ",")
    return out.select("c_custkey", at("$.personalInfo.name").alias("name"), at("$.personalInfo.phone").alias("phone"), joined("$.workExperience[0].description").alias("rows"),
                      joined("$.workExperience[0].descriptionStyles").alias("styles"), F.size(F.from_json(at("$.sectionMeta"), "array<string>")).alias("sections"), at("$.customSections.x.items[0].title").alias("item"))
