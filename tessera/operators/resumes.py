"""Typed records: positional checks and repairs of entries, lists and section data, all as array expressions.

An entry is a struct with company, title, years, description (rows) and descriptionStyles; a record has arrays of
them. Records are compared place by place, so nothing here shuffles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import METRIC, has_month, has_term, trimmed
from tessera.plans.catalog import query
from tessera.sources.tables import table

ROWS = "array<string>"


def at(values: Column, i: Column) -> Column:
    """The value at a place from 0, null outside."""
    return F.get(values, i)


def fold(text: Column) -> Column:
    """Lower case, white space runs as one space, trimmed; null counts as empty."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " ")))


def restored_years(old: Column, new: Column) -> Column:
    """new, each entry with the old years of its place where those name a month and its own don't."""
    def one(e: Column, i: Column) -> Column:
        was = at(old, i)["years"]
        back = F.coalesce((was != e["years"]) & has_month(was) & ~has_month(e["years"]), F.lit(False))
        return e.withField("years", F.when(back, was).otherwise(e["years"]))

    return F.transform(new, one)


def identity_changes(old: Column, new: Column, fields: tuple[str, ...] = ("company", "title")) -> Column:
    """place.field of what names an entry and isn't what it was; entries beyond the shorter list don't count."""
    pairs = F.slice(F.arrays_zip(old.alias("o"), new.alias("n")), F.lit(1), F.least(F.size(old), F.size(new)))

    def changed(p: Column, i: Column) -> Column:
        was, now = (lambda f: trimmed(F.coalesce(p["o"][f], F.lit("")))), (lambda f: trimmed(F.coalesce(p["n"][f], F.lit(""))))
        return F.array_compact(F.array(*[F.when((was(f) != "") & (was(f) != now(f)), F.concat(i.cast("string"), F.lit(f".{f}"))) for f in fields]))

    return F.flatten(F.transform(pairs, changed))


def row_words(entries: Column) -> Column:
    """Words in all description rows."""
    rows = F.flatten(F.transform(entries, lambda e: F.coalesce(e["description"], F.array().cast(ROWS))))
    return F.aggregate(rows, F.lit(0), lambda n, r: n + F.size(F.regexp_extract_all(r, F.lit(r"[^\x20\x09-\x0D]+"), 0)))


def invented_metrics(old: Column, new: Column) -> Column:
    """Percentages, factors and amounts that the new rows of an entry name and its old rows don't."""
    def said(e: Column) -> Column:
        return F.array_distinct(F.flatten(F.transform(F.coalesce(e["description"], F.array().cast(ROWS)), lambda r: F.regexp_extract_all(r, F.lit(METRIC), 0))))

    return F.flatten(F.transform(new, lambda e, i: F.array_except(said(e), F.coalesce(said(at(old, i)), F.array().cast(ROWS)))))


def change_warnings(old: Column, new: Column) -> Column:
    """Codes of what looks wrong with changed entries; unchanged ones get one code alone."""
    many = (row_words(old) > 0) & (row_words(new) > 1.8 * row_words(old))
    found = F.concat(
        F.array_compact(F.array(F.when(F.size(old) != F.size(new), "section_count"))),
        F.transform(identity_changes(old, new), lambda x: F.concat(F.lit("identity:"), x)),
        F.array_compact(F.array(F.when(many, "word_count"))),
        F.transform(invented_metrics(old, new), lambda x: F.concat(F.lit("metric:"), x)))
    return F.when(old.eqNullSafe(new), F.array(F.lit("nothing_applied"))).otherwise(found)


def restored_styles(old: Column, new: Column) -> Column:
    """new, with the old styles of an entry's place where it lost some: one a row, bullet beyond the old ones."""
    def one(e: Column, i: Column) -> Column:
        was = at(old, i)["descriptionStyles"]
        kept = F.coalesce(F.size(e["descriptionStyles"]) == F.size(e["description"]), F.lit(False)) & e["descriptionStyles"].isNotNull()
        back = F.transform(e["description"], lambda _, k: F.coalesce(F.get(was, k), F.lit("bullet")))
        return e.withField("descriptionStyles", F.when((F.coalesce(F.size(was), F.lit(0)) > 0) & ~kept, back).otherwise(e["descriptionStyles"]))

    return F.transform(new, one)


def with_dropped(old: Column, new: Column) -> Column:
    """new, then the old items that it lacks without regard to case, each once."""
    lowered = F.transform(new, lambda x: F.lower(x))
    lost = F.filter(old, lambda x, i: ~F.array_contains(lowered, F.lower(x)) & ~F.exists(F.slice(old, F.lit(1), i), lambda y: F.lower(y) == F.lower(x)))
    return F.concat(new, lost)


def occurrence(values: Column, x: Column, i: Column) -> Column:
    """How many items before place i are alike."""
    return F.size(F.filter(F.slice(values, F.lit(1), i), lambda y: fold(y) == fold(x)))


def count_of(values: Column, x: Column) -> Column:
    return F.size(F.filter(values, lambda y: fold(y) == fold(x)))


def merged_list(old: Column, new: Column, may_gain: bool) -> Column:
    """new, then old items that it lacks, multiplicity counted; items that old lacks stay only if the list may gain some."""
    kept = new if may_gain else F.filter(new, lambda x, i: occurrence(new, x, i) < count_of(old, x))
    return F.concat(kept, F.filter(old, lambda x, i: occurrence(old, x, i) >= count_of(kept, x)))


def identity(entry: Column, fields: tuple[str, ...] = ("company", "title")) -> Column:
    """What an entry is known by: its id if that isn't 0, else its naming fields."""
    named = F.concat_ws("|", *[fold(entry[f]) for f in fields])
    return F.when(F.coalesce(entry["id"], F.lit(0)) != 0, F.concat(F.lit("id:"), entry["id"].cast("string"))).otherwise(F.concat(F.lit("fields:"), named))


def same_entries(old: Column, new: Column) -> Column:
    """Whether two lists have the same identities, each as often."""
    return F.array_sort(F.transform(old, lambda e: identity(e))) == F.array_sort(F.transform(new, lambda e: identity(e)))


def assigned_ids(ids: Column) -> Column:
    """Ids where the first positive one of each value stays and the others follow on the largest, in order."""
    top = F.coalesce(F.array_max(F.filter(ids, lambda x: x > 0)), F.lit(0))
    fresh = F.transform(ids, lambda x, i: F.when(F.coalesce(x > 0, F.lit(False)) & ~F.exists(F.slice(ids, F.lit(1), i), lambda y: y.eqNullSafe(x)), F.lit(0)).otherwise(F.lit(1)))
    return F.transform(ids, lambda x, i: F.when(at(fresh, i) == 0, x).otherwise(top + F.aggregate(F.slice(fresh, F.lit(1), i + 1), F.lit(0), lambda n, y: n + y)))


def without(values: Column, gone: Column) -> Column:
    """Items but for those in gone, without regard to case."""
    lowered = F.transform(gone, lambda x: F.lower(x))
    return F.filter(values, lambda x: ~F.array_contains(lowered, F.lower(x)))


def any_month(entries: Column) -> Column:
    return F.exists(entries, lambda e: F.coalesce(has_month(e["years"]), F.lit(False)))


def kept_texts(values: Column) -> Column:
    """Trimmed items that aren't blank; null stays null."""
    return F.filter(F.transform(values, lambda x: trimmed(x)), lambda x: F.coalesce(x != "", F.lit(False)))


def with_content(entries: Column, fields: tuple[str, ...] = ("company", "title", "years")) -> Column:
    """Entries with a field or a row that says something; blank rows go with their styles."""
    def tidy(e: Column) -> Column:
        rows = F.arrays_zip(F.coalesce(e["description"], F.array().cast(ROWS)).alias("t"), F.coalesce(e["descriptionStyles"], F.array().cast(ROWS)).alias("s"))
        said = F.filter(rows, lambda r: F.coalesce(trimmed(r["t"]) != "", F.lit(False)))
        return e.withField("description", F.transform(said, lambda r: trimmed(r["t"]))).withField("descriptionStyles", F.transform(said, lambda r: F.coalesce(r["s"], F.lit("bullet"))))

    says = lambda e: reduce(lambda a, b: a | b, [F.coalesce(trimmed(e[f]) != "", F.lit(False)) for f in fields]) | (F.size(e["description"]) > 0)
    return F.filter(F.transform(entries, tidy), says)


def selected_text(entries: Column) -> Column:
    """Titles, companies and rows of entries, joined by a space without the empty ones: neither years nor places."""
    parts = F.flatten(F.transform(entries, lambda e: F.concat(F.array(e["title"], e["company"]), F.coalesce(e["description"], F.array().cast(ROWS)))))
    return F.array_join(F.filter(parts, lambda x: F.coalesce(x != "", F.lit(False))), " ")


# Records of orders: a line is an entry, the tailored one changes some of its parts.

_LINES = """e AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) - 1 AS i, l_linenumber AS n,
'S' || l_suppkey % 7 AS company, 'P' || l_partkey % 5 AS title, month(l_shipdate) AS m, strftime(l_shipdate, '%b %Y') AS long, year(l_shipdate)::VARCHAR AS short, l_quantity::INT AS q, l_returnflag AS flag FROM lineitem),
r AS (SELECT id, i, n, q, flag, company, title, CASE WHEN m % 3 = 0 THEN short ELSE long END AS years, CASE WHEN q % 10 = 0 THEN 'Z' ELSE company END AS company2,
CASE WHEN m % 2 = 0 THEN short ELSE long END AS years2, ['sold ' || q || ' units', flag || ' grade'] AS d, CASE WHEN q % 2 = 0 THEN ['sold ' || q || ' units and a good many of them at once', 'cut ' || q || '% cost'] ELSE ['sold ' || q || ' units', flag || ' grade'] END AS d2,
CASE WHEN flag = 'R' THEN ['plain', 'bullet'] ELSE CAST([] AS VARCHAR[]) END AS s, CASE WHEN q % 3 = 0 THEN CAST([] AS VARCHAR[]) ELSE ['bullet', 'bullet'] END AS s2 FROM e)"""


def order_records(spark, sf_dir) -> DataFrame:
    """id, old and new entries (at most four) of orders with lines."""
    line = table(spark, sf_dir, "lineitem")
    q, m = F.col("l_quantity").cast("int"), F.month("l_shipdate")
    long, short = F.date_format("l_shipdate", "MMM yyyy"), F.year("l_shipdate").cast("string")
    company, title = F.concat(F.lit("S"), (F.col("l_suppkey") % 7).cast("string")), F.concat(F.lit("P"), (F.col("l_partkey") % 5).cast("string"))
    rows = F.array(F.concat(F.lit("sold "), q.cast("string"), F.lit(" units")), F.concat("l_returnflag", F.lit(" grade")))
    rows2 = F.array(F.concat(F.lit("sold "), q.cast("string"), F.lit(" units and a good many of them at once")), F.concat(F.lit("cut "), q.cast("string"), F.lit("% cost")))
    none, both = F.array().cast(ROWS), F.array(F.lit("bullet"), F.lit("bullet"))
    old = F.struct(F.col("l_linenumber").alias("id"), company.alias("company"), title.alias("title"), F.when(m % 3 == 0, short).otherwise(long).alias("years"), rows.alias("description"),
                   F.when(F.col("l_returnflag") == "R", F.array(F.lit("plain"), F.lit("bullet"))).otherwise(none).alias("descriptionStyles"))
    new = F.struct(F.col("l_linenumber").alias("id"), F.when(q % 10 == 0, "Z").otherwise(company).alias("company"), title.alias("title"), F.when(m % 2 == 0, short).otherwise(long).alias("years"),
                   F.when(q % 2 == 0, rows2).otherwise(rows).alias("description"), F.when(q % 3 == 0, none).otherwise(both).alias("descriptionStyles"))
    held = line.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_extendedprice", old.alias("old"), new.alias("new")))).alias("l"))
    return held.select("id", F.transform("l", lambda x: x["old"]).alias("old"), F.slice(F.transform("l", lambda x: x["new"]), 1, 4).alias("new"))


_MONTHED = "regexp_matches({}, '[A-Z][a-z][a-z] ')"


@query(f"""WITH {_LINES} SELECT id, string_agg(CASE WHEN {_MONTHED.format('years')} AND NOT {_MONTHED.format('years2')} THEN years ELSE years2 END, '|' ORDER BY i) AS years FROM r WHERE i < 4 GROUP BY id""")
def restore_years(spark, sf_dir):
    rows = order_records(spark, sf_dir)
    return rows.select("id", F.array_join(F.transform(restored_years(F.col("old"), F.col("new")), lambda e: e["years"]), "|").alias("years"))


@query(f"""WITH {_LINES}, w AS (SELECT id, count(*) AS n, sum(len(string_split(d[1] || ' ' || d[2], ' '))) AS a, sum(CASE WHEN i < 4 THEN len(string_split(d2[1] || ' ' || d2[2], ' ')) END) AS b,
string_agg(CASE WHEN company2 <> company AND i < 4 THEN 'identity:' || i || '.company' END, ',' ORDER BY i) AS ids, string_agg(CASE WHEN q % 2 = 0 AND i < 4 THEN 'metric:' || q || '%' END, ',' ORDER BY i) AS ms,
bool_and(company = company2 AND years = years2 AND d = d2 AND s = s2 AND i < 4) AS same FROM r GROUP BY id)
SELECT id, CASE WHEN same THEN 'nothing_applied' ELSE concat_ws(',', CASE WHEN n > 4 THEN 'section_count' END, ids, CASE WHEN b > 1.8 * a THEN 'word_count' END, ms) END AS warnings FROM w""")
def verify_changes(spark, sf_dir):
    """What looks wrong with an order's changed lines."""
    return order_records(spark, sf_dir).select("id", F.array_join(change_warnings(F.col("old"), F.col("new")), ",").alias("warnings"))


@query(f"""WITH {_LINES} SELECT id, string_agg(array_to_string(CASE WHEN len(s) > 0 AND len(s2) <> 2 THEN s ELSE s2 END, '+'), '|' ORDER BY i) AS styles FROM r WHERE i < 4 GROUP BY id""")
def restore_styles(spark, sf_dir):
    rows = order_records(spark, sf_dir)
    return rows.select("id", F.array_join(F.transform(restored_styles(F.col("old"), F.col("new")), lambda e: F.array_join(e["descriptionStyles"], "+")), "|").alias("styles"))


@query(f"""WITH {_LINES}, a AS (SELECT id, string_agg(title || ' ' || company2 || ' ' || d2[1] || ' ' || d2[2], ' ' ORDER BY i) AS t FROM r WHERE i < 4 GROUP BY id)
SELECT id, t AS selected, lower(t) LIKE '%grade%' AND regexp_matches(lower(t), '(^|[^a-z0-9_])grade($|[^a-z0-9_])') AS graded, regexp_matches(lower(t), '(^|[^a-z0-9_])p1($|[^a-z0-9_])') AS p1 FROM a""")
def selected_texts(spark, sf_dir):
    """The searched text of an order's changed lines, and whether two terms stand in it."""
    rows = order_records(spark, sf_dir).select("id", selected_text(F.col("new")).alias("selected"))
    return rows.select("id", "selected", has_term(F.col("selected"), "grade").alias("graded"), has_term(F.col("selected"), "P1").alias("p1"))


@query(f"""WITH {_LINES}, n AS (SELECT id, count(*) AS a, count(*) FILTER (i < 4) AS b FROM r GROUP BY id),
c AS (SELECT id, bool_and(k) AS same FROM (SELECT id, count(*) FILTER (i < 4) = count(*) AS k FROM r GROUP BY id, n) GROUP BY id) SELECT id, same FROM c""")
def entry_multisets(spark, sf_dir):
    """Whether an order's lines and their changed form have the same identities, each as often."""
    return order_records(spark, sf_dir).select("id", same_entries(F.col("old"), F.col("new")).alias("same"))


@query(f"""WITH {_LINES}, k AS (SELECT id, i, n % 4 AS x, max(n % 4) OVER (PARTITION BY id) AS top, row_number() OVER (PARTITION BY id, n % 4 ORDER BY i) AS o FROM r),
f AS (SELECT *, CASE WHEN x > 0 AND o = 1 THEN 0 ELSE 1 END AS fresh FROM k)
SELECT id, string_agg(CASE WHEN fresh = 0 THEN x ELSE top + (SELECT sum(fresh) FROM f g WHERE g.id = f.id AND g.i <= f.i) END, ',' ORDER BY i) AS ids FROM f GROUP BY id""")
def assign_ids(spark, sf_dir):
    """Line numbers modulo 4 as ids, which repeat and may be 0."""
    ids = F.transform("old", lambda e: e["id"] % 4)
    return order_records(spark, sf_dir).select("id", F.array_join(assigned_ids(ids), ",").alias("ids"))


@query(f"WITH {_LINES} SELECT id, bool_or({_MONTHED.format('years')}) AS dated, bool_or({_MONTHED.format('years2')}) FILTER (i < 4) AS still FROM r GROUP BY id")
def months_in_records(spark, sf_dir):
    """Whether any line names a month, before and after."""
    return order_records(spark, sf_dir).select("id", any_month(F.col("old")).alias("dated"), any_month(F.col("new")).alias("still"))


@query(f"""WITH {_LINES}, t AS (SELECT id, i, CASE WHEN q % 4 = 0 THEN '' ELSE company2 END AS c, CASE WHEN q % 4 = 0 THEN ' ' ELSE d2[1] END AS x FROM r WHERE i < 4)
SELECT id, coalesce(string_agg(c || ':' || x, '|' ORDER BY i) FILTER (c <> ''), '') AS kept FROM t GROUP BY id""")
def drop_empty_entries(spark, sf_dir):
    """Lines of every fourth quantity lose all they say, and go."""
    blank = F.transform("new", lambda e: F.when(F.element_at(F.split(e["description"][0], " "), 2).cast("int") % 4 == 0, e.withField("company", F.lit("")).withField("title", F.lit(" ")).withField("years", F.lit("")).withField(
        "description", F.array(F.lit(" "), F.lit("")))).otherwise(e))
    rows = order_records(spark, sf_dir).select("id", with_content(blank).alias("k"))
    return rows.select("id", F.array_join(F.transform("k", lambda e: F.concat_ws(":", e["company"], e["description"][0])), "|").alias("kept"))


# Lists of customers: the segments of their orders' priorities before and after a date.

_LISTS = """o AS (SELECT o_custkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS i, substr(o_orderpriority, 3) AS p, year(o_orderdate) < 1998 AS old FROM orders),
a AS (SELECT id, p, row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS i, row_number() OVER (PARTITION BY id, lower(p) ORDER BY i) - 1 AS k, count(*) OVER (PARTITION BY id, lower(p)) AS n FROM o WHERE old),
b AS (SELECT id, p, row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS i, row_number() OVER (PARTITION BY id, lower(p) ORDER BY i) - 1 AS k, count(*) OVER (PARTITION BY id, lower(p)) AS n FROM
(SELECT id, CASE WHEN i % 2 = 0 THEN lower(p) ELSE p END AS p, i FROM o WHERE NOT old)),
x AS (SELECT DISTINCT id FROM o)"""


def customer_lists(spark, sf_dir) -> DataFrame:
    """id, old and new lists of priorities, some of the new ones in lower case."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), "o_orderdate", "o_orderkey", F.substring("o_orderpriority", 3, 99).alias("p"), (F.year("o_orderdate") < 1998).alias("is_old"))
    held = orders.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", "p", "is_old"))).alias("l"))
    cased = F.transform("l", lambda x, i: F.struct(x["is_old"].alias("o"), F.when(x["is_old"] | (i % 2 == 1), x["p"]).otherwise(F.lower(x["p"])).alias("p")))
    pick = lambda keep: F.transform(F.filter("l2", keep), lambda x: x["p"])
    return held.select("id", cased.alias("l2")).select("id", pick(lambda x: x["o"]).alias("old"), pick(lambda x: ~x["o"]).alias("new"))


@query(f"""WITH {_LISTS}, lost AS (SELECT a.id, a.p, a.i + 100000 AS i FROM a WHERE a.k = 0 AND NOT EXISTS (SELECT 1 FROM b WHERE b.id = a.id AND lower(b.p) = lower(a.p)))
SELECT x.id, coalesce(string_agg(u.p, ',' ORDER BY u.i), '') AS items FROM x LEFT JOIN (SELECT id, p, i FROM b UNION ALL SELECT * FROM lost) u ON u.id = x.id GROUP BY x.id""")
def keep_dropped_items(spark, sf_dir):
    return customer_lists(spark, sf_dir).select("id", F.array_join(with_dropped(F.col("old"), F.col("new")), ",").alias("items"))


@query(f"""WITH {_LISTS}, kept AS (SELECT b.id, b.p, b.i, b.k FROM b JOIN (SELECT id, lower(p) AS l, count(*) AS n FROM a GROUP BY ALL) c ON c.id = b.id AND c.l = lower(b.p) WHERE b.k < c.n),
kn AS (SELECT id, lower(p) AS l, count(*) AS n FROM kept GROUP BY ALL),
lost AS (SELECT a.id, a.p, a.i + 100000 AS i FROM a LEFT JOIN kn ON kn.id = a.id AND kn.l = lower(a.p) WHERE a.k >= coalesce(kn.n, 0)),
gain AS (SELECT a.id, a.p, a.i + 100000 AS i FROM a LEFT JOIN (SELECT id, lower(p) AS l, count(*) AS n FROM b GROUP BY ALL) n ON n.id = a.id AND n.l = lower(a.p) WHERE a.k >= coalesce(n.n, 0)),
s AS (SELECT id, string_agg(p, ',' ORDER BY i) AS v FROM (SELECT id, p, i FROM kept UNION ALL SELECT * FROM lost) GROUP BY id),
g AS (SELECT id, string_agg(p, ',' ORDER BY i) AS v FROM (SELECT id, p, i FROM b UNION ALL SELECT * FROM gain) GROUP BY id)
SELECT x.id, coalesce(s.v, '') AS held, coalesce(g.v, '') AS gained FROM x LEFT JOIN s USING (id) LEFT JOIN g USING (id)""")
def merge_lists(spark, sf_dir):
    """Lists merged with multiplicity: one may not gain items, one may."""
    old, new = F.col("old"), F.col("new")
    return customer_lists(spark, sf_dir).select("id", F.array_join(merged_list(old, new, False), ",").alias("held"), F.array_join(merged_list(old, new, True), ",").alias("gained"))


@query(f"""WITH {_LISTS}, k AS (SELECT b.id, b.p, b.i FROM b WHERE lower(b.p) NOT IN ('low', 'urgent')) SELECT x.id, coalesce(string_agg(k.p, ',' ORDER BY k.i), '') AS items FROM x LEFT JOIN k USING (id) GROUP BY x.id""")
def drop_violations(spark, sf_dir):
    """Items that are critical violations go."""
    return customer_lists(spark, sf_dir).select("id", F.array_join(without(F.col("new"), F.array(F.lit("LOW"), F.lit("Urgent"))), ",").alias("items"))


@query(f"""WITH {_LISTS}, u AS (SELECT id, p, i FROM a UNION ALL SELECT id, p, i + 100000 FROM b), f AS (SELECT id, p, min(i) AS i FROM u GROUP BY id, p) SELECT x.id, coalesce(string_agg(f.p, ',' ORDER BY f.i), '') AS items FROM x LEFT JOIN f USING (id) GROUP BY x.id""")
def keyword_union(spark, sf_dir):
    """Distinct items of lists, casing counts, in the order they come."""
    return customer_lists(spark, sf_dir).select("id", F.array_join(F.array_union("old", "new"), ",").alias("items"))


# Section data.

SECTION_KEYS = ("personalInfo", "summary", "workExperience", "education", "personalProjects", "additional")


def sorted_sections(sections: Column, hidden_too: bool = False) -> Column:
    """Sections (structs with order and isVisible) in their order, equal ones as they came; hidden ones on demand."""
    placed = F.transform(sections, lambda s, i: F.struct(s["order"].alias("o"), i.alias("i"), s.alias("s")))
    kept = placed if hidden_too else F.filter(placed, lambda x: x["s"]["isVisible"])
    return F.transform(F.array_sort(kept), lambda x: x["s"])


def next_custom_id(ids: Column) -> Column:
    """custom_n with the number after the largest there is; ids without a number count as 0."""
    numbers = F.transform(ids, lambda x: F.regexp_extract(x, r"^custom_([0-9]+)", 1).try_cast("long"))
    return F.concat(F.lit("custom_"), (F.coalesce(F.array_max(numbers), F.lit(0)) + 1).cast("string"))


def localized(sections: Column, names: dict[str, tuple[str, str]]) -> Column:
    """Default sections that still bear their default name get the localized one; names: id to (default, localized)."""
    defaults = F.create_map(*[F.lit(x) for k, (d, _) in names.items() for x in (k, d)])
    local = F.create_map(*[F.lit(x) for k, (_, n) in names.items() for x in (k, n)])
    untouched = lambda s: F.coalesce(s["isDefault"] & (F.element_at(defaults, s["id"]) == s["displayName"]), F.lit(False))
    return F.transform(sections, lambda s: s.withField("displayName", F.when(untouched(s), F.element_at(local, s["id"])).otherwise(s["displayName"])))


def visible_statuses(order: tuple[str, ...], hidden: Column) -> Column:
    """Statuses in their order without hidden ones; all where everything would be hidden."""
    every = F.array(*[F.lit(s) for s in order])
    shown = F.filter(every, lambda s: ~F.array_contains(hidden, s))
    return F.when(F.size(shown) == 0, every).otherwise(shown)


def toggled(order: tuple[str, ...], hidden: Column, status: Column) -> Column:
    """hidden after a status was shown or hidden; the last visible one stays."""
    last = F.size(F.filter(F.array(*[F.lit(s) for s in order]), lambda s: ~F.array_contains(hidden, s) & (s != status))) == 0
    shown = F.filter(hidden, lambda s: s != status)
    return F.when(F.array_contains(hidden, status), shown).when(last, hidden).otherwise(F.array_append(hidden, status))


_NAMES = {"0": ("view", "Ansicht"), "1": ("click", "Klick"), "2": ("signup", "Anmeldung")}
_STATUSES = ("view", "click", "signup", "purchase", "error")


def user_sections(spark, sf_dir) -> DataFrame:
    """Users' events as sections: id from 0 in order of time, order by value, visible above 3."""
    events = table(spark, sf_dir, "events")
    held = events.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type", "value"))).alias("l"))
    return held.select("user_id", F.transform(F.slice("l", 1, 12), lambda e, i: F.struct(
        i.cast("string").alias("id"), e["event_type"].alias("displayName"), (e["value"] > 3).alias("isVisible"), (i % 3 != 2).alias("isDefault"), F.floor(e["value"]).cast("int").alias("order"))).alias("s"))


_SECTIONS = """s AS (SELECT user_id, i, event_type AS name, value > 3 AS visible, i % 3 <> 2 AS is_default, floor(value)::INT AS o FROM
(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events) WHERE i < 12)"""


@query(f"""WITH {_SECTIONS} SELECT user_id, coalesce(string_agg(i, ',' ORDER BY o, i) FILTER (visible), '') AS shown, string_agg(i, ',' ORDER BY o, i) AS every, 'custom_' || max(i) + 1 AS next,
string_agg(CASE WHEN is_default AND i = 0 AND name = 'view' THEN 'Ansicht' WHEN is_default AND i = 1 AND name = 'click' THEN 'Klick' ELSE name END, ',' ORDER BY i) AS names FROM s GROUP BY user_id""")
def section_order(spark, sf_dir):
    """Sections shown and all of them in order, the next id, and localized names."""
    rows = user_sections(spark, sf_dir)
    ids = lambda x: F.array_join(F.transform(x, lambda s: s["id"]), ",")
    custom = F.transform("s", lambda s: F.concat(F.lit("custom_"), s["id"]))
    return rows.select("user_id", ids(sorted_sections(F.col("s"))).alias("shown"), ids(sorted_sections(F.col("s"), True)).alias("every"), next_custom_id(custom).alias("next"),
                       F.array_join(F.transform(localized(F.col("s"), _NAMES), lambda s: s["displayName"]), ",").alias("names"))


@query("""WITH h AS (SELECT user_id, list_distinct(list(event_type)) AS hidden FROM events WHERE event_id % 3 = 0 GROUP BY user_id),
v AS (SELECT user_id, hidden, list_filter(['view', 'click', 'signup', 'purchase', 'error'], lambda s: NOT list_contains(hidden, s)) AS shown FROM h)
SELECT user_id, CASE WHEN len(shown) = 0 THEN 'view,click,signup,purchase,error' ELSE array_to_string(shown, ',') END AS shown,
CASE WHEN list_contains(hidden, 'view') THEN len(hidden) - 1 WHEN len(list_filter(shown, lambda s: s <> 'view')) = 0 THEN len(hidden) ELSE len(hidden) + 1 END AS hidden_after FROM v""")
def column_visibility(spark, sf_dir):
    """A user's hidden columns are the types of some of their events; then the first column is toggled."""
    hidden = table(spark, sf_dir, "events").where("event_id % 3 = 0").groupBy("user_id").agg(F.collect_set("event_type").alias("h"))
    return hidden.select("user_id", F.array_join(visible_statuses(_STATUSES, F.col("h")), ",").alias("shown"), F.size(toggled(_STATUSES, F.col("h"), F.lit("view"))).cast("long").alias("hidden_after"))


# Wizard.

def review_warnings(name: Column, contacts: list[Column], work: Column, projects: Column, education: Column, skills: Column) -> Column:
    """What a reviewed record lacks, in order; lists count by their size."""
    blank = lambda x: trimmed(F.coalesce(x, F.lit(""))) == ""
    empty = lambda x: F.coalesce(x, F.lit(0)) == 0
    return F.array_compact(F.array(
        F.when(blank(name), "name"), F.when(reduce(lambda a, b: a & b, map(blank, contacts)), "contact"), F.when(empty(work) & empty(projects), "experience"),
        F.when(empty(education), "education"), F.when(empty(skills), "skills")))


def next_gap(work: Column, education: Column, projects: Column, skills: Column) -> Column:
    """The first empty section, else review."""
    empty = lambda x: F.coalesce(x, F.lit(0)) == 0
    return F.when(empty(work), "workExperience").when(empty(education), "education").when(empty(projects), "personalProjects").when(empty(skills), "skills").otherwise("review")


WIZARD_SECTIONS = ("intro", "contact", "summary", "workExperience", "internships", "education", "personalProjects", "skills", "review")


def valid_section(section: Column) -> Column:
    """A known section, else review."""
    return F.when(section.isin(*WIZARD_SECTIONS), section).otherwise("review")


def next_question(text: Column, section: Column, gap: Column) -> Column:
    """(text, section): the suggested question if it says something and names a section, else the gap's own (null text)."""
    said = F.coalesce(trimmed(text) != "", F.lit(False)) & section.isNotNull()
    return F.struct(F.when(said, trimmed(text)).alias("text"), F.when(said, valid_section(section)).otherwise(gap).alias("section"))


_WIZARD = """k AS (SELECT c_custkey, c_name, count(o_orderkey) FILTER (o_orderstatus = 'F') AS work, count(o_orderkey) FILTER (o_orderstatus = 'O') AS education,
count(o_orderkey) FILTER (o_orderstatus = 'P') AS projects, count(o_orderkey) FILTER (o_orderpriority = '1-URGENT') AS skills FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL)"""


@query(f"""WITH {_WIZARD}, g AS (SELECT *, CASE WHEN work = 0 THEN 'workExperience' WHEN education = 0 THEN 'education' WHEN projects = 0 THEN 'personalProjects' WHEN skills = 0 THEN 'skills' ELSE 'review' END AS gap FROM k)
SELECT c_custkey, concat_ws(',', CASE WHEN c_custkey % 5 = 0 THEN 'name' END, CASE WHEN c_custkey % 3 = 0 THEN 'contact' END, CASE WHEN work = 0 AND projects = 0 THEN 'experience' END,
CASE WHEN education = 0 THEN 'education' END, CASE WHEN skills = 0 THEN 'skills' END) AS warnings, gap,
CASE WHEN c_custkey % 4 = 0 THEN gap WHEN c_custkey % 4 = 1 THEN 'review' ELSE 'skills' END AS section FROM g""")
def wizard_review(spark, sf_dir):
    """Customers as drafts: what they lack, the section to go on with, and the section of the next question."""
    status, orders = F.col("o_orderstatus"), table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "k")
    counts = orders.groupBy("k").agg(F.count_if(status == "F").alias("work"), F.count_if(status == "O").alias("education"), F.count_if(status == "P").alias("projects"),
                                     F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("skills"))
    rows = table(spark, sf_dir, "customer").join(counts, F.col("c_custkey") == F.col("k"), "left")
    key, (work, education, projects, skills) = F.col("c_custkey"), map(F.col, ("work", "education", "projects", "skills"))
    name, mail = F.when(key % 5 == 0, " ").otherwise(F.col("c_name")), F.when(key % 3 != 0, "x@y.z")
    gap = next_gap(work, education, projects, skills)
    asked = next_question(F.when(key % 4 != 0, "What next?"), F.when(key % 4 == 1, "elsewhere").otherwise("skills"), gap)
    return rows.select("c_custkey", F.array_join(review_warnings(name, [mail, F.lit(None)], work, projects, education, skills), ",").alias("warnings"), gap.alias("gap"), asked["section"].alias("section"))


def reviewed(step: Column, asked: Column) -> Column:
    """The step after a request to review: always review; asking on stops at 15 questions."""
    return F.when(asked >= 15, "review").otherwise(step)


@query("""WITH t AS (SELECT conv_id, turn, count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn) AS asked, role FROM conversations)
SELECT conv_id, turn, asked, CASE WHEN asked >= 15 THEN 'review' WHEN turn = 0 THEN 'intro' ELSE 'question' END AS step, least(asked, least(15, greatest(8, asked + CASE WHEN asked >= 15 THEN 0 ELSE 2 END))) AS current FROM t""")
def wizard_turns(spark, sf_dir):
    """Turns of a conversation folded in order: questions asked so far, the step and the progress."""
    from pyspark.sql import Window

    so_far = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    asked = F.count_if(F.col("role") == "user").over(so_far)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", asked.alias("asked"))
    total = F.least(F.lit(15), F.greatest(F.lit(8), F.col("asked") + F.when(F.col("asked") >= 15, 0).otherwise(2)))
    return rows.select("conv_id", "turn", "asked", reviewed(F.when(F.col("turn") == 0, "intro").otherwise("question"), F.col("asked")).alias("step"), F.least("asked", total).alias("current"))
