"""Records with nested parts: multisets, ordered unions, positional joins and open maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import initials
from tessera.plans.catalog import query
from tessera.sources.tables import table


@query("SELECT l_partkey, count(*) FILTER (l_returnflag = 'R') - count(*) FILTER (l_returnflag = 'A') AS surplus FROM lineitem GROUP BY ALL HAVING surplus > 0")
def multiset_diff(spark, sf_dir):
    """Parts returned more often than accepted, with how often: EXCEPT ALL as one aggregation."""
    flag = F.col("l_returnflag")
    signed = F.when(flag == "R", 1).when(flag == "A", -1).otherwise(0)
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sum(signed).alias("surplus")).where("surplus > 0")


@query("""WITH s AS (SELECT DISTINCT l_suppkey, p_brand, year(l_shipdate) AS y FROM lineitem JOIN part ON l_partkey = p_partkey),
b AS (SELECT l_suppkey, p_brand, bool_or(y <= 1995) AS before, bool_or(y > 1995) AS after FROM s GROUP BY ALL)
SELECT l_suppkey, count(*) FILTER (after AND NOT before) AS added, count(*) FILTER (before AND NOT after) AS removed FROM b GROUP BY ALL""")
def added_removed_sets(spark, sf_dir):
    """Brands a supplier took up or gave up after 1995."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", (F.year("l_shipdate") > 1995).alias("late"))
    sold = lines.join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    brands = sold.groupBy("l_suppkey", "p_brand").agg(F.bool_or(~F.col("late")).alias("before"), F.bool_or("late").alias("after"))
    return brands.groupBy("l_suppkey").agg(F.count_if(F.col("after") & ~F.col("before")).alias("added"), F.count_if(F.col("before") & ~F.col("after")).alias("removed"))


@query(r"""WITH t AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[\p{L}\p{N}]+')) AS w, generate_subscripts(regexp_extract_all(text, '[\p{L}\p{N}]+'), 1) AS i FROM conversations),
f AS (SELECT conv_id, lower(w) AS k, w, turn, i, row_number() OVER (PARTITION BY conv_id, lower(w) ORDER BY turn, i, w) AS n FROM t)
SELECT conv_id, k AS term, w AS casing FROM f WHERE n = 1""")
def ordered_union_first_casing(spark, sf_dir):
    """The words of a conversation, each in the casing it first has."""
    words = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), 0)).alias("i", "w"))
    first = words.groupBy("conv_id", F.lower("w").alias("term")).agg(F.min(F.struct("turn", "i", "w")).alias("f"))
    return first.select("conv_id", "term", F.col("f.w").alias("casing"))


@query("""SELECT coalesce(a.l_orderkey, b.l_orderkey) AS l_orderkey, coalesce(a.l_linenumber, b.l_linenumber - 1) AS l_linenumber, a.l_partkey AS part, b.l_partkey AS next_part
FROM lineitem a FULL JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1""")
def positional_outer(spark, sf_dir):
    """Lines beside the line of the place after theirs, on either side without a partner too."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    after = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("next_part"))
    return lines.withColumnRenamed("l_partkey", "part").join(after, ["l_orderkey", "l_linenumber"], "full")


@query("""SELECT o_orderkey, count(l_linenumber) AS lines, coalesce(sum(l_quantity), 0.0::DOUBLE) AS quantity FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL""")
def nested_record(spark, sf_dir):
    """An order with its lines as an array of structs, folded back to counts."""
    parts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_quantity")).alias("parts"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey").join(parts, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    total = F.aggregate("parts", F.lit(0.0), lambda a, p: a + p["l_quantity"])
    return orders.select("o_orderkey", F.coalesce(F.size("parts"), F.lit(0)).cast("long").alias("lines"), F.coalesce(total, F.lit(0.0)).alias("quantity"))


def json_kind(value: Column) -> Column:
    """The kind of a JSON value given as text."""
    return (F.when(value.startswith("{"), "object").when(value.startswith("["), "array").when(value.isin("true", "false"), "boolean")
            .when(value.isNull() | (value == "null"), "null").when(value.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?$"), "number").otherwise("string"))


@query("""WITH p AS (SELECT event_type, unnest(json_keys(props)) AS key, props FROM events)
SELECT event_type, key, CASE json_type(props, '$.' || key) WHEN 'UBIGINT' THEN 'number' WHEN 'BIGINT' THEN 'number' WHEN 'DOUBLE' THEN 'number' WHEN 'VARCHAR' THEN 'string' ELSE lower(json_type(props, '$.' || key)) END AS kind,
count(*) AS n FROM p GROUP BY ALL""")
def key_kinds(spark, sf_dir):
    """The keys of the events' open maps with the kinds of their values."""
    pairs = table(spark, sf_dir, "events").select("event_type", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))
    return pairs.groupBy("event_type", "key", json_kind(F.col("value")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(r"""SELECT p_partkey, array_to_string([upper(left(w, 1)) FOR w IN list_filter(regexp_split_to_array(p_name, '[\x20\x09-\x0D]+'), lambda w: regexp_matches(w, '^\p{L}'))[1:3]], '') AS monogram FROM part""")
def monogram(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", initials(F.col("p_name")).alias("monogram"))


def alignment(tailored: DataFrame, master: DataFrame) -> DataFrame:
    """key, value, severity of values (key, value on both sides) that the master lacks.

    Info where a master value of the key contains it or lies in it, else critical. Values compare
    in lower case; candidates meet by key alone, and what meets is reduced before it leaves the task.
    """
    new = tailored.select("key", F.lower("value").alias("value")).distinct()
    old = master.select("key", F.lower("value").alias("known")).distinct()
    lacking = new.join(old.select("key", F.col("known").alias("value")), ["key", "value"], "left_anti")
    near = F.bool_or(F.coalesce(F.contains("known", "value") | F.contains("value", "known"), F.lit(False)))
    return lacking.join(old.where("known <> ''"), "key", "left").groupBy("key", "value").agg(F.when(near, "info").otherwise("critical").alias("severity"))


@query("""WITH s AS (SELECT DISTINCT l_suppkey, lower(p_name || ' ' || p_brand) AS v, year(l_shipdate) > 1997 AS late FROM lineitem JOIN part ON l_partkey = p_partkey),
x AS (SELECT n.l_suppkey, n.v, (SELECT bool_or(contains(o.v, n.v) OR contains(n.v, o.v)) FROM s o WHERE NOT o.late AND o.l_suppkey = n.l_suppkey) AS near
FROM s n WHERE n.late AND NOT EXISTS (SELECT 1 FROM s o WHERE NOT o.late AND o.l_suppkey = n.l_suppkey AND o.v = n.v))
SELECT l_suppkey, count(*) AS violations, count(*) FILTER (near IS NOT TRUE) AS critical, greatest(0.0::DOUBLE, 1.0::DOUBLE - 0.1::DOUBLE * count(*)) AS confidence FROM x GROUP BY ALL""")
def alignment_violations(spark, sf_dir):
    """Goods of a brand that a supplier sells after 1997 without having sold them before."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", (F.year("l_shipdate") > 1997).alias("late"))
    sold = lines.join(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    sold = sold.select(F.col("l_suppkey").alias("key"), F.concat_ws(" ", "p_name", "p_brand").alias("value"), "late").distinct()
    found = alignment(sold.where("late").drop("late"), sold.where("NOT late").drop("late"))
    return found.groupBy(F.col("key").alias("l_suppkey")).agg(
        F.count(F.lit(1)).alias("violations"), F.count_if(F.col("severity") == "critical").alias("critical"), F.greatest(F.lit(0.0), 1.0 - 0.1 * F.count(F.lit(1))).alias("confidence"))


@query("""WITH a AS (SELECT conv_id, count(*) FILTER (role = 'user') AS asked, arg_max(role, turn) = 'assistant' AS done FROM conversations GROUP BY ALL)
SELECT conv_id, least(asked, least(15, greatest(8, asked + CASE WHEN done THEN 0 ELSE 2 END))) AS current, least(15, greatest(8, asked + CASE WHEN done THEN 0 ELSE 2 END)) AS total FROM a""")
def wizard_progress(spark, sf_dir):
    """Questions asked and to be expected: 8 to 15, two ahead until the assistant has the last word."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("asked"), F.max(F.struct("turn", "role")).alias("m"))
    total = F.least(F.lit(15), F.greatest(F.lit(8), F.col("asked") + F.when(F.col("m.role") == "assistant", 0).otherwise(2)))
    return asked.select("conv_id", F.least("asked", total).alias("current"), total.alias("total"))


@query("""SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS text FROM conversations c WHERE turn < (SELECT max(turn) FROM conversations m WHERE m.conv_id = c.conv_id) GROUP BY ALL""")
def wizard_last_snapshot(spark, sf_dir):
    """Undo: what a conversation was before its last turn, which is the last but one."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("last"))
    before = turns.join(last, "conv_id").where("turn < last").groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("m"))
    return before.select("conv_id", "m.turn", "m.text")
