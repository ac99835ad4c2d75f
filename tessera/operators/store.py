"""Tables as a store: lookups, listings, inserts, partial updates, cascades and imports, all as frames to frames.

Nothing is changed in place: each write returns the new state of its tables, and `commit_together` puts several
of them on disk at once.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import trimmed
from tessera.plans.catalog import query
from tessera.sources.tables import table

STAMP = "timestamp'2025-01-01 00:00:00'"


def scan(rows: DataFrame, equal: dict[str, object], order: Sequence[str] = ()) -> DataFrame:
    """Rows whose columns equal the given values, in order; a value of None asks for nothing."""
    for name, value in equal.items():
        if value is not None:
            rows = rows.where(F.col(name) == F.lit(value))
    return rows.orderBy(*order) if order else rows


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey = 17")
def point_lookup(spark, sf_dir):
    """One row by its key; none where there is no such key. The filter reaches the scan."""
    return scan(table(spark, sf_dir, "orders"), {"o_orderkey": 17}).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_orderdate, o_orderkey LIMIT 1")
def flagged_first(spark, sf_dir):
    """The first row that bears a flag."""
    return scan(table(spark, sf_dir, "orders"), {"o_orderpriority": "1-URGENT"}, ["o_orderdate", "o_orderkey"]).limit(1).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus = 'P'")
def optional_scan(spark, sf_dir):
    """Board cards by two optional predicates, one of them not given, in order of status and date."""
    return scan(table(spark, sf_dir, "orders"), {"o_orderstatus": "P", "o_orderpriority": None}, ["o_orderstatus", "o_orderdate", "o_orderkey"]).select(
        "o_orderkey", "o_orderstatus", "o_orderpriority")


def listing(rows: DataFrame, master: Column, changed: str, columns: Sequence[str], with_master: bool = False) -> DataFrame:
    """Chosen columns of the rows, latest change first, rows without a change last; master rows only on demand."""
    kept = rows if with_master else rows.where(~F.coalesce(master, F.lit(False)))
    return kept.orderBy(F.col(changed).desc_nulls_last()).select(*columns)


@query("""SELECT o_orderkey, o_custkey, o_orderstatus, changed FROM (SELECT *, CASE WHEN o_orderstatus <> 'O' THEN o_orderdate END AS changed FROM orders) WHERE o_orderpriority <> '1-URGENT'""")
def resume_listing(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("changed", F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate")))
    return listing(rows, F.col("o_orderpriority") == "1-URGENT", "changed", ["o_orderkey", "o_custkey", "o_orderstatus", "changed"])


def flattened(rows: DataFrame, open_map: str, names: Sequence[str]) -> DataFrame:
    """Columns for keys of an open map (map<string,string>), which win over columns of the same name."""
    held = [c for c in rows.columns if c != open_map]

    def one(name: str) -> Column:
        core = F.col(name).cast("string") if name in held else F.lit(None).cast("string")
        return F.when(F.map_contains_key(F.coalesce(open_map, F.create_map().cast("map<string,string>")), name), F.element_at(open_map, name)).otherwise(core).alias(name)

    return rows.select(*[c for c in held if c not in names], *map(one, names))


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'from map' ELSE event_type END AS event_type, json_extract_string(props, '$.k') AS k, CAST(NULL AS VARCHAR) AS absent FROM events""")
def open_map_lookup(spark, sf_dir):
    """Events with their open properties at the top level; some properties override a column."""
    more = F.when(F.col("event_id") % 5 == 0, F.create_map(F.lit("event_type"), F.lit("from map"))).otherwise(F.create_map().cast("map<string,string>"))
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", F.map_concat(F.from_json("props", "map<string,string>"), more).alias("open"))
    return flattened(rows, "open", ["event_type", "k", "absent"])


def first_by(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the first in the given order, by aggregation."""
    rest = [c for c in rows.columns if c not in (*keys, *order)]
    return rows.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_first")).select(*keys, "_first.*")


@query("SELECT o_custkey, o_orderdate, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def index_first(spark, sf_dir):
    """The relation of a key that was made first; ties by id."""
    return first_by(table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey"), ["o_custkey"], ["o_orderdate", "o_orderkey"])


def inserted(rows: DataFrame, now: Column, defaults: dict[str, Column], key: Column | None = None, id_col: str = "id") -> DataFrame:
    """New rows with an id (random, or from a key so that a retry makes the same), both stamps and defaults for nulls."""
    fresh = F.expr("uuid()") if key is None else F.md5(key.cast("string"))
    filled = rows.select(*[F.coalesce(F.col(c), defaults[c]).alias(c) if c in defaults else F.col(c) for c in rows.columns], *[v.alias(c) for c, v in defaults.items() if c not in rows.columns])
    return filled.withColumns({id_col: fresh, "created_at": now, "updated_at": now})


@query("SELECT doc_id, coalesce(lang, 'md') AS lang, 'pending' AS status, md5(doc_id::VARCHAR) AS id, TIMESTAMP '2025-01-01 00:00:00' AS created_at, TIMESTAMP '2025-01-01 00:00:00' AS updated_at FROM documents")
def insert_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return inserted(rows, F.expr(STAMP), {"lang": F.lit("md"), "status": F.lit("pending")}, F.col("doc_id"))


def whole_batches(rows: DataFrame, batch: str, content: str) -> DataFrame:
    """Rows of the batches in which every content holds something; a batch with one blank fails altogether.

    Verdicts are aggregated first, so a batch of any size is never in one task.
    """
    sound = rows.groupBy(batch).agg(F.bool_and(F.coalesce(trimmed(F.col(content)) != "", F.lit(False))).alias("_sound")).where("_sound").select(batch)
    return rows.join(sound, batch, "left_semi")


@query("""WITH c AS (SELECT conv_id, turn, CASE WHEN length(text) < 60 THEN ' ' || chr(10) ELSE text END AS content FROM conversations),
s AS (SELECT conv_id FROM c GROUP BY conv_id HAVING bool_and(trim(content, ' ' || chr(10)) <> ''))
SELECT conv_id, turn, sha256(content) AS content, md5(conv_id || ':' || turn) AS id FROM c WHERE conv_id IN (SELECT conv_id FROM s)""")
def create_batch(spark, sf_dir):
    """Conversations as batches of turns; short turns count as blank here and fail their batch."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.length("text") < 60, " \n").otherwise(F.col("text")).alias("content"))
    kept = whole_batches(rows, "conv_id", "content")
    return kept.select("conv_id", "turn", F.sha2("content", 256).alias("content"), F.md5(F.concat_ws(":", "conv_id", "turn")).alias("id"))


def updated(base: DataFrame, changes: DataFrame, key: str, now: Column, stamp: str = "updated_at") -> tuple[DataFrame, DataFrame]:
    """(base after the changes, keys of changes without a row). changes: one row a key, column `set` as map<string,string>.

    Keys of the map that name no column are ignored; a row with a change is stamped even if nothing else changes.
    """
    known = [c for c in base.columns if c not in (key, stamp)]
    kinds = dict(base.dtypes)
    marked = changes.select(F.col(key).alias("_k"), F.col("set").alias("_set"))
    both = base.join(marked, F.col(key) == F.col("_k"), "left")
    has = F.col("_k").isNotNull()

    def one(c: str) -> Column:
        return F.when(has & F.map_contains_key("_set", c), F.element_at("_set", c).cast(kinds[c])).otherwise(F.col(c)).alias(c)

    out = both.select(key, *map(one, known), F.when(has, now).otherwise(F.col(stamp)).alias(stamp))
    return out, marked.join(base.select(key), F.col("_k") == F.col(key), "left_anti").select(F.col("_k").alias(key))


@query("""SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'q' || l.quality ELSE d.lang END AS lang, d.source,
CASE WHEN l.doc_id IS NOT NULL THEN TIMESTAMP '2025-01-01 00:00:00' ELSE TIMESTAMP '2024-01-01 00:00:00' END AS updated_at
FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id)""")
def update_known_columns(spark, sf_dir):
    """Labels as changes of one known and one unknown column."""
    base = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.expr("timestamp'2024-01-01 00:00:00'").alias("updated_at"))
    changes = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    changes = changes.select("doc_id", F.create_map(F.lit("lang"), F.concat(F.lit("q"), "quality"), F.lit("nowhere"), F.lit("x")).alias("set"))
    return updated(base, changes, "doc_id", F.expr(STAMP))[0]


def merged_maps(base: Column, more: Column) -> Column:
    """Two maps as one; the second wins, null counts as empty."""
    none = F.create_map().cast("map<string,string>")
    more = F.coalesce(more, none)
    return F.map_concat(F.map_filter(F.coalesce(base, none), lambda k, v: ~F.map_contains_key(more, k)), more)


def map_text(value: Column) -> Column:
    """A map as text, keys in order."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(value)), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null")))), ";")


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'k=new;status=' || event_type WHEN event_id % 3 = 1 THEN 'k=' || json_extract_string(props, '$.k') || ';status=' || event_type
ELSE 'k=' || json_extract_string(props, '$.k') END AS open FROM events""")
def merge_open_map(spark, sf_dir):
    """Updates of keys outside the columns go to a row's open map; a third of the rows get none."""
    status = F.create_map(F.lit("status"), F.col("event_type"))
    more = F.when(F.col("event_id") % 3 == 0, F.map_concat(status, F.create_map(F.lit("k"), F.lit("new")))).when(F.col("event_id") % 3 == 1, status)
    return table(spark, sf_dir, "events").select("event_id", map_text(merged_maps(F.from_json("props", "map<string,string>"), more)).alias("open"))


def deleted(rows: DataFrame, dependents: DataFrame, gone: DataFrame, key: str, source: str, result: str | None = None, payload: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, dependents) after the keys in gone(key) went.

    Dependents of a source that went go too; those whose result went stay without their payload, as a mark that
    it was used up.
    """
    rows_left = rows.join(gone.select(key).distinct(), key, "left_anti")
    marks = gone.select(F.col(key).alias("_gone")).distinct()
    left = dependents.join(marks, F.col(source) == F.col("_gone"), "left_anti")
    if result is not None:
        left = left.join(marks, F.col(result) == F.col("_gone"), "left")
        left = left.withColumn(payload, F.when(F.col("_gone").isNull(), F.col(payload))).drop("_gone")
    return rows_left, left


_GONE = "SELECT c_custkey FROM customer WHERE c_acctbal < 1000"


@query(f"""WITH g AS ({_GONE}) SELECT e.event_id, CASE WHEN r.c_custkey IS NULL THEN e.event_type END AS payload FROM events e LEFT JOIN g r ON r.c_custkey = e.event_id % 300
WHERE e.user_id NOT IN (SELECT c_custkey FROM g)""")
def delete_with_payload(spark, sf_dir):
    """Poor customers go: events that they caused go with them, events that led to them keep a mark only."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("event_id") % 300).alias("result"), F.col("event_type").alias("payload"))
    customers = table(spark, sf_dir, "customer")
    gone = customers.where("c_acctbal < 1000").select("c_custkey")
    return deleted(customers, events, gone, "c_custkey", "user_id", "result", "payload")[1].select("event_id", "payload")


@query(f"WITH g AS ({_GONE}) SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM g)")
def delete_dependents(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return deleted(customers, orders, customers.where("c_acctbal < 1000").select("c_custkey"), "c_custkey", "o_custkey")[1]


def emptied(tables: dict[str, DataFrame], keep: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Every table without rows and with its columns, but for those kept."""
    return {name: df if name in keep else df.limit(0) for name, df in tables.items()}


@query("SELECT 'nation' AS name, count(*) AS n FROM nation UNION ALL SELECT 'orders', 0 UNION ALL SELECT 'events', 0")
def reset_tables(spark, sf_dir):
    left = emptied({name: table(spark, sf_dir, name) for name in ("nation", "orders", "events")}, keep=["nation"])
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in left.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def commit_together(spark: SparkSession, frames: dict[str, DataFrame], folder: str) -> str:
    """Writes several tables below a new folder and makes it the current one by a single rename; returns it.

    Readers that go through `current` see all of the tables or none: until the rename, everything lies in a
    staging folder, which goes when a write fails.
    """
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    version = uuid.uuid4().hex
    staging, final = f"{folder}/_staging-{version}", f"{folder}/v-{version}"
    try:
        for name, df in frames.items():
            df.write.parquet(f"{staging}/{name}")
    except Exception:
        fs.delete(path(staging), True)
        raise
    if not fs.rename(path(staging), path(final)):
        raise OSError(f"can't commit {staging}")
    return final


def tailored(rows: DataFrame, key: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """(new records, their relations) of rows (key, job_id, content): ids follow from the key, so both agree on retry."""
    made = rows.withColumns({"tailored_id": F.md5(F.concat_ws(":", key, "job_id")), "created_at": now})
    records = made.select(F.col("tailored_id").alias("id"), "content", F.col(key).alias("parent_id"), "created_at")
    relations = made.select(F.sha1("tailored_id").alias("request_id"), F.col(key).alias("original_id"), "tailored_id", "job_id", "created_at")
    return records, relations


@query("""SELECT md5(o_orderkey || ':' || o_custkey) AS id, o_orderkey AS parent_id, o_custkey AS job_id, sha1(md5(o_orderkey || ':' || o_custkey)) AS request_id, o_orderpriority AS content
FROM orders WHERE o_orderstatus = 'F'""")
def create_tailored(spark, sf_dir):
    """Each finished order makes a record and its relation; both are read back joined."""
    rows = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey", F.col("o_custkey").alias("job_id"), F.col("o_orderpriority").alias("content"))
    records, relations = tailored(rows, "o_orderkey", F.expr(STAMP))
    return records.join(relations, F.col("id") == F.col("tailored_id")).select("id", "parent_id", "job_id", "request_id", "content")


def imported(legacy: DataFrame, key: str, owner: str, flag: str, made: str, core: Sequence[str], defaults: dict[str, Column]) -> DataFrame:
    """Rows of an old store: core columns with defaults, what else they hold as an open map, one flag an owner.

    Of an owner's flagged rows the earliest keeps the flag; ties by key.
    """
    first = legacy.where(flag).groupBy(owner).agg(F.min(F.struct(made, key)).alias("_m")).select(F.col(owner).alias("_o"), F.col("_m")[key].alias("_keep"))
    rest = [c for c in legacy.columns if c not in (*core, key, owner, flag, made)]
    pairs = [x for c in rest for x in (F.lit(c), F.col(c).cast("string"))]
    open_map = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,string>")
    filled = [F.coalesce(F.col(c), defaults[c]).alias(c) if c in defaults else F.col(c) for c in core]
    both = legacy.join(first, F.col(owner).eqNullSafe(F.col("_o")), "left")
    return both.select(key, owner, made, *filled, (F.col(flag) & F.col(key).eqNullSafe(F.col("_keep"))).alias(flag), open_map.alias("open"))


@query("""WITH f AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT o.o_orderkey, coalesce(nullif(o_orderstatus, 'P'), 'pending') AS status, coalesce(f.n = 1, false) AS is_master, 'o_orderpriority=' || o_orderpriority AS open
FROM orders o LEFT JOIN f ON f.o_orderkey = o.o_orderkey""")
def import_legacy(spark, sf_dir):
    """Urgent orders claim to be their customer's master; one stays."""
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", F.nullif("o_orderstatus", F.lit("P")).alias("status"), (F.col("o_orderpriority") == "1-URGENT").alias("is_master"))
    out = imported(rows, "o_orderkey", "o_custkey", "is_master", "o_orderdate", ["status"], {"status": F.lit("pending")})
    return out.select("o_orderkey", "status", "is_master", map_text(F.col("open")).alias("open"))


def with_columns(rows: DataFrame, ddl: str) -> DataFrame:
    """Rows with the columns of a newer schema that they lack, null; what is there stays as it is."""
    return rows.unionByName(rows.sparkSession.createDataFrame([], ddl), allowMissingColumns=True)


@query("SELECT r_regionkey, r_name, CAST(NULL AS VARCHAR) AS title, CAST(NULL AS VARCHAR) AS token FROM region")
def additive_migration(spark, sf_dir):
    return with_columns(table(spark, sf_dir, "region"), "r_name string, title string, token string")


def staged_cards(cards: DataFrame, board: DataFrame, status: str, applied: str, now: Column, order: Sequence[str]) -> DataFrame:
    """New cards with applied_at (now unless saved or given) and the next positions of their columns.

    A column goes on from the number of cards it has; new cards of one column follow in the given order.
    """
    sizes = board.groupBy(status).agg(F.count(F.lit(1)).alias("_size"))
    place = F.row_number().over(Window.partitionBy(status).orderBy(*order)) - 1
    placed = cards.withColumn("_place", place).join(F.broadcast(sizes), status, "left")
    given = F.when(F.col(status) == "saved", F.col(applied)).otherwise(F.coalesce(F.col(applied), now))
    return placed.withColumns({applied: given, "position": F.coalesce("_size", F.lit(0)) + F.col("_place")}).drop("_size", "_place")


@query("""WITH b AS (SELECT CASE o_orderstatus WHEN 'O' THEN 'saved' WHEN 'F' THEN 'applied' ELSE 'offer' END AS status, o_orderkey, o_orderdate FROM orders),
old AS (SELECT status, count(*) AS n FROM b WHERE o_orderkey % 10 <> 0 GROUP BY status)
SELECT o_orderkey, b.status, CASE WHEN b.status = 'saved' THEN NULL ELSE TIMESTAMP '2025-01-01 00:00:00' END AS applied_at,
coalesce(n, 0) + row_number() OVER (PARTITION BY b.status ORDER BY o_orderkey) - 1 AS position FROM b LEFT JOIN old USING (status) WHERE o_orderkey % 10 = 0""")
def stage_cards(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "O", "saved").when(F.col("o_orderstatus") == "F", "applied").otherwise("offer")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", status.alias("status"), F.lit(None).cast("timestamp").alias("applied_at"))
    new = F.col("o_orderkey") % 10 == 0
    return staged_cards(rows.where(new), rows.where(~new), "status", "applied_at", F.expr(STAMP), ["o_orderkey"])


def with_master(rows: DataFrame, owner: str, key: str, flag: str, targets: DataFrame) -> DataFrame:
    """Rows after targets(owner, target) took the lead: an owner's other rows lose the flag; an unknown target changes nothing."""
    marked = targets.select(F.col(owner).alias("_o"), F.col("target").alias("_t"))
    sound = marked.join(rows.select(F.col(owner).alias("_o"), F.col(key).alias("_t")), ["_o", "_t"], "left_semi")
    both = rows.join(sound, F.col(owner) == F.col("_o"), "left")
    return both.withColumn(flag, F.when(F.col("_t").isNull(), F.col(flag)).otherwise(F.col(key) == F.col("_t"))).drop("_o", "_t")


@query("""WITH r AS (SELECT o_custkey, o_orderkey, o_orderpriority = '1-URGENT' AS is_master FROM orders), t AS (SELECT o_custkey, CASE WHEN o_custkey % 4 = 0 THEN -1 ELSE max(o_orderkey) END AS target FROM orders GROUP BY o_custkey)
SELECT r.o_orderkey, CASE WHEN target = -1 THEN is_master ELSE r.o_orderkey = target END AS is_master FROM r JOIN t USING (o_custkey)""")
def set_master(spark, sf_dir):
    """A customer's last order takes the lead; a quarter of the customers name an order that isn't there."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderpriority") == "1-URGENT").alias("is_master"))
    targets = rows.groupBy("o_custkey").agg(F.max("o_orderkey").alias("last")).select("o_custkey", F.when(F.col("o_custkey") % 4 == 0, F.lit(-1)).otherwise(F.col("last")).alias("target"))
    return with_master(rows, "o_custkey", "o_orderkey", "is_master", targets).select("o_orderkey", "is_master")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority <> '1-URGENT' AND o_custkey IS NOT NULL")
def tailored_only(spark, sf_dir):
    """Rows made from another row: those with a parent."""
    parent = F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_custkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", parent.alias("o_custkey")).where("o_custkey IS NOT NULL")
