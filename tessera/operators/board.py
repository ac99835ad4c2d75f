"""Ordered boards: columns of cards, moves and renumbering by window functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.catalog import query
from tessera.sources.tables import table

#: Columns in the order they are shown, which isn't alphabetical (fixed values).
COLUMNS = ("view", "click", "signup", "purchase", "error")


#: Ranges that a group's keys are cut into, at quantiles.
BINS = 64


def placed(rows: DataFrame, group: str, key: str, tie: str) -> DataFrame:
    """`rows` with position, long from 0 without gaps in each group by (key, tie); null keys come first, null groups are one.

    A group isn't sorted in one task: a numeric key is cut at approximate quantiles of the group, so clustered
    keys spread as well; each range is numbered by itself and starts at the count of those before. What is
    prefix-summed is BINS rows a group.
    """
    number = F.col(key).cast("double")
    bounds = rows.groupBy(F.col(group).alias("_q")).agg(F.percentile_approx(number, [i / BINS for i in range(1, BINS)], F.lit(20 * BINS)).alias("_bounds"))
    cut = rows.join(bounds, F.col(group).eqNullSafe(F.col("_q")))
    cut = cut.withColumn("_bin", F.when(number.isNull(), -1).otherwise(F.size(F.filter("_bounds", lambda b: b < number)))).drop("_q", "_bounds")
    earlier = Window.partitionBy(group).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy(group, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    starts = starts.select(F.col(group).alias("_g"), F.col("_bin").alias("_b"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(group, "_bin").orderBy(key, tie)) - 1
    both = cut.withColumn("_inside", inside).join(starts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_bin") == F.col("_b")))
    return both.withColumn("position", F.col("_start") + F.col("_inside")).drop("_bin", "_inside", "_g", "_b", "_start")


def moved(board: DataFrame, card: int, status: str, index: int | None) -> DataFrame:
    """`board` (event_id, event_type, position) with one card at an index of a column, both columns closed up.

    No index or one past the end appends, a negative one goes first; an unknown card changes nothing.
    """
    at = F.lit(None).cast("double") if index is None else F.lit(max(index, 0) - 0.5)
    old = board.where(F.col("event_id") == card).agg(F.max("event_type").alias("_from"), F.max("position").alias("_at"))
    here = F.col("event_id") == card
    closed = F.col("position") - F.when((F.col("event_type") == F.col("_from")) & (F.col("position") > F.col("_at")), 1).otherwise(0)
    size = board.where(F.col("event_type") == status).agg(F.max("position").alias("_last"))
    end = F.coalesce(F.col("_last"), F.lit(0)) + 1.0
    keyed = board.join(F.broadcast(old)).join(F.broadcast(size)).select(
        *[c for c in board.columns if c not in ("event_type", "position")], F.when(here, status).otherwise(F.col("event_type")).alias("event_type"),
        F.when(here, F.least(F.coalesce(at, end), end)).otherwise(closed.cast("double")).alias("_key"))
    return placed(keyed, "event_type", "_key", "event_id").drop("_key")


def cards(events: DataFrame) -> DataFrame:
    """One card per user and status, placed by its first event; the hot statuses meet after partial aggregation."""
    first = events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))
    return placed(first, "event_type", "event_id", "user_id")


_CARDS = """WITH f AS (SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL),
cards AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS position FROM f)"""


@query(f"""{_CARDS}, s AS (SELECT unnest(['view', 'click', 'signup', 'purchase', 'error', 'archived']) AS status, unnest([1, 2, 3, 4, 5, 6])::BIGINT AS rank)
SELECT s.status, s.rank, count(c.event_id) AS cards, max(position) AS last FROM s LEFT JOIN cards c ON c.event_type = s.status AND c.event_type <> 'signup' GROUP BY ALL""")
def board_columns(spark, sf_dir):
    """Every column of the board with its cards, those without any too; cards of an unknown status (here: signup, held back) don't count."""
    shown = [*COLUMNS, "archived"]
    ranks = F.explode(F.arrays_zip(F.array(*[F.lit(c) for c in shown]).alias("status"), F.array(*[F.lit(i + 1) for i in range(len(shown))]).alias("rank")))
    columns = spark.range(1).select(ranks.alias("s")).select("s.status", F.col("s.rank").cast("long").alias("rank"))
    counts = cards(table(spark, sf_dir, "events")).where("event_type <> 'signup'").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("position").alias("last"))
    return columns.join(counts, F.col("status") == F.col("event_type"), "left").select("status", "rank", F.coalesce("n", F.lit(0)).alias("cards"), "last")


@query(f"{_CARDS} SELECT event_id, event_type AS status, row_number() OVER (PARTITION BY event_type ORDER BY position, event_id) - 1 AS position FROM cards WHERE event_id % 3 <> 0")
def board_delete(spark, sf_dir):
    """Cards of every third event go; the rest close ranks."""
    left = cards(table(spark, sf_dir, "events")).where("event_id % 3 <> 0")
    return placed(left.drop("position"), "event_type", "event_id", "user_id").select("event_id", F.col("event_type").alias("status"), "position")


@query(f"""{_CARDS}, m AS (SELECT event_id, CASE WHEN position % 10 = 0 THEN 'purchase' ELSE event_type END AS status, CASE WHEN position % 10 = 0 AND event_type <> 'purchase' THEN 1 ELSE 0 END AS moved, position FROM cards)
SELECT event_id, status, row_number() OVER (PARTITION BY status ORDER BY moved, position, event_id) - 1 AS position FROM m""")
def board_bulk_move(spark, sf_dir):
    """Every tenth card of a column moves to the end of the purchases; all columns are numbered anew."""
    c = cards(table(spark, sf_dir, "events"))
    goes = F.col("position") % 10 == 0
    end = c.agg((F.max("position") + 1).alias("_end"))
    keyed = c.join(F.broadcast(end)).select("event_id", F.when(goes, "purchase").otherwise(F.col("event_type")).alias("status"), (F.col("position") + F.when(goes & (F.col("event_type") != "purchase"), F.col("_end")).otherwise(0)).alias("key"))
    return placed(keyed, "status", "key", "event_id").drop("key")


@query(f"""{_CARDS}, m AS (SELECT event_id, event_type AS status, CASE WHEN position = 0 THEN 5.5::DOUBLE ELSE position END AS key FROM cards)
SELECT event_id, status, row_number() OVER (PARTITION BY status ORDER BY key) - 1 AS position FROM m""")
def board_move(spark, sf_dir):
    """The first card of each column moves behind the sixth."""
    key = F.when(F.col("position") == 0, 5.5).otherwise(F.col("position").cast("double"))
    keyed = cards(table(spark, sf_dir, "events")).select("event_id", F.col("event_type").alias("status"), key.alias("key"))
    return placed(keyed, "status", "key", "event_id").drop("key")


@query(f"""{_CARDS}, k AS (SELECT event_id, CASE WHEN event_id = 10 THEN 'error' ELSE event_type END AS status, CASE WHEN event_id = 10 THEN 1.5::DOUBLE
 ELSE position - CASE WHEN event_type = (SELECT event_type FROM cards WHERE event_id = 10) AND position > (SELECT position FROM cards WHERE event_id = 10) THEN 1 ELSE 0 END END AS key FROM cards)
SELECT event_id, status, row_number() OVER (PARTITION BY status ORDER BY key, event_id) - 1 AS position FROM k""")
def board_move_across(spark, sf_dir):
    """One card goes to the third place among the errors."""
    out = moved(cards(table(spark, sf_dir, "events")).drop("user_id"), 10, "error", 2)
    return out.select("event_id", F.col("event_type").alias("status"), "position")


@query("""SELECT o_orderkey, o_orderstatus, c_name, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""")
def card_detail(spark, sf_dir):
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey, "left").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return joined.select("o_orderkey", "o_orderstatus", "c_name", "n_name")


@query("SELECT o_orderkey, nullif(o_custkey, 7) AS o_custkey, count(*) OVER (PARTITION BY nullif(o_custkey, 7)) > 1 AS shared FROM orders")
def shared_base(spark, sf_dir):
    """Orders whose customer has others: counts are aggregated first and joined back, so a hot customer splits."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.nullif("o_custkey", F.lit(7)).alias("o_custkey"))
    counts = orders.groupBy("o_custkey").agg((F.count(F.lit(1)) > 1).alias("shared"))
    counts = counts.withColumnRenamed("o_custkey", "_k")
    return orders.join(counts, F.col("o_custkey").eqNullSafe(F.col("_k"))).select("o_orderkey", "o_custkey", "shared")


@query("SELECT d.doc_id, left(text, 80) AS snippet, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def list_with_snippet(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    # Cut before the join: only the snippet is shuffled.
    return docs.select("doc_id", F.substring("text", 1, 80).alias("snippet")).join(labels.select("doc_id", "quality"), "doc_id", "left")


@query("SELECT n_name, r_name, count(c_custkey) AS customers FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL")
def lineage_chain(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    chain = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return chain.join(customers, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("n_name", "r_name", F.coalesce("n", F.lit(0)).alias("customers"))


def planned(cards: DataFrame, moves: DataFrame, status: str, position: str, id_col: str) -> DataFrame:
    """moves (active, over_card or over_column) with from, at, to_column, index of where they lead, and noop.

    Over a card of another column the card goes to its place there, over a column to its end; within its own
    column it takes the place of the card it is over, or the last one. What leads nowhere else is no move.
    """
    where = cards.select(F.col(id_col).alias("_id"), F.col(status).alias("_s"), F.col(position).alias("_p"))
    sizes = cards.groupBy(status).agg(F.count(F.lit(1)).alias("_n")).select(F.col(status).alias("_c"), "_n")
    a, o = where.toDF("_a", "from", "at"), where.toDF("_o", "_os", "_op")
    both = moves.join(a, F.col("active") == F.col("_a"), "left").join(o, F.col("over_card") == F.col("_o"), "left")
    both = both.withColumn("to_column", F.coalesce("over_column", "_os", "from")).join(sizes, F.col("to_column") == F.col("_c"), "left")
    own, n = F.col("from") == F.col("to_column"), F.coalesce("_n", F.lit(0))
    index = F.when(F.col("over_column").isNotNull(), n - F.when(own, 1).otherwise(0)).otherwise(F.coalesce("_op", "at"))
    noop = F.col("from").isNull() | F.coalesce(F.col("active") == F.col("over_card"), F.lit(False)) | (own & (index == F.col("at")))
    return both.select(*moves.columns, "from", "at", "to_column", index.alias("index"), F.coalesce(noop, F.lit(True)).alias("noop"))


@query(f"""{_CARDS}, n AS (SELECT event_type AS c, count(*) AS n FROM cards GROUP BY event_type),
m AS (SELECT event_id AS active, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id + event_id % 2 * 40 END AS over_card, CASE WHEN event_id % 3 = 0 THEN 'purchase' END AS over_column, event_type, position FROM cards),
p AS (SELECT m.*, coalesce(over_column, o.event_type, m.event_type) AS target, o.position AS op FROM m LEFT JOIN cards o ON o.event_id = m.over_card)
SELECT active, target AS to_column, CASE WHEN over_column IS NOT NULL THEN n - (event_type = target)::INT ELSE coalesce(op, position) END AS index,
active = over_card IS TRUE OR coalesce(active = over_card, false) OR (event_type = target AND CASE WHEN over_column IS NOT NULL THEN n - 1 ELSE coalesce(op, position) END = position) AS noop FROM p JOIN n ON n.c = target""".replace("active = over_card IS TRUE OR ", ""))
def plan_moves(spark, sf_dir):
    """Where cards dropped on others or on a column would go."""
    board = cards(table(spark, sf_dir, "events")).select("event_id", "event_type", "position")
    i = F.col("event_id")
    moves = board.select(i.alias("active"), F.when(i % 3 != 0, i + i % 2 * 40).alias("over_card"), F.when(i % 3 == 0, "purchase").alias("over_column"))
    return planned(board, moves, "event_type", "position", "event_id").select("active", "to_column", "index", "noop")
