"""State machines in batch form: claims on processing, finishing, preview leases and deadlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.catalog import query
from tessera.sources.tables import table

RETRYABLE = ("failed", "processing")


def claimable(status: Column, version: Column, seen: Column) -> Column:
    """Failed rows and those at work may be claimed again; a ready one only at the version that the caller saw."""
    return F.coalesce(status.isin(*RETRYABLE) | ((status == "ready") & seen.isNotNull() & (version == seen)), F.lit(False))


def claimed(rows: DataFrame, requests: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(rows after the claims, outcome of each request): claimed with its token, refused, or missing.

    rows: id, status, token, updated_at, ...; requests: id, token, seen (null: no ready row), one a row.
    """
    asked = requests.select(F.col("id").alias("_id"), F.col("token").alias("_token"), F.col("seen").alias("_seen"))
    both = rows.join(asked, F.col("id") == F.col("_id"), "left")
    takes = F.col("_id").isNotNull() & claimable(F.col("status"), F.col("updated_at"), F.col("_seen"))
    changed = {"status": F.when(takes, "processing").otherwise(F.col("status")), "token": F.when(takes, F.col("_token")).otherwise(F.col("token")),
               "updated_at": F.when(takes, now).otherwise(F.col("updated_at"))}
    found = asked.join(rows.select("id", "status", "updated_at"), F.col("_id") == F.col("id"), "left")
    outcome = F.when(F.col("id").isNull(), "missing").when(claimable(F.col("status"), F.col("updated_at"), F.col("_seen")), "claimed").otherwise("refused")
    return both.withColumns(changed).drop("_id", "_token", "_seen"), found.select(F.col("_id").alias("id"), outcome.alias("outcome"), F.when(outcome == "claimed", F.col("_token")).alias("token"))


_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'P' THEN 'processing' ELSE 'ready' END"
_SEEN = "CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate END"


def _attempts(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Orders as records at work, and requests for all of them and for some that aren't there."""
    orders = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "P", "processing").otherwise("ready")
    rows = orders.select(F.col("o_orderkey").alias("id"), status.alias("status"), F.lit("old").alias("token"), F.col("o_orderdate").alias("updated_at"))
    requests = orders.select((F.col("o_orderkey") + F.when(F.col("o_orderkey") % 7 == 0, -1_000_000_000).otherwise(0)).alias("id"), F.concat(F.lit("t"), "o_orderkey").alias("token"),
                             F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderdate")).alias("seen"))
    return rows, requests


@query(f"""SELECT CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey - 1000000000 ELSE o_orderkey END AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'missing'
WHEN {_STATUS} IN ('failed', 'processing') OR {_SEEN} = o_orderdate THEN 'claimed' ELSE 'refused' END AS outcome,
CASE WHEN o_orderkey % 7 <> 0 AND ({_STATUS} IN ('failed', 'processing') OR {_SEEN} = o_orderdate) THEN 't' || o_orderkey END AS token FROM orders""")
def claim_processing(spark, sf_dir):
    return claimed(*_attempts(spark, sf_dir), F.expr("timestamp'2025-01-01 00:00:00'"))[1]


def finished(rows: DataFrame, ends: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(rows after the ends, outcome of each): committed, stale or missing.

    ends: id, token, status ('ready' or 'failed'), data. The token has to be the row's own, null for a row that
    nobody claimed (which can only fail); data stay with a ready row alone.
    """
    asked = ends.select(*[F.col(c).alias(f"_{c}") for c in ("id", "token", "status", "data")])
    both = rows.join(asked, F.col("id") == F.col("_id"), "left")
    owns = F.col("_id").isNotNull() & F.col("token").eqNullSafe(F.col("_token")) & F.col("status").eqNullSafe(F.lit("processing"))
    owns &= F.col("_token").isNotNull() | (F.col("_status") == "failed")
    changed = {"data": F.when(owns, F.when(F.col("_status") == "ready", F.col("_data"))).otherwise(F.col("data")), "status": F.when(owns, F.col("_status")).otherwise(F.col("status")),
               "token": F.when(~owns, F.col("token")), "updated_at": F.when(owns, now).otherwise(F.col("updated_at"))}
    found = asked.join(rows, F.col("_id") == F.col("id"), "left")
    outcome = F.when(F.col("id").isNull(), "missing").when(owns, "committed").otherwise("stale")
    return both.select(*[changed.get(c, F.col(c)).alias(c) for c in rows.columns]), found.select(F.col("_id").alias("id"), outcome.alias("outcome"))


@query(f"""WITH r AS (SELECT o_orderkey AS id, {_STATUS} AS status, o_orderkey % 3 AS t FROM orders)
SELECT id, CASE WHEN status = 'processing' AND t <> 2 THEN (CASE WHEN id % 2 = 0 THEN 'ready' ELSE 'failed' END) ELSE status END AS status,
CASE WHEN status = 'processing' AND t <> 2 THEN (CASE WHEN id % 2 = 0 THEN 'd' || id END) ELSE 'old' END AS data FROM r""")
def finish_processing(spark, sf_dir):
    """Two thirds of the attempts come with the token of their record."""
    rows = _attempts(spark, sf_dir)[0].withColumn("data", F.lit("old")).withColumn("token", F.concat(F.lit("t"), "id"))
    ends = rows.select("id", F.when(F.col("id") % 3 != 2, F.col("token")).otherwise("other").alias("token"), F.when(F.col("id") % 2 == 0, "ready").otherwise("failed").alias("status"),
                       F.concat(F.lit("d"), "id").alias("data"))
    return finished(rows, ends, F.expr("timestamp'2025-01-01 00:00:00'"))[0].select("id", "status", "data")


def inputs_current(previews: DataFrame, sources: DataFrame, jobs: DataFrame) -> DataFrame:
    """previews with `current`: whether source and job still have the contents that were seen.

    previews: source_id, job_id, source_hash, job_hash; sources and jobs: id, content. Only hashes meet.
    """
    s = sources.select(F.col("id").alias("_s"), F.sha2("content", 256).alias("_sh"))
    j = jobs.select(F.col("id").alias("_j"), F.sha2("content", 256).alias("_jh"))
    both = previews.join(s, F.col("source_id") == F.col("_s"), "left").join(j, F.col("job_id") == F.col("_j"), "left")
    same = (F.col("_sh") == F.col("source_hash")) & (F.col("_jh") == F.col("job_hash"))
    return both.withColumn("current", F.coalesce(same, F.lit(False))).drop("_s", "_sh", "_j", "_jh")


@query("""WITH p AS (SELECT d.doc_id AS source_id, d.doc_id % 40 AS job_id, sha256(d.text) AS sh, CASE WHEN d.doc_id % 5 = 0 THEN 'stale' ELSE sha256(b.text) END AS jh FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id % 40)
SELECT source_id, coalesce(sha256(d.text) = sh AND sha256(b.text) = jh, false) AS current FROM p LEFT JOIN documents d ON d.doc_id = source_id LEFT JOIN benchmark b ON b.item_id = job_id""")
def preview_inputs(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content")), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("content"))
    made = docs.select(F.col("id").alias("source_id"), (F.col("id") % 40).alias("job_id"), F.sha2("content", 256).alias("source_hash"))
    made = made.join(items.select(F.col("id").alias("_i"), F.sha2("content", 256).alias("_h")), F.col("job_id") == F.col("_i"), "left")
    made = made.select("source_id", "job_id", "source_hash", F.when(F.col("source_id") % 5 == 0, "stale").otherwise(F.col("_h")).alias("job_hash"))
    return inputs_current(made, docs, items).select("source_id", "current")


def holds(token: Column, claim_token: Column, lease_ends: Column, now: Column) -> Column:
    """Whether a claim is the caller's and its lease hasn't run out."""
    return F.coalesce((token == claim_token) & (lease_ends > now), F.lit(False))


def completed(previews: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """previews after the requests (preview_id, token, result_id, response) of those who hold them, with `outcome`.

    completed: the result and its response stay with the preview and the claim ends; lost: the claim isn't the
    caller's any more or the inputs changed; null: nobody asked. previews: preview_id, claim_token, lease_ends,
    current, result_id, response.
    """
    asked = requests.select(*[F.col(c).alias(f"_{c}") for c in ("preview_id", "token", "result_id", "response")])
    both = previews.join(asked, F.col("preview_id") == F.col("_preview_id"), "left")
    done = holds(F.col("_token"), F.col("claim_token"), F.col("lease_ends"), now) & F.coalesce("current", F.lit(False))
    changed = {"result_id": F.when(done, F.col("_result_id")).otherwise(F.col("result_id")), "response": F.when(done, F.col("_response")).otherwise(F.col("response")),
               "claim_token": F.when(~done, F.col("claim_token")), "lease_ends": F.when(~done, F.col("lease_ends"))}
    outcome = F.when(F.col("_preview_id").isNull(), None).when(done, "completed").otherwise("lost")
    return both.select(*[changed.get(c, F.col(c)).alias(c) for c in previews.columns], outcome.alias("outcome"))


def released(previews: DataFrame, requests: DataFrame) -> DataFrame:
    """previews without the claims that their owners (preview_id, token) give back; others stay."""
    asked = requests.select(F.col("preview_id").alias("_preview_id"), F.col("token").alias("_token"))
    both = previews.join(asked, F.col("preview_id") == F.col("_preview_id"), "left")
    own = F.coalesce(F.col("_token") == F.col("claim_token"), F.lit(False))
    return both.select(*[(F.when(~own, F.col(c)) if c in ("claim_token", "lease_ends") else F.col(c)).alias(c) for c in previews.columns])


def _previews(spark, sf_dir) -> tuple[DataFrame, DataFrame, Column]:
    """Events as previews claimed an hour ahead, and a request for each with the right token or another."""
    now = F.expr("timestamp'2024-01-15 00:00:00'")
    events = table(spark, sf_dir, "events")
    rows = events.select(F.col("event_id").alias("preview_id"), F.concat(F.lit("t"), "user_id").alias("claim_token"), (F.col("ts") + F.expr("INTERVAL 3600 SECONDS")).alias("lease_ends"),
                         (F.col("event_type") != "error").alias("current"), F.lit(None).cast("string").alias("result_id"), F.lit(None).cast("string").alias("response"))
    requests = events.where("event_id % 4 <> 3").select(
        F.col("event_id").alias("preview_id"), F.when(F.col("event_id") % 4 == 0, "other").otherwise(F.concat(F.lit("t"), "user_id")).alias("token"), F.col("event_type").alias("result_id"), F.col("props").alias("response"))
    return rows, requests, now


_HELD = "event_id % 4 IN (1, 2) AND ts + INTERVAL 3600 SECOND > TIMESTAMP '2024-01-15 00:00:00' AND event_type <> 'error'"


@query(f"""SELECT event_id AS preview_id, CASE WHEN event_id % 4 = 3 THEN NULL WHEN {_HELD} THEN 'completed' ELSE 'lost' END AS outcome,
CASE WHEN {_HELD} THEN event_type END AS result_id, CASE WHEN NOT ({_HELD}) THEN 't' || user_id END AS claim_token FROM events""")
def complete_previews(spark, sf_dir):
    rows, requests, now = _previews(spark, sf_dir)
    return completed(rows, requests, now).select("preview_id", "outcome", "result_id", "claim_token")


@query("SELECT event_id AS preview_id, CASE WHEN event_id % 4 NOT IN (1, 2) THEN 't' || user_id END AS claim_token FROM events")
def release_claims(spark, sf_dir):
    rows, requests, _ = _previews(spark, sf_dir)
    return released(rows, requests).select("preview_id", "claim_token")


def purged(previews: DataFrame, now: Column) -> DataFrame:
    """previews but for those that ran out unused and that nobody holds: expires_at, result_id, claim_token, lease_ends."""
    stale = (F.col("expires_at") <= now) & F.col("result_id").isNull() & (F.col("claim_token").isNull() | F.coalesce(F.col("lease_ends") <= now, F.lit(False)))
    return previews.where(~F.coalesce(stale, F.lit(False)))


@query("""SELECT event_id AS preview_id FROM events WHERE NOT (ts + INTERVAL 604800 SECOND <= TIMESTAMP '2024-01-15 00:00:00' AND event_type <> 'purchase'
AND (event_id % 2 = 0 OR ts + INTERVAL 864000 SECOND <= TIMESTAMP '2024-01-15 00:00:00'))""")
def purge_previews(spark, sf_dir):
    """Events as previews of a week; purchases have a result, odd ones a claim of ten days."""
    later = lambda n: F.col("ts") + F.expr(f"INTERVAL {n} SECONDS")
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("preview_id"), later(604800).alias("expires_at"), F.when(F.col("event_type") == "purchase", "r").alias("result_id"),
                                                 F.when(F.col("event_id") % 2 == 1, "t").alias("claim_token"), later(864000).alias("lease_ends"))
    return purged(rows, F.expr("timestamp'2024-01-15 00:00:00'")).select("preview_id")


def preferred(rows: DataFrame, key: str, result: str, made: str, expires: str, now: Column, id_col: str) -> DataFrame:
    """One preview a key: a completed one before others, then the latest made; open ones that ran out don't count."""
    done = F.col(result).isNotNull()
    best = rows.where(done | (F.col(expires) > now)).groupBy(key).agg(F.max(F.struct(done.alias("done"), F.col(made).alias("made"), F.col(id_col).alias("id"))).alias("b"))
    return best.select(key, F.col("b.id").alias(id_col), F.col("b.done").alias("completed"))


@query("""SELECT user_id, event_id, event_type = 'purchase' AS completed FROM events WHERE event_type = 'purchase' OR ts + INTERVAL 604800 SECOND > TIMESTAMP '2024-01-20 00:00:00'
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_type = 'purchase' DESC, ts DESC, event_id DESC) = 1""")
def preferred_preview(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.when(F.col("event_type") == "purchase", "r").alias("result"), (F.col("ts") + F.expr("INTERVAL 604800 SECONDS")).alias("expires"))
    return preferred(rows, "user_id", "result", "ts", "expires", F.expr("timestamp'2024-01-20 00:00:00'"), "event_id")


def deadlines(rows: DataFrame, key: str, order: str, started: str, seconds: str) -> DataFrame:
    """rows with deadline: the earliest of its own and those of the operations around it, which come before it."""
    own = F.col(started) + F.make_dt_interval(secs=F.col(seconds))
    outer = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("deadline", F.min(own).over(outer))


@query("""SELECT event_id, min(ts + to_seconds((event_id % 5 + 1) * 100000)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS deadline FROM events""")
def nested_deadlines(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", ((F.col("event_id") % 5 + 1) * 100000).alias("s"))
    return deadlines(rows, "user_id", "event_id", "ts", "s").select("event_id", "deadline")


def commit_result(outcome: Column) -> Column:
    """What a client hears about a commit: done, a conflict or nothing there."""
    return F.when(outcome == "committed", "ok").when(outcome == "stale", "conflict").otherwise("not_found")


def busy(code: Column) -> Column:
    """Whether an engine's error code, whose low byte is the kind, says busy (5) or locked (6)."""
    return (code.bitwiseAND(F.lit(255))).isin(5, 6)


@query("""SELECT event_id, CASE event_type WHEN 'view' THEN 'ok' WHEN 'click' THEN 'conflict' ELSE 'not_found' END AS answer, (event_id & 255) IN (5, 6) AS busy FROM events""")
def commit_answers(spark, sf_dir):
    outcome = F.when(F.col("event_type") == "view", "committed").when(F.col("event_type") == "click", "stale").otherwise("missing")
    return table(spark, sf_dir, "events").select("event_id", commit_result(outcome).alias("answer"), busy(F.col("event_id")).alias("busy"))
