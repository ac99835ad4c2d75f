"""Keyed state in batch form: first and latest rows, leases and expiry."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tessera.plans.catalog import query
from tessera.sources.tables import table

LEASE_SECONDS, TTL_SECONDS = 3600, 7 * 86400


@query("SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def dedup_first_wins(spark, sf_dir):
    """The first event of a key, by aggregation: partial results travel, not rows."""
    first = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("f"))
    return first.select(F.col("f.event_id").alias("event_id"), "user_id", "event_type")


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY ALL".replace("arg_max(event_id, (ts, event_id))", "max_by(event_id, {'a': ts, 'b': event_id})").replace("arg_max(event_type, (ts, event_id))", "max_by(event_type, {'a': ts, 'b': event_id})"))
def latest_claim(spark, sf_dir):
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("m"))
    return last.select("user_id", F.col("m.event_id").alias("event_id"), F.col("m.event_type").alias("event_type"))


def claim_outcome(found: Column, inputs_match: Column, payload_matches: Column, completed: Column, result_exists: Column,
                  expires: Column, inputs_current: Column, lease_ends: Column, now: Column) -> Column:
    """What a request to confirm a preview gets, by the first check that decides; a null check fails."""
    def fails(check: Column) -> Column:
        return ~F.coalesce(check, F.lit(False))

    done = F.coalesce(completed, F.lit(False))
    return (F.when(fails(found), "missing").when(fails(inputs_match), "conflict").when(fails(payload_matches), "invalid")
            .when(done & fails(result_exists), "deleted").when(done, "replay").when(expires <= now, "expired")
            .when(fails(inputs_current), "stale").when(lease_ends > now, "busy").otherwise("granted"))


@query(f"""WITH o AS (SELECT *, lag(ts) OVER w AS before, lag(event_type) OVER w AS kind, lag(value) OVER w AS was FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, CASE WHEN before IS NULL THEN 'missing' WHEN event_type = 'error' THEN 'conflict' WHEN value < 1 THEN 'invalid' WHEN kind = 'purchase' AND was < 5 THEN 'deleted'
WHEN kind = 'purchase' THEN 'replay' WHEN before + INTERVAL {TTL_SECONDS} SECOND <= ts THEN 'expired' WHEN was < value / 10 THEN 'stale'
WHEN before + INTERVAL {LEASE_SECONDS} SECOND > ts THEN 'busy' ELSE 'granted' END AS outcome FROM o""")
def claim_decision(spark, sf_dir):
    """Each event confirms the preview that the user's event before it made."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    before, kind, was = (F.lag(c).over(order) for c in ("ts", "event_type", "value"))
    rows = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value", before.alias("before"), kind.alias("kind"), was.alias("was"))
    seconds = [F.col("before") + F.expr(f"INTERVAL {n} SECONDS") for n in (TTL_SECONDS, LEASE_SECONDS)]
    outcome = claim_outcome(
        F.col("before").isNotNull(), F.col("event_type") != "error", F.col("value") >= 1, F.col("kind") == "purchase", F.col("was") >= 5,
        seconds[0], F.col("was") >= F.col("value") / 10, seconds[1], F.col("ts"))
    return rows.select("event_id", outcome.alias("outcome"))


@query(f"""WITH n AS (SELECT max(ts) AS now FROM events), l AS (SELECT user_id, event_type, max(ts) AS made, bool_or(event_type = 'purchase') AS done FROM events GROUP BY ALL)
SELECT user_id, event_type FROM l, n WHERE done OR made + INTERVAL {TTL_SECONDS} SECOND > now""")
def expire_previews(spark, sf_dir):
    """A user's previews that stay: completed ones, and those whose time hasn't run out."""
    events = table(spark, sf_dir, "events")
    now = events.agg(F.max("ts").alias("now"))
    made = events.groupBy("user_id", "event_type").agg(F.max("ts").alias("made"))
    alive = (F.col("event_type") == "purchase") | (F.col("made") + F.expr(f"INTERVAL {TTL_SECONDS} SECONDS") > F.col("now"))
    return made.join(F.broadcast(now)).where(alive).select("user_id", "event_type")


@query("""SELECT user_id, coalesce(min(event_id) FILTER (event_type NOT IN ('error', 'view')), max(event_id)) AS master FROM events GROUP BY ALL""")
def elect_master(spark, sf_dir):
    """Who leads after all of a user's inserts: a new row takes the lead where there is none or the leader failed or is at work.

    So the first sound row leads for good, or else the last row does: one aggregation, no fold.
    """
    sound = ~F.col("event_type").isin("error", "view")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.coalesce(F.min(F.when(sound, F.col("event_id"))), F.max("event_id")).alias("master"))


@query("""WITH h AS (SELECT source, doc_id, sha256(coalesce(text, '')) AS h FROM documents), f AS (SELECT source, h, min(doc_id) AS first_doc FROM h GROUP BY ALL)
SELECT source, count(*) AS misses FROM f GROUP BY ALL""")
def cache_misses(spark, sf_dir):
    """How many contents a source has to have worked out: equal hashes are found in the cache."""
    hashed = table(spark, sf_dir, "documents").select("source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    return hashed.distinct().groupBy("source").agg(F.count(F.lit(1)).alias("misses"))


@query("SELECT e.event_id FROM events e WHERE e.event_type <> 'error' AND NOT EXISTS (SELECT 1 FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'error' AND x.event_id % 40 = 0)")
def cascade_delete(spark, sf_dir):
    """Events, errors apart, of users without any of the errors that count (every fortieth event is looked at)."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    gone = events.where("event_type = 'error' AND event_id % 40 = 0").select("user_id").distinct()
    return events.join(gone, "user_id", "left_anti").where("event_type <> 'error'").select("event_id")


@query("SELECT d.doc_id, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY ALL) l USING (doc_id)")
def partial_update(spark, sf_dir):
    """Known values over defaults."""
    updates = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return table(spark, sf_dir, "documents").select("doc_id").join(updates, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"))
