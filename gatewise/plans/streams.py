"""Registered streaming queries: each runs a bounded file stream to its end and returns what it produced."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatewise.operators import decide as D
from gatewise.plans.decisions import _CHAIN, HIGH, MEDIUM, PAIRS, payloads, saved_chain
from gatewise.plans.registry import query
from gatewise.sources.files import write_stage
from gatewise.sources.standins import load
from gatewise.streaming import decisions as S


def events(spark, d):
    return S.event_stream(spark, d, "events", "ts")


@query("stream_decisions", ("members",), _CHAIN + " SELECT company_id, raw_rating, rating, category, decision, reason FROM decided")
def stream_decisions(spark, d):
    """Payloads on arrival, by the function that ``decide_payloads`` uses on tables and the same files."""
    folder = saved_chain(spark, d)
    write_stage(payloads(spark, d), f"{folder}/arrived", None)
    arrived = spark.readStream.schema(spark.read.parquet(f"{folder}/arrived").schema).parquet(f"{folder}/arrived")
    chain = D.load_chain(spark, folder)
    decided = S.decide_stream(arrived, lambda p: D.decide_payloads(p, PAIRS, chain, HIGH, MEDIUM, ["company_id"]))
    return S.available_rows(decided, "decide", "append")


@query("stream_rates", (), """
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, CAST(COUNT(*) AS BIGINT) AS n, ROUND(AVG(value), 6) AS mean_value FROM events GROUP BY 1, 2""")
def stream_rates(spark, d):
    out = S.closed_rows(events(spark, d), "ts", "1 day", "rates", lambda e: S.window_rates(e, "ts", "event_type", "value", "1 day"))
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("mean_value", 6).alias("mean_value"))


@query("stream_sliding_rates", (), """
w AS (SELECT ts, event_type, value, unnest([0, 1]) AS back FROM events)
SELECT strftime(date_trunc('day', ts) - back * INTERVAL 1 DAY, '%Y-%m-%d') AS day, event_type, CAST(COUNT(*) AS BIGINT) AS n, ROUND(AVG(value), 6) AS mean_value FROM w GROUP BY 1, 2""")
def stream_sliding_rates(spark, d):
    out = S.closed_rows(events(spark, d), "ts", "1 day", "sliding", lambda e: S.window_rates(e, "ts", "event_type", "value", "2 days", slide="1 day"))
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("mean_value", 6).alias("mean_value"))


@query("stream_sessions", (), """
g AS (SELECT user_id, ts, CASE WHEN ts - LAG(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, SUM(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, strftime(MIN(ts), '%Y-%m-%d %H:%M:%S') AS session_start, CAST(COUNT(*) AS BIGINT) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark, d):
    out = S.closed_rows(events(spark, d), "ts", "1 day", "sessions", lambda e: S.sessions(e, "ts", "user_id", "6 hours"))
    return out.select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "n")


@query("stream_dedupe", (), "SELECT CAST(COUNT(*) AS BIGINT) AS n, CAST(SUM(event_id) AS BIGINT) AS id_sum FROM events")
def stream_dedupe(spark, d):
    """Every event is sent twice; the stream keeps one copy of each."""
    twice = events(spark, d).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    once = S.available_rows(S.drop_resent(twice, "ts", ["event_id"], "1 hour").select("event_id", "ts"), "dedupe", "append")
    return once.agg(F.count("*").alias("n"), F.sum("event_id").alias("id_sum"))


_LATEST = "SELECT user_id AS \"key\", event_id, payload FROM (SELECT user_id, event_id, props AS payload, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1"


@query("stream_latest_batches", (), _LATEST)
def stream_latest_batches(spark, d):
    updates = S.available_rows(S.latest_rows(events(spark, d), "user_id", "ts", "event_id", "props"), "latest", "update")
    return S.newest_update(updates)


@query("stream_latest_state", (), _LATEST)
def stream_latest_state(spark, d):
    updates = S.available_rows(S.latest_state(events(S.state_session(spark), d), "user_id", "ts", "event_id", "props"), "state", "update")
    return S.newest_update(updates)


def label_stream(spark, d):
    """Purchases stand for decisions, errors for fraud reports."""
    return S.label_events(events(spark, d), "user_id", "ts", "event_id", "value", F.col("event_type") == "purchase", F.col("event_type") == "error")


@query("stream_label_maturation", (), """
SELECT a.event_id, arg_min(b.event_id, (b.ts, b.event_id)) AS report_id, strftime(MIN(b.ts), '%Y-%m-%d %H:%M:%S') AS reported_at, ROUND(arg_min(b.value, (b.ts, b.event_id)), 6) AS amount
FROM events a LEFT JOIN events b ON a.user_id = b.user_id AND b.event_type = 'error' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 3 DAY
WHERE a.event_type = 'purchase' AND a.user_id IS NOT NULL GROUP BY a.event_id""")
def stream_label_maturation(spark, d):
    """Every decision once: its first report within three days, or NULLs."""
    out = S.closed_rows(label_stream(S.state_session(spark), d), "at", "1 day", "labels", lambda e: S.mature_labels(e, 3))
    return out.select(F.col("decision_id").alias("event_id"), "report_id", F.date_format("reported_at", "yyyy-MM-dd HH:mm:ss").alias("reported_at"), F.round("amount", 6).alias("amount"))


@query("late_label_reports", (), """
l AS (SELECT user_id, MAX(ts) AS at FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT CAST(COUNT(*) AS BIGINT) AS late_reports FROM events e JOIN l USING (user_id) WHERE e.event_type = 'error' AND e.ts > l.at + INTERVAL 1 DAY""")
def late_label_reports(spark, d):
    e = load(spark, d, "events")
    return S.count_late(e.filter("event_type = 'error'"), e.filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("decided_at")), "user_id", "decided_at", "ts", 1)
