"""Streams over the events table, run once over all that is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.operators.ranking import cap_per_group
from loomwork.plans.registry import Registry
from loomwork.sources.storage import scratch
from loomwork.streaming import events as E

R = Registry()


def _stream(t):
    return E.read_events(t.spark, t.folder)


@R.add("r12_stream_dashboard", "SELECT event_type, ts::DATE AS day, count(*) AS n, round(max(value), 4) AS most FROM events GROUP BY 1, 2")
def dashboard(t):
    rows = E.run_available(E.daily_counts(_stream(t)), scratch(t.spark, "dashboard"), "update")
    last = cap_per_group(rows, ["event_type", "day"], [F.desc("batch")], 1)
    return last.select("event_type", "day", "n", F.round("most", 4).alias("most"))


@R.add("r04_stream_latest", "SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def latest(t):
    rows = E.run_available(E.latest_per_key(_stream(t)), scratch(t.spark, "latest"), "update")
    return cap_per_group(rows, ["user_id"], [F.desc("batch")], 1).select("user_id", "event_id")


@R.add("r09_stream_dispatch", "SELECT event_id, '{\"insert_id\":\"' || event_id || '\",\"event_type\":\"' || event_type || '\"}' AS envelope FROM events")
def dispatch(t):
    return E.run_available(E.dispatched_once(_stream(t)), scratch(t.spark, "dispatch")).select("event_id", "envelope")


IDLE_HOURS = 12
SESSION_SQL = f"""b AS (SELECT user_id, ts, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
s AS (SELECT *, sum((before IS NULL OR epoch_us(ts) - epoch_us(before) > {IDLE_HOURS * 3_600_000_000})::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM b)"""


def _epochs(t):
    return E.run_available(E.epochs(_stream(t), IDLE_HOURS * 3_600_000), scratch(t.spark, "epochs"), "update")


@R.add("r03_stream_epochs", f"WITH {SESSION_SQL} SELECT user_id, row_number() OVER w AS epoch, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) // 1000000 AS seconds FROM s WINDOW w AS (PARTITION BY user_id, session ORDER BY ts, event_id)")
def epochs(t):
    """Each report of a key with its number and the time since the one before; after a long silence they begin anew."""
    return _epochs(t).where("NOT evicted").select("user_id", "epoch", "seconds")


@R.add(
    "r05_evicted_sessions",
    f"WITH {SESSION_SQL}, e AS (SELECT user_id, session, count(*) AS epoch, epoch_ms(max(ts)) AS last FROM s GROUP BY 1, 2) SELECT user_id, epoch FROM e WHERE session < (SELECT max(session) FROM e f WHERE f.user_id = e.user_id) OR last + {IDLE_HOURS * 3_600_000} < (SELECT max(last) FROM e)",
)
def evicted(t):
    """The keys that were evicted, by their next report or by the stream's time, with the reports that they had."""
    return _epochs(t).where("evicted").select("user_id", "epoch")


@R.add(
    "r13_stream_retries",
    """WITH e AS (SELECT *, event_type <> 'error' AS ok FROM events), b AS (SELECT *, coalesce(sum(ok::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island FROM e),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS attempts FROM b), d AS (SELECT *, count_if(NOT ok AND attempts >= 3) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS dead FROM n)
SELECT user_id, event_id, attempts, CASE WHEN ok THEN 'done' WHEN attempts >= 3 THEN 'failed' ELSE 'retry' END AS status, CASE WHEN NOT ok AND attempts < 3 THEN attempts * attempts * attempts * attempts + 5 END AS delay FROM d WHERE coalesce(dead, 0) = 0""",
)
def retries(t):
    """Users as jobs whose errors are failed tries; the third in a row is the last."""
    tries = _stream(t).select("user_id", "event_id", "ts", (F.col("event_type") != "error").alias("ok"))
    return E.run_available(E.retried(tries, 3), scratch(t.spark, "retries")).drop("batch")


@R.add("r01_stream_due", "SELECT event_id FROM events WHERE ts <= TIMESTAMP '2024-01-20' AND event_type <> 'error' AND (event_type <> 'click' OR ts < TIMESTAMP '2024-01-20' - INTERVAL 4 HOURS)")
def stream_due(t):
    """Jobs of a stream whose time has come: errors have failed, and clicks are locked since their time."""
    at = F.col("ts")
    jobs = _stream(t).select("event_id", at.alias("run_at"), F.when(F.col("event_type") == "click", at).alias("locked_at"), F.when(F.col("event_type") == "error", at).alias("failed_at"))
    return E.run_available(E.due_jobs(jobs, "2024-01-20"), scratch(t.spark, "due")).select("event_id")


@R.add("r08_stream_sink", "SELECT event_id, user_id, round(value, 4) AS value FROM events")
def sink(t):
    return E.run_available(_stream(t), scratch(t.spark, "sink")).select("event_id", "user_id", F.round("value", 4).alias("value"))


@R.add(
    "r06_status_after_snapshot",
    "SELECT user_id, coalesce(min_by(event_id, (ts, event_id)) FILTER (event_type = 'purchase' AND value > 150), max_by(event_id, (ts, event_id))) AS event_id,"
    " coalesce(bool_or(event_type = 'purchase' AND value > 150), FALSE) AS done FROM events GROUP BY 1",
)
def status_after_snapshot(t):
    """A large purchase ends a user's story. The snapshot holds what even ids say, the stream everything; the overlap changes nothing."""
    end = (F.col("event_type") == "purchase") & (F.col("value") > 150)
    marked = lambda rows: rows.select("user_id", "event_id", "ts", end.alias("done"))
    rows = E.run_available(E.final_status(marked(_stream(t))), scratch(t.spark, "status"), "update").drop("batch")
    snapshot = E.final_status(marked(t.events.withColumn("ts", F.col("ts").cast("timestamp")).where("event_id % 2 = 0")))
    return E.final_status(snapshot.unionByName(rows)).select("user_id", "event_id", "done")


@R.add("r10_refreshed_list", "SELECT event_id, user_id FROM events WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = user_id AND c_acctbal < 0)")
def refreshed_list(t):
    """Customers in debt are shut out, by a list that each batch reads anew."""
    listed = lambda: t.customer.where("c_acctbal < 0").withColumnRenamed("c_custkey", "user_id")
    return E.run_available(_stream(t), scratch(t.spark, "listed"), step=E.without_listed(listed, "user_id")).select("event_id", "user_id")
