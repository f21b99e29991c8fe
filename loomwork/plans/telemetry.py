"""Events: bot filters, day buckets, gaps, dashboards, dispatch and progress checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomwork.operators import ranking
from loomwork.plans.registry import Registry

R = Registry()
BOT = "event_type = 'error'"


@R.add("p17_bot_exclusion", "SELECT event_id FROM events WHERE NOT (event_type = 'error' AND CAST(json_extract(props, '$.k') AS BIGINT) % 2 = 0)")
def bot_exclusion(t):
    """Events of bots go, unless their properties allow the bot."""
    allowed = F.get_json_object("props", "$.k").cast("bigint") % 2 != 0
    return t.events.where(~(F.expr(BOT) & ~allowed)).select("event_id")


@R.add("a19_counts_by_type", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def counts_by_type(t):
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@R.add("r12_daily_dashboard", "SELECT event_type, ts::DATE AS day, count(*) AS n, round(max(value), 4) AS most FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-17' GROUP BY 1, 2")
def dashboard(t):
    """Seven calendar days by tumbling windows."""
    week = t.events.where((F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-01-17").cast("timestamp_ntz")))
    days = week.groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"), F.round(F.max("value"), 4).alias("most"))
    return days.select("event_type", F.to_date("w.start").alias("day"), "n", "most")


@R.add(
    "w07_gap_filled_days",
    """WITH d AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events WHERE event_type = 'purchase'), b AS (SELECT user_id, min(day) AS a, max(day) AS z FROM d GROUP BY 1),
g AS (SELECT user_id, unnest(generate_series(a, z, INTERVAL 1 DAY))::DATE AS day FROM b) SELECT g.user_id, g.day, d.day IS NOT NULL AS has_rows FROM g LEFT JOIN d ON d.user_id = g.user_id AND d.day = g.day""",
)
def gap_days(t):
    rows = t.events.where("event_type = 'purchase'").select("user_id", F.to_date("ts").alias("day"))
    return ranking.gap_filled_days(rows, ["user_id"], "day")


@R.add("w09_equal_time_buckets", "SELECT user_id, event_id, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS bucket FROM (SELECT *, CASE WHEN lag(ts::DATE) OVER (PARTITION BY user_id ORDER BY ts, event_id) = ts::DATE THEN 0 ELSE 1 END AS f FROM events)")
def time_buckets(t):
    rows = t.events.select("user_id", "event_id", "ts", F.to_date("ts").alias("day"))
    return ranking.collapsed_runs(rows, ["user_id"], ["ts", "event_id"], "day").select("user_id", "event_id", F.col("run").alias("bucket"))


@R.add("w11_progress_regressions", "SELECT user_id, event_id, value < prev AS went_down, event_type <> prev_type AS changed FROM (SELECT *, lag(value) OVER w AS prev, lag(event_type) OVER w AS prev_type FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE prev IS NOT NULL")
def regressions(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = t.events.withColumns({"prev": F.lag("value").over(w), "prev_type": F.lag("event_type").over(w)}).where("prev IS NOT NULL")
    return rows.select("user_id", "event_id", (F.col("value") < F.col("prev")).alias("went_down"), (F.col("event_type") != F.col("prev_type")).alias("changed"))


@R.add("s25_dispatch_envelopes", "SELECT event_id, '{\"insert_id\":\"' || event_id || '\",\"event_type\":\"' || event_type || '\",\"time\":' || (epoch_us(ts) // 1000) || '}' AS envelope FROM events WHERE event_type <> 'error'")
def envelopes(t):
    time = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000)
    body = F.struct(F.col("event_id").cast("string").alias("insert_id"), "event_type", time.alias("time"))
    return t.events.where(~F.expr(BOT)).select("event_id", F.to_json(body).alias("envelope"))


@R.add("r04_latest_wins", "SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id, max(ts)::DATE AS day FROM events GROUP BY 1")
def latest_wins(t):
    return t.events.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.to_date(F.max("ts")).alias("day"))


@R.add("r05_idle_keys", "SELECT user_id FROM events GROUP BY 1 HAVING max(ts) < TIMESTAMP '2024-01-29'")
def idle(t):
    return t.events.groupBy("user_id").agg(F.max("ts").alias("last")).where(F.col("last") < F.lit("2024-01-29").cast("timestamp_ntz")).select("user_id")


@R.add("r01_due_jobs", "SELECT o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1996-01-01' AND o_orderstatus <> 'F' AND (o_orderpriority <> '1-URGENT' OR o_orderdate < TIMESTAMP '1996-01-01' - INTERVAL 4 HOURS)")
def due_jobs(t):
    """Jobs whose time has come, that haven't failed, and whose lock, if any, is older than four hours."""
    now = F.lit("1996-01-01").cast("timestamp_ntz")
    locked_at = F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderdate"))
    free = locked_at.isNull() | (locked_at < now - F.expr("INTERVAL 4 HOURS"))
    return t.orders.where((F.col("o_orderdate") <= now) & (F.col("o_orderstatus") != "F") & free).select("o_orderkey")


@R.add("r11_late_dates", "SELECT o_orderdate::DATE < DATE '1996-01-01' AS late, count(*) AS n, CAST(sum(CASE WHEN o_orderdate::DATE < DATE '1996-01-01' THEN date_diff('day', o_orderdate::DATE, DATE '1996-01-01') ELSE 0 END) AS BIGINT) AS skipped_days FROM orders GROUP BY 1")
def late(t):
    day, today = F.to_date("o_orderdate"), F.lit("1996-01-01").cast("date")
    skipped = F.when(day < today, F.datediff(today, day)).otherwise(0)
    return t.orders.groupBy((day < today).alias("late")).agg(F.count("*").alias("n"), F.sum(skipped).alias("skipped_days"))


@R.add("r13_dead_letters", "SELECT c_custkey, c_custkey % 30 AS attempts, c_custkey % 30 >= 25 AS failed FROM customer")
def dead_letters(t):
    n = (F.col("c_custkey") % 30).alias("attempts")
    return t.customer.select("c_custkey", n, (F.col("c_custkey") % 30 >= 25).alias("failed"))
