"""Event streams: daily dashboards, latest progress, at-least-once dispatch, epochs and idle keys, a micro-batch sink.

All take a streaming frame of (event_id, ts, user_id, event_type, value); ts is a timestamp.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files: str = "events.parquet", files_per_batch: int = 100) -> DataFrame:
    """The files of a folder whose names fit, as a stream."""
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", files).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def daily_counts(events: DataFrame, lateness: str = "1 day") -> DataFrame:
    """(event_type, day, n, most) by tumbling days; rows later than `lateness` no longer count."""
    days = events.withWatermark("ts", lateness).groupBy("event_type", F.window("ts", "1 day").alias("w"))
    return days.agg(F.count("*").alias("n"), F.max("value").alias("most")).select("event_type", F.to_date("w.start").alias("day"), "n", "most")


def latest_per_key(events: DataFrame, key: str = "user_id") -> DataFrame:
    """(key, event_id, ts): the latest wins; run it in update mode."""
    last = F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id")
    return events.groupBy(key).agg(last, F.max("ts").alias("ts"))


def dispatched_once(events: DataFrame, within: str = "7 days") -> DataFrame:
    """JSON envelopes of events; an event that is delivered again within that time goes out once."""
    once = events.withWatermark("ts", within).dropDuplicatesWithinWatermark(["event_id"])
    return once.select("event_id", F.to_json(F.struct(F.col("event_id").cast("string").alias("insert_id"), "event_type")).alias("envelope"))


def due_jobs(jobs: DataFrame, now: str) -> DataFrame:
    """Jobs (id, run_at, locked_at, failed_at) whose time has come and that nobody works on."""
    at = F.lit(now).cast("timestamp")
    free = F.col("locked_at").isNull() | (F.col("locked_at") < at - F.expr("INTERVAL 4 HOURS"))
    return jobs.where((F.col("run_at") <= at) & free & F.col("failed_at").isNull())


def _micros(frames: Iterator[pd.DataFrame], *more: str) -> list[tuple]:
    """(microseconds, *more) of the rows of a key, in order of time."""
    rows = pd.concat([f[["ts", *more]] for f in frames])
    return sorted(zip(rows["ts"].astype("datetime64[us]").astype("int64").tolist(), *[rows[c].tolist() for c in more], strict=True))


def epochs(events: DataFrame, idle_ms: int = 300_000) -> DataFrame:
    """(user_id, epoch, seconds, evicted): a row for each progress report of a key, with its number and the whole seconds since the report before, null for the first.

    A key that is silent for more than idle_ms, by its next report or as the stream's time moves on, is evicted, with a last row that says so; its next report is the first again. The state
    of a key is a number and a time, however many reports it has.
    """
    names = ["user_id", "epoch", "seconds", "evicted"]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        epoch, last = state.get if state.exists else (0, 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], epoch, None, True)], columns=names)
            return
        out = []
        for (at,) in _micros(frames):
            if epoch and at - last > idle_ms * 1000:
                out.append((key[0], epoch, None, True))
                epoch = 0
            out.append((key[0], epoch + 1, max(at - last, 0) // 1_000_000 if epoch else None, False))
            epoch, last = epoch + 1, max(last, at)
        state.update((epoch, last))
        state.setTimeoutTimestamp(max(last // 1000 + idle_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=names).astype({"seconds": "Int64"})

    return events.withWatermark("ts", "0 seconds").groupBy("user_id").applyInPandasWithState(
        step, "user_id long, epoch long, seconds long, evicted boolean", "epoch long, last long", "update", GroupStateTimeout.EventTimeTimeout
    )


#: Tries of a job before it is given up, and the seconds before the next one, n tries to the power added to the least.
MOST_TRIES, LEAST_DELAY, DELAY_POWER = 25, 5, 4


def retried(outcomes: DataFrame, most: int = MOST_TRIES) -> DataFrame:
    """(user_id, event_id, attempts, status, delay): what becomes of jobs (user_id) as their tries (event_id, ts, ok) come in.

    status: `done` after a try that went well, with which the job's count begins anew; `retry` after one that failed, with the seconds until the next; `failed` after the last one allowed, behind which
    tries of the job no longer count. The state of a job is its count and whether it failed.
    """
    names = ["user_id", "event_id", "attempts", "status", "delay"]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        attempts, failed = state.get if state.exists else (0, False)
        out = []
        for _, event_id, ok in _micros(frames, "event_id", "ok"):
            if failed:
                break
            attempts += 1
            failed = not ok and attempts >= most
            status = "done" if ok else "failed" if failed else "retry"
            out.append((key[0], event_id, attempts, status, attempts**DELAY_POWER + LEAST_DELAY if status == "retry" else None))
            attempts = 0 if ok else attempts
        state.update((attempts, failed))
        yield pd.DataFrame(out, columns=names).astype({"delay": "Int64"})

    return outcomes.groupBy("user_id").applyInPandasWithState(
        step, "user_id long, event_id long, attempts long, status string, delay long", "attempts long, failed boolean", "append", GroupStateTimeout.NoTimeout
    )


def retrying_sink(path: str, tries: int = 5, wait: Callable[[float], None] = time.sleep) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes each batch to a folder of its own, so that a batch that is run again replaces itself.

    A write that fails is tried again after 5, 25, 125 ... seconds, 600 at most.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        for n in range(1, tries + 1):
            try:
                batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
                return
            except PySparkException:
                if n == tries:
                    raise
                wait(min(5.0**n, 600.0))

    return write


def final_status(rows: DataFrame, key: str = "user_id") -> DataFrame:
    """(key, event_id, ts, done): the earliest row that is done, as nothing after it counts; else the latest.

    The result is again such rows, so a snapshot and the result of a stream (run it in update mode) can be united and put through
    once more: a snapshot that is read after the stream began closes the gap between the two, and rows that both have change nothing.
    A null in done is not done.
    """
    done, order = F.coalesce("done", F.lit(False)), F.struct("ts", "event_id")
    first, last = F.min(F.when(done, order)), F.max(F.when(~done, order))
    kept = rows.groupBy(key).agg(first.alias("first_done"), last.alias("last"))
    row = F.coalesce("first_done", "last")
    return kept.select(key, row["event_id"].alias("event_id"), row["ts"].alias("ts"), F.col("first_done").isNotNull().alias("done"))


def without_listed(read_list: Callable[[], DataFrame], key: str) -> Callable[[DataFrame], DataFrame]:
    """A step for `run_available`: drops the rows of a batch whose key is in a list that is read anew for each batch.

    A join of a stream with a table would keep the files that were there when the stream started. Null keys stay.
    """
    return lambda batch: batch.join(read_list().select(key), key, "left_anti").select(*batch.columns)


def run_available(stream: DataFrame, path: str, mode: str = "append", step: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Run a stream over all that is there, through the sink, and read what it wrote with the batch of each row.

    step, if given, is applied to each batch before it is written; it keeps the columns.
    """
    write = retrying_sink(f"{path}/rows")
    each = write if step is None else lambda batch, batch_id: write(step(batch), batch_id)
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").foreachBatch(each).trigger(availableNow=True).start()
    query.awaitTermination()
    schema = StructType([*stream.schema.fields, StructField("batch", LongType())])
    return stream.sparkSession.read.schema(schema).parquet(f"{path}/rows")
