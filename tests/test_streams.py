"""Stateful streams over several batches: evicted, retried and dead keys."""

import datetime as dt

from pyspark.sql import functions as F

from loomwork.streaming import events as E

T0 = dt.datetime(2024, 1, 1)


def batches(spark, folder, parts):
    for n, rows in enumerate(parts):
        frame = spark.createDataFrame([(i, T0 + dt.timedelta(seconds=s), user, kind, 1.0, "") for i, s, user, kind in rows], E.SCHEMA)
        frame.coalesce(1).write.parquet(f"{folder}/made-{n}")
        (one,) = [p for p in (folder / f"made-{n}").iterdir() if p.name.startswith("part-")]
        (folder / "in").mkdir(exist_ok=True)
        one.rename(folder / "in" / f"{n}.parquet")
    return E.read_events(spark, f"file://{folder}/in", "*.parquet", files_per_batch=1)


def test_epochs_over_batches(spark, tmp_path):
    parts = [[(1, 0, 7, "a"), (2, 10, 7, "a"), (3, 5, 8, "a")], [(4, 25, 7, "a"), (5, 2000, 9, "a")], [(6, 2100, 7, "a"), (7, 2101, 9, "a")]]
    rows = E.run_available(E.epochs(batches(spark, tmp_path, parts)), f"file://{tmp_path}/out", "update").collect()
    got = sorted((r.user_id, r.evicted, r.epoch, -1 if r.seconds is None else r.seconds) for r in rows)
    assert got == [(7, False, 1, -1), (7, False, 1, -1), (7, False, 2, 10), (7, False, 3, 15), (7, True, 3, -1), (8, False, 1, -1), (8, True, 1, -1), (9, False, 1, -1), (9, False, 2, 101)]


def test_retries_over_batches(spark, tmp_path):
    parts = [[(1, 0, 7, "error"), (2, 1, 7, "error"), (3, 2, 8, "error")], [(4, 3, 7, "error"), (5, 4, 8, "ok"), (6, 5, 8, "error")], [(7, 6, 7, "ok")]]
    tries = batches(spark, tmp_path, parts).select("user_id", "event_id", "ts", (F.col("event_type") != "error").alias("ok"))
    rows = E.run_available(E.retried(tries, 3), f"file://{tmp_path}/out").collect()
    assert sorted((r.user_id, r.event_id, r.attempts, r.status, r.delay) for r in rows) == [(7, 1, 1, "retry", 6), (7, 2, 2, "retry", 21), (7, 4, 3, "failed", None), (8, 3, 1, "retry", 6), (8, 5, 2, "done", None), (8, 6, 1, "retry", 6)]
