"""Calendar functions: local dates, next runs, retry delays. Every function takes `now` as a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARLY_MORNING_HOUR = 5
RUN_AFTER_MIDNIGHT = "INTERVAL 2 HOURS"


def local(ts: Column, zone: Column | str) -> Column:
    """A UTC time (timestamp_ntz) as the wall-clock time of a zone."""
    zone = F.lit(zone) if isinstance(zone, str) else zone
    return F.convert_timezone(F.lit("UTC"), zone, ts)


def to_utc(ts: Column, zone: Column | str) -> Column:
    zone = F.lit(zone) if isinstance(zone, str) else zone
    return F.convert_timezone(zone, F.lit("UTC"), ts)


def local_date(ts: Column, zone: Column | str) -> Column:
    return F.to_date(local(ts, zone))


def day_of_week(day: Column) -> Column:
    """sun, mon, ... sat."""
    return F.lower(F.date_format(day, "E"))


def is_early_morning(ts: Column, zone: Column | str) -> Column:
    return F.hour(local(ts, zone)) < EARLY_MORNING_HOUR


def run_time(day: Column, zone: Column | str) -> Column:
    """The UTC time of a local day's run: local midnight and two hours of absolute time."""
    return to_utc(day.cast("timestamp_ntz"), zone) + F.expr(RUN_AFTER_MIDNIGHT)


def next_run(day: Column, zone: Column | str, now: Column) -> Column:
    """struct(run_at, day, skipped): the first run after `day` that isn't over at `now`, and how many days were skipped.

    The run of the local day of two hours before `now`, or one soon after it, is the first that isn't over; so a
    few days are tried, however long ago `day` was.
    """
    base = F.greatest(F.date_add(day, 1), local_date(now - F.expr(RUN_AFTER_MIDNIGHT), zone))
    left = F.filter(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.date_add(base, i)), lambda d: run_time(d, zone) >= now)
    first = F.get(left, F.lit(0))
    return F.struct(run_time(first, zone).alias("run_at"), first.alias("day"), (F.datediff(first, day) - 1).alias("skipped"))


def realistic_date(scheduled: Column, now: Column, zone: Column | str) -> Column:
    """Not scheduled: today in the early morning, else tomorrow; scheduled for the past: today; else as scheduled."""
    today = local_date(now, zone)
    return F.when(scheduled.isNull(), F.when(is_early_morning(now, zone), today).otherwise(F.date_add(today, 1))).when(scheduled < today, today).otherwise(scheduled)


def retry_delay(attempts: Column) -> Column:
    """Seconds until a failed job runs again."""
    return (F.pow(attempts, F.lit(4)) + 5).cast("long")


def backoff(n: Column) -> Column:
    """Seconds before the n-th try to write again."""
    return F.least(F.pow(F.lit(5.0), n), F.lit(600.0)).cast("long")


def rfc1123z(ts: Column) -> Column:
    """Mon, 02 Jan 2006 15:04:05 +0000 of a UTC time."""
    return F.concat(F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000"))


def parse_rfc1123(text: Column) -> Column:
    """A UTC time from RFC 1123 text with a numeric or GMT zone; null if it isn't one."""
    rest = F.regexp_replace(text, r"^[A-Za-z]{3}, ", "")
    rest = F.regexp_replace(rest, r" (?:GMT|UTC|Z)$", " +0000")
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.try_to_timestamp(rest, F.lit("d MMM yyyy HH:mm:ss Z")).cast("timestamp_ntz"))


def parse_iso8601(text: Column) -> Column:
    """A UTC time from ISO 8601 text in three layouts: with an offset, with Z, date only."""
    tries = [F.try_to_timestamp(text, F.lit(p)) for p in ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd")]
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.coalesce(*tries).cast("timestamp_ntz"))
