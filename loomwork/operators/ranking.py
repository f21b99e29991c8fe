"""Caps and ranks within groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cap_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], most: int | Column) -> DataFrame:
    """The first `most` rows of each group in the given order; the order should end in a unique key.

    With a number, Spark prunes groups before the shuffle (WindowGroupLimit), so a hot group
    moves `most` rows of each task only.
    """
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", n).where(F.col("_place") <= most).drop("_place")


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return cap_per_group(df, keys, order, 1)


def mode_with_count(df: DataFrame, keys: Sequence[str], value: str, alias: str) -> DataFrame:
    """For each group its most frequent value as "value (count)"; of equal counts the least value."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    first = cap_per_group(counts, keys, [F.col("_n").desc(), F.col(value).asc()], 1)
    return first.select(*keys, F.concat(F.col(value).cast("string"), F.lit(" ("), F.col("_n").cast("string"), F.lit(")")).alias(alias))


def deduplicated(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Insertion-ordered set on a key: the first row of each key wins and keeps its position."""
    return cap_per_group(df, keys, order, 1)


def flagged_ends(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """df with is_first and is_last within each group."""
    up = Window.partitionBy(*keys).orderBy(*order)
    whole = Window.partitionBy(*keys)
    n = F.row_number().over(up)
    return df.withColumns({"is_first": n == 1, "is_last": n == F.count("*").over(whole)})


def head_middle_tail(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], ends: int = 5, most: int = 12) -> DataFrame:
    """df with `part`: "all" in groups of at most `most` rows, else head, middle or tail, with `ends` rows at either end."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    size = F.count("*").over(Window.partitionBy(*keys))
    part = F.when(size <= most, "all").when(n <= ends, "head").when(n > size - ends, "tail").otherwise("middle")
    return df.withColumn("part", part)


def collapsed_runs(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], value: str) -> DataFrame:
    """df with `run`: the number of value changes so far; neighbours of equal value share a run (nulls are equal)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    first = F.row_number().over(w) == 1
    changed = F.when(first | ~F.col(value).eqNullSafe(F.lag(value).over(w)), 1).otherwise(0)
    return df.withColumn("_c", changed).withColumn("run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_c")


def gap_filled_days(df: DataFrame, keys: Sequence[str], day: str) -> DataFrame:
    """(keys, day, has_rows): each day from a group's first to its last, however long a gap is."""
    days = df.select(*keys, day).where(F.col(day).isNotNull()).distinct()
    before = F.lag(day).over(Window.partitionBy(*keys).orderBy(day))
    start = F.coalesce(F.date_add(before, 1), F.col(day))
    return days.withColumn("_from", start).select(*keys, F.col(day).alias("_to"), F.explode(F.sequence("_from", F.col(day))).alias(day)).select(*keys, day, (F.col(day) == F.col("_to")).alias("has_rows"))
