"""Set operations that keep order, upserts and snapshots as set-based rewrites."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tagged_union(parts: dict[str, DataFrame], tag: str = "kind") -> DataFrame:
    """A union of frames of equal columns, with the name of each row's frame."""
    return reduce(DataFrame.unionByName, [df.withColumn(tag, F.lit(name)) for name, df in parts.items()])


def ordered_union(frames: Sequence[DataFrame], key: str, order: str) -> DataFrame:
    """Rows of all frames in frame order, then in `order`; of each key the first stays, with its new position `pos` within it."""
    rows = reduce(DataFrame.unionByName, [df.withColumn("_frame", F.lit(i)) for i, df in enumerate(frames)])
    first = F.row_number().over(Window.partitionBy(key).orderBy("_frame", order))
    return rows.withColumn("_n", first).where("_n = 1").drop("_n")


def ordered_except(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """df without the keys of other; positions stay as they are."""
    return df.join(other.select(key).distinct(), key, "left_anti")


def ordered_intersect(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return df.join(other.select(key).distinct(), key, "left_semi")


def upsert(stored: DataFrame, fresh: DataFrame, keys: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """The stored rows, with fresh ones in place of those of the same key. Of several fresh rows of a key the first in `order` counts."""
    if order:
        n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        fresh = fresh.withColumn("_n", n).where("_n = 1").drop("_n")
    return stored.join(fresh.select(*keys), list(keys), "left_anti").unionByName(fresh)


def versioned_upsert(stored: DataFrame, fresh: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """As upsert, but a fresh row counts only if its version is greater than the stored one, or nothing is stored."""
    old = stored.select(*keys, F.col(version).alias("_old"))
    newer = fresh.join(old, list(keys), "left").where(F.col("_old").isNull() | (F.col(version) > F.col("_old"))).drop("_old")
    return upsert(stored, newer, keys, [F.col(version).desc()])


def counted_upsert(stored: DataFrame, sent: DataFrame, key: str, version: str) -> DataFrame:
    """(key, version, updated): what is stored after `sent` (key, version).

    What isn't stored gets version 1; a version that isn't greater than the stored one changes nothing; without a version the stored one is counted up.
    """
    met = sent.select(key, F.col(version).alias("_new")).join(stored.select(key, F.col(version).alias("_old")), key, "full")
    conflict = F.col("_new").isNotNull() & (F.col("_new") <= F.col("_old"))
    out = F.when(F.col("_old").isNull(), F.lit(1)).when(conflict, F.col("_old")).otherwise(F.coalesce("_new", F.col("_old") + 1))
    return met.select(key, out.alias(version), (~F.coalesce(conflict, F.lit(False))).alias("updated"))


def null_aware_anti(df: DataFrame, other: DataFrame, column: str) -> DataFrame:
    """NOT IN with SQL's nulls: a null on the other side leaves no row, and a null here is kept only if the other side is empty.

    One aggregate over the other side tells which case holds; the rest is a plain anti join, which may shuffle.
    """
    rows, known = other.agg(F.count("*"), F.count(column)).first()
    if not rows:
        return df
    if known < rows:
        return df.where("false")
    return df.where(F.col(column).isNotNull()).join(other.select(column), column, "left_anti").select(*df.columns)


def snapshot_changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, change): keys that were added or removed between two snapshots."""
    a = before.select(key).distinct().withColumn("_a", F.lit(True))
    b = after.select(key).distinct().withColumn("_b", F.lit(True))
    both = a.join(b, key, "full")
    return both.where("_a IS NULL OR _b IS NULL").select(key, F.when(F.col("_a").isNull(), "added").otherwise("removed").alias("change"))


def demoted_versions(history: DataFrame, key: str, version: str, current: int = 1_000_000) -> DataFrame:
    """A type-2 history after its current rows are demoted: the current version becomes the largest other one plus one."""
    others = F.max(F.when(F.col(version) != current, F.col(version))).over(Window.partitionBy(key))
    return history.withColumn(version, F.when(F.col(version) == current, F.coalesce(others, F.lit(0)) + 1).otherwise(F.col(version)))


class FilteredCatalog:
    """Registers tables as views that hide discarded rows; the tables themselves get no name."""

    def __init__(self, discarded: str = "discarded_at"):
        self.discarded = discarded

    def register(self, name: str, df: DataFrame) -> None:
        df.createOrReplaceTempView(f"{name}_with_discarded")
        df.where(F.col(self.discarded).isNull()).createOrReplaceTempView(f"{name}_without_discarded")
