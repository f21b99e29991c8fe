"""Prefix joins as equi-joins: every string becomes its prefixes, and the longest that is a root wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_ROOTS = 500_000  #: roots that are broadcast, after a count; more are joined by a shuffle


def longest_prefix(df: DataFrame, column: str, roots: DataFrame, root: str, mode: str = "char") -> DataFrame:
    """df with `root`: the longest root that `column` starts with, or null.

    mode "char": roots end anywhere; only prefixes of lengths that some root has are tried. Mode "path": roots
    end where the string ends or before a slash. Each distinct string is matched once, so a
    string that repeats in many rows costs one match and a join by its value.
    """
    roots = roots.select(F.col(root).alias("_root")).where(F.col(root).isNotNull()).distinct()
    strings = df.select(F.col(column).alias("_string")).where(F.col(column).isNotNull()).distinct()
    if mode == "char":
        # a string's length bounds the number of distinct lengths
        lengths = sorted(r[0] for r in roots.select(F.length("_root")).distinct().collect())
        fits = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("_string"))
        tried = F.transform(fits, lambda n: F.substring(F.col("_string"), F.lit(1), n))
    elif mode == "path":
        parts = F.split("_string", "/")
        tried = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    else:
        raise ValueError("mode is char or path")
    few = roots.limit(MOST_ROOTS + 1).count() <= MOST_ROOTS
    met = strings.select("_string", F.explode(tried).alias("_root")).join(F.broadcast(roots) if few else roots, "_root")
    best = met.groupBy("_string").agg(F.max(F.struct(F.length("_root").alias("n"), "_root")).alias("_best"))
    return df.join(best, F.col(column) == F.col("_string"), "left").withColumn(root, F.col("_best._root")).drop("_string", "_best")
