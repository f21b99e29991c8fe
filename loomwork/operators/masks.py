"""XPath masks: links that share a path but for one to three indices form a group.

A link is a row (page, pos, url, xpath); the trie of a tree walk isn't needed once masks are strings to join on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def segments(xpath: Column) -> Column:
    """The steps of /a[1]/b[2] as an array."""
    return F.filter(F.split(xpath, "/"), lambda s: s != "")


def masked(parts: Column, *places: Column) -> Column:
    """The path with [*] for the index of the steps at these places (from 1)."""
    star = lambda s, i: F.when(F.array_contains(F.array(*places), i + 1), F.regexp_replace(s, r"\[\d+\]$", "[*]")).otherwise(s)
    return F.concat(F.lit("/"), F.array_join(F.transform(parts, star), "/"))


def masks(parts: Column, stars: int) -> Column:
    """All masks of a path with so many stars, places ascending."""
    n = F.size(parts)
    up = lambda a: F.when(a <= n, F.sequence(a, n)).otherwise(F.array().cast("array<int>"))
    if stars == 1:
        return F.transform(up(F.lit(1)), lambda a: masked(parts, a))
    if stars == 2:
        return F.flatten(F.transform(up(F.lit(1)), lambda a: F.transform(up(a + 1), lambda b: masked(parts, a, b))))
    if stars == 3:
        inner = lambda a: F.flatten(F.transform(up(a + 1), lambda b: F.transform(up(b + 1), lambda c: masked(parts, a, b, c))))
        return F.flatten(F.transform(up(F.lit(1)), inner))
    raise ValueError("one to three stars")


def mask_groups(links: DataFrame, feed: DataFrame, stars: int = 1) -> DataFrame:
    """(page, mask, n_links, n_feed): groups of links under one mask.

    Only masks of links to entries of the feed (page, url) are tried; a group needs two distinct urls. A page's entries of the feed
    are an array beside its links, so everything goes by page: inputs that are dealt by page are not shuffled again, and no mask is.
    """
    known = feed.groupBy("page").agg(F.collect_set("url").alias("_feed"))
    flagged = links.join(known, "page").withColumn("in_feed", F.coalesce(F.array_contains("_feed", F.col("url")), F.lit(False)).cast("int"))
    rows = flagged.select("page", "url", "in_feed", F.explode(masks(segments(F.col("xpath")), stars)).alias("mask"))
    urls = rows.groupBy("page", "mask", "url").agg(F.max("in_feed").alias("in_feed"))
    groups = urls.groupBy("page", "mask").agg(F.count("*").alias("n_links"), F.sum("in_feed").alias("n_feed"))
    return groups.where("n_links > 1 AND n_feed > 0")


def ranked_groups(groups: DataFrame) -> DataFrame:
    """Groups with `place` within the page: more feed entries first, then more links, then the mask."""
    from pyspark.sql import Window

    w = Window.partitionBy("page").orderBy(F.desc("n_feed"), F.desc("n_links"), "mask")
    return groups.withColumn("place", F.row_number().over(w))
