"""Sequence algebra on feeds: ordered lists whose entries of equal time form unordered buckets.

A feed is rows (feed, pos, key, at): position from 0, the link's key, its time or null. A list is
rows (feed, pos, key). All operators work on every feed at once, by joins and windows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucketed(feed: DataFrame) -> DataFrame:
    """feed with bucket (from 0) and is_order_certain: neighbours of equal time share a bucket if all entries have a time, else each entry is one."""
    w = Window.partitionBy("feed").orderBy("pos")
    dated = F.count_if(F.col("at").isNull()).over(Window.partitionBy("feed")) == 0
    new = F.when((F.row_number().over(w) > 1) & dated & F.col("at").eqNullSafe(F.lag("at").over(w)), 0).otherwise(1)
    rows = feed.withColumns({"is_order_certain": dated, "_new": new})
    return rows.withColumn("bucket", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_new")


def reversed_if_ascending(feed: DataFrame) -> DataFrame:
    """Newest first: an ascending feed is turned, one of equal times as well, an unsorted one sorted (stable); a feed with missing times or fewer than two entries stays."""
    w = Window.partitionBy("feed").orderBy("pos")
    before = F.lag("at").over(w)
    whole = Window.partitionBy("feed")
    rows = feed.withColumns({"_up": F.col("at") >= before, "_down": F.col("at") <= before})
    rows = rows.withColumns({
        "_dated": F.count_if(F.col("at").isNull()).over(whole) == 0,
        "_n": F.count("*").over(whole),
        "_all_up": F.bool_and(F.coalesce("_up", F.lit(True))).over(whole),
        "_all_down": F.bool_and(F.coalesce("_down", F.lit(True))).over(whole),
    })
    kept = ~F.col("_dated") | (F.col("_n") < 2) | (F.col("_all_down") & ~F.col("_all_up"))
    seconds = F.unix_micros(F.col("at").cast("timestamp"))
    main = F.when(kept, F.lit(0)).when(F.col("_all_up"), F.lit(0)).otherwise(-seconds)
    then = F.when(kept, F.col("pos")).when(F.col("_all_up"), -F.col("pos")).otherwise(F.col("pos"))
    out = rows.withColumns({"_a": main, "_b": then})
    return out.withColumn("pos", F.row_number().over(Window.partitionBy("feed").orderBy("_a", "_b")) - 1).select(*feed.columns)


def included(feed: DataFrame, keys: DataFrame) -> DataFrame:
    """feed with in_set: is the key among keys (feed, key)?"""
    known = keys.select("feed", "key").distinct().withColumn("in_set", F.lit(True))
    return feed.join(known, ["feed", "key"], "left").withColumn("in_set", F.coalesce("in_set", F.lit(False)))


def included_counts(feed: DataFrame, keys: DataFrame) -> DataFrame:
    """(feed, n, n_in, all_in)."""
    return included(feed, keys).groupBy("feed").agg(F.count("*").alias("n"), F.count_if("in_set").alias("n_in"), F.bool_and("in_set").alias("all_in"))


def included_prefix(feed: DataFrame, keys: DataFrame) -> DataFrame:
    """(feed, length): entries in the set before the first incomplete bucket and in it."""
    buckets = included(bucketed(feed), keys).groupBy("feed", "bucket").agg(F.count("*").alias("n"), F.count_if("in_set").alias("k"))
    before = Window.partitionBy("feed").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    open_ = F.coalesce(F.bool_and(F.col("n") == F.col("k")).over(before), F.lit(True))
    return buckets.withColumn("_open", open_).groupBy("feed").agg(F.coalesce(F.sum(F.when(F.col("_open"), F.col("k"))), F.lit(0)).alias("length"))


def sequence_matches(feed: DataFrame, listed: DataFrame, offset: DataFrame | None = None) -> DataFrame:
    """(feed, matches): does the list, laid at `offset` (feed, offset; default 0), match the feed?

    Within a bucket any order matches; what of the list lies beyond the feed's end isn't compared. Each place of the
    feed is in a bucket, so the list's keys at the places of one bucket must be keys of it, once each.
    """
    places = bucketed(feed).select("feed", "pos", "bucket", "key")
    rows = listed.select("feed", F.col("pos").alias("_i"), F.col("key").alias("_key"))
    if offset is not None:
        rows = rows.join(offset, "feed").withColumn("_at", F.col("_i") + F.col("offset")).drop("offset")
    else:
        rows = rows.withColumn("_at", F.col("_i"))
    at = rows.join(places.select("feed", F.col("pos").alias("_at"), F.col("bucket").alias("_bucket")), ["feed", "_at"])
    # the n-th mention of a key in a bucket meets the n-th entry of that key there
    at = at.withColumn("_m", F.row_number().over(Window.partitionBy("feed", "_bucket", "_key").orderBy("_i")))
    own = places.withColumn("_m", F.row_number().over(Window.partitionBy("feed", "bucket", "key").orderBy("pos")))
    own = own.select("feed", F.col("bucket").alias("_bucket"), F.col("key").alias("_key"), "_m", F.lit(True).alias("_hit"))
    met = at.join(own, ["feed", "_bucket", "_key", "_m"], "left")
    found = met.groupBy("feed").agg(F.bool_and(F.coalesce("_hit", F.lit(False))).alias("matches"))
    return listed.select("feed").distinct().join(found, "feed", "left").select("feed", F.coalesce("matches", F.lit(True)).alias("matches"))


def suffix_match(feed: DataFrame, listed: DataFrame) -> DataFrame:
    """(feed, prefix_length, suffix_length): the feed's end that the list begins with; no row without a match.

    The list's first key marks where the suffix begins: it may begin anywhere in that key's bucket, if the entries of the
    bucket that come before it aren't in the list. Feeds and lists are gathered by feed, once each, as in feed_diff.
    """
    seen, known = _listed(feed, "seen", "pos", "key", "at"), _listed(listed, "known", "pos", "key")

    def length(keys: Column) -> Column:  # a null key is no entry of a list
        fits = lambda s: F.when(laid(s, keys) & ~F.exists(s, lambda e: e["key"].isNull()), F.array(F.size(s).cast("long")))
        return let(_suffix(F.col("seen"), keys), fits)

    found = let(F.transform("known", lambda e: e["key"]), length)
    out = seen.join(known, "feed").select("feed", F.size("seen").alias("n"), F.explode(found).alias("suffix_length"))
    return out.select("feed", (F.col("n") - F.col("suffix_length")).alias("prefix_length"), "suffix_length")


def match_except_first(feed: DataFrame, listed: DataFrame) -> DataFrame:
    """(feed, first_key): the list matches the feed from its second entry on; first_key is the entry of the first bucket that the list lacks."""
    n = listed.groupBy("feed").agg(F.lit(1).alias("offset"))
    ok = sequence_matches(feed, listed, n).where("matches").select("feed")
    firsts = bucketed(feed).where("bucket = 0").join(listed.select("feed", "key"), ["feed", "key"], "left_anti")
    only = firsts.groupBy("feed").agg(F.count("*").alias("k"), F.min("key").alias("first_key")).where("k = 1")
    return only.join(ok, "feed", "left_semi").select("feed", "first_key")


def lists_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """(feed, equal): position-wise equality of two lists."""
    both = a.select("feed", "pos", F.col("key").alias("_a")).join(b.select("feed", "pos", F.col("key").alias("_b")), ["feed", "pos"], "full")
    return both.groupBy("feed").agg(F.bool_and(F.col("_a").eqNullSafe(F.col("_b"))).alias("equal"))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _listed(rows: DataFrame, name: str, *fields: str) -> DataFrame:
    """(feed, name): each feed's entries as an array, by position."""
    return rows.groupBy("feed").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))


def _runs(entries: Column) -> Column:
    """For each entry the number of its bucket: neighbours of equal time share one, if all have a time."""
    dated = F.forall(entries, lambda e: e["at"].isNotNull())

    def step(acc: Column, e: Column) -> Column:
        same = dated & acc["at"].eqNullSafe(e["at"]) & (F.size(acc["runs"]) > 0)
        now = F.when(same, acc["run"]).otherwise(acc["run"] + 1)
        return F.struct(now.alias("run"), e["at"].alias("at"), F.concat(acc["runs"], F.array(now)).alias("runs"))

    start = F.struct(F.lit(-1).alias("run"), F.lit(None).cast("timestamp_ntz").alias("at"), F.array().cast("array<int>").alias("runs"))
    return F.aggregate(entries, start, step, lambda acc: acc["runs"])


def _suffix(seen: Column, known: Column) -> Column:
    """The feed's end that the list may begin with: what comes after the first bucket with the list's first key, and what the list has of that bucket."""

    def of(runs: Column) -> Column:
        numbered = F.zip_with(seen, runs, lambda e, r: F.struct(e["key"].alias("key"), e["at"].alias("at"), r.alias("run")))
        start = F.array_min(F.transform(F.filter(numbered, lambda e: e["key"] == F.get(known, F.lit(0))), lambda e: e["run"]))
        return F.filter(numbered, lambda e: (e["run"] > start) | ((e["run"] == start) & F.array_contains(known, e["key"])))

    return let(_runs(seen), of)


def laid(suffix: Column, known: Column) -> Column:
    """Does the list, laid at the suffix's begin, have in each bucket the keys of that bucket, once each?"""

    def of(runs: Column) -> Column:
        own = F.zip_with(suffix, runs, lambda e, r: F.struct(r.alias("r"), e["key"].alias("k")))
        other = F.zip_with(F.slice(known, 1, F.size(suffix)), runs, lambda k, r: F.struct(r.alias("r"), k.alias("k")))
        return F.array_sort(own) == F.array_sort(other)

    return (F.size(suffix) > 0) & (F.size(known) >= F.size(suffix)) & let(_runs(suffix), of)


def feed_diff(feed: DataFrame, existing: DataFrame, discarded: DataFrame, missing: DataFrame, least_overlap: int = 3) -> DataFrame:
    """(feed, status, key, pos): new entries of each feed against the posts known before.

    Known posts that are `missing` from the feed and feed entries that were `discarded` don't count. No
    new entry: status ok without key. An overlap under least_overlap, a feed whose end isn't the known list, or an
    overlap that isn't all of that end: status no_match. Else a row for each new entry, in feed order.

    A feed has tens to hundreds of entries: each input is shuffled once by feed and gathered there, and the rest are array functions.
    """
    keys = lambda rows, name: rows.groupBy("feed").agg(F.collect_set("key").alias(name))
    none = lambda name, kind: F.coalesce(name, F.array().cast(kind)).alias(name)
    kind = f"array<{dict(feed.dtypes)['key']}>"
    listed = _listed(feed, "seen", "pos", "key", "at").join(_listed(existing, "known", "pos", "key"), "feed", "left")
    listed = listed.join(keys(discarded, "gone"), "feed", "left").join(keys(missing, "lost"), "feed", "left")
    listed = listed.select("feed", "seen", F.transform("known", lambda e: e["key"]).alias("known"), none("gone", kind), none("lost", kind)).select("feed", "seen", none("known", kind), "gone", "lost")
    rows = listed.select(
        "feed", F.filter("seen", lambda e: ~F.array_contains("gone", e["key"])).alias("seen"), F.filter("known", lambda k: ~F.array_contains("lost", k)).alias("known")
    ).where(F.size("seen") > 0)
    rows = rows.select("feed", "seen", "known", F.filter("seen", lambda e: ~F.array_contains("known", e["key"])).alias("fresh"))
    overlap = F.size("seen") - F.size("fresh")
    matches = let(_suffix(F.col("seen"), F.col("known")), lambda s: (F.size(s) == overlap) & laid(s, F.col("known")))
    status = F.when(F.size("fresh") == 0, "ok").when((overlap < least_overlap) | ~F.coalesce(matches, F.lit(False)), "no_match").otherwise("new")
    state = rows.select("feed", status.alias("status"), F.transform("fresh", lambda e: e["key"].cast("string")).alias("fresh"))
    shown = F.when(F.col("status") == "new", F.col("fresh")).otherwise(F.array(F.lit(None).cast("string")))
    out = state.select("feed", "status", F.posexplode(shown).alias("pos", "key"))
    return out.select("feed", F.when(F.col("status") == "new", "ok").otherwise(F.col("status")).alias("status"), "key", F.when(F.col("key").isNotNull(), F.col("pos")).alias("pos"))


def appended(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """fresh (feed, key, pos; newest first) with `index` continuing after the stored maximum (feed, index), oldest first."""
    last = stored.groupBy("feed").agg(F.max("index").alias("_last"))
    n = F.row_number().over(Window.partitionBy("feed").orderBy(F.desc("pos")))
    return fresh.withColumn("_n", n).join(last, "feed", "left").select("feed", "key", (F.coalesce("_last", F.lit(-1)) + F.col("_n")).cast("long").alias("index"))
