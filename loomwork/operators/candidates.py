"""Candidate lists of posts: order checks, matches with a feed, date sources, titles, category covers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions.text import common_prefix


def order_flags(rows: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """(keys, is_ascending, is_descending, n) of each list; neighbours may be equal, nulls count as equal."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))
    steps = rows.select(*keys, F.col(value).alias("_v"), before.alias("_b"))
    holds = lambda c: F.bool_and(F.coalesce(c, F.lit(True)))
    return steps.groupBy(*keys).agg(holds(F.col("_v") >= F.col("_b")).alias("is_ascending"), holds(F.col("_v") <= F.col("_b")).alias("is_descending"), F.count("*").alias("n"))


def match_kinds(lists: DataFrame, feed: DataFrame, threshold) -> DataFrame:
    """(list, n_match, n_feed, kind): how a list (list, feed, key) relates to its feed (feed, key).

    all: every entry of the feed is in it; almost: at least threshold(n_feed) of them; else none.
    """
    sizes = feed.groupBy("feed").agg(F.count("*").alias("n_feed"))
    met = lists.select("list", "feed", "key").distinct().join(feed.select("feed", "key").distinct(), ["feed", "key"])
    counts = met.groupBy("list", "feed").agg(F.count("*").alias("n_match"))
    rows = lists.select("list", "feed").distinct().join(counts, ["list", "feed"], "left").join(sizes, "feed").withColumn("n_match", F.coalesce("n_match", F.lit(0)))
    kind = F.when(F.col("n_match") == F.col("n_feed"), "all").when(F.col("n_match") >= threshold(F.col("n_feed")), "almost").otherwise("none")
    return rows.select("list", "n_match", "n_feed", kind.alias("kind"))


def date_path(candidates: DataFrame) -> DataFrame:
    """(page_set, source, xpath): the one path whose dates can be used: the only one, else the only meta, else the only time."""
    n = lambda c: F.count_if(c)
    of = lambda s: F.min(F.when(F.col("source") == s, F.col("xpath")))
    sets_ = candidates.groupBy("page_set").agg(
        F.count("*").alias("n"), n(F.col("source") == "meta").alias("n_meta"), n(F.col("source") == "time").alias("n_time"),
        F.min("source").alias("s"), F.min("xpath").alias("x"), of("meta").alias("x_meta"), of("time").alias("x_time"),
    )
    pick = lambda one, meta, time: F.when(F.col("n") == 1, one).when(F.col("n_meta") == 1, meta).when(F.col("n_time") == 1, time)
    out = sets_.select("page_set", pick(F.col("s"), F.lit("meta"), F.lit("time")).alias("source"), pick(F.col("x"), F.col("x_meta"), F.col("x_time")).alias("xpath"))
    return out.where("source IS NOT NULL")


def best_titles(links: DataFrame, feed_titles: DataFrame, page_titles: DataFrame) -> DataFrame:
    """links (key, title) with missing titles from the feed, then from the page, then the key itself; all by key."""
    a = feed_titles.select("key", F.col("title").alias("_feed"))
    b = page_titles.select("key", F.col("title").alias("_page"))
    full = lambda c: F.nullif(c, F.lit(""))
    return links.join(a, "key", "left").join(b, "key", "left").select("key", F.coalesce(full(F.col("title")), full(F.col("_feed")), full(F.col("_page")), F.col("key").cast("string")).alias("title"))


#: Categories of a list that are broadcast at most; beyond that Spark deals out the pairs.
FEW = 1_000


def few(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if a count shows that it is small."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def covering_sets(bitmaps: DataFrame, goal: Column, size: int) -> DataFrame:
    """Combinations of `size` categories (2 or 3) whose bitmaps together have every bit of the goal; categories of one list are few."""
    bitmaps = few(bitmaps)
    side = lambda i: bitmaps.select(F.col("c").alias(f"c{i}"), F.col("bits").alias(f"b{i}"))
    out = side(1).join(side(2), F.col("c1") > F.col("c2"))
    covered = F.col("b1").bitwiseOR(F.col("b2"))
    if size == 3:
        out = out.join(side(3), F.col("c2") > F.col("c3"))
        covered = covered.bitwiseOR(F.col("b3"))
    return out.where(covered.bitwiseAND(goal) == goal).select(*[f"c{i}" for i in range(1, size + 1)])


def later_links(links: DataFrame, most: int = 10) -> DataFrame:
    """Links (page, url, depth, is_feed, class, from_start) worth following in later rounds.

    Feeds go; where more than `most` remain on a page, likely posts go; of the start page only links at the top stay.
    """
    kept = links.where("NOT is_feed").where("NOT from_start OR depth <= 1")
    counts = kept.groupBy("page").agg(F.count("*").alias("_n"))
    return kept.join(counts, "page").where((F.col("_n") <= most) | (F.col("class") != "post")).drop("_n")


def zone_labels(zones: DataFrame) -> DataFrame:
    """(zone, label) of zones (zone, name): the friendly name, with the city of the zone where several zones share it."""
    shared = zones.groupBy("name").agg(F.count("*").alias("_n"))
    city = F.replace(F.substring_index("zone", "/", -1), F.lit("_"), F.lit(" "))
    label = F.when(F.col("_n") > 1, F.concat("name", F.lit(" ("), city, F.lit(")"))).otherwise(F.col("name"))
    return zones.join(shared, "name").select("zone", label.alias("label"))


#: A feed of more entries is long; a multiple of the step looks cut off.
LONG_FEED, ROUND_STEP = 50, 100


def is_long_feed(n: Column) -> Column:
    """Does a feed of n entries seem to hold the whole history?"""
    return (n > LONG_FEED) & (n % ROUND_STEP != 0)


def title_ends(titles: DataFrame, groups: list[str], title: str = "title") -> DataFrame:
    """(groups, prefix, suffix): what all titles of a group begin and end with, so that it can be cut off.

    The ends of a set are those of its least and greatest member, of the reversed titles for the suffix: partial aggregates, whatever the
    size of a group. A suffix loses the ellipsis that it starts with. Both are empty if together they are as long (in bytes) as the
    shortest title, as for a single one. Null titles don't count; a group of them alone has empty ends.
    """
    bounds = titles.groupBy(*groups).agg(
        F.min(title).alias("low"), F.max(title).alias("high"), F.min(F.reverse(title)).alias("back_low"), F.max(F.reverse(title)).alias("back_high"),
        F.min(F.octet_length(title)).alias("shortest"),
    )
    ends = bounds.withColumns({"prefix": common_prefix(F.col("low"), F.col("high")), "suffix": F.reverse(common_prefix(F.col("back_low"), F.col("back_high")))})
    for ellipsis in ("...", "…"):
        ends = ends.withColumn("suffix", F.when(F.startswith("suffix", F.lit(ellipsis)), F.substring("suffix", len(ellipsis) + 1, 1 << 30)).otherwise(F.col("suffix")))
    apart = F.octet_length("prefix") + F.octet_length("suffix") < F.col("shortest")
    return ends.select(*groups, *[F.when(apart, F.col(c)).otherwise("").alias(c) for c in ("prefix", "suffix")])


def extraction_records(links: DataFrame, dated: DataFrame, feed: DataFrame, threshold: Callable[[Column], Column]) -> DataFrame:
    """(list, n_links, n_kept, has_duplicates, n_url_days, dates, is_sorted, is_reverse_sorted): what each list of links is, before it is held against its feed.

    links (list, stars, pos, key, day, url_day): of one masked path, with the dates beside the links and in their addresses. dated (list): lists whose links share a path to dates. feed (list, key): entries of the list's feed.
    Equal links in a row are one, with the first one's date. Of a dated list with more than threshold(its feed's length) of the feed's entries only links with a date are kept; of another one dates count if every link has one.
    dates: `all` where the list has the whole feed, `almost` where it has threshold many of it, else `some`; null without dates. Whether dates fall or rise all along is asked with two stars and more; with one the
    order of the links is trusted (null). n_links is the number after runs are one. A feed without entries is had by every list; a list without a feed likewise.
    """
    order = Window.partitionBy("list").orderBy("pos")
    runs = links.withColumn("_before", F.lag(F.struct("key")).over(order)).where(F.col("_before").isNull() | ~F.col("_before.key").eqNullSafe(F.col("key"))).drop("_before")
    # a feed's entries are an array beside its list, so everything goes by list: inputs that are dealt by list are not shuffled again
    entries = feed.groupBy("list").agg(F.collect_set("key").alias("_entries"), F.bool_or(F.col("key").isNull()).cast("int").alias("_null"))
    of = runs.groupBy("list").agg(F.count("*").alias("n_links"), F.bool_and(F.col("day").isNotNull()).alias("_whole"), F.collect_set("key").alias("_keys"))
    facts = of.join(entries, "list", "left").join(dated.select("list").distinct().withColumn("_dated", F.lit(True)), "list", "left")
    facts = facts.withColumns({"_feed": F.size("_entries") + F.col("_null"), "_met": F.size(F.array_intersect("_keys", "_entries"))}).fillna(0, ["_feed", "_met"]).fillna(False, ["_dated"])
    enough = threshold(F.col("_feed"))
    filtered = F.col("_dated") & (F.col("_met") > enough)
    facts = facts.select("list", "n_links", filtered.alias("_filtered"), F.when(filtered | (F.col("_dated") & F.col("_whole")), F.when(F.col("_met") == F.col("_feed"), "all").when(F.col("_met") >= enough, "almost").otherwise("some")).alias("dates"))
    kept = runs.join(facts, "list").where(~F.col("_filtered") | F.col("day").isNotNull())
    kept = kept.withColumns({"_last": F.lag("day").over(order), "_nth": F.row_number().over(Window.partitionBy("list", "key").orderBy("pos"))})
    asked = F.col("dates").isNotNull() & (F.col("stars") >= 2)
    holds = lambda c: F.bool_and(F.when(asked, F.coalesce(c, F.lit(True))))
    found = kept.groupBy("list").agg(
        F.count("*").alias("n_kept"), F.coalesce(F.bool_or(F.col("_nth") > 1), F.lit(False)).alias("has_duplicates"), F.count("url_day").alias("n_url_days"),
        holds(F.col("_last") >= F.col("day")).alias("is_sorted"), holds(F.col("_last") <= F.col("day")).alias("is_reverse_sorted"),
    )
    out = facts.join(found, "list", "left").fillna(0, ["n_kept", "n_url_days"]).fillna(False, ["has_duplicates"])
    return out.select("list", "n_links", "n_kept", "has_duplicates", "n_url_days", "dates", "is_sorted", "is_reverse_sorted")
