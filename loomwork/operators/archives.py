"""Matching whole lists of links with feeds: which list on a page is the archive, and how it relates to the feed.

lists: list, feed, pos, key, day (null: unknown). feed: feed, pos, key, at. A list has the whole history and a feed its newest part, so
a list matches where it begins with the feed. Every list meets its feed once, by an equi-join on the feed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.operators import sequences as Q
from loomwork.operators.ranking import cap_per_group

#: How lists may match, the more certain first.
KINDS = ("sorted", "reverse", "by_date", "except_first", "pinned")


def _matches(lists: DataFrame, feed: DataFrame) -> DataFrame:
    """(list, feed, kind, n), as archive_matches. A list is as long as a page and a feed as a document: each is shuffled once and gathered, and the kinds are told apart by array functions."""
    listed = lists.groupBy("list", "feed").agg(F.array_sort(F.collect_list(F.struct("pos", "key", "day"))).alias("_l"))
    newest = feed.groupBy("feed").agg(F.array_sort(F.collect_list(F.struct("pos", "key", F.col("at").cast("timestamp_ntz").alias("at")))).alias("_f"))
    rows = listed.join(newest, "feed").select("list", "feed", "_l", "_f", F.transform("_l", lambda e: e["key"]).alias("_keys"), F.transform("_f", lambda e: e["key"]).alias("_known"))
    by_day = F.transform(F.reverse(F.array_sort(F.transform("_l", lambda e: F.struct(e["day"].alias("d"), (-e["pos"]).alias("p"), e["key"].alias("key"))))), lambda e: e["key"])
    dated = F.forall("_l", lambda e: e["day"].isNotNull())
    # what the list lacks of the feed, if that is one entry, and the feed without it
    rows = rows.withColumn("_lost", F.array_except("_known", "_keys"))
    rows = rows.withColumns({
        "_rest": F.filter("_f", lambda e: e["key"] != F.get("_lost", F.lit(0))),
        "_at": F.array_position("_known", F.get("_lost", F.lit(0))),
    })
    lacks_one = (F.size("_lost") == 1) & (F.size("_rest") == F.size("_f") - 1)
    fits = lacks_one & ((F.size("_rest") == 0) | Q.laid(F.col("_rest"), F.col("_keys")))
    holds = {
        "sorted": Q.laid(F.col("_f"), F.col("_keys")),
        "reverse": Q.laid(F.col("_f"), F.reverse("_keys")),
        "by_date": dated & Q.laid(F.col("_f"), by_day),
        "except_first": fits & (F.col("_at") == 1),
        "pinned": fits & (F.col("_at") > 1),
    }
    kinds = F.array_compact(F.array(*[F.when(holds[k], F.lit(k)) for k in KINDS]))
    return rows.select("list", "feed", F.explode(kinds).alias("kind"), F.size("_l").cast("long").alias("n"))


def archive_matches(lists: DataFrame, feed: DataFrame) -> DataFrame:
    """(list, kind, n): each way in which a list matches its feed, with the list's length.

    sorted, reverse, by_date (where all its links have one; equal dates as they stand): the list so ordered begins with the feed. except_first: the list has all but the feed's newest entry, and begins with the rest; pinned: it lacks exactly one
    other entry and begins with the rest.
    """
    return _matches(lists, feed).select("list", "kind", "n")


def best_archives(lists: DataFrame, feed: DataFrame) -> DataFrame:
    """(feed, list, kind, n): of each feed the longest list that matches; of equal ones the more certain kind, then the least list.

    That is what trying the kinds in order gives, where each must beat the length found before.
    """
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    return cap_per_group(_matches(lists, feed), ["feed"], [F.desc("n"), order, "list"], 1).select("feed", "list", "kind", "n")


def two_part_lists(heads: DataFrame, lists: DataFrame, feed: DataFrame) -> DataFrame:
    """(list, n): lists that match their feed after the links of a head group (list, pos, key) of the same page, the two without overlap."""
    overlap = heads.select("list", "key").join(lists.select("list", "key"), ["list", "key"], "left_semi").select("list").distinct()
    sizes = heads.groupBy("list").agg(F.count("*").alias("_n"))
    moved = lists.join(sizes, "list").withColumn("pos", F.col("pos") + F.col("_n")).drop("_n")
    feeds = lists.select("list", "feed").distinct()
    both = moved.unionByName(heads.join(feeds, "list").select("list", "feed", "pos", "key", F.lit(None).cast(dict(lists.dtypes)["day"]).alias("day"))).join(overlap, "list", "left_anti")
    return archive_matches(both, feed).where("kind = 'sorted'").select("list", "n")


#: So many entries of a feed that are all on a page may be its whole history; the numbers of stars of masked paths.
LONG_FEED, STARS = 31, (1, 2, 3)


def _longest(lists: Column, fits: Callable[[Column], Column], none: Column) -> Column:
    """Of the lists that fit the one that has more links than the distinct links of the best before it."""
    return F.aggregate(F.filter(lists, fits), none, lambda best, x: F.when(best.isNull() | (x["n"] > best["n_distinct"]), x).otherwise(best))


def unordered_matches(lists: DataFrame, feed: DataFrame, on_page: DataFrame, known: DataFrame, threshold: Callable[[Column], Column]) -> DataFrame:
    """(page, seq, kind, stars, list, n): what a page shows of its feed where no list is in the feed's order; one row of kind `none` for a page without any.

    lists (page, stars, list, pos, key): links that share a masked path of so many stars, lists numbered in their order on the page. feed (page, key): of the page's blog. on_page (page, key): all links of the page. known (page, n, dated):
    the ordered history found on the page before, if any; what follows must be longer, so the least length grows from step to step. In this order:
    `almost_feed`: a list shorter than the feed, of its entries only and of at least threshold(its length) of them; the feed itself is then the history; of the fewest stars that have one, the longest. `shuffled`: for each
    number of stars the longest list with all entries of the feed, in any order. `shuffled_almost`: with at least threshold(its length) of them, but not all. `long_feed`: LONG_FEED entries or more, all on the
    page. A history by dates leaves out both shuffled kinds. n is the number of distinct links, of a feed that of its entries; list is null for feeds. A list's repeated links count towards its own length, and null keys for nothing.
    """
    entries = feed.where("key IS NOT NULL").select("page", "key").distinct()
    rows = lists.where("key IS NOT NULL").groupBy("page", "stars", "list", "key").agg(F.count("*").alias("_times")).join(entries.withColumn("_in", F.lit(1)), ["page", "key"], "left")
    sizes = rows.groupBy("page", "stars", "list").agg(F.sum("_times").alias("n"), F.count("*").alias("n_distinct"), F.count("_in").alias("n_in"))
    # as many lists as a page has paths
    gathered = sizes.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("stars", "list", "n", "n_distinct", "n_in"))).alias("_lists"))
    shown = on_page.select("page", "key").distinct().join(entries, ["page", "key"], "left_semi").groupBy("page").agg(F.count("*").alias("_shown"))
    feeds = entries.groupBy("page").agg(F.count("*").alias("_feed"))
    pages = on_page.select("page").union(lists.select("page")).distinct()
    at = pages.join(feeds, "page", "left").join(gathered, "page", "left").join(shown, "page", "left").join(known.select("page", F.col("n").alias("_known"), "dated"), "page", "left")
    none_of = "array<struct<stars:int,list:long,n:bigint,n_distinct:bigint,n_in:bigint>>"
    at = at.select("page", F.coalesce("_feed", F.lit(0)).alias("_feed"), F.coalesce(F.col("_lists").cast(none_of), F.array().cast(none_of)).alias("_lists"), F.coalesce("_shown", F.lit(0)).alias("_shown"), (F.coalesce("_known", F.lit(0)) + 1).alias("_least"), F.coalesce("dated", F.lit(False)).alias("_dated"))
    at = at.withColumn("_enough", threshold(F.col("_feed")))
    none, kinds = F.get(F.filter("_lists", lambda x: F.lit(False)), F.lit(0)), []
    found = lambda column, kind, stars, n: F.when(F.col(column).isNotNull(), F.struct(F.lit(kind).alias("kind"), stars.alias("stars"), F.col(column)["list"].alias("list"), n.alias("n")))

    almost = lambda x: (x["n"] < F.col("_feed")) & (x["n"] >= F.col("_enough")) & (x["n_in"] >= F.col("_enough")) & (x["n_in"] == x["n_distinct"])
    long_enough = lambda x: (x["n"] >= F.col("_feed")) & (x["n"] >= F.col("_least")) & ~F.col("_dated")

    def starred(k: int) -> Callable[[Column], Column]:
        return lambda x: x["stars"] == k

    first = None
    for k in STARS:
        best = _longest(F.filter("_lists", starred(k)), almost, none)
        first = best if first is None else F.coalesce(first, best)
    at = at.withColumn("_almost", F.when((F.col("_feed") > 0) & (F.col("_feed") >= F.col("_least")), first))
    at = at.withColumn("_least", F.when(F.col("_almost").isNotNull(), F.col("_feed") + 1).otherwise(F.col("_least")))
    at = at.withColumn("_dated", F.col("_dated") & F.col("_almost").isNull())  # the last history found is the one that has dates or not
    kinds.append(found("_almost", "almost_feed", F.col("_almost")["stars"], F.col("_feed")))
    whole = lambda x: (F.col("_feed") > 0) & (x["n_in"] == F.col("_feed"))
    some = lambda x: (F.col("_feed") > 0) & (x["n_in"] < F.col("_feed")) & (x["n_in"] >= F.col("_enough"))
    for kind, has in (("shuffled", whole), ("shuffled_almost", some)):
        for k in STARS:
            name = f"_{kind}{k}"
            at = at.withColumn(name, _longest(F.filter(F.filter("_lists", starred(k)), has), long_enough, none))
            at = at.withColumn("_least", F.when(F.col(name).isNotNull(), F.col(name)["n_distinct"] + 1).otherwise(F.col("_least")))
            kinds.append(found(name, kind, F.col(name)["stars"], F.col(name)["n_distinct"]))
    long = (F.col("_feed") >= LONG_FEED) & (F.col("_feed") >= F.col("_least")) & (F.col("_shown") == F.col("_feed"))
    kinds.append(F.when(long, F.struct(F.lit("long_feed").alias("kind"), F.lit(None).cast("int").alias("stars"), F.lit(None).cast("long").alias("list"), F.col("_feed").alias("n"))))
    rows = at.select("page", F.array_compact(F.array(*kinds)).alias("_found"))
    out = rows.select("page", F.posexplode_outer("_found").alias("seq", "f")).select("page", F.coalesce("seq", F.lit(0)).alias("seq"), F.coalesce("f.kind", F.lit("none")).alias("kind"), "f.stars", "f.list", "f.n")
    return out.withColumn("list", F.when(F.col("kind") != "almost_feed", F.col("list")))
