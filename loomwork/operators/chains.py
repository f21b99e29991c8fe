"""Histories over several pages: chains of next pages by pointer doubling, and the links on them stitched together and checked.

A chain of n pages takes log2(n) rounds for all blogs at once: each round doubles the pages that are numbered, and the distance that a pointer leaps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.operators import sequences as Q
from loomwork.sources.storage import dropped, staged

#: Fixed value: a history of more links is too long.
MOST_LINKS = 10_000


def page_chains(firsts: DataFrame, nexts: DataFrame, pages: DataFrame, most_pages: int = MOST_LINKS) -> tuple[DataFrame, DataFrame]:
    """(numbers, ends): the pages of each blog's chain, and how it ends.

    firsts (blog, page): where chains begin. nexts (blog, page, target): links to next pages. pages (blog, page): what can be fetched. numbers (blog, page, number): from 1,
    as far as pages follow each other by one link each. ends (blog, end, n_pages): `last` where the last page has no such link, `ambiguous` where it has links to several pages,
    `broken` where its next page can't be fetched, `cyclic` where it comes back to a page of the chain or has more than most_pages.
    """
    here = pages.select("blog", "page").distinct()
    links = nexts.select("blog", "page", "target").distinct()
    fan = links.groupBy("blog", "page").agg(F.count("*").alias("_n"), F.min("target").alias("target"))
    fan = staged(fan.join(here.select("blog", F.col("page").alias("target"), F.lit(True).alias("_there")), ["blog", "target"], "left"), "next-pages")
    only = fan.where("_n = 1 AND _there").select("blog", "page", "target")
    leap = staged(only, "leaps")
    chain = staged(firsts.select("blog", "page").distinct().join(here, ["blog", "page"], "left_semi").withColumn("number", F.lit(1).cast("long")), "chain")
    reach = 1
    while reach <= most_pages:
        # a page that is there already is not numbered again: a cycle ends where it closes
        more = chain.join(leap, ["blog", "page"]).select("blog", F.col("target").alias("page"), (F.col("number") + reach).alias("number"))
        grown = chain.unionByName(more).groupBy("blog", "page").agg(F.min("number").alias("number"))
        grown, before = staged(grown, "chain"), chain
        on = grown.count() > before.count()
        dropped(before)
        chain = grown
        if not on:
            break
        far = leap.select("blog", F.col("page").alias("target"), F.col("target").alias("_far"))
        twice = staged(leap.join(far, ["blog", "target"]).select("blog", "page", F.col("_far").alias("target")), "leaps")
        dropped(leap)
        leap, reach = twice, reach * 2
    dropped(leap)
    last = chain.groupBy("blog").agg(F.max_by("page", "number").alias("page"), F.max("number").alias("n_pages"))
    at_end = last.join(fan, ["blog", "page"], "left")
    end = F.when(F.col("n_pages") > most_pages, "cyclic").when(F.col("_n").isNull(), "last").when(F.col("_n") > 1, "ambiguous").when(F.col("_there"), "cyclic").otherwise("broken")
    return chain, at_end.select("blog", end.alias("end"), "n_pages")


def stitched(firsts: DataFrame, nexts: DataFrame, entries: DataFrame, feed: DataFrame, most_links: int = MOST_LINKS) -> DataFrame:
    """(blog, outcome, n_pages, n_links): the links of each blog's chain of pages as one history, and whether it is one.

    entries (blog, page, pos, key): the links to posts on each page, a page without any is none. feed (feed, pos, key, at): of the blog as `feed`. The first that applies: `ambiguous`, `broken`
    as in page_chains; `too_long`: cyclic, or more than most_links links; `overlap`: the second page repeats a link of the first (later pages may repeat links); `not_feed`: laid end to end, the
    pages don't begin with the feed; else `whole`. A chain of one page is `single`. n_pages and n_links are of the chain as far as it goes.
    """
    numbers, ends = page_chains(firsts, nexts, entries.select("blog", "page").distinct(), most_links)
    feed = staged(feed, "feed")
    rows = entries.join(numbers, ["blog", "page"]).select("blog", "number", "pos", "key")
    # what is asked of single links is asked of the first two pages and of as many links as the feed has; all others are counted and stay behind
    own = Window.partitionBy("blog")
    placed = rows.withColumns({"place": F.row_number().over(own.orderBy("number", "pos")) - 1, "n_links": F.count("*").over(own)})
    placed = placed.join(feed.groupBy(F.col("feed").alias("blog")).agg(F.count("*").alias("_feed")), "blog", "left")
    front = staged(placed.where((F.col("number") <= 2) | (F.col("place") < F.col("_feed"))).select("blog", "number", "place", "key", "n_links"), "entries")
    sizes = front.groupBy("blog").agg(F.max("n_links").alias("n_links"))
    both = front.where("number <= 2 AND key IS NOT NULL").groupBy("blog", "key").agg((F.min("number") < F.max("number")).alias("_both"))
    overlap = both.where("_both").select("blog").distinct().withColumn("_overlap", F.lit(True))
    laid = front.select(F.col("blog").alias("feed"), F.col("place").alias("pos"), "key")
    fits = Q.sequence_matches(feed, laid).select(F.col("feed").alias("blog"), "matches")
    found = ends.join(sizes, "blog").join(overlap, "blog", "left").join(fits, "blog", "left")
    outcome = (
        F.when(F.col("end").isin("ambiguous", "broken"), F.col("end"))
        .when((F.col("end") == "cyclic") | (F.col("n_links") > most_links), "too_long")
        .when(F.col("n_pages") == 1, "single")
        .when(F.col("_overlap"), "overlap")
        .when(~F.coalesce("matches", F.lit(True)), "not_feed")
        .otherwise("whole")
    )
    return found.select("blog", outcome.alias("outcome"), "n_pages", "n_links")
