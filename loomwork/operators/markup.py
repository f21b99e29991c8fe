"""Where on a page the titles and dates of links stand, worked out from links whose titles are known.

links: (group, page_id, pos, key, xpath), the links of a group that share a masked path and are in the feed. Paths have an index at each step. All groups are worked out at
once, by equi-joins on pages, paths and titles; elements and dates are rows of pages as `sources.html_pages` reads them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions.text import equalized_title
from loomwork.sources.storage import staged_wide

#: Up to so many links so many may have another title; of more links three.
TOLERANCES, MOST_TOLERANCE = ((8, 0), (52, 2)), 3


def tolerated(n: Column) -> Column:
    out = F.lit(MOST_TOLERANCE)
    for most, misses in reversed(TOLERANCES):
        out = F.when(n <= most, misses).otherwise(out)
    return out


def parent_path(xpath: Column, steps: int) -> Column:
    """The path without its last steps."""
    return F.regexp_replace(xpath, rf"(/[^/]+){{{steps}}}$", "") if steps else xpath


def title_paths(links: DataFrame, elements: DataFrame, titles: DataFrame, distance: int) -> DataFrame:
    """(group, kind, rank, path): where the titles of each group's links stand, relative to the link.

    titles (key, title): the feed's titles. elements (page_id, pos, xpath, text). distance: steps from a link up to the element that holds one link's post. The first of these that fits:
    `self`: the link's own text, if at most so many distinct links have another title as `tolerated` says; `child`: the first path to an element within the link, in
    order of the links, at which at most so many have another title; `neighbor`: all paths to elements beside the link under the same post at which no link has another title (it may have no such
    element). A link without a title in the feed has another one. Titles are compared as `equalized_title` makes them. Groups without any of these have no row.
    """
    named = staged_wide(elements.select("page_id", F.col("pos").alias("_at"), F.col("xpath").alias("_xpath"), equalized_title(F.col("text")).alias("_title")), "elements")
    own = named.select("page_id", F.col("_xpath").alias("xpath"), F.col("_title").alias("_own"))
    feed = titles.groupBy("key").agg(F.min(equalized_title(F.col("title"))).alias("_feed"))
    rows = links.join(own, ["page_id", "xpath"], "left").join(feed, "key", "left")
    rows = staged_wide(rows.select("group", "page_id", "pos", "key", "xpath", "_own", "_feed", parent_path(F.col("xpath"), distance).alias("_top")), "links")

    other = lambda a: F.coalesce(F.col(a) != F.col("_feed"), F.lit(True))
    keys = rows.groupBy("group", "key").agg(F.bool_or(other("_own")).alias("_a"), F.bool_or(~F.coalesce(F.contains("_own", "_feed"), F.lit(False))).alias("_b"))
    counts = keys.groupBy("group").agg(tolerated(F.count("*")).alias("_most"), F.count_if("_a").alias("_self"), F.count_if("_b").alias("_child"))
    sizes = rows.groupBy("group").agg(F.count("*").alias("_links"))
    counts = staged_wide(counts.join(sizes, "group"), "counts")
    by_self = counts.where("_self <= _most").select("group", F.lit("self").alias("kind"), F.lit(0).alias("rank"), F.lit("").alias("path"))

    def first_paths(base: str, skip: Column) -> DataFrame:
        """(group, path, place): the first element under `base` with the link's title, of each link; paths by the first link that has them."""
        under = F.startswith("_xpath", F.concat(base, F.lit("/"))) & ~skip
        met = rows.join(named, (rows["page_id"] == named["page_id"]) & (rows["_feed"] == named["_title"])).where(under)
        first = met.groupBy("group", "pos", base).agg(F.min(F.struct("_at", "_xpath")).alias("_e"))
        path = F.substring(F.col("_e._xpath"), F.length(base) + 1, F.lit(1 << 30))
        return first.groupBy("group", path.alias("path")).agg(F.min("pos").alias("place"))

    def with_elements(paths: DataFrame, base: str) -> DataFrame:
        """Each link beside each path of its group, with the title that stands there."""
        at = rows.join(paths, "group").withColumn("_xpath", F.concat(base, "path"))
        return at.join(named.select("page_id", "_xpath", "_title", F.lit(True).alias("_there")), ["page_id", "_xpath"], "left")

    rest = counts.join(by_self.select("group"), "group", "left_anti").hint("merge")
    inner = first_paths("xpath", F.lit(False)).join(rest.where("_child <= _most").select("group", "_most"), "group")
    tried = with_elements(inner, "xpath").groupBy("group", "path", "place", "_most").agg(F.count_if(other("_title")).alias("_misses")).where("_misses <= _most")
    by_child = staged_wide(tried.groupBy("group").agg(F.min(F.struct("place", "path")).alias("f")).select("group", F.lit("child").alias("kind"), F.lit(0).alias("rank"), "f.path"), "children")

    left = rest.join(by_child.select("group"), "group", "left_anti").select("group").hint("merge")
    # with one step to the post, the link itself is not its neighbour
    itself = (F.col("_xpath") == F.col("xpath")) | F.startswith("_xpath", F.concat("xpath", F.lit("/"))) if distance == 1 else F.lit(False)
    beside = first_paths("_top", itself).join(left, "group")
    kept = with_elements(beside, "_top").groupBy("group", "path", "place").agg(F.bool_and(~F.coalesce("_there", F.lit(False)) | ~other("_title")).alias("_all")).where("_all")
    rank = F.row_number().over(Window.partitionBy("group").orderBy("place", "path")) - 1
    up = "/.." * distance
    by_neighbor = kept.select("group", F.lit("neighbor").alias("kind"), rank.alias("rank"), F.concat(F.lit(up), "path").alias("path"))
    return by_self.unionByName(by_child).unionByName(by_neighbor)


def date_paths(links: DataFrame, dates: DataFrame, distance: int) -> DataFrame:
    """(group, path, source, n_paths): the one relative path at which all links of a group have a date: the only one, or the only one from time elements.

    dates (page_id, xpath, source): date candidates. n_paths: how many paths all links share. Groups without such a path have no row.
    """
    rows = links.select("group", "page_id", "pos", parent_path(F.col("xpath"), distance).alias("_top"))
    steps = F.size(F.split("xpath", "/")) - 1
    # every element above a date may be a post: equi-joins on their paths, not a comparison of all dates with all links
    above = dates.select("page_id", "source", "xpath", F.explode(F.sequence(F.lit(1), steps)).alias("_n")).withColumn("_top", F.concat(F.lit("/"), F.array_join(F.slice(F.split(F.substring("xpath", 2, 1 << 30), "/"), F.lit(1), F.col("_n")), "/")))
    at = rows.join(above, ["page_id", "_top"]).select("group", "page_id", "pos", "source", F.substring(F.col("xpath"), F.length("_top") + 1, F.lit(1 << 30)).alias("path")).distinct()
    sizes = links.select("group", "page_id", "pos").distinct().groupBy("group").agg(F.count("*").alias("_links"))
    shared = at.groupBy("group", "path", "source").agg(F.count("*").alias("_n")).join(sizes, "group").where("_n = _links")
    of = shared.groupBy("group").agg(
        F.count("*").alias("n_paths"), F.count_if(F.col("source") == "time").alias("_times"), F.min(F.struct("path", "source")).alias("_one"),
        F.min(F.when(F.col("source") == "time", F.struct("path", "source"))).alias("_time"),
    )
    chosen = F.when(F.col("n_paths") == 1, F.col("_one")).when(F.col("_times") == 1, F.col("_time"))
    found = of.select("group", chosen.alias("c"), "n_paths").where("c IS NOT NULL")
    return found.select("group", F.concat(F.lit("/.." * distance), "c.path").alias("path"), "c.source", "n_paths")
