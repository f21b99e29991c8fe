"""Pages that continue each other: the template of a next-page link, the links that fit it, and which search round's result is taken.

Links are rows (blog, page, page_url, pos, url, in_head). Everything is worked out for all blogs at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions.urls import bare_host

#: Paths that surely, and that probably, lead to the second page; the path of dated searches and its key.
SURE_SECOND, PROBABLE_SECOND = r"/(?:index-?2|page/?2)[^/\d]*$", r"/2$"
SEARCH_PATH, SEARCH_KEY = "/search", "updated-max"
#: Fixed value: a result of so many links ends the search.
ENOUGH_LINKS = 11


def trimmed_path(url: Column) -> Column:
    """The path of an absolute URL without slashes at its end."""
    return F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1), "/+$", "")


def query_values(url: Column, key: str) -> Column:
    """All values of a query key, in order."""
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    return F.transform(F.regexp_extract_all(query, F.lit(rf"(?:^|&){key}=([^&]*)"), F.lit(1)), lambda v: F.coalesce(F.try_url_decode(v), v))


def _only(url: Column, key: str) -> Column:
    """The value of a query key that is there once, else null."""
    values = query_values(url, key)
    return F.when(F.size(values) == 1, F.get(values, F.lit(0)))


def page_templates(links: DataFrame, dated: DataFrame) -> DataFrame:
    """(blog, kind, host, prefix, suffix, is_certain, url): how the first page of each blog leads to the second.

    links: of first pages only. dated (blog): those whose feed generator pages by dates. The first kind with any link counts: `dated`
    searches, a sure `path`, a `query` with page=2, a probable path; a blog whose links of that kind have several targets has none. For
    query templates prefix is the whole path. Null URLs are no links; an empty table gives no rows.
    """
    host, path = bare_host(F.col("url")), trimmed_path(F.col("url"))
    by_date = links.join(dated.select("blog").distinct().withColumn("_dated", F.lit(True)), "blog", "left")
    own = host == bare_host(F.col("page_url"))
    search = F.col("_dated") & (path == SEARCH_PATH) & _only(F.col("url"), SEARCH_KEY).isNotNull()
    rank = F.when(search, 0).when(own & path.rlike(SURE_SECOND), 1).when(own & (_only(F.col("url"), "page") == "2"), 2).when(own & path.rlike(PROBABLE_SECOND), 3)
    target = F.concat(host, path, *[F.concat(F.lit(f"|{k}="), F.coalesce(_only(F.col("url"), k), F.lit(""))) for k in ("page", SEARCH_KEY)])
    found = by_date.select("blog", "pos", "url", host.alias("host"), path.alias("path"), rank.alias("rank"), target.alias("target")).where("rank IS NOT NULL")
    # a group per blog and kind, then the first kind of each: both are partial aggregates
    kinds = found.groupBy("blog", "rank").agg(F.min(F.struct("pos", "url", "host", "path")).alias("first"), F.min("target").alias("low"), F.max("target").alias("high"))
    first = kinds.groupBy("blog").agg(F.min(F.struct("rank", "first", "low", "high")).alias("k")).select("blog", "k.rank", "k.first.*", "k.low", "k.high").where("low = high")
    part = lambda n: F.regexp_extract("path", r"^(.*)2([^2]*)$", n)
    by_path, by_query = F.col("rank").isin(1, 3), F.col("rank") == 2
    return first.select(
        "blog", F.when(by_path, "path").when(by_query, "query").otherwise("dated").alias("kind"), F.when(by_path | by_query, F.col("host")).alias("host"),
        F.when(by_path, part(1)).when(by_query, F.col("path")).alias("prefix"), F.when(by_path, part(2)).alias("suffix"), (F.col("rank") < 3).alias("is_certain"), "url",
    )


def next_page_links(links: DataFrame, numbers: DataFrame, templates: DataFrame) -> DataFrame:
    """(blog, page, number, url): links to the page after each page (blog, page, number) by its blog's template; one row for each fitting link.

    A dated search goes on with an earlier date than the page's own, and not by a link of the page's head.
    """
    rows = links.join(numbers.select("blog", "page", "number"), ["blog", "page"])
    rows = rows.join(templates.select("blog", "kind", F.col("host").alias("_host"), "prefix", "suffix"), "blog")
    host, path, after = bare_host(F.col("url")), trimmed_path(F.col("url")), (F.col("number") + 1).cast("string")
    by_path = (F.col("kind") == "path") & (host == F.col("_host")) & (path == F.concat("prefix", after, "suffix"))
    by_query = (F.col("kind") == "query") & (host == F.col("_host")) & (path == F.col("prefix")) & (_only(F.col("url"), "page") == after)
    searches = (path == SEARCH_PATH) & (trimmed_path(F.col("page_url")) == SEARCH_PATH) & ~F.col("in_head")
    by_date = (F.col("kind") == "dated") & searches & (_only(F.col("url"), SEARCH_KEY) < _only(F.col("page_url"), SEARCH_KEY))
    return rows.where(by_path | by_query | by_date).select("blog", "page", "number", "url")


def accepted_results(results: DataFrame, blogs: DataFrame, enough: int = ENOUGH_LINKS) -> DataFrame:
    """(blog, phase, n): which of the results (blog, phase 1 to 3, n links) ends each blog's search.

    The first of at least `enough` links, else the one with most, the earlier of equal ones. blogs (blog, n_entries, ends_early):
    a feed of fewer than two entries has the first phase alone and must find enough there; where ends_early, the third phase is left out.
    """
    rows = results.join(blogs, "blog").where((F.col("phase") == 1) | (F.col("n_entries") >= 2)).where((F.col("phase") < 3) | ~F.col("ends_early"))
    rows = rows.where((F.col("n_entries") >= 2) | (F.col("n") >= enough))
    whole = F.col("n") >= enough
    order = F.struct(F.when(whole, 0).otherwise(1).alias("_a"), F.when(whole, F.col("phase")).otherwise(-F.col("n")).alias("_b"), "phase", "n")
    return rows.groupBy("blog").agg(F.min(order).alias("_r")).select("blog", "_r.phase", "_r.n")


def common_links(first: DataFrame, second: DataFrame) -> DataFrame:
    """(blog, key, pos): the links (blog, key, pos) of a second page that its blog's first one has too, each once, at its first place."""
    return second.groupBy("blog", "key").agg(F.min("pos").alias("pos")).join(first.select("blog", "key").distinct(), ["blog", "key"], "left_semi")
