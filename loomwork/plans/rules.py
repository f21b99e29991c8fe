"""Archive matching, feed preference, discovery results, and small rules of scheduling and storage."""

from __future__ import annotations

import zoneinfo

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomwork.functions import schedule as S
from loomwork.functions import urls as U
from loomwork.operators import archives as A
from loomwork.operators import publishing as P
from loomwork.operators import sequences as Q
from loomwork.operators import sets
from loomwork.operators.ranking import cap_per_group
from loomwork.plans import publishing
from loomwork.plans.registry import Registry
from loomwork.sources import feeds

R = Registry()

#: The history of a customer with at least six orders of different days; the newest five are the feed.
ARCHIVE_SQL = """o AS (SELECT DISTINCT o_custkey AS feed, o_orderdate::DATE AS day FROM orders), c AS (SELECT feed, count(*) AS n FROM o GROUP BY 1 HAVING count(*) >= 6)"""


def _archives(t):
    """A list for each feed: newest first, oldest first, first and last swapped, without the newest, without the third, without the two newest."""
    rows = t.orders.select(F.col("o_custkey").alias("feed"), F.to_date("o_orderdate").alias("day")).distinct()
    own = Window.partitionBy("feed")
    rows = rows.withColumns({"n": F.count("*").over(own), "new": F.row_number().over(own.orderBy(F.desc("day"))) - 1}).where("n >= 6")
    rows = rows.withColumn("key", F.date_format("day", "yyyy-MM-dd"))
    feed = rows.where("new < 5").select("feed", F.col("new").alias("pos"), "key", F.col("day").cast("timestamp_ntz").alias("at"))
    k, new, n = F.col("feed") % 6, F.col("new"), F.col("n")
    pos = F.when(k == 1, n - 1 - new).when((k == 2) & (new == 0), n - 1).when((k == 2) & (new == n - 1), F.lit(0)).otherwise(new)
    rows = rows.where(~((k == 3) & (new == 0)) & ~((k == 4) & (new == 2)) & ~((k == 5) & (new < 2))).withColumn("_o", pos)
    lists = rows.select((F.col("feed") * 10).alias("list"), "feed", (F.row_number().over(own.orderBy("_o")) - 1).alias("pos"), "key", F.when(k == 2, F.col("day")).alias("day"))
    return lists, feed


@R.add("x07_archive_orders", f"WITH {ARCHIVE_SQL} SELECT feed * 10 AS list, ['sorted', 'reverse', 'by_date'][feed % 6 + 1] AS kind, n FROM c WHERE feed % 6 < 3")
def archive_orders(t):
    return A.archive_matches(*_archives(t)).where(F.col("kind").isin("sorted", "reverse", "by_date"))


@R.add("x06_best_archive", f"WITH {ARCHIVE_SQL} SELECT feed, feed * 10 AS list, ['sorted', 'reverse', 'by_date', 'except_first', 'pinned'][feed % 6 + 1] AS kind, n - (feed % 6 > 2)::INT AS n FROM c WHERE feed % 6 < 5")
def best_archive(t):
    """Beside each whole list there is a shorter one that matches too; the longer one is taken."""
    lists, feed = _archives(t)
    shorter = lists.where("pos < 5 AND feed % 6 = 0").withColumn("list", F.col("list") + 1)
    return A.best_archives(lists.unionByName(shorter), feed)


@R.add("x08_two_part_lists", f"WITH {ARCHIVE_SQL} SELECT feed * 10 AS list, n FROM c WHERE feed % 6 IN (0, 2) OR feed % 6 = 3")
def two_parts(t):
    """The newest two links stand in a group of their own, before the others."""
    lists, feed = _archives(t)
    heads = feed.where("pos < 2").select((F.col("feed") * 10).alias("list"), "pos", "key")
    rest = lists.join(feed.where("pos < 2").select("feed", "key"), ["feed", "key"], "left_anti").where("feed % 6 IN (0, 2, 3)").withColumn("day", F.lit(None).cast("date"))
    rest = rest.withColumn("pos", F.row_number().over(Window.partitionBy("list").orderBy(F.desc("key"))) - 1).select("list", "feed", "pos", "key", "day")
    return A.two_part_lists(heads, rest, feed)


@R.add("x09_pinned_entry", f"WITH {ARCHIVE_SQL}, r AS (SELECT feed, strftime(day, '%Y-%m-%d') AS key, row_number() OVER (PARTITION BY feed ORDER BY day DESC) AS i FROM o JOIN c USING (feed)) SELECT feed, key AS pinned FROM r WHERE feed % 6 = 4 AND i = 3")
def pinned(t):
    """The one entry of the feed that the list lacks."""
    lists, feed = _archives(t)
    found = A.archive_matches(lists, feed).where("kind = 'pinned'").join(lists.select("list", "feed").distinct(), "list").select("feed")
    lacking = feed.join(lists.select("feed", "key"), ["feed", "key"], "left_anti").join(found, "feed", "left_semi")
    return lacking.select("feed", F.col("key").alias("pinned"))


@R.add("e10_compared_with_feed", f"WITH {ARCHIVE_SQL} SELECT feed, feed % 6 = 0 OR feed % 5 = 0 AS agrees FROM c")
def compared(t):
    """Does a result begin with the feed? Taken for granted where the feed's order is uncertain."""
    lists, feed = _archives(t)
    feed = feed.withColumn("at", F.when(F.col("feed") % 5 != 0, F.col("at")))
    certain = Q.bucketed(feed).groupBy("feed").agg(F.bool_and("is_order_certain").alias("certain"))
    # lists without dates of their own, so that only the order as it stands counts; what lacks an entry isn't the feed
    fits = A.archive_matches(lists.withColumn("day", F.lit(None).cast("date")), feed).where("kind = 'sorted'").select((F.col("list") / 10).cast("long").alias("feed")).withColumn("fits", F.lit(True))
    rows = certain.join(fits, "feed", "left")
    return rows.select("feed", (~F.col("certain") | F.coalesce("fits", F.lit(False))).alias("agrees"))


@R.add("t05_newest_first", "SELECT l_orderkey, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber, l_partkey, l_suppkey) AS place FROM lineitem")
def newest_first(t):
    """Links newest first; of equal dates the earlier on the page."""
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("l_shipdate"), "l_linenumber", "l_partkey", "l_suppkey"))
    return t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", n.cast("long").alias("place"))


@R.add("t10_reversed", "SELECT o_custkey, o_orderkey, count(*) OVER (PARTITION BY o_custkey) - row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos FROM orders")
def turned(t):
    rows = t.orders.select("o_custkey", "o_orderkey")
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderkey"))).cast("long") - 1)


@R.add("x23_merged_pinned", "SELECT l_orderkey, l_partkey, l_suppkey, day, row_number() OVER (PARTITION BY l_orderkey ORDER BY day DESC, l_partkey, l_suppkey, l_linenumber) AS place FROM (SELECT *, CASE WHEN l_linenumber = 1 THEN l_commitday ELSE l_shipdate::DATE END AS day FROM (SELECT *, l_shipdate::DATE - 30 AS l_commitday FROM lineitem))")
def merged_pinned(t):
    """A pinned link's date comes from its own text; then it takes its place among the others."""
    from loomwork.functions import dates

    text = F.concat(F.lit("pinned on "), F.date_format(F.date_sub(F.to_date("l_shipdate"), 30), "yyyy-MM-dd"))
    own = t.lineitem.where("l_linenumber = 1").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", dates.found_date(text).alias("day"))
    others = t.lineitem.where("l_linenumber <> 1").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.to_date("l_shipdate").alias("day"))
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("day"), "l_partkey", "l_suppkey", "l_linenumber"))
    return own.unionByName(others).select("l_orderkey", "l_partkey", "l_suppkey", "day", n.cast("long").alias("place"))


@R.add("a23_common_paths", "SELECT o_custkey, o_orderpriority FROM (SELECT o_custkey, o_orderpriority, count(DISTINCT o_orderstatus) AS n FROM orders GROUP BY 1, 2) JOIN (SELECT o_custkey, count(DISTINCT o_orderstatus) AS m FROM orders GROUP BY 1) USING (o_custkey) WHERE n = m")
def common_paths(t):
    """Paths that every link of a group has."""
    rows = t.orders.select("o_custkey", "o_orderpriority", "o_orderstatus")
    links = rows.groupBy("o_custkey").agg(F.count_distinct("o_orderstatus").alias("m"))
    return rows.groupBy("o_custkey", "o_orderpriority").agg(F.count_distinct("o_orderstatus").alias("n")).join(links, "o_custkey").where("n = m").select("o_custkey", "o_orderpriority")


@R.add("f32_preferred_feed", "SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'https://e.com/blog/' || page_id || '/rss' WHEN page_id % 4 = 1 THEN 'https://e.com/posts/rss' WHEN page_id % 4 = 2 THEN 'https://e.com/rss' END AS feed FROM pages")
def preferred_feed(t):
    """On the way up to the root later feeds replace earlier ones, but one below /blog/ or /posts/ doesn't give way to one that isn't."""
    k = F.col("page_id")
    blog = F.concat(F.lit("https://e.com/blog/"), k.cast("string"), F.lit("/rss"))
    found = F.when(k % 4 == 0, F.array(F.lit(None).cast("string"), blog, F.lit("https://e.com/rss"))).when(k % 4 == 1, F.array(blog, F.lit("https://e.com/blog/posts/rss"), F.lit("https://e.com/posts/rss")))
    found = found.when(k % 4 == 2, F.array(F.lit("https://e.com/x/rss"), F.lit(None).cast("string"), F.lit("https://e.com/rss"))).otherwise(F.array(F.lit(None).cast("string")))
    # a feed under both is left for one that has /posts/ only if /blog/ stays; so the second case starts without /blog/
    found = F.when(k % 4 == 1, F.array(F.lit("https://e.com/a/rss"), F.lit("https://e.com/posts/rss"), F.lit("https://e.com/rss"))).otherwise(found)
    return t.pages.select("page_id", U.preferred_feed(found).alias("feed"))


@R.add(
    "d13_discovery_results",
    """SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'not_a_url' WHEN 1 THEN 'unreachable' WHEN 2 THEN 'none' WHEN 3 THEN 'single' WHEN 4 THEN 'multiple' ELSE CASE WHEN page_id % 4 = 1 THEN 'single' ELSE 'bad' END END AS result FROM pages""",
)
def discovery(t):
    """What looking for feeds at an address comes to: one feed, several, none, or why it failed."""
    k = F.col("page_id")
    starts = t.pages.select("page_id", F.when(k % 6 == 0, "mailto:a@b").otherwise(F.concat(F.lit("https://e.com/"), k.cast("string"))).alias("url"))
    # of feeds one in two is cut off, which the parser notices
    whole = '<rss version="2.0"><channel><title>t</title><link>https://e.com/</link><item><title>i</title><link>https://e.com/i</link></item></channel></rss>'
    content = F.when(k % 6 == 5, F.when(k % 4 == 1, F.lit(whole)).otherwise(F.left(F.lit(whole), F.lit(90)))).otherwise(F.col("html"))
    fetched = t.pages.where("page_id % 6 > 1").select(F.concat(F.lit("https://e.com/"), k.cast("string")).alias("url"), k.alias("doc_id"), content.alias("content"), (k % 6 == 5).alias("is_feed"))
    read = feeds.read_feeds(fetched.where("is_feed")).select("doc_id", F.col("error").isNull().alias("is_whole"))
    fetched = fetched.join(read, "doc_id", "left").select("url", "is_feed", F.coalesce("is_whole", F.lit(False)).alias("is_whole"))
    links = t.pages.where("page_id % 6 IN (3, 4)").select(F.concat(F.lit("https://e.com/"), k.cast("string")).alias("url"), F.explode(F.when(k % 6 == 3, F.array(F.lit("/feed"), F.lit("/feed"))).otherwise(F.array(F.lit("/feed"), F.lit("/rss")))).alias("link"))
    return U.discovery_results(starts, fetched, links).select("page_id", "result")


@R.add(
    "j18_catalog_mismatch",
    """SELECT n_name, CASE WHEN n IS NULL THEN 'missing' ELSE 'differs' END AS problem FROM nation JOIN (SELECT c_nationkey, round(count(*) / 15.0)::BIGINT AS expected FROM customer GROUP BY 1) ON c_nationkey = n_nationkey
LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier WHERE s_nationkey % 5 <> 0 GROUP BY 1) ON s_nationkey = n_nationkey WHERE n IS NULL OR n <> expected""",
)
def catalog_mismatch(t):
    """What is expected (a supplier for 15 customers of a nation) against what is there; what isn't there at all is reported too."""
    expected = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.round(F.count("*") / 15).cast("long").alias("expected"))
    there = t.supplier.where("s_nationkey % 5 <> 0").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    rows = t.nation.select("n_nationkey", "n_name").join(expected, "n_nationkey").join(there, "n_nationkey", "left").where("n IS NULL OR n <> expected")
    return rows.select("n_name", F.when(F.col("n").isNull(), "missing").otherwise("differs").alias("problem"))


@R.add("g07_skipped_runs", """WITH d AS (SELECT o_orderkey, o_orderdate::DATE AS day, timezone('UTC', timezone('Europe/Paris', (DATE '1996-06-10' + i::INT)::TIMESTAMP)) + INTERVAL 2 HOURS AS run, DATE '1996-06-10' + i::INT AS d FROM orders, range(0, 10) r(i) WHERE o_orderdate < TIMESTAMP '1996-06-12')
SELECT o_orderkey, min(d) AS day, min(d) - max(day) - 1 AS skipped FROM d WHERE d > day AND run >= TIMESTAMP '1996-06-12 10:00:00' GROUP BY 1""")
def skipped_runs(t):
    """A date in the past moves to the next run that isn't over; the days between are counted."""
    run = S.next_run(F.to_date("o_orderdate"), "Europe/Paris", F.lit("1996-06-12 10:00:00").cast("timestamp_ntz"))
    late = t.orders.where(F.col("o_orderdate") < F.lit("1996-06-12").cast("timestamp_ntz"))
    return late.select("o_orderkey", run.alias("r")).select("o_orderkey", "r.day", F.col("r.skipped").cast("long").alias("skipped"))


ZONES = ("Mars/Base", "UTC", "Europe/Paris", "America/Los_Angeles", "europe/paris ", "Asia/Kolkata", "Pacific/Auckland")


@R.add("g17_invalid_zones", f"SELECT c_custkey FROM customer WHERE {list(ZONES)}[c_custkey % 7 + 1] NOT IN (SELECT name FROM pg_timezone_names())")
def invalid_zones(t):
    """Settings whose zone isn't one that this system knows."""
    known = t.spark.createDataFrame([(z,) for z in sorted(zoneinfo.available_timezones())], "zone string")  # some hundred names
    zone = F.get(F.array(*[F.lit(z) for z in ZONES]), (F.col("c_custkey") % 7).cast("int"))
    return t.customer.select("c_custkey", zone.alias("zone")).join(F.broadcast(known), "zone", "left_anti").select("c_custkey")


@R.add("g18_initial_publication", f"WITH {publishing.MODEL_SQL} SELECT p.sub_id, p.index, d.sub_id IS NOT NULL AS today FROM posts p LEFT JOIN due d ON d.sub_id = p.sub_id AND d.index = p.index WHERE p.sub_id % 10 = 3 AND p.published_at IS NULL")
def initial_publication(t):
    """Subscriptions that were just set up (keys that end in 3): which of their posts are published at once."""
    subs, posts, schedule = publishing.model(t)
    chosen = subs.where("sub_id % 10 = 3").select("sub_id")
    own = posts.where("published_at IS NULL").join(chosen, "sub_id", "left_semi")
    due = P.due_posts(subs.join(chosen, "sub_id", "left_semi"), own, schedule, F.to_date(publishing.now())).select("sub_id", "index", F.lit(True).alias("today"))
    return own.join(due, ["sub_id", "index"], "left").select("sub_id", "index", F.coalesce("today", F.lit(False)).alias("today"))


@R.add("g21_waitlist", "SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 1 WHEN c_custkey % 4 = 1 THEN 3 WHEN c_custkey % 4 = 2 THEN 6 ELSE 5 END AS version, c_custkey % 4 <> 3 AS updated FROM customer")
def waitlist(t):
    """New rows have version 1; a user's version must be greater than the stored one, else it is a conflict; anonymous ones count up."""
    k = F.col("c_custkey")
    stored = t.customer.where("c_custkey % 4 <> 0").select(k.alias("id"), F.when(k % 4 == 1, 2).otherwise(5).alias("version"))
    sent = t.customer.select(k.alias("id"), F.when(k % 4 == 2, F.lit(6)).when(k % 4 == 3, F.lit(5)).alias("version"))
    return sets.counted_upsert(stored, sent, "id", "version")


@R.add("w03_first_unpublished", f"WITH {publishing.MODEL_SQL} SELECT sub_id, count(*) AS n, min(index) AS first, max(index) AS last FROM due GROUP BY 1")
def first_unpublished(t):
    due = publishing._due(t)[2]
    return due.groupBy("sub_id").agg(F.count("*").alias("n"), F.min("index").alias("first"), F.max("index").alias("last"))


@R.add("w04_last_published", f"WITH {publishing.FEED_SQL} SELECT sub_id, count(*) AS n, min(index) AS first FROM old GROUP BY 1")
def last_published(t):
    shown = P.subscription_feed(*publishing._due(t), publishing.now()).where("kind = 'old'")
    return shown.groupBy("sub_id").agg(F.count("*").alias("n"), F.min(F.col("post_id") % 100).alias("first"))


@R.add("t04_stable_merge", "SELECT o_custkey, o_orderkey, place FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE DESC, o_orderstatus, o_orderkey) AS place FROM orders) WHERE place <= 30")
def stable_merge(t):
    """Rows of several sources, latest day first; of one day in the order of the sources, and in each as they were; thirty stay."""
    rows = t.orders.select("o_custkey", "o_orderkey", "o_orderstatus", F.to_date("o_orderdate").alias("day"))
    order = [F.desc("day"), "o_orderstatus", "o_orderkey"]
    kept = cap_per_group(rows, ["o_custkey"], order, 30)
    return kept.select("o_custkey", "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(*order)).cast("long").alias("place"))
