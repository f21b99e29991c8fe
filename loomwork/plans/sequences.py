"""Sequence algebra and feed diffs: a customer's orders are a feed, newest first; entries of one month share a time."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomwork.operators import candidates as C
from loomwork.operators import masks as M
from loomwork.operators import sequences as Q
from loomwork.plans.registry import Registry

R = Registry()

FEED_SQL = """feed AS (SELECT o_custkey AS feed, o_orderkey AS key, date_trunc('month', o_orderdate)::TIMESTAMP AS tm,
 row_number() OVER (PARTITION BY o_custkey ORDER BY date_trunc('month', o_orderdate) DESC, o_orderkey) - 1 AS pos FROM orders),
b AS (SELECT *, dense_rank() OVER (PARTITION BY feed ORDER BY tm DESC) - 1 AS bucket FROM feed)"""


def feed(t):
    month = F.date_trunc("month", "o_orderdate").cast("timestamp_ntz")
    rows = t.dealt("orders", "o_custkey").select(F.col("o_custkey").alias("feed"), F.col("o_orderkey").alias("key"), month.alias("at"))
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("feed").orderBy(F.desc("at"), "key")) - 1)


def even(rows):
    return rows.where("key % 2 = 0").select("feed", "key")


@R.add("e01_buckets", f"WITH {FEED_SQL} SELECT feed, pos, key, bucket FROM b")
def buckets(t):
    return Q.bucketed(feed(t)).select("feed", F.col("pos").cast("long").alias("pos"), "key", "bucket")


@R.add("e02_included_counts", f"WITH {FEED_SQL} SELECT feed, count(*) AS n, count(*) FILTER (key % 2 = 0) AS n_in, bool_and(key % 2 = 0) AS all_in FROM feed GROUP BY 1")
def included(t):
    rows = feed(t)
    return Q.included_counts(rows, even(rows))


@R.add(
    "e03_included_prefix",
    f"""WITH {FEED_SQL}, c AS (SELECT feed, bucket, count(*) AS n, count(*) FILTER (key % 3 <> 0) AS k FROM b GROUP BY 1, 2),
o AS (SELECT *, coalesce(bool_and(n = k) OVER (PARTITION BY feed ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS open FROM c)
SELECT feed, CAST(coalesce(sum(k) FILTER (open), 0) AS BIGINT) AS length FROM o GROUP BY 1""",
)
def included_prefix(t):
    rows = feed(t)
    return Q.included_prefix(rows, rows.where("key % 3 <> 0").select("feed", "key"))


@R.add("e04_sequence_match", f"WITH {FEED_SQL} SELECT DISTINCT feed, true AS matches FROM feed")
def sequence(t):
    """Each feed's own keys, ascending within buckets of equal time and reversed there: they match."""
    rows = Q.bucketed(feed(t))
    turned = F.row_number().over(Window.partitionBy("feed").orderBy("bucket", F.desc("key"))) - 1
    return Q.sequence_matches(rows.select("feed", "pos", "key", "at"), rows.select("feed", turned.alias("pos"), "key"))


@R.add("e04_sequence_mismatch", f"WITH {FEED_SQL}, r AS (SELECT feed, row_number() OVER (PARTITION BY feed ORDER BY pos DESC) - 1 AS pos, bucket AS own FROM b) SELECT feed, bool_and(bucket = own) AS matches FROM b JOIN r USING (feed, pos) GROUP BY 1")
def reversed_sequence(t):
    """The reversed list matches only where every place meets a key of its own bucket."""
    rows = feed(t)
    turned = F.row_number().over(Window.partitionBy("feed").orderBy(F.desc("pos"))) - 1
    return Q.sequence_matches(rows, rows.select("feed", turned.alias("pos"), "key"))


@R.add("e06_suffix_match", f"WITH {FEED_SQL}, l AS (SELECT feed, min(bucket) + (max(bucket) - min(bucket) + 1) // 2 AS start FROM b GROUP BY 1) SELECT feed, count(*) FILTER (bucket < start) AS prefix_length, count(*) FILTER (bucket >= start) AS suffix_length FROM b JOIN l USING (feed) GROUP BY 1")
def suffix(t):
    """The later half of the buckets is a suffix of its feed."""
    rows = Q.bucketed(feed(t))
    start = rows.groupBy("feed").agg((F.floor((F.max("bucket") + 1) / 2)).alias("start"))
    half = rows.join(start, "feed").where("bucket >= start")
    listed = half.select("feed", (F.row_number().over(Window.partitionBy("feed").orderBy("pos")) - 1).alias("pos"), "key")
    return Q.suffix_match(rows.select("feed", "pos", "key", "at"), listed)


@R.add("e07_ordered_except", f"WITH {FEED_SQL} SELECT feed, key FROM feed WHERE key % 2 <> 0")
def ordered_except(t):
    rows = feed(t)
    return rows.join(even(rows), ["feed", "key"], "left_anti").select("feed", "key")


@R.add("e08_lists_equal", f"WITH {FEED_SQL} SELECT feed, count(*) FILTER (key % 50 = 0) = 0 AS equal FROM feed GROUP BY 1")
def equal_lists(t):
    rows = feed(t)
    other = rows.withColumn("key", F.when(F.col("key") % 50 == 0, -F.col("key") - 1).otherwise(F.col("key")))
    return Q.lists_equal(rows, other)


@R.add(
    "e09_feed_diff",
    f"""WITH {FEED_SQL}, n AS (SELECT feed, count(*) AS n, count(*) FILTER (bucket >= 1) AS old FROM b GROUP BY 1)
SELECT feed, CASE WHEN n = old THEN 'ok' WHEN old < 3 THEN 'no_match' ELSE 'ok' END AS status, CASE WHEN n > old AND old >= 3 THEN key::VARCHAR END AS key
FROM b JOIN n USING (feed) WHERE bucket = 0 AND (old >= 3 OR pos = 0)""",
)
def diff(t):
    """The posts of the newest time are new; the others were known. At least three known posts have to be left in the feed."""
    rows = Q.bucketed(feed(t))
    known = rows.where("bucket >= 1").select("feed", (F.row_number().over(Window.partitionBy("feed").orderBy("pos")) - 1).alias("pos"), "key")
    none = known.select("feed", "key").where("false")
    return Q.feed_diff(rows.select("feed", "pos", "key", "at"), known, none, none).drop("pos")


@R.add("e11_appended_index", f"WITH {FEED_SQL}, o AS (SELECT feed, count(*) FILTER (bucket > 0) AS last FROM b GROUP BY 1) SELECT feed, key, last + row_number() OVER (PARTITION BY feed ORDER BY pos DESC) - 1 AS index FROM b JOIN o USING (feed) WHERE bucket = 0")
def appended(t):
    rows = Q.bucketed(feed(t))
    old = rows.where("bucket > 0").select("feed", (F.row_number().over(Window.partitionBy("feed").orderBy(F.desc("pos"))) - 1).alias("index"))
    return Q.appended(old, rows.where("bucket = 0").select("feed", "key", "pos"))


@R.add("d07_chronology_repair", f"WITH {FEED_SQL} SELECT feed, key, row_number() OVER (PARTITION BY feed ORDER BY tm DESC, key DESC) - 1 AS pos FROM feed")
def repaired(t):
    """Ascending feeds are turned round."""
    up = feed(t).withColumn("pos", F.row_number().over(Window.partitionBy("feed").orderBy("at", "key")) - 1)
    return Q.reversed_if_ascending(up).select("feed", "key", F.col("pos").cast("long").alias("pos"))


LINKS_SQL = """l AS (SELECT l_orderkey AS page, l_partkey AS url, '/html[1]/body[1]/div[' || (l_linenumber % 2 + 1) || ']/a[' || row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber) || ']' AS xpath FROM lineitem),
f AS (SELECT l_orderkey AS page, min(l_partkey) AS url FROM lineitem GROUP BY 1)"""


def _links(t):
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber"))
    path = F.format_string("/html[1]/body[1]/div[%d]/a[%d]", F.col("l_linenumber") % 2 + 1, n)
    lines = t.dealt("lineitem", "l_orderkey")
    links = lines.select(F.col("l_orderkey").alias("page"), F.col("l_partkey").alias("url"), path.alias("xpath"))
    return links, lines.groupBy(F.col("l_orderkey").alias("page")).agg(F.min("l_partkey").alias("url"))


MASK1_SQL = f"""{LINKS_SQL}, m AS (SELECT page, url, unnest([regexp_replace(xpath, '^/html\\[1\\]', '/html[*]'), regexp_replace(xpath, '/body\\[1\\]', '/body[*]'),
 regexp_replace(xpath, '/div\\[[0-9]+\\]', '/div[*]'), regexp_replace(xpath, '/a\\[[0-9]+\\]$', '/a[*]')]) AS mask FROM l)"""


@R.add("x01_mask_groups", f"WITH {MASK1_SQL} SELECT m.page, mask, count(DISTINCT m.url) AS n_links, count(DISTINCT f.url) AS n_feed FROM m LEFT JOIN f ON f.page = m.page AND f.url = m.url GROUP BY 1, 2 HAVING count(DISTINCT m.url) > 1 AND count(f.url) > 0")
def mask_groups(t):
    return M.mask_groups(*_links(t))


@R.add("x01_two_star_groups", f"""WITH {LINKS_SQL}, m AS (SELECT page, url, regexp_replace(regexp_replace(xpath, '/div\\[[0-9]+\\]', '/div[*]'), '/a\\[[0-9]+\\]$', '/a[*]') AS mask FROM l)
SELECT m.page, mask, count(DISTINCT m.url) AS n_links, count(DISTINCT f.url) AS n_feed FROM m LEFT JOIN f ON f.page = m.page AND f.url = m.url GROUP BY 1, 2 HAVING count(DISTINCT m.url) > 1""")
def two_star_groups(t):
    groups = M.mask_groups(*_links(t), stars=2)
    return groups.where(F.col("mask").contains("/div[*]/a[*]"))


@R.add("x03_ranked_groups", f"""WITH {MASK1_SQL}, g AS (SELECT m.page, mask, count(DISTINCT m.url) AS n_links, count(DISTINCT f.url) AS n_feed FROM m LEFT JOIN f ON f.page = m.page AND f.url = m.url GROUP BY 1, 2 HAVING count(DISTINCT m.url) > 1 AND count(f.url) > 0)
SELECT page, mask, place FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY n_feed DESC, n_links DESC, mask) AS place FROM g) WHERE place <= 2""")
def ranked(t):
    return M.ranked_groups(M.mask_groups(*_links(t))).where("place <= 2").select("page", "mask", F.col("place").cast("long").alias("place"))


@R.add("a22_on_every_page", "SELECT l_partkey, l_returnflag FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_linenumber) = (SELECT count(DISTINCT l_linenumber) FROM lineitem)")
def on_every_page(t):
    """(xpath, source) pairs that occur on every page: as many distinct pages as there are."""
    rows = t.lineitem.select("l_partkey", "l_returnflag", "l_linenumber")
    pages = rows.agg(F.count_distinct("l_linenumber").alias("n_pages"))
    groups = rows.groupBy("l_partkey", "l_returnflag").agg(F.count_distinct("l_linenumber").alias("n"))
    return groups.join(F.broadcast(pages), F.col("n") == F.col("n_pages")).select("l_partkey", "l_returnflag")


@R.add("x17_dominant_host", "SELECT o_custkey, max_by(o_orderpriority, (k, o_orderpriority)) AS host FROM (SELECT o_custkey, o_orderpriority, count(*) AS k FROM orders GROUP BY 1, 2) GROUP BY 1")
def dominant(t):
    counts = t.orders.groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("k"))
    return counts.groupBy("o_custkey").agg(F.max_by("o_orderpriority", F.struct("k", "o_orderpriority")).alias("host"))


@R.add("x18_long_feed", "SELECT l_suppkey, l_returnflag, l_shipmonth, count(*) > 50 AND count(*) % 100 <> 0 AS is_long FROM (SELECT *, month(l_shipdate) % 3 AS l_shipmonth FROM lineitem) GROUP BY 1, 2, 3")
def long_feed(t):
    """Feeds that are longer than a page usually shows, and not cut at a round number."""
    return t.lineitem.groupBy("l_suppkey", "l_returnflag", (F.month("l_shipdate") % 3).cast("long").alias("l_shipmonth")).agg(C.is_long_feed(F.count("*")).alias("is_long"))


@R.add("x25_equal_candidates", "SELECT min(s_nationkey) AS s_nationkey, count(*) AS copies FROM (SELECT s_nationkey, string_agg((s_suppkey % 3)::VARCHAR, ',' ORDER BY s_suppkey) AS ks FROM supplier GROUP BY 1) GROUP BY ks")
def equal_candidates(t):
    """Candidates whose lists are equal, position by position, are one; the lists are compared by digests of (position, key), and never gathered."""
    n = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey"))
    rows = t.supplier.select("s_nationkey", n.alias("n"), (F.col("s_suppkey") % 3).alias("k"))
    digest = [F.count("*").alias("size"), F.bit_xor(F.xxhash64("n", "k")).alias("d1"), F.bit_xor(F.xxhash64("k", "n", F.lit(1))).alias("d2")]
    return rows.groupBy("s_nationkey").agg(*digest).groupBy("size", "d1", "d2").agg(F.min("s_nationkey").alias("s_nationkey"), F.count("*").alias("copies")).select("s_nationkey", "copies")


@R.add(
    "x19_redirect_chains",
    """WITH RECURSIVE e AS (SELECT p_partkey AS a, p_partkey // 2 AS b FROM part), r AS (SELECT a AS start, a AS loc, 0 AS hops FROM e
UNION ALL SELECT start, b, hops + 1 FROM r JOIN e ON e.a = r.loc WHERE hops < 20 AND b > 0) SELECT start, max(hops) AS hops, min(loc) AS target FROM r GROUP BY 1""",
)
def redirects(t):
    """Chains of redirects by pointer doubling, until none goes on."""
    from loomwork.operators.redirects import resolved

    edges = t.part.where("p_partkey > 1").select(F.col("p_partkey").alias("source"), F.floor(F.col("p_partkey") / 2).alias("target"))
    return resolved(t.part.select(F.col("p_partkey").alias("start")), edges).select("start", "hops", "target")


@R.add("x12_next_pages", r"SELECT a.page_id, b.page_id AS next_id FROM pages a JOIN pages b ON regexp_replace(a.url, '[0-9]+.*$', '') = regexp_replace(b.url, '[0-9]+.*$', '') AND CAST(regexp_extract(b.url, '([0-9]+)', 1) AS BIGINT) = CAST(regexp_extract(a.url, '([0-9]+)', 1) AS BIGINT) + 1")
def next_pages(t):
    """Pages that follow each other: equal templates, page numbers one apart."""
    rows = t.pages.select("page_id", F.regexp_replace("url", r"[0-9]+.*$", "").alias("template"), F.regexp_extract("url", r"([0-9]+)", 1).cast("bigint").alias("n"))
    after = rows.select(F.col("page_id").alias("next_id"), "template", (F.col("n") - 1).alias("n"))
    return rows.join(after, ["template", "n"]).select("page_id", "next_id")
