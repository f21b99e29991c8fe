"""Link analytics: caps, ranking, rollups, host counts, prefix matches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomwork.functions import urls as U
from loomwork.operators import prefix_join, ranking
from loomwork.operators.link_rank import capped_links, rank_roots
from loomwork.plans.registry import Registry
from loomwork.sources.tables import LINKS_SQL

R = Registry()

CAPPED_SQL = f"""WITH {LINKS_SQL},
a AS (SELECT *, row_number() OVER (PARTITION BY root, url ORDER BY link_id) AS n FROM links),
b AS (SELECT *, row_number() OVER (PARTITION BY root, author ORDER BY link_id) AS m FROM a WHERE n <= 3),
kept AS (SELECT link_id, root, url, author, channel FROM b WHERE m <= 3)"""

DENIED = ["Brand#11", "Brand#25"]

RANK_SQL = f"""{CAPPED_SQL},
c AS (SELECT root, count(*) AS n_links, count(*) FILTER (channel = '1-URGENT') AS n_library FROM kept GROUP BY root),
au AS (SELECT root, author, count(*) AS k FROM kept GROUP BY ALL),
ta AS (SELECT root, CAST(author AS VARCHAR) || ' (' || k || ')' AS top_author, row_number() OVER (PARTITION BY root ORDER BY k DESC, author) AS n FROM au),
ch AS (SELECT root, channel, count(*) AS k FROM kept GROUP BY ALL),
tc AS (SELECT root, channel || ' (' || k || ')' AS top_channel, row_number() OVER (PARTITION BY root ORDER BY k DESC, channel) AS n FROM ch)
SELECT c.root, n_links, top_author, top_channel, n_library FROM c JOIN ta USING (root) JOIN tc USING (root)
WHERE ta.n = 1 AND tc.n = 1 AND n_links >= 2 AND c.root NOT IN ('Brand#11', 'Brand#25')"""


@R.add("flagship_link_ranking", RANK_SQL)
def flagship(t):
    return rank_roots(t.links(), "1-URGENT", 2, DENIED)


@R.add("w01_cap_per_url", f"WITH {LINKS_SQL} SELECT link_id, root, url FROM (SELECT *, row_number() OVER (PARTITION BY root, url ORDER BY link_id) AS n FROM links) WHERE n <= 3")
def cap_per_url(t):
    return ranking.cap_per_group(t.links(), ["root", "url"], ["link_id"], 3).select("link_id", "root", "url")


@R.add("w02_cap_per_author", f"{CAPPED_SQL} SELECT link_id, root, author FROM kept")
def cap_per_author(t):
    return capped_links(t.links()).select("link_id", "root", "author")


@R.add(
    "a09_mode_with_count",
    f"""WITH {LINKS_SQL}, c AS (SELECT root, author, count(*) AS k FROM links GROUP BY ALL)
SELECT root, top_author FROM (SELECT root, CAST(author AS VARCHAR) || ' (' || k || ')' AS top_author, row_number() OVER (PARTITION BY root ORDER BY k DESC, author) AS n FROM c) WHERE n = 1""",
)
def mode_author(t):
    return ranking.mode_with_count(t.links(), ["root"], "author", "top_author")


@R.add("a08_conditional_count", f"WITH {LINKS_SQL} SELECT root, count(*) FILTER (channel = '1-URGENT') AS n_library, count(*) AS n FROM links GROUP BY root")
def conditional_count(t):
    return t.links().groupBy("root").agg(F.count_if(F.col("channel") == "1-URGENT").alias("n_library"), F.count("*").alias("n"))


@R.add(
    "a10_submission_rollup",
    """SELECT p_brand AS root, count(*) AS num_submissions, CAST(sum(l_linenumber) AS BIGINT) AS total_points, strftime(max(l_shipdate), '%Y-%m-%d') AS last_posted_at
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand""",
)
def submission_rollup(t):
    joined = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy(F.col("p_brand").alias("root")).agg(
        F.count("*").alias("num_submissions"), F.sum("l_linenumber").alias("total_points"), F.date_format(F.max("l_shipdate"), "yyyy-MM-dd").alias("last_posted_at")
    )


HOSTS_SQL = "h AS (SELECT page_id, url, regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '^www\\.', '') AS host FROM pages)"


@R.add("a11_urls_per_host", f"WITH {HOSTS_SQL} SELECT host, count(DISTINCT url) AS n_urls FROM h GROUP BY host HAVING count(DISTINCT url) > 2")
def urls_per_host(t):
    hosts = t.pages.select("url", U.bare_host(F.col("url")).alias("host")).distinct()
    return hosts.groupBy("host").agg(F.count("*").alias("n_urls")).where("n_urls > 2")


@R.add("a12_hosts_by_links", f"WITH {HOSTS_SQL}, c AS (SELECT host, count(*) AS n_links FROM h GROUP BY host) SELECT host, n_links, rank() OVER (ORDER BY n_links DESC) AS place FROM c")
def hosts_by_links(t):
    """All hosts with their rank, the busiest first. Ranks come from the table of distinct counts, so no window spans all hosts."""
    hosts = t.pages.groupBy(U.bare_host(F.col("url")).alias("host")).agg(F.count("*").alias("n_links"))
    sizes = hosts.groupBy("n_links").agg(F.count("*").alias("n"))
    before = Window.orderBy(F.desc("n_links")).rowsBetween(Window.unboundedPreceding, -1)
    ranks = sizes.select("n_links", (F.coalesce(F.sum("n").over(before), F.lit(0)) + 1).alias("place"))
    return hosts.join(ranks, "n_links").select("host", "n_links", "place")


@R.add("p13_host_skip_list", f"WITH {HOSTS_SQL} SELECT page_id, host FROM h WHERE host NOT LIKE 'm.%' AND host NOT IN ('spam-farm.example.org')")
def host_skip_list(t):
    skip = t.spark.createDataFrame([("spam-farm.example.org",)], "host string")
    hosts = t.pages.select("page_id", U.bare_host(F.col("url")).alias("host")).where(~F.col("host").startswith("m."))
    return hosts.join(F.broadcast(skip), "host", "left_anti").select("page_id", "host")


ROOTS_SQL = "roots AS (SELECT DISTINCT regexp_extract(short, '^[^/?#]*/?[a-z]*') AS root FROM s WHERE page_id % 3 = 0)"
SHORT_SQL = "s AS (SELECT page_id, regexp_replace(url, '^[a-z]+://(www\\.)?', '') AS short FROM pages)"


@R.add("j13_prefix_join", f"WITH {SHORT_SQL}, {ROOTS_SQL} SELECT page_id, short, (SELECT max_by(root, length(root)) FROM roots WHERE starts_with(short, root)) AS root FROM s")
def prefix_match(t):
    """The longest root that a URL starts with, roots being cut at any character."""
    short = t.pages.select("page_id", U.short_url(F.col("url")).alias("short"))
    roots = short.where("page_id % 3 = 0").select(F.regexp_extract("short", r"^[^/?#]*/?[a-z]*", 0).alias("root")).distinct()
    return prefix_join.longest_prefix(short, "short", roots, "root").select("page_id", "short", "root")


@R.add(
    "j13_prefix_join_path",
    f"""WITH {SHORT_SQL}, roots AS (SELECT DISTINCT regexp_extract(short, '^[^/?#]*(/[a-z]+)?') AS root FROM s WHERE page_id % 3 = 0),
b AS (SELECT page_id, regexp_extract(short, '^[^?#]*') AS base FROM s)
SELECT page_id, base, (SELECT max_by(root, length(root)) FROM roots WHERE base = root OR starts_with(base, root || '/')) AS root FROM b""",
)
def path_prefix_match(t):
    short = t.pages.select("page_id", F.regexp_extract(U.short_url(F.col("url")), r"^[^?#]*", 0).alias("base"))
    roots = short.where("page_id % 3 = 0").select(F.regexp_extract("base", r"^[^/?#]*(/[a-z]+)?", 0).alias("root")).distinct()
    return prefix_join.longest_prefix(short, "base", roots, "root", mode="path").select("page_id", "base", "root")


@R.add("f04_short_url", f"WITH {SHORT_SQL} SELECT page_id, short FROM s")
def short_urls(t):
    return t.pages.select("page_id", U.short_url(F.col("url")).alias("short"))


@R.add("f30_host_of_canonical", f"WITH {SHORT_SQL} SELECT page_id, CASE WHEN strpos(short, '/') > 0 THEN substr(short, 1, strpos(short, '/') - 1) ELSE short END AS host FROM s")
def host_of_canonical(t):
    return t.pages.select("page_id", F.substring_index(U.short_url(F.col("url")), "/", 1).alias("host"))


@R.add("t07_by_popularity", "SELECT p_brand AS root, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS points FROM part GROUP BY p_brand ORDER BY n DESC, points DESC, root LIMIT 10")
def by_popularity(t):
    counts = t.part.groupBy(F.col("p_brand").alias("root")).agg(F.count("*").alias("n"), F.sum("p_size").alias("points"))
    return counts.orderBy(F.desc("n"), F.desc("points"), "root").limit(10)


@R.add("s07_only_new_partitions", "SELECT DISTINCT l_shipdate::DATE AS day FROM lineitem WHERE l_shipdate::DATE NOT IN (SELECT o_orderdate::DATE FROM orders)")
def only_new_partitions(t):
    """Days on one side that are not yet stored on the other."""
    days = t.lineitem.select(F.to_date("l_shipdate").alias("day")).distinct()
    return days.join(t.orders.select(F.to_date("o_orderdate").alias("day")).distinct(), "day", "left_anti")


@R.add("j08_stacked_anti_joins", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def stacked_anti_joins(t):
    done = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    failed = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.select("c_custkey").join(done, "c_custkey", "left_anti").join(failed, "c_custkey", "left_anti")


@R.add("a27_two_counts", "SELECT (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS n_open, (SELECT count(*) FROM orders) AS n_all")
def two_counts(t):
    return t.orders.agg(F.count_if(F.col("o_orderstatus") == "O").alias("n_open"), F.count("*").alias("n_all"))
