"""Next-page templates over the pages table, and the rounds of a search over the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.operators import paging as P
from loomwork.plans.registry import Registry

R = Registry()

PAGE_SQL = """p AS (SELECT page_id AS blog, page_id % 7 AS k, regexp_replace(regexp_extract(url, '://([^/?#]*)', 1), '^www\\.', '') AS host,
rtrim(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/') AS path, rtrim(regexp_extract(url, '^([^?#]*)', 1), '/') AS base FROM pages)"""


def _links(t, number):
    """Pages as first pages of blogs; each links, by its id, to the next one in one of the known ways, to two of them, or to none, and beside it to another host."""
    rows = t.pages.select(F.col("page_id").alias("blog"), F.col("page_id").alias("page"), F.col("url").alias("page_url"), F.rtrim(F.regexp_extract("url", r"^([^?#]*)", 1), F.lit("/")).alias("base"))
    k, n, base = F.col("blog") % 7, F.lit(str(number)), F.col("base")
    site = F.regexp_extract("base", r"^([a-z]+://[^/]*)", 1)
    search = lambda day: F.concat(site, F.lit(f"/search?updated-max=2020-01-{day}T00%3A00%3A00&max-results=7"))
    links = F.when(k == 0, F.array(F.concat(base, F.lit("/page/"), n))).when(k == 1, F.array(F.concat(base, F.lit("?page="), n))).when(k == 2, F.array(F.concat(base, F.lit("/"), n, F.lit("/"))))
    links = links.when(k == 3, F.array(F.concat(base, F.lit("/page/"), n), F.concat(base, F.lit("/other/page/"), n))).when(k == 4, F.array(search(30 - number)))
    links = links.when(k == 5, F.array(F.concat(base, F.lit("/"), n), F.concat(base, F.lit("/index-"), n, F.lit(".html")))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("url", F.explode(F.concat(links, F.array(F.lit("https://elsewhere.example/page/2")))))
    page_url = F.when(k == 4, search(31 - number)).otherwise(F.col("page_url")) if number > 2 else F.col("page_url")
    return rows.select("blog", "page", page_url.alias("page_url"), F.xxhash64("url").alias("pos"), "url", F.lit(False).alias("in_head"))


def _templates(t):
    return P.page_templates(_links(t, 2), t.pages.where("page_id % 7 = 4").select(F.col("page_id").alias("blog")))


@R.add("f36_next_page_templates", f"WITH {PAGE_SQL} SELECT blog, CASE WHEN k = 1 THEN 'query' WHEN k = 4 THEN 'dated' ELSE 'path' END AS kind, CASE WHEN k <> 4 THEN host END AS host, CASE k WHEN 0 THEN path || '/page/' WHEN 1 THEN path WHEN 2 THEN path || '/' WHEN 5 THEN path || '/index-' END AS prefix, CASE k WHEN 0 THEN '' WHEN 2 THEN '' WHEN 5 THEN '.html' END AS suffix, k <> 2 AS is_certain FROM p WHERE k IN (0, 1, 2, 4, 5)")
def templates(t):
    return _templates(t).drop("url")


@R.add("f36_next_page_links", f"WITH {PAGE_SQL} SELECT blog, 2 AS number, CASE k WHEN 0 THEN base || '/page/3' WHEN 1 THEN base || '?page=3' WHEN 2 THEN base || '/3/' WHEN 4 THEN regexp_extract(base, '^([a-z]+://[^/]*)', 1) || '/search?updated-max=2020-01-27T00%3A00%3A00&max-results=7' ELSE base || '/index-3.html' END AS url FROM p WHERE k IN (0, 1, 2, 4, 5)")
def next_links(t):
    """The second pages' links to the third ones, by the templates of the first."""
    numbers = t.pages.select(F.col("page_id").alias("blog"), F.col("page_id").alias("page"), F.lit(2).alias("number"))
    return P.next_page_links(_links(t, 3), numbers, _templates(t)).select("blog", "number", "url")


@R.add(
    "x20_accepted_results",
    """WITH r AS (SELECT o_custkey AS blog, (o_orderkey % 3 + 1)::INT AS phase, count(*) AS n FROM orders GROUP BY 1, 2), b AS (SELECT c_custkey AS blog, c_custkey % 4 AS n_entries, c_nationkey = 3 AS ends_early FROM customer),
a AS (SELECT r.* FROM r JOIN b USING (blog) WHERE (n_entries >= 2 OR (phase = 1 AND n >= 5)) AND NOT (phase = 3 AND ends_early)), e AS (SELECT blog, min(phase) AS phase FROM a WHERE n >= 5 GROUP BY 1),
o AS (SELECT *, row_number() OVER (PARTITION BY blog ORDER BY n DESC, phase) AS i FROM a WHERE blog NOT IN (SELECT blog FROM e)) SELECT blog, phase, n FROM a JOIN e USING (blog, phase) UNION ALL SELECT blog, phase, n FROM o WHERE i = 1""",
)
def accepted(t):
    """Customers as blogs, their orders as the links that three rounds found; five are enough here."""
    results = t.orders.groupBy(F.col("o_custkey").alias("blog"), (F.col("o_orderkey") % 3 + 1).cast("int").alias("phase")).agg(F.count("*").alias("n"))
    blogs = t.customer.select(F.col("c_custkey").alias("blog"), (F.col("c_custkey") % 4).alias("n_entries"), (F.col("c_nationkey") == 3).alias("ends_early"))
    return P.accepted_results(results, blogs, 5)


@R.add("x20_common_links", "SELECT blog, key, pos FROM (SELECT l_suppkey AS blog, l_partkey AS key, min(l_linenumber) AS pos FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1, 2) SEMI JOIN (SELECT l_suppkey AS blog, l_partkey AS key FROM lineitem WHERE l_returnflag = 'R') USING (blog, key)")
def common(t):
    """Links that two entries of a blog share: parts that a supplier has in both of two groups of line items."""
    rows = t.lineitem.select(F.col("l_suppkey").alias("blog"), F.col("l_partkey").alias("key"), F.col("l_linenumber").alias("pos"), "l_returnflag")
    return P.common_links(rows.where("l_returnflag = 'R'"), rows.where("l_returnflag = 'N'"))
