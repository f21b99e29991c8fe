"""Sources and sinks: exports read back from the shared folder, partition loads, appends, caches, static tables.

Each writes documents or tables made from the data below the shared folder, and reads them with the reader that it is about.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.functions import schedule as S
from loomwork.functions import text as X
from loomwork.functions import urls as U
from loomwork.plans.registry import Registry
from loomwork.sources import exports, feeds, html_pages
from loomwork.sources.storage import scratch

R = Registry()


@R.add("s05_message_export", "SELECT 'https://example.com/' || o_orderkey AS url, o_orderkey AS message_id, NULL::VARCHAR AS thread_id, 'c' || (o_custkey % 20) AS channel, o_orderpriority AS author FROM orders")
def messages(t):
    """Exports of nested messages, a document for each channel and some authors, as a row for each address."""
    content = F.concat(F.lit("see https://example.com/"), F.col("o_orderkey").cast("string"), F.lit(", not http://localhost:1/ or ftp://x/"))
    message = F.struct(F.col("o_orderkey").alias("id"), F.lit("2024").alias("timestamp"), content.alias("content"), F.struct(F.col("o_orderpriority").alias("name")).alias("author"))
    rows = t.orders.select(F.concat(F.lit("c"), (F.col("o_custkey") % 20).cast("string")).alias("c"), (F.col("o_orderkey") % 50).alias("part"), message.alias("m"))
    docs = rows.groupBy("c", "part").agg(F.collect_list("m").alias("messages")).select(F.struct(F.col("c").alias("id")).alias("channel"), "messages")
    path = scratch(t.spark, "export")
    docs.select(F.to_json(F.struct("channel", "messages")).alias("value")).repartition(200, "value").write.text(path)
    # a text file of several documents is one document for each line
    return exports.message_links(t.spark.read.schema(exports.EXPORT_SCHEMA).json(path)).select("url", "message_id", "thread_id", "channel", "author")


@R.add("s06_replaced_partitions", "SELECT o_orderpriority AS channel, o_orderkey AS id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'fresh' ELSE 'stored' END AS state FROM orders WHERE o_orderpriority <> '1-URGENT' OR o_orderkey % 2 = 0")
def replaced(t):
    """A channel that is imported again replaces what is stored of it, and nothing else."""
    path = scratch(t.spark, "channels")
    rows = t.orders.select(F.col("o_orderpriority").alias("channel"), F.col("o_orderkey").alias("id"))
    exports.replace_partitions(rows.withColumn("state", F.lit("stored")), path, "channel")
    exports.replace_partitions(rows.where("channel = '1-URGENT' AND id % 2 = 0").withColumn("state", F.lit("fresh")), path, "channel")
    return t.spark.read.schema("id long, state string, channel string").parquet(path).select("channel", "id", "state")


@R.add("s08_search_pages", "SELECT url, 'page ' || page_id AS title, strftime(TIMESTAMP '2024-01-01' + INTERVAL (page_id) MINUTE, '%Y-%m-%d %H:%M:%S') AS created_at, (page_id % 90)::INT AS points FROM pages WHERE page_id % 5 <> 0")
def search_pages(t):
    """Pages of search hits; a hit without an address is left out."""
    at = F.date_format(F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("page_id").cast("int")), "yyyy-MM-dd'T'HH:mm:ss'.000Z'")
    hit = F.struct(at.alias("created_at"), (F.col("page_id") % 90).alias("points"), F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("title"), F.when(F.col("page_id") % 5 != 0, F.col("url")).alias("url"))
    path = scratch(t.spark, "search")
    docs = t.pages.groupBy(F.floor(F.col("page_id") / 20)).agg(F.collect_list(hit).alias("hits"))
    docs.select(F.to_json(F.struct("hits")).alias("value")).write.text(path)
    return exports.search_hits(t.spark.read.schema(exports.SEARCH_SCHEMA).json(path))


def _documents(t):
    key = F.col("o_orderkey").cast("string")
    item = F.concat(F.lit("<item><title>a&nbsp;b &amp; "), key, F.lit("</title><feedburner:origLink>https://example.com/p/"), key, F.lit("</feedburner:origLink><link>https://x/</link></item>"))
    text = F.concat(F.lit("<rss><channel><title>t</title><generator>"), F.get(F.array(*[F.lit(g) for g in ("Tumblr (3.0)", "Medium", "Blogger", "Hugo")]), (F.col("o_orderkey") % 4).cast("int")), F.lit("</generator>"), item, F.lit("</channel></rss>"))
    return t.orders.select(F.col("o_orderkey").alias("doc_id"), text.alias("content"), F.lit("https://example.com/feed").alias("url"))


@R.add("s11_feed_scan", "SELECT o_orderkey AS doc_id, 0 AS pos, 'https://example.com/p/' || o_orderkey AS url, 'a b & ' || o_orderkey AS title FROM orders")
def feed_scan(t):
    """Feeds that aren't well-formed: an entity of HTML, an undeclared prefix."""
    return feeds.entries(feeds.read_feeds(_documents(t))).select("doc_id", "pos", "url", "title")


@R.add("d05_generators", "SELECT o_orderkey AS doc_id, ['tumblr', 'medium', 'blogger', 'other'][o_orderkey % 4 + 1] AS generator FROM orders")
def generators(t):
    return feeds.read_feeds(_documents(t)).select("doc_id", "generator")


@R.add("d06_feed_titles", "SELECT page_id AS doc_id, CASE WHEN page_id % 3 = 0 THEN regexp_extract(url, '://([^/?#]*)', 1) WHEN page_id % 3 = 1 THEN 'one two' ELSE 'a < b' END AS title FROM pages")
def feed_titles(t):
    """Missing: the host; unescaped, with breaks and runs of blanks as one blank."""
    title = F.when(F.col("page_id") % 3 == 0, "").when(F.col("page_id") % 3 == 1, "<title>one&lt;br/&gt;  two</title>").otherwise("<title>a &amp;lt; b</title>")
    docs = t.pages.select(F.col("page_id").alias("doc_id"), F.concat(F.lit("<rss><channel>"), title, F.lit("</channel></rss>")).alias("content"), "url")
    return feeds.read_feeds(docs).select("doc_id", "title")


@R.add("s12_link_rows", r"SELECT page_id, (i - 1)::INT AS pos, regexp_extract_all(html, '<a href=\"([^\"]*)\">', 1)[i] AS href FROM (SELECT page_id, html, unnest(range(1, len(regexp_extract_all(html, '<a href=\"([^\"]*)\">', 1)) + 1)) AS i FROM pages)")
def link_rows(t):
    return html_pages.read_links(t.pages).where("tag = 'a'").select("page_id", "pos", "href")


_OPEN = "<table><tr><td><a href='/1'>x</a><td><a href='/2'>{}</a><tr><td><a href='/3' aria-label='l'></a></table><ul><li><a href='/4'>y</a><li><a href='/5'>z</a></ul><p><a href='/6'>p</a><p><a href='/7'>q</a>"


@R.add(
    "d09_labelled_links",
    """SELECT page_id, href, xpath FROM pages, (VALUES ('/1', '/table[1]/tbody[1]/tr[1]/td[1]/a[1]'), ('/2', '/table[1]/tbody[1]/tr[1]/td[2]/a[1]'), ('/3', '/table[1]/tbody[1]/tr[2]/td[1]/a[1]'),
('/4', '/ul[1]/li[1]/a[1]'), ('/5', '/ul[1]/li[2]/a[1]'), ('/6', '/p[1]/a[1]'), ('/7', '/p[2]/a[1]')) v(href, tail), (SELECT 1), LATERAL (SELECT '/html[1]/body[1]' || tail AS xpath) WHERE href <> '/2' OR page_id % 2 = 0""",
)
def labelled_links(t):
    """Links of markup without end tags; those without text or label are left out."""
    before, after = _OPEN.split("{}")
    html = F.concat(F.lit(before), F.when(F.col("page_id") % 2 == 0, "w").otherwise(""), F.lit(after))
    return html_pages.read_links(t.pages.select("page_id", html.alias("html"))).select("page_id", "href", "xpath")


@R.add("d10_link_texts", "SELECT page_id, 'to ' || page_id AS text, 'b.a' AS class FROM pages")
def link_texts(t):
    """The text within a link, over elements, and its classes without those of single posts."""
    html = F.concat(F.lit("<div class='post-7 b A'><a class='post-12 B a' href=x>to <b>"), F.col("page_id").cast("string"), F.lit("</b></a></div>"))
    rows = html_pages.read_links(t.pages.select("page_id", html.alias("html")))
    return rows.select("page_id", "text", F.array_join(F.reverse(F.split(F.regexp_extract("class_xpath", r"/a\(([^)]*)\)", 1), r"\.")), ".").alias("class"))


@R.add("d15_categories", "SELECT page_id, 'category' AS kind, CASE WHEN page_id % 3 = 0 THEN 'Uncategorized' ELSE 'c' || (page_id % 3) END AS name FROM pages UNION ALL SELECT page_id, 'tag', CASE WHEN page_id % 2 = 0 THEN 'Uncategorized' ELSE 't' || page_id END FROM pages")
def categories(t):
    """Categories and tags by the rel of links, the default one where a page has none."""
    k = F.col("page_id")
    html = F.concat(
        F.when(k % 3 != 0, F.concat(F.lit("<a rel='category nofollow' href=/c>c"), (k % 3).cast("string"), F.lit("</a>"))).otherwise(""),
        F.when(k % 2 != 0, F.concat(F.lit("<a rel=tag href=/t>t"), k.cast("string"), F.lit("</a>"))).otherwise("<a rel=bookmark href=/b>b</a>"),
    )
    return html_pages.read_categories(t.pages.select("page_id", html.alias("html")))


@R.add(
    "s14_read_through_cache",
    """WITH r AS (SELECT DISTINCT l_partkey + 300 AS request FROM lineitem), c AS (SELECT l_partkey AS request, count(*) || ' sold' AS body FROM lineitem WHERE l_returnflag = 'N' AND l_quantity > 40 GROUP BY 1)
SELECT request, c.body IS NOT NULL AS hit, coalesce(c.body, p_name) AS body FROM r LEFT JOIN c USING (request) LEFT JOIN part ON p_partkey = request""",
)
def cache(t):
    """What the cache has (sales of parts) comes from it, the rest from the source (the parts table), which doesn't have all that is asked for."""
    requests = t.lineitem.select((F.col("l_partkey") + 300).alias("request")).distinct()
    cached = t.lineitem.where("l_returnflag = 'N' AND l_quantity > 40").groupBy(F.col("l_partkey").alias("request")).agg(F.concat(F.count("*").cast("string"), F.lit(" sold")).alias("stored"))
    met = requests.join(cached, "request", "left")
    fetched = met.where("stored IS NULL").select("request").join(t.part.select(F.col("p_partkey").alias("request"), F.col("p_name").alias("fetched")), "request")
    return met.join(fetched, "request", "left").select("request", F.col("stored").isNotNull().alias("hit"), F.coalesce("stored", "fetched").alias("body"))


@R.add("s17_insert_from_select", "SELECT l_orderkey AS sub_id, count(*) AS n FROM lineitem GROUP BY 1 UNION ALL SELECT -o_orderkey - 1, count(*) FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P' GROUP BY 1")
def inserted(t):
    """Rows selected from one table are appended to another."""
    path = scratch(t.spark, "posts")
    posts = t.lineitem.select(F.col("l_orderkey").alias("sub_id"), "l_partkey")
    posts.write.mode("append").parquet(path)
    chosen = t.orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("sub_id"))
    posts.join(chosen, "sub_id", "left_semi").select((-F.col("sub_id") - 1).alias("sub_id"), "l_partkey").write.mode("append").parquet(path)
    return t.spark.read.schema(posts.schema).parquet(path).groupBy("sub_id").agg(F.count("*").alias("n"))


@R.add("s18_two_tables", "SELECT 'post' AS kind, count(*) AS n, sum(p_partkey) AS keys FROM part UNION ALL SELECT 'category', count(*), sum(p_partkey) FROM part WHERE p_size > 10")
def two_tables(t):
    """Posts and their categories from one frame, with ids that both know."""
    posts, links = scratch(t.spark, "posts"), scratch(t.spark, "post-categories")
    rows = t.part.select(F.col("p_partkey").alias("id"), "p_name", F.when(F.col("p_size") > 10, F.col("p_brand")).alias("category"))
    rows.select("id", "p_name").write.parquet(posts)
    rows.where("category IS NOT NULL").select("id", "category").write.parquet(links)
    sums = lambda path, kind: t.spark.read.schema("id long").parquet(path).agg(F.count("*").alias("n"), F.sum("id").alias("keys")).select(F.lit(kind).alias("kind"), "n", "keys")
    return sums(posts, "post").unionByName(sums(links, "category"))


@R.add("s19_event_append", "SELECT event_id, event_type, '{\"k\":' || regexp_extract(props, '([0-9]+)', 1) || '}' AS props FROM events")
def event_append(t):
    """Events, one at a time or many, are appended; their properties are JSON."""
    path = scratch(t.spark, "events")
    rows = t.events.select("event_id", "event_type", F.to_json(F.from_json("props", "k int")).alias("props"))
    rows.where("event_id = 0").write.mode("append").parquet(path)
    rows.where("event_id <> 0").write.mode("append").parquet(path)
    return t.spark.read.schema(rows.schema).parquet(path)


@R.add("s20_micro_batches", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def micro_batches(t):
    from loomwork.streaming import events as E

    return E.run_available(E.read_events(t.spark, t.folder), scratch(t.spark, "batches")).groupBy("event_type").agg(F.count("*").alias("n"))


@R.add("s23_title_lists", "SELECT p_brand || ': ' || p_name || ' (' || p_partkey || ')' AS line FROM part")
def title_lists(t):
    """Titles of lists as lines of text."""
    path = scratch(t.spark, "lists")
    t.part.orderBy("p_brand", "p_partkey").select(F.concat("p_brand", F.lit(": "), "p_name", F.lit(" ("), F.col("p_partkey").cast("string"), F.lit(")")).alias("value")).write.text(path)
    return t.spark.read.text(path).select(F.col("value").alias("line"))


@R.add("s26_retention", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n > 10")
def retention(t):
    """What goes where the ten newest of each owner stay."""
    from loomwork.operators.ranking import cap_per_group

    kept = cap_per_group(t.orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 10)
    return t.orders.select("o_orderkey").join(kept.select("o_orderkey"), "o_orderkey", "left_anti")


#: Hosts whose pages are never fetched.
SKIPPED = ("spam-farm.example.org", "m.ththth.example.net")


@R.add("s27_static_tables", "SELECT page_id, regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '^www\\.', '') IN ('spam-farm.example.org', 'm.ththth.example.net') AS skipped FROM pages")
def static_tables(t):
    """A table in the code, of a known small size, joined by broadcast."""
    known = t.spark.createDataFrame([(h,) for h in SKIPPED], "host string").withColumn("known", F.lit(True))
    return t.pages.select("page_id", U.bare_host(F.col("url")).alias("host")).join(F.broadcast(known), "host", "left").select("page_id", F.col("known").isNotNull().alias("skipped"))


@R.add("f20_backoff", "SELECT l_linenumber + i AS n, CAST(least(power(5, l_linenumber + i), 600) AS BIGINT) AS seconds FROM (SELECT DISTINCT l_linenumber FROM lineitem), range(0, 20, 7) r(i)")
def backoffs(t):
    n = (F.col("l_linenumber") + F.col("i")).cast("long")
    rows = t.lineitem.select("l_linenumber").distinct().select("l_linenumber", F.explode(F.array(F.lit(0), F.lit(7), F.lit(14))).alias("i"))
    return rows.select(n.alias("n"), S.backoff(n).alias("seconds"))


@R.add("f24_rss_clients", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'Feedly' WHEN 1 THEN 'Inoreader' ELSE 'curl/' || event_id END AS client FROM events")
def rss_clients(t):
    k = F.col("event_id")
    agent = F.when(k % 3 == 0, F.concat(F.lit("Feedly/1."), k.cast("string"))).when(k % 3 == 1, "Mozilla/5.0 (compatible; inoreader.com; 3 subscribers)").otherwise(F.concat(F.lit("curl/"), k.cast("string")))
    return t.events.select("event_id", X.rss_client(agent).alias("client"))


@R.add("f26_random_ids", "SELECT c_custkey, rtrim(replace(replace(to_base64(unhex(substr(sha256(c_name), 1, 32))), '+', '-'), '/', '_'), '=') AS id FROM customer")
def random_ids(t):
    return t.customer.select("c_custkey", X.random_id(F.col("c_name")).alias("id"))
