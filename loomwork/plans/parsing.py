"""Feeds, pages and exports as rows. Documents are made from the tables, and the SQL reads the tables directly."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.functions import dates as D
from loomwork.functions import schedule as S
from loomwork.functions import text as X
from loomwork.plans.registry import Registry
from loomwork.sources import exports, feeds, html_pages

R = Registry()


def _feed_documents(t, kind: str):
    """A feed for each customer, its orders as entries in order of keys."""
    orders = t.orders.select("o_custkey", "o_orderkey", "o_orderdate", F.concat(F.lit("Post <b>"), F.col("o_orderpriority"), F.lit("</b> & more")).alias("title"))
    key = F.col("o_orderkey").cast("string")
    link, title = F.concat(F.lit("https://example.com/p/"), key), X.escaped_xml(F.col("title"))
    if kind == "rss":
        item = F.concat(F.lit("<item><title>"), title, F.lit("</title><link>"), link, F.lit("</link><pubDate>"), S.rfc1123z(F.col("o_orderdate")), F.lit("</pubDate></item>"))
        head, tail = '<?xml version="1.0" encoding="utf-8"?><rss version="2.0"><channel><title>Some &amp;lt;blog</title><link>https://example.com/</link><generator>Tumblr (3.0)</generator>', "</channel></rss>"
    elif kind == "rdf":
        item = F.concat(F.lit("<item><title>"), title, F.lit("</title><link>"), link, F.lit("</link><dc:date>"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("</dc:date></item>"))
        head, tail = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title></title><link>https://example.com/</link></channel>', "</rdf:RDF>"
    else:
        item = F.concat(F.lit('<entry><title>'), title, F.lit('</title><link rel="alternate" href="'), link, F.lit('"/><link rel="self" href="x"/><updated>'), F.date_format("o_orderdate", "yyyy-MM-dd'T'00:00:00'Z'"), F.lit("</updated></entry>"))
        head, tail = '<feed xmlns="http://www.w3.org/2005/Atom"><title>Atom</title><link href="https://example.com/"/><generator>Blogger</generator>', "</feed>"
    rows = orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", item.alias("xml")))).alias("items"))
    content = F.concat(F.lit(head), F.array_join(F.transform("items", lambda i: i["xml"]), ""), F.lit(tail))
    return rows.select(F.col("o_custkey").alias("doc_id"), content.alias("content"), F.lit("https://example.com/feed").alias("url"))


def _entries_sql(published: str) -> str:
    return f"""SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos, 'https://example.com/p/' || o_orderkey AS url,
 'Post <b>' || o_orderpriority || '</b> & more' AS title, {published} AS published FROM orders"""


def _read(t, kind):
    return feeds.entries(feeds.read_feeds(_feed_documents(t, kind))).withColumn("pos", F.col("pos").cast("long"))


@R.add("d02_rss_entries", _entries_sql("strftime(o_orderdate, '%a, %d %b %Y %H:%M:%S +0000')"))
def rss(t):
    return _read(t, "rss")


@R.add("d03_rdf_entries", _entries_sql("strftime(o_orderdate, '%Y-%m-%d')"))
def rdf(t):
    return _read(t, "rdf")


@R.add("d04_atom_entries", _entries_sql("strftime(o_orderdate, '%Y-%m-%dT00:00:00Z')"))
def atom(t):
    return _read(t, "atom")


@R.add("d01_feed_heads", """SELECT o_custkey AS doc_id, k AS kind, CASE k WHEN 'rss' THEN 'Some <blog' WHEN 'rdf' THEN 'example.com' ELSE 'Atom' END AS title, 'https://example.com/' AS root_link,
CASE k WHEN 'rss' THEN 'tumblr' WHEN 'rdf' THEN 'other' ELSE 'blogger' END AS generator, k AS sniffed FROM (SELECT DISTINCT o_custkey FROM orders), (VALUES ('rss'), ('rdf'), ('atom')) v(k)""")
def heads(t):
    out = None
    for kind in ("rss", "rdf", "atom"):
        part = feeds.read_heads(_feed_documents(t, kind)).drop("error")
        out = part if out is None else out.unionByName(part)
    return out


@R.add("d08_page_links", r"""SELECT page_id, count(*) AS n, sum(length(href))::BIGINT AS chars FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">', 1)) AS href FROM pages) GROUP BY 1""")
def page_links(t):
    links = html_pages.read_links(t.pages)
    return links.groupBy("page_id").agg(F.count("*").alias("n"), F.sum(F.length("href")).alias("chars"))


@R.add("d08_link_paths", """SELECT page_id, pos, '/html[1]/body[1]/nav[1]/ul[1]/li[' || (pos + 1) || ']/a[1]' AS xpath FROM (SELECT page_id, unnest(range(0, len(regexp_extract_all(regexp_extract(html, '<nav><ul>.*?</ul>'), '<a href=')))) AS pos FROM pages)""")
def link_paths(t):
    """The links of each page's first list, by their paths."""
    links = html_pages.read_links(t.pages).where(F.col("xpath").startswith("/html[1]/body[1]/nav[1]/ul[1]/li["))
    return links.select("page_id", F.col("pos").cast("long").alias("pos"), "xpath")


@R.add("d11_page_title", "SELECT page_id, coalesce(nullif(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), ''), url) AS title FROM pages")
def page_titles(t):
    return t.pages.select("page_id", html_pages.page_title(F.col("html"), F.col("url")).alias("title"))


@R.add("d12_feed_links", "SELECT page_id, page_id % 6 IN (0, 3, 4) AS is_feed FROM pages")
def feed_links(t):
    """Feeds by the end of their address or by their type; feeds of comments, ?alt=rss twins and other links aren't."""
    ends = ["/blog/feed.xml", "/comments/feed", "/feeds/posts?alt=rss", "/feeds/posts/default", "/any", "/any"]
    end = F.get(F.array(*[F.lit(e) for e in ends]), (F.col("page_id") % 6).cast("int"))
    rel, kind = F.lit("alternate"), F.when(F.col("page_id") % 6 == 4, "application/atom+xml").when(F.col("page_id") % 6 == 2, "application/rss+xml").otherwise("text/html")
    return t.pages.select("page_id", html_pages.is_feed_link(F.concat(F.lit("https://example.com"), end), rel, kind).alias("is_feed"))


@R.add("d16_meta_refresh", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN page_id % 10 END AS delay, CASE WHEN page_id % 2 = 0 THEN url END AS target FROM pages")
def refreshes(t):
    tag = F.concat(F.lit('<meta http-equiv="refresh" content="'), (F.col("page_id") % 10).cast("string"), F.lit("; url="), F.col("url"), F.lit('">'))
    html = F.when(F.col("page_id") % 2 == 0, tag).otherwise("<meta charset='utf-8'>")
    return t.pages.select("page_id", html_pages.meta_refresh(html).alias("m")).select("page_id", F.col("m.delay").cast("long").alias("delay"), "m.target")


@R.add("d18_job_payload", "SELECT o_orderkey, 'PublishPostsJob' AS class, o_custkey AS argument, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def payloads(t):
    """Class, first argument and date of a job's YAML text, whose form is fixed."""
    yaml = F.concat(F.lit("job_data:\n  job_class: PublishPostsJob\n  arguments:\n  - "), F.col("o_custkey").cast("string"), F.lit("\n  - '"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("'\n"))
    rows = t.orders.select("o_orderkey", yaml.alias("handler"))
    return rows.select(
        "o_orderkey", F.regexp_extract("handler", r"job_class: (\S+)", 1).alias("class"), F.regexp_extract("handler", r"arguments:\n  - (\d+)", 1).cast("bigint").alias("argument"), F.regexp_extract("handler", r"- '(\d{4}-\d\d-\d\d)'", 1).alias("day")
    )


@R.add("f13_text_dates", "SELECT o_orderkey, o_orderdate::DATE AS day FROM orders")
def text_dates(t):
    k, d = F.col("o_orderkey") % 5, F.col("o_orderdate")
    text = (
        F.when(k == 0, F.date_format(d, "'Posted on 'MMMM d', 'yyyy"))
        .when(k == 1, F.date_format(d, "d MMM yyyy"))
        .when(k == 2, F.date_format(d, "yyyy-MM-dd' by me'"))
        .when(k == 3, F.date_format(d, "EEE', 'dd MMM yyyy HH:mm:ss"))
        .otherwise(F.date_format(d, "yyyy.MM.dd"))
    )
    return t.orders.select("o_orderkey", D.found_date(text).alias("day"))


@R.add("d14_page_dates", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'meta' ELSE 'time' END AS source, '2024-01-0' || (page_id % 9 + 1) AS value FROM pages")
def page_dates(t):
    day = F.concat(F.lit("2024-01-0"), (F.col("page_id") % 9 + 1).cast("string"))
    head = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('<meta property="article:published_time" content="'), day, F.lit('">'))).otherwise(F.concat(F.lit('<time datetime="'), day, F.lit('">then</time>')))
    return html_pages.read_dates(t.pages.select("page_id", head.alias("html"))).select("page_id", "source", "value")


@R.add(
    "s10_line_scan",
    """SELECT page_id, 1 AS line_no, url, page_id || ' of them' AS label, NULL AS error FROM pages UNION ALL
SELECT page_id, 3, CASE WHEN page_id % 3 > 0 THEN url END, CASE WHEN page_id % 3 > 0 THEN 'again' END, CASE WHEN page_id % 3 = 0 THEN 'line 3 is not a url and a label' END FROM pages""",
)
def lines(t):
    """Lists of addresses with labels: a line of each page's address, a blank one, and one that is an address only for some."""
    k = F.col("page_id")
    text = F.concat("url", F.lit("  "), k.cast("string"), F.lit(" of them \n \r\n"), F.when(k % 3 > 0, F.concat(F.lit(" "), "url", F.lit("\tagain"))).otherwise(F.concat(F.lit("see "), "url")))
    return exports.parsed_lines(t.pages.select("page_id", text.alias("text")))


@R.add("d17_links_in_messages", "SELECT o_orderkey, 'https://example.com/' || o_orderkey AS url FROM orders")
def message_links(t):
    key = F.col("o_orderkey").cast("string")
    text = F.concat(F.lit("see (https://example.com/"), key, F.lit(") and http://localhost:3000/x or ftp://example.com/"), key, F.lit("!"))
    return t.orders.select("o_orderkey", F.explode(exports.links_in_text(text)).alias("url"))
