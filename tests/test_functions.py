"""URL, title, date and schedule functions on cases of our own."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomwork.functions import dates as D
from loomwork.functions import schedule as S
from loomwork.functions import text as X
from loomwork.functions import urls as U
from loomwork.sources import feeds, html_pages
from loomwork.sources.exports import links_in_text, parsed_lines, read_messages, read_search_pages, replace_partitions

BASE = "https://blog.example.com/posts/one?x=1"
LINKS = [
    ("https://example.com/a", "https://example.com/a", "example.com/a"),
    ("HTTP://example.com/a", "http://example.com/a", "example.com/a"),
    ("ftp://example.com/a", None, None),
    ("mailto:a@example.com", None, None),
    ("two", "https://blog.example.com/posts/two", "blog.example.com/posts/two"),
    ("/two", "https://blog.example.com/two", "blog.example.com/two"),
    ("../up", "https://blog.example.com/up", "blog.example.com/up"),
    ("//other.com/b", "https://other.com/b", "other.com/b"),
    ("?page=2", "https://blog.example.com/posts/one?page=2", "blog.example.com/posts/one?page=2"),
    ("#top", "https://blog.example.com/posts/one?x=1", "blog.example.com/posts/one"),
    ("http://example.com:80/a", "http://example.com/a", "example.com/a"),
    ("https://example.com:443/a", "https://example.com/a", "example.com/a"),
    ("https://example.com:8080/a", "https://example.com:8080/a", "example.com:8080/a"),
    ("https://example.com/?page=1&utm=x&m=2", "https://example.com/?page=1&utm=x&m=2", "example.com/?m=2&page=1"),
    ("https://example.com/?page=", "https://example.com/?page=", "example.com/?page="),
    ("https://example.com/?page=3&page=4", "https://example.com/?page=3&page=4", "example.com/?page=3"),
    ("https://example.com/", "https://example.com/", "example.com"),
    ("https://example.com/a\nb", "https://example.com/ab", "example.com/ab"),
    (" %20https://example.com/a%0a\t", "https://example.com/a", "example.com/a"),
    ("https://example.com//a//b", "https://example.com/a/b", "example.com/a/b"),
    ("https://user:pw@example.com/", None, None),
    ("https:example.com", None, None),
    ("http://ex ample.com/", None, None),
    ("http://example.com:port/", None, None),
]


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in df.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


def test_canonical_links(spark):
    links = [x[0] for x in LINKS]
    got = column(spark, links, lambda v: U.canonical_link(v, F.lit(BASE)))
    assert got == [x[1] for x in LINKS]
    curis = column(spark, links, lambda v: U.canonical_string(U.canonical_uri(U.canonical_link(v, F.lit(BASE)))))
    assert curis == [x[2] for x in LINKS]


def test_uri_keys(spark):
    key = lambda v: U.uri_key(U.canonical_uri(v), ["a.com", "b.com"], expect_post_paths=True)
    got = column(spark, ["https://a.com/x/", "https://b.com/x", "https://c.com/x", "https://a.com/post/12/one", "https://b.com/post/12"], key)
    assert got[0] == got[1] != got[2] and got[3] == got[4]


def test_path_ladder_and_classes(spark):
    assert column(spark, ["https://e.com/a/b/?x=1"], U.path_ladder) == [["https://e.com/a/b", "https://e.com/a", "https://e.com"]]
    assert column(spark, ["/blog-archive", "/x/posts", "/journal.html", "/2020/05", "/2020/05/x"], U.path_class) == ["archives", "archives", "main", "post", "other"]
    assert [str(x) for x in column(spark, ["/2020/02/29/x", "/2021/02/29/x", "/2020/13/01/", "/2020/05/06"], U.url_date)] == ["2020-02-29", "None", "None", "None"]


def test_titles_and_slugs(spark):
    assert column(spark, ["  a \r\n b  c ", "", None], X.normalized_title) == ["a b c", "", None]
    assert column(spark, ["It’s “So”…"], X.equalized_title) == ["it's \"so\"..."]
    slugs = ["Post", "Two Words", "What's -- this?", "Привет", "x" * 120, " ".join("word%d" % i for i in range(15)), " ".join(["a" * 45] * 3)]
    assert column(spark, slugs, X.post_slug) == ["post", "two-words", "what-s-this", "", "x" * 100, "-".join("word%d" % i for i in range(10)), "-".join(["a" * 45] * 2)]


def test_guid_matches_the_known_hash(spark):
    assert column(spark, ["1-welcome"], X.guid)[0][:8] == "02d00b67"


def test_small_text_functions(spark):
    assert column(spark, [1, 2, 3, 4, 11, 112, 21], X.ordinal_suffix, "int") == ["st", "nd", "rd", "th", "th", "th", "st"]
    assert column(spark, ["10.20.30.40"], X.redacted_ip) == ["10.20.0.1"]
    assert column(spark, ["Feedly/1.0", "Mozilla inoreader.com; 1", "curl"], X.rss_client) == ["Feedly", "Inoreader", "curl"]
    assert column(spark, [0.9, 1.0, 7.0, 130.0, 320.0], X.nice_maximum, "double") == pytest.approx([1.0, 1.0, 10.0, 200.0, 500.0])
    agent = "Mozilla/5.0 (Windows NT 10.0; Win64) AppleWebKit/537.36 Chrome/120.0 Safari/537.36"
    got = column(spark, [agent, "Googlebot/2.1"], X.user_platform)
    assert (got[0]["browser"], got[0]["os_name"], got[0]["os_version"], got[0]["bot_name"]) == ("Chrome", "Windows", "10.0", None)
    assert (got[1]["browser"], got[1]["bot_name"]) == ("Crawler", "Googlebot")
    ids = column(spark, ["a", "b"], X.random_id)
    assert len(set(ids)) == 2 and all(len(i) == 22 for i in ids)


@settings(max_examples=20, deadline=None)
@given(titles=st.lists(st.text(max_size=40), min_size=1, max_size=10))
def test_title_functions_are_idempotent(spark, titles):
    for f in (X.normalized_title, X.equalized_title):
        once = column(spark, titles, f)
        assert column(spark, once, f) == once


def test_dates(spark):
    good = {
        "May 6, 2021": "2021-05-06", "6 May 2021": "2021-05-06", "6th of May, 2021": "2021-05-06", "2021.05.06": "2021-05-06", "Sept. 3 '21": "2021-09-03",
        "posted 2021-05-06 x": "2021-05-06", "Thu, 06 May 2021 10:00:00 GMT": "2021-05-06",
    }
    day_of = lambda texts, **more: column(spark, texts, lambda c: D.found_date(c, **more).cast("string"))
    assert day_of(list(good)) == list(good.values())
    bad = ["", "May", "5/6/2021", "May 2021", "May 32, 2021", "no digits", "May 6", "1" * 200, "30 Feb 2020", "Version 2.10.1", "20200506", "10:30", None]
    assert day_of(bad) == [None] * len(bad)
    assert day_of(["May 6"], year=F.lit(2020)) == ["2020-05-06"]


def test_schedule(spark):
    zone = "America/Los_Angeles"
    day = lambda v: F.date_format(S.run_time(v.cast("date"), zone), "yyyy-MM-dd HH:mm")
    # a plain day, and the days when clocks go forward and back: two hours after local midnight in absolute time
    assert column(spark, ["2022-05-03", "2022-03-13", "2022-11-06"], day) == ["2022-05-03 09:00", "2022-03-13 10:00", "2022-11-06 09:00"]
    run = lambda v: S.next_run(F.lit("2022-05-03").cast("date"), zone, v.cast("timestamp_ntz"))
    got = column(spark, ["2022-05-03 12:00:00", "2022-05-04 09:00:00", "2022-05-06 12:00:00"], run)
    assert [(str(r["day"]), r["skipped"]) for r in got] == [("2022-05-04", 0), ("2022-05-04", 0), ("2022-05-07", 3)]
    assert column(spark, ["2022-05-05"], lambda v: S.day_of_week(v.cast("date"))) == ["thu"]
    parsed = column(spark, ["Mon, 02 Jan 2006 15:04:05 -0700", "Mon, 2 Jan 2006 15:04:05 GMT", "soon"], S.parse_rfc1123)
    assert [str(x) for x in parsed] == ["2006-01-02 22:04:05", "2006-01-02 15:04:05", "None"]
    iso = column(spark, ["2006-01-02T15:04:05Z", "2006-01-02T15:04:05+02:00", "2006-01-02", "x"], S.parse_iso8601)
    assert [str(x) for x in iso] == ["2006-01-02 15:04:05", "2006-01-02 13:04:05", "2006-01-02 00:00:00", "None"]


def test_feeds():
    item = "<item><title>A &amp;amp; B</title>{}</item>"
    rss = "<rss><channel><title> My<br/>blog </title>{}</channel></rss>"
    burner = '<feedburner:origLink xmlns:feedburner="http://rssnamespace.org/feedburner/ext/1.0">https://a/1</feedburner:origLink><link>https://b/1</link>'
    assert feeds.parse(rss.format(item.format(burner)), "https://e.com/f")["entries"][0]["url"] == "https://a/1"
    assert feeds.parse(rss.format(item.format("<guid>https://g/1</guid>")), None)["entries"][0]["url"] == "https://g/1"
    assert feeds.parse(rss.format(item.format('<guid isPermaLink="false">7</guid>')), None)["error"] == "an entry has no link"
    assert feeds.parse(rss.format(item.format("<link>l</link>")), None)["entries"][0]["title"] == "A & B"
    assert feeds.parse("<rss><channel></channel></rss>", "https://e.com/f")["title"] == "e.com"
    assert feeds.parse("<html></html>", None)["error"] == "no feed"
    assert feeds.parse("\x0b<a", None)["error"].startswith("not XML")
    assert feeds.parse(None, None)["error"].startswith("not XML")


MALFORMED = [
    ("<rss><channel><title>a&nbsp;b</title><item><link>http://a/</link></item></channel></rss>", "a b", ["http://a/"]),
    ('<rss><channel><atom:link href="x"/><title>t</title><item><link>http://a/?a=1&b=2</link></item></channel></rss>', "t", ["http://a/?a=1&b=2"]),
    ("<rss><channel><title>x &bogus; y</title><item><link>http://a/</link></b></item><item><link>http://b/</link>", "x &bogus; y", ["http://a/", "http://b/"]),
    ("<rss><channel><title><![CDATA[a <b> & c]]></title><!-- & --><item><link>http://a/</link></item></channel></rss>&", "a <b> & c", ["http://a/"]),
]


@pytest.mark.parametrize("content,title,urls", MALFORMED)
def test_feeds_that_are_not_well_formed(content, title, urls):
    got = feeds.parse(content, None)
    assert (got["kind"], got["title"], [e["url"] for e in got["entries"]]) == ("rss", title, urls)


PATHS = [
    ("<ul><li><a href=1>a</a><li><a href=2>b</a></ul>", ["/ul[1]/li[1]/a[1]", "/ul[1]/li[2]/a[1]"]),
    ("<p><a href=1>a</a><p><a href=2>b</a><div><a href=3>c</a></div>", ["/p[1]/a[1]", "/p[2]/a[1]", "/div[1]/a[1]"]),
    ("<table><tr><td><a href=1>a</a><td><a href=2>b</a><tr><th><a href=3>c</a></table><a href=4>d", ["/table[1]/tbody[1]/tr[1]/td[1]/a[1]", "/table[1]/tbody[1]/tr[1]/td[2]/a[1]", "/table[1]/tbody[1]/tr[2]/th[1]/a[1]", "/a[1]"]),
    ("<dl><dt><a href=1>a</a><dd><a href=2>b</a><dt><a href=3>c</a></dl>", ["/dl[1]/dt[1]/a[1]", "/dl[1]/dd[1]/a[1]", "/dl[1]/dt[2]/a[1]"]),
    ("<ul><li><ul><li><a href=1>a</a></ul><li><a href=2>b</a></ul>", ["/ul[1]/li[1]/ul[1]/li[1]/a[1]", "/ul[1]/li[2]/a[1]"]),
    ("<html><head><title>t</title><body><a href=1>a</a>", ["/a[1]"]),
]


@pytest.mark.parametrize("markup,paths", PATHS)
def test_implied_tags(markup, paths):
    assert [x["xpath"] for x in html_pages._walked(markup).links] == ["/html[1]/body[1]" + p for p in paths]


def test_feed_links(spark):
    rows = [("http://a/feed", None, None, True), ("http://a/comments/feed/", None, None, False), ("http://a/comments/default", None, None, False), ("http://a/x/comments/y/feed", None, None, True), ("/feeds/posts/default?alt=rss", None, None, False), ("/any", "alternate", "application/rss+xml", True), ("/any", "next", "application/rss+xml", False), ("/all.atom.xml", None, None, True), ("/atom", None, None, False)]
    df = spark.createDataFrame(rows, "href string, rel string, kind string, want boolean")
    assert all(r.got == r.want for r in df.select("want", html_pages.is_feed_link(F.col("href"), F.col("rel"), F.col("kind")).alias("got")).collect())


def test_html_links(spark):
    html = "<html><body><div class='b a post-7'><a href='/x'>one</a><a href='/y'></a><a href='/z' aria-label='z'></a></div><p>3 May 2020<br><area href='/q'></body>"
    df = spark.createDataFrame([(1, html), (2, None), (3, "<<<")], "page_id long, html string")
    got = [(r.href, r.xpath) for r in html_pages.read_links(df).orderBy("page_id", "pos").collect()]
    assert got == [("/x", "/html[1]/body[1]/div[1]/a[1]"), ("/z", "/html[1]/body[1]/div[1]/a[3]"), ("/q", "/html[1]/body[1]/p[1]/area[1]")]
    assert [r.value for r in html_pages.read_dates(df).collect()] == ["3 May 2020"]


def test_exports(spark, tmp_path):
    (tmp_path / "a.json").write_text(
        '{"channel": {"id": "7", "categoryId": "3"}, "messages": [{"id": 1, "timestamp": "t", "content": "see https://e.com/a, http://localhost:1/x", "author": {"name": "n"}}]}'
    )
    rows = read_messages(spark, f"file://{tmp_path}/a.json").collect()
    assert [(r.url, r.message_id, r.thread_id, r.channel, r.author) for r in rows] == [("https://e.com/a", 1, "7", "3", "n")]
    (tmp_path / "b.json").write_text('{"hits": [{"created_at": "2020-01-02T03:04:05.000Z", "points": 5, "title": "t", "url": "u"}, {"points": 1, "url": null}]}')
    assert [tuple(r) for r in read_search_pages(spark, f"file://{tmp_path}/b.json").collect()] == [("u", "t", "2020-01-02 03:04:05", 5)]
    df = spark.createDataFrame([("a", 1), ("b", 2)], "channel string, x int")
    replace_partitions(df, f"file://{tmp_path}/out", "channel")
    replace_partitions(spark.createDataFrame([("b", 3)], "channel string, x int"), f"file://{tmp_path}/out", "channel")
    assert sorted((r.channel, r.x) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == [("a", 1), ("b", 3)]
    lines = parsed_lines(spark.createDataFrame([("https://a b\n\nbad",)], "text string")).collect()
    assert [(r.line_no, r.url, r.error) for r in lines] == [(1, "https://a", None), (3, None, "line 3 is not a url and a label")]
    assert column(spark, [None], links_in_text) == [None]
