"""Paths of titles and dates on parsed pages."""

import pytest

from loomwork.operators import markup as M
from loomwork.sources import html_pages

POST = "<li><a href='/{k}'>{inner}</a>{beside}</li>"


def page(posts):
    return "<html><body><ul>" + "".join(POST.format(k=k, inner=i, beside=b) for k, i, b in posts) + "</ul></body></html>"


def induced(spark, groups, titles, distance=1):
    """groups: group -> posts. All links of a page are its group."""
    pages = spark.createDataFrame([(g, page(p)) for g, p in groups.items()], "page_id long, html string")
    links = html_pages.read_links(pages).selectExpr("page_id AS group", "page_id", "pos", "substring(href, 2) AS key", "xpath")
    found = M.title_paths(links, html_pages.read_elements(pages), spark.createDataFrame(titles, "key string, title string"), distance)
    return sorted((r.group, r.kind, r.rank, r.path) for r in found.collect())


def many(n, bad=0, wrap="{}", base="T"):
    return [(f"{base}{i}", wrap.format("other" if i < bad else f"{base} title {i}"), "") for i in range(n)], [(f"{base}{i}", f"{base} title {i}") for i in range(n)]


def test_own_text_with_each_tolerance(spark):
    groups, titles = {}, []
    for g, (n, bad) in enumerate([(8, 0), (8, 1), (9, 2), (9, 3), (52, 2), (53, 3), (53, 4)]):
        groups[g], more = many(n, bad, base=f"g{g}x")
        titles += more
    assert induced(spark, groups, titles) == [(g, "self", 0, "") for g in (0, 2, 4, 5)]


def test_children_and_neighbors(spark):
    groups, titles = {}, []
    groups[0], more = many(8, 0, "<img><b>{}</b> and more", "c")  # an element within the link
    titles += more
    groups[1], more = many(9, 2, "<i>2</i><span>x<em>{}</em></span>", "d")  # deeper, two of nine have another title: they don't contain the feed's, which is tolerated
    titles += more
    groups[2] = [(f"n{i}", "read on", f"<h2>n title {i}</h2><p>n title {i}</p>") for i in range(4)]  # two paths beside the link
    titles += [(f"n{i}", f"n title {i}") for i in range(4)]
    groups[3] = [(f"m{i}", "read on", f"<h2>m title {i}</h2>" if i else "<p>none</p>") for i in range(4)]  # one has no such element
    titles += [(f"m{i}", f"m title {i}") for i in range(4)]
    groups[4] = [(f"o{i}", "read on", f"<h2>{'o' if i else 'x'} title {i}</h2>") for i in range(4)]  # a neighbour with another title
    titles += [(f"o{i}", f"o title {i}") for i in range(4)]
    groups[5] = [(f"u{i}", f"u title {i}", "") for i in range(3)]  # not in the feed
    assert induced(spark, groups, titles) == [(0, "child", 0, "/b[1]"), (1, "child", 0, "/span[1]/em[1]"), (2, "neighbor", 0, "/../h2[1]"), (3, "neighbor", 0, "/../h2[1]")]
    assert induced(spark, {1: []}, titles) == []


@pytest.mark.parametrize("repeat", [1, 2])
def test_dates_beside_links(spark, repeat):
    def posts(g):
        inner = {0: "<time datetime='2020-01-0{i}'>then</time>", 1: "<p>May {i}, 2020</p>", 2: "<p>May {i}, 2020</p><time datetime='2020-01-0{i}'>then</time>", 3: "<p>May {i}</p><em>1{i}</em>", 4: "<p>none</p>"}[g]
        return [(f"{g}{i}", "x", inner.format(i=i) * repeat if g != 4 or i else "") for i in range(1, 4)]

    pages = spark.createDataFrame([(g, page(posts(g))) for g in range(5)], "page_id long, html string")
    links = html_pages.read_links(pages).selectExpr("page_id AS group", "page_id", "pos", "xpath")
    got = sorted(map(tuple, M.date_paths(links, html_pages.read_dates(pages), 1).collect()))
    if repeat == 1:
        assert got == [(0, "/../time[1]", "time", 1), (1, "/../p[1]/text()[1]", "text", 1), (2, "/../time[1]", "time", 2)]
    else:  # two of each: no way to choose
        assert got == []


def test_elements_and_dates_in_order(spark):
    html = "<html><head><meta name='dc.date.issued' content='2020-01-02'><meta property='article:published_time' content='2020-01-03'></head><body><p>On <b>May 3, 2020</b> it<br>was</p><time datetime='2020-01-04'>1 day</time></body>"
    pages = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")
    got = [(r.source, r.value, r.xpath) for r in html_pages.read_dates(pages).orderBy("page_id", "pos").collect()]
    assert got == [
        ("meta", "2020-01-02", "/html[1]/head[1]/meta[@name='dc.date.issued']"), ("meta", "2020-01-03", "/html[1]/head[1]/meta[@property='article:published_time']"),
        ("text", "May 3, 2020", "/html[1]/body[1]/p[1]/b[1]/text()[1]"), ("time", "2020-01-04", "/html[1]/body[1]/time[1]"), ("text", "1 day", "/html[1]/body[1]/time[1]/text()[1]"),
    ]
    texts = {r.xpath: r.text for r in html_pages.read_elements(pages).collect()}
    assert texts["/html[1]/body[1]/p[1]"] == "On May 3, 2020 it\nwas" and texts["/html[1]/body[1]/p[1]/text()[2]"] == " it" and texts["/html[1]/body[1]/p[1]/br[1]"] == ""
    assert {r.page_id for r in html_pages.read_elements(pages).collect()} == {1}


def test_paths_are_not_broadcast_by_the_size_of_their_file(spark):
    def broadcasts(df):
        return df._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin")

    pages = spark.createDataFrame([(g, page([(f"{g}k", "read on", f"<h2>title {g}</h2>")])) for g in range(5)], "page_id long, html string")
    links = html_pages.read_links(pages).selectExpr("page_id AS group", "page_id", "pos", "substring(href, 2) AS key", "xpath")
    titles = spark.createDataFrame([(f"{g}k", f"title {g}") for g in range(5)], "key string, title string")
    found = M.title_paths(links, html_pages.read_elements(pages), titles, 1)
    assert broadcasts(found) == 0 and sorted((r.group, r.kind, r.path) for r in found.collect()) == [(g, "neighbor", "/../h2[1]") for g in range(5)]
