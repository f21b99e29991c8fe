"""Sequence, diff, publication and stream operators on small cases."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from loomwork.operators import candidates, masks, paging, prefix_join, publishing, redirects, sequences, sets
from loomwork.streaming import events

T = [datetime(2022, 5, d) for d in range(1, 20)]


def feed_of(spark, buckets):
    rows = [("f", p, k, T[18 - b]) for p, (b, k) in enumerate((b, k) for b, keys in enumerate(buckets) for k in keys)]
    return spark.createDataFrame(rows or [("x", 0, "x", None)], "feed string, pos int, key string, at timestamp_ntz").where("feed = 'f'")


def list_of(spark, keys):
    return spark.createDataFrame([("f", i, k) for i, k in enumerate(keys)] or [("x", 0, "x")], "feed string, pos int, key string").where("feed = 'f'")


SUFFIX = [
    (["a", "b", "c"], "abc", 3), (["a", "b", "c"], "bc", 2), (["ab", "c"], "bc", 2), (["ab", "c"], "bac", 3), (["ab", "cd"], "bdc", 3), (["a", "b"], "bx", 1),
    (["a", "b", "c"], "ac", None), (["a", "b"], "x", None), (["ab", "cd"], "acb", None),
]


@pytest.mark.parametrize("buckets,listed,length", SUFFIX)
def test_suffix(spark, buckets, listed, length):
    rows = sequences.suffix_match(feed_of(spark, buckets), list_of(spark, listed)).collect()
    assert (rows[0].suffix_length if rows else None) == length


DIFFS = [
    ("no update", ["a", "b", "c"], "abc", "", "", ("ok", [])),
    ("good update", ["n", "a", "b", "c"], "abc", "", "", ("ok", ["n"])),
    ("small overlap", ["n", "m", "a", "b"], "ab", "", "", ("no_match", [])),
    ("drastic change", ["x", "y", "z", "w"], "abc", "", "", ("no_match", [])),
    ("shuffled end", ["n", "b", "a", "c"], "abc", "", "", ("no_match", [])),
    ("equal times in new", ["nm", "a", "b", "c"], "abc", "", "", ("ok", ["n", "m"])),
    ("equal times at the boundary", ["na", "b", "c"], "abc", "", "", ("ok", ["n"])),
    ("equal times in old", ["n", "ba", "c"], "abc", "", "", ("ok", ["n"])),
    ("discarded", ["n", "d", "a", "b", "c"], "abc", "d", "", ("ok", ["n"])),
    ("missing", ["n", "a", "b", "c"], "abmc", "", "m", ("ok", ["n"])),
]


@pytest.mark.parametrize("name,buckets,existing,discarded,missing,want", DIFFS)
def test_feed_diff(spark, name, buckets, existing, discarded, missing, want):
    rows = sequences.feed_diff(feed_of(spark, buckets), list_of(spark, existing), list_of(spark, discarded), list_of(spark, missing)).orderBy("pos").collect()
    assert rows[0].status == want[0] and [r.key for r in rows if r.key is not None] == want[1]


def test_match_except_first(spark):
    rows = sequences.match_except_first(feed_of(spark, ["p", "a", "b"]), list_of(spark, "ab")).collect()
    assert [r.first_key for r in rows] == ["p"]


def test_masks(spark):
    df = spark.createDataFrame([("/a[1]/b[2]/c[3]",)], "p string")
    got = df.select(*[masks.masks(masks.segments(F.col("p")), n).alias(f"m{n}") for n in (1, 2, 3)]).first()
    assert got.m1 == ["/a[*]/b[2]/c[3]", "/a[1]/b[*]/c[3]", "/a[1]/b[2]/c[*]"]
    assert got.m2 == ["/a[*]/b[*]/c[3]", "/a[*]/b[2]/c[*]", "/a[1]/b[*]/c[*]"] and got.m3 == ["/a[*]/b[*]/c[*]"]


def test_prefix_join_equals_brute_force(spark):
    strings, roots = ["e.com/blog/a", "e.com/blo", "e.com", "x", "", None, "e.community"], ["e.com", "e.com/blog", "e.com/b", ""]
    df, other = spark.createDataFrame([(s,) for s in strings], "s string"), spark.createDataFrame([(r,) for r in roots], "r string")
    got = {r.s: r.root for r in prefix_join.longest_prefix(df, "s", other.withColumnRenamed("r", "root"), "root").collect()}
    assert got == {s: max((r for r in roots if s is not None and s.startswith(r)), key=len, default=None) for s in strings}
    path = {r.s: r.root for r in prefix_join.longest_prefix(df, "s", other.withColumnRenamed("r", "root"), "root", "path").collect()}
    assert path["e.com/blog/a"] == "e.com/blog" and path["e.com/blo"] == "e.com" and path["e.community"] is None


def test_redirects_and_cycles(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 12)] + [(50, 51), (51, 50)], "source int, target int")
    got = {r.start: (r.target, r.hops, r.is_cycle) for r in redirects.resolved(spark.createDataFrame([(1,), (12,), (50,), (7,)], "start int"), edges).collect()}
    assert got[1] == (12, 11, False) and got[12] == (12, 0, False) and got[7] == (12, 5, False) and got[50][2]


def test_null_aware_anti(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    k = lambda *v: spark.createDataFrame([(x,) for x in v], "k int")
    ids = lambda d: [r.k for r in sets.null_aware_anti(df, d, "k").collect()]
    assert ids(k(1, None)) == [] and ids(k(1)) == [2] and sorted(map(str, ids(k(1).where("false")))) == ["1", "2", "None"]


def model(spark, n_posts, published, paused=False, per_day=2):
    subs = spark.createDataFrame([(1, 9, paused, datetime(2022, 5, 1))], "sub_id long, user_id long, is_paused boolean, set_up_at timestamp_ntz")
    rows = [(1, i, 100 + i, datetime(2022, 5, 1) if i < published else None) for i in range(n_posts)]
    posts = spark.createDataFrame(rows or [(2, 0, 0, None)], "sub_id long, index long, post_id long, published_at timestamp_ntz")
    schedule = spark.createDataFrame([(1, "tue", per_day), (1, "wed", 0)], "sub_id long, day_of_week string, count int")
    return subs, posts, schedule


CASES = [
    # posts, published, paused, day: new posts, final, items in the feed
    (5, 1, False, date(2022, 5, 3), [1, 2], False, ["new", "new", "old", "welcome"]),
    (3, 1, False, date(2022, 5, 3), [1, 2], True, ["final", "new", "new", "old", "welcome"]),
    (5, 1, True, date(2022, 5, 3), [], False, ["old", "welcome"]),
    (5, 1, False, date(2022, 5, 4), [], False, ["old", "welcome"]),
    (40, 35, False, date(2022, 5, 3), [35, 36], False, ["new", "new"] + ["old"] * 28),
    (36, 35, False, date(2022, 5, 3), [35], True, ["final", "new"] + ["old"] * 28),
    (29, 28, False, date(2022, 5, 4), [], False, ["old"] * 28 + ["welcome"]),
]


@pytest.mark.parametrize("n,published,paused,day,new,final,kinds", CASES)
def test_publication(spark, n, published, paused, day, new, final, kinds):
    subs, posts, schedule = model(spark, n, published, paused)
    due = publishing.due_posts(subs, posts, schedule, F.lit(day))
    assert sorted(r["index"] for r in due.collect()) == new
    assert publishing.finishing(subs, posts, due).first().is_final == final
    feed = publishing.subscription_feed(subs, posts, due, F.lit(datetime(2022, 5, 3, 9)))
    assert [r.kind for r in feed.orderBy("position").collect()] == kinds


def test_versions(spark):
    stored = spark.createDataFrame([(1, 3), (2, 1)], "k int, version int")
    fresh = spark.createDataFrame([(1, 2), (2, 4), (3, 1)], "k int, version int")
    assert sorted(tuple(r) for r in sets.versioned_upsert(stored, fresh, ["k"], "version").collect()) == [(1, 3), (2, 4), (3, 1)]
    history = spark.createDataFrame([("a", 1), ("a", 1_000_000), ("b", 1_000_000)], "k string, version int")
    assert sorted(tuple(r) for r in sets.demoted_versions(history, "k", "version").collect()) == [("a", 1), ("a", 2), ("b", 1)]


def test_archives(spark):
    from loomwork.operators import archives

    feed = spark.createDataFrame([("f", i, k, T[18 - i]) for i, k in enumerate("abcde")], "feed string, pos int, key string, at timestamp_ntz")
    whole = "abcdefgh"
    lists = {1: whole, 2: whole[::-1], 3: whole[1:], 4: "abdefgh", 5: "cdefgh", 6: "abcd", 7: "hbcdefga"}
    days = {k: T[18 - i] for i, k in enumerate(whole)}
    rows = [(n, "f", i, k, days[k] if n == 7 else None) for n, keys in lists.items() for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "list int, feed string, pos int, key string, day timestamp_ntz")
    got = {(r.list, r.kind, r.n) for r in archives.archive_matches(df, feed).collect()}
    assert got == {(1, "sorted", 8), (2, "reverse", 8), (3, "except_first", 7), (4, "pinned", 7), (7, "by_date", 8)} | {(6, "pinned", 4)}
    plan = archives.best_archives(df, feed)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 5  # lists, feeds, their join, and the best of each feed
    best = archives.best_archives(df, feed).collect()
    assert [(r.list, r.kind) for r in best] == [(1, "sorted")]
    heads = spark.createDataFrame([(5, 0, "a"), (5, 1, "b"), (1, 0, "a")], "list int, pos int, key string")
    assert [(r.list, r.n) for r in archives.two_part_lists(heads, df.where("list IN (1, 5)"), feed).collect()] == [(5, 8)]


def test_long_chains_and_cycles(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(200, 201), (201, 200)], "source int, target int")
    got = {r.start: (r.target, r.hops, r.is_cycle) for r in redirects.resolved(spark.createDataFrame([(0,), (37,), (200,)], "start int"), edges).collect()}
    assert got[0] == (100, 100, False) and got[37] == (100, 63, False) and got[200][2]


def test_feed_diff_shuffles_each_input_once(spark):
    f = feed_of(spark, ["n", "a", "b", "c"])
    plan = sequences.feed_diff(f, list_of(spark, "abc"), list_of(spark, "d"), list_of(spark, "m"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 8 and plan.count("Window") == 0


def test_upserts_that_count(spark):
    stored = spark.createDataFrame([(1, 2), (2, 5), (3, 5)], "id int, version int")
    sent = spark.createDataFrame([(1, None), (2, 6), (3, 5), (4, 9)], "id int, version int")
    got = {r.id: (r.version, r.updated) for r in sets.counted_upsert(stored, sent, "id", "version").collect()}
    assert got == {1: (3, True), 2: (6, True), 3: (5, False), 4: (1, True)}


def test_status_after_done_stays(spark):
    rows = [("a", 1, T[0], False), ("a", 2, T[1], True), ("a", 3, T[2], True), ("a", 4, T[3], False), ("b", 5, T[0], None), ("b", 6, T[0], None), (None, 7, T[0], True)]
    frame = lambda some: spark.createDataFrame(some, "user_id string, event_id long, ts timestamp, done boolean")
    want = {("a", 2, True), ("b", 6, False), (None, 7, True)}
    show = lambda df: {(r.user_id, r.event_id, r.done) for r in df.collect()}
    assert show(events.final_status(frame(rows))) == want
    for cut in range(len(rows) + 1):  # a snapshot of any part, and a stream with any overlap, give the same
        both = events.final_status(frame(rows[:cut])).unionByName(events.final_status(frame(rows[max(cut - 2, 0) :])))
        assert show(events.final_status(both)) == want
    assert events.final_status(frame([])).count() == 0


def test_list_is_read_anew_for_each_batch(spark, tmp_path):
    for n in range(3):
        data = [(10 * n + u, T[n], u, "view", 0.0, "{}") for u in (1, 2)]
        spark.createDataFrame(data, events.SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    reads = []

    def listed():  # a key is added with each read
        reads.append(len(reads))
        return spark.createDataFrame([(u,) for u in range(1, len(reads))], "user_id long")

    stream = events.read_events(spark, str(tmp_path / "in"), "*.parquet", 1)
    got = events.run_available(stream, str(tmp_path / "out"), step=events.without_listed(listed, "user_id"))
    assert sorted((r.batch, r.user_id) for r in got.collect()) == [(0, 1), (0, 2), (1, 2)]


TITLES = [
    (["Blog: one - me", "Blog: two - me"], "Blog: ", " - me"), (["one... - me", "two... - me"], "", " - me"), (["one… - me", "two… - me"], "", " - me"),
    (["only"], "", ""), (["aa", "aaa"], "", ""), (["éa", "èb"], "", ""), (["aé", "bè"], "", ""), (["xéaü", "xébü"], "xé", "ü"), (["", "a"], "", ""), ([None], "", ""), ([None, "pas", "pbs"], "p", "s"),
]


def test_title_ends(spark):
    rows = [(n, x) for n, (titles, _, _) in enumerate(TITLES) for x in titles]
    got = {r.n: (r.prefix, r.suffix) for r in candidates.title_ends(spark.createDataFrame(rows, "n int, title string"), ["n"]).collect()}
    assert got == {n: (prefix, suffix) for n, (_, prefix, suffix) in enumerate(TITLES)}
    assert candidates.title_ends(spark.createDataFrame([], "n int, title string"), ["n"]).count() == 0


#: blog: links of its first page, whether it pages by dates, and (kind, prefix, suffix, is_certain) of its template
FIRST_PAGES = [
    (["http://www.a/page/2", "http://a/page/2/", "http://b/page2"], False, ("path", "/page/", "", True)),
    (["http://a/x/index-2.html", "http://a/2"], False, ("path", "/x/index-", ".html", True)),
    (["http://a/page/22", "http://a/l?page=2", "http://a/2"], False, ("query", "/l", None, True)),
    (["http://a/l?page=2&page=2", "http://a/2020/2"], False, ("path", "/2020/", "", False)),
    (["http://a/page/2", "http://a/y/page/2"], False, None), (["http://b/page/2", None, "", "nothing"], False, None),
    (["http://a/page/2", "http://a/search?updated-max=2020"], True, ("dated", None, None, True)),
    (["http://a/search?updated-max=2019", "http://a/search?updated-max=2020"], True, None),
    (["http://a/page/2", "http://a/search?updated-max=2020"], False, ("path", "/page/", "", True)),
]
LINKS = "blog int, page int, page_url string, pos int, url string, in_head boolean"


def test_page_templates(spark):
    rows = [(n, 1, "http://a/", pos, u, False) for n, (urls, _, _) in enumerate(FIRST_PAGES) for pos, u in enumerate(urls)]
    dated = spark.createDataFrame([(n,) for n, (_, by_date, _) in enumerate(FIRST_PAGES) if by_date] * 2, "blog int")
    found = paging.page_templates(spark.createDataFrame(rows, LINKS), dated)
    got = {r.blog: (r.kind, r.prefix, r.suffix, r.is_certain) for r in found.collect()}
    assert got == {n: want for n, (_, _, want) in enumerate(FIRST_PAGES) if want}
    assert paging.page_templates(spark.createDataFrame([], LINKS), dated).count() == 0
    at = "http://a/search?updated-max=2020"
    pages = [(0, 2, "http://a/page/2", 0, "http://a/page/3", False), (0, 2, "http://a/page/2", 1, "http://a/page/1", False), (2, 2, "http://a/l?page=2", 0, "http://a/l?page=3", False)]
    pages += [(6, 2, at, pos, f"http://a/search?updated-max={y}", head) for pos, (y, head) in enumerate([(2021, False), (2019, True), (2018, False)])]
    df = spark.createDataFrame(pages, LINKS)
    after = paging.next_page_links(df, df.select("blog", "page").distinct().withColumn("number", F.lit(2)), found)
    assert sorted((r.blog, r.url) for r in after.collect()) == [(0, "http://a/page/3"), (2, "http://a/l?page=3"), (6, "http://a/search?updated-max=2018")]


def test_accepted_results(spark):
    rows = [(1, 1, 11), (1, 2, 30), (2, 1, 4), (2, 2, 12), (2, 3, 40), (3, 1, 4), (3, 2, 4), (3, 3, 3), (4, 1, 4), (4, 3, 20), (5, 1, 10), (5, 2, 20), (6, 1, 11), (7, 3, 2)]
    blogs = [(b, 1 if b in (5, 6) else 2, b == 4) for b in range(1, 9)]
    got = paging.accepted_results(spark.createDataFrame(rows, "blog int, phase int, n int"), spark.createDataFrame(blogs, "blog int, n_entries int, ends_early boolean"))
    assert sorted(map(tuple, got.collect())) == [(1, 1, 11), (2, 2, 12), (3, 1, 4), (4, 1, 4), (6, 1, 11), (7, 3, 2)]


def test_feeds_of_equal_times_are_turned(spark):
    a, b, c = (datetime(2020, 1, d) for d in (1, 2, 3))
    feeds = {1: [a, a, a], 2: [a], 3: [a, a, b], 4: [b, a, a], 5: [a, c, b, c], 6: [a, None, a]}
    rows = [(f, i, f"{f}{i}", t) for f, times in feeds.items() for i, t in enumerate(times)]
    got = sequences.reversed_if_ascending(spark.createDataFrame(rows, "feed int, pos int, key string, at timestamp_ntz")).orderBy("feed", "pos").collect()
    assert [r.key for r in got] == ["12", "11", "10", "20", "32", "31", "30", "40", "41", "42", "51", "53", "52", "50", "60", "61", "62"]
