"""Chains of pages against a walk from page to page."""

import random

from loomwork.operators import chains as C


def test_chains_equal_a_walk(spark):
    rng = random.Random(3)
    nexts, firsts, pages = [], [], []
    for blog in range(40):
        n = rng.choice([1, 2, 3, 9, 70])
        there = [p for p in range(n) if p == 0 or rng.random() < 0.97]
        pages += [(blog, p) for p in there]
        firsts.append((blog, 0))
        for p in there:
            if p + 1 < n:
                nexts.append((blog, p, p + 1))
                if rng.random() < 0.02:
                    nexts.append((blog, p, 0))
            elif rng.random() < 0.3:
                nexts.append((blog, p, rng.randrange(n)))
    firsts.append((99, 5))  # isn't there
    frame = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{x} int" for x in names.split()))
    numbers, ends = C.page_chains(frame(firsts, "blog page"), frame(nexts, "blog page target"), frame(pages, "blog page"))
    got, end = {}, {r.blog: (r.end, r.n_pages) for r in ends.collect()}
    for r in numbers.collect():
        got.setdefault(r.blog, {})[r.number] = r.page
    for blog in range(40):
        chain = [0]
        while True:
            targets = {t for b, p, t in nexts if (b, p) == (blog, chain[-1])}
            if len(targets) != 1:
                want = "ambiguous" if targets else "last"
                break
            (to,) = targets
            if (blog, to) not in set(pages):
                want = "broken"
                break
            if to in chain:
                want = "cyclic"
                break
            chain.append(to)
        assert end[blog] == (want, len(chain)) and got[blog] == dict(enumerate(chain, 1)), blog
    assert 99 not in end and {e for e, _ in end.values()} == {"last", "ambiguous", "broken", "cyclic"}


def test_long_chains_and_none(spark):
    long = spark.range(500).selectExpr("1 AS blog", "id AS page", "id + 1 AS target")
    first = spark.createDataFrame([(1, 0)], "blog int, page long")
    numbers, ends = C.page_chains(first, long.where("page < 499"), long.select("blog", "page"))
    assert numbers.where("number = page + 1").count() == 500 and [tuple(r) for r in ends.collect()] == [(1, "last", 500)]
    _, ends = C.page_chains(first, long.where("page < 499"), long.select("blog", "page"), most_pages=100)
    assert ends.first().end == "cyclic"
    numbers, ends = C.page_chains(first.where("false"), long, long.select("blog", "page"))
    assert numbers.count() == 0 and ends.count() == 0


def test_stitched(spark):
    entries = [(b, p, i, 10 * p + i) for b in range(6) for p in range(3) for i in range(3)]
    entries = [e for e in entries if e[:2] not in ((4, 1), (4, 2))] + [(1, 1, 3, 2)]  # blog 1's second page repeats a link
    nexts = [(b, p, p + 1) for b in (0, 1, 2, 3) for p in range(2)] + [(3, 2, 0), (5, 0, 1), (5, 0, 2)]
    feed = [(b, i, k if (b, i) != (2, 4) else 99, None) for b in range(6) for i, k in enumerate([0, 1, 2, 10, 11])]
    got = C.stitched(
        spark.createDataFrame([(b, 0) for b in range(6)], "blog int, page int"), spark.createDataFrame(nexts, "blog int, page int, target int"),
        spark.createDataFrame(entries, "blog int, page int, pos int, key int"), spark.createDataFrame(feed, "feed int, pos int, key int, at timestamp"),
    )
    assert sorted(map(tuple, got.collect())) == [(0, "whole", 3, 9), (1, "overlap", 3, 10), (2, "not_feed", 3, 9), (3, "too_long", 3, 9), (4, "single", 1, 3), (5, "ambiguous", 1, 3)]


def test_links_behind_the_front_are_only_counted(spark, monkeypatch):
    kept = {}

    def spied(df, name, staged=C.staged):
        kept[name] = staged(df, name)
        return kept[name]

    monkeypatch.setattr(C, "staged", spied)
    frame = spark.createDataFrame
    entries = frame([(1, p, i, p * 10 + i) for p in range(1, 7) for i in range(4)], "blog long, page long, pos int, key long")
    nexts = frame([(1, p, p + 1) for p in range(1, 6)], "blog long, page long, target long")
    feed = frame([(1, i, 10 + i, None) for i in range(3)], "feed long, pos int, key long, at timestamp")
    got = C.stitched(frame([(1, 1)], "blog long, page long"), nexts, entries, feed).collect()
    assert [tuple(r) for r in got] == [(1, "whole", 6, 24)] and kept["entries"].count() == 8
