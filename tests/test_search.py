"""The search in batch rounds against queues in Python."""

import random

from pyspark.sql import functions as F

from loomwork.operators import search as S


def searched(starts, links, results, enough, requests, seen, asked, best, extra=0):
    """One phase of one blog, a page at a time: (best, ended early); seen, asked and best go on from the phase before."""
    queues = [[], [], []]
    had = False
    for url, rank in starts:
        if url not in seen:
            seen.add(url)
            queues[rank].append(url)
            had = had or rank == 0
    while any(queues):
        page = next(q for q in queues if q).pop(0)
        asked.append(page)
        for url, rank in links.get(page, []):
            if rank < 2 and url not in seen:
                seen.add(url)
                queues[rank].append(url)
                had = had or rank == 0
        n = results.get(page)
        if n is not None and (best is None or n > best[0]):
            best = (n, page)
        if (had or len(asked) + extra >= requests) and not queues[0] and best and best[0] >= enough:
            break
    return best


def graphs(seed, blogs=12, pages=40):
    rng = random.Random(seed)
    ranks = {p: rng.choice([0, 1, 1, 2, 2]) for p in range(pages)}
    own = lambda b, p: 1 if b % 3 == 0 and ranks[p] == 0 else ranks[p]
    links = {(b, p): [(u, own(b, u)) for u in rng.sample(range(pages), rng.randint(0, 4))] for b in range(blogs) for p in range(pages)}
    results = {(b, p): rng.randint(1, 30) for b in range(blogs) for p in range(pages) if rng.random() < 0.3}
    starts = {(b, k): [(u, own(b, u)) for u in rng.sample(range(pages), rng.randint(0, 5))] for b in range(blogs) for k in (1, 2, 3)}
    return links, results, starts


def frames(spark, links, results, starts):
    rows = [(b, p, i, u, r) for (b, p), found in links.items() for i, (u, r) in enumerate(found)]
    a = spark.createDataFrame(rows, "blog int, page int, pos int, url int, rank int")
    b = spark.createDataFrame([(b, p, n) for (b, p), n in results.items()], "blog int, page int, n int")
    c = spark.createDataFrame([(b, k, i, u, r) for (b, k), found in starts.items() for i, (u, r) in enumerate(found)], "blog int, phase int, pos int, url int, rank int")
    return a, b, c


def test_rounds_equal_a_queue(spark):
    links, results, starts = graphs(1)
    a, b, c = frames(spark, links, results, starts)
    got = {r.blog: (r.n, r.url, r.requests) for r in S.search_rounds(c.where("phase = 1"), a, b, enough=24, requests=7).collect()}
    for blog in range(12):
        asked = []
        of = lambda d, blog=blog: {p: x for (k, p), x in d.items() if k == blog}
        best = searched([x for x in starts[blog, 1] if x[1] < 2], of(links), of(results), 24, 7, set(), asked, None)
        assert got.get(blog, (None, None, 0)) == (best[0] if best else None, best[1] if best else None, len(asked)), blog
    none = S.search_rounds(c.where("false"), a, b)
    assert none.count() == 0


def test_phases_equal_queues(spark):
    links, results, starts = graphs(2)
    a, b, c = frames(spark, links, results, starts)
    blogs = [(k, k % 4, k == 5) for k in range(12)]
    got = {r.blog: (r.phase, r.n, r.url, r.requests) for r in S.search_in_phases(spark.createDataFrame(blogs, "blog int, n_entries int, ends_early boolean"), c, a, b, enough=18, enough_in_phase=24, requests=9).collect()}
    ended = set()
    for blog, n_entries, early in blogs:
        of = lambda d, blog=blog: {p: x for (k, p), x in d.items() if k == blog}
        seen, asked, best, result = set(), [], None, None
        for phase in (1, 2, 3):
            if phase > 1 and (n_entries < 2 or phase == 3 and early):
                break
            own = [x for x in starts[blog, phase] if x[1] < (3 if phase == 3 else 2)]
            best = searched(own, of(links), of(results), 24, 9, seen, asked, best, 2 if phase > 1 else 0)
            if best:
                result = (phase, best[0], best[1], len(asked) + (2 if phase > 1 else 0))
                if best[0] >= 18:
                    break
        if result and n_entries < 2 and result[1] < 18:
            result = None
        assert got.get(blog) == result, blog
        ended.add(result and result[0])
    assert ended >= {1, 3, None}


def sequentially(candidates, outcomes):
    """The first candidate is looked at, and taken or put back before the first that is worse."""
    queue = [(True, n, c, 0) for c, n in candidates]
    put = []
    for x in queue:  # found one after another
        at = next((i for i, y in enumerate(put) if x[:2] > y[:2]), len(put))
        put.insert(at, x)
    while put:
        matches, n, c, step = put.pop(0)
        if step == 0:
            found = outcomes.get((c, 1))
        elif step == 1:
            found = outcomes.get((c, 2))
        else:
            found = (matches, n, False)
        if not found:
            continue
        if not put or found[:2] > put[0][:2] or (not found[2] and found[:2] == put[0][:2]):
            if found[2]:
                found = outcomes.get((c, 2))
                if not found:
                    continue
            return c, found[1], found[0]
        x = (found[0], found[1], c, 1 if step == 0 and found[2] else 2)
        at = next((i for i, y in enumerate(put) if x[:2] > y[:2]), len(put))
        put.insert(at, x)
    return None


def test_settled_equals_a_loop(spark):
    rng = random.Random(4)
    candidates = {b: [(100 * b + i, rng.randint(1, 6)) for i in range(rng.randint(1, 6))] for b in range(60)}
    outcomes = {}
    for own in candidates.values():
        for c, n in own:
            if rng.random() < 0.8:
                outcomes[c, 1] = (rng.random() < 0.7, max(0, n + rng.choice([-3, -1, 0, 0, 2])), rng.random() < 0.4)
            if rng.random() < 0.7:
                outcomes[c, 2] = (True, n + rng.choice([-2, 0, 1]), False)
    a = spark.createDataFrame([(b, c, i, n) for b, own in candidates.items() for i, (c, n) in enumerate(own)], "blog int, candidate int, pos int, n int")
    o = spark.createDataFrame([(c, s, *x) for (c, s), x in outcomes.items()], "candidate int, step int, matches boolean, n int, is_partial boolean")
    got = {r.blog: (r.candidate, r.n, r.matches) for r in S.settled(a, o).collect()}
    want = {b: sequentially(own, outcomes) for b, own in candidates.items()}
    assert got == {b: x for b, x in want.items() if x} and None in want.values()


def test_closer_looks(spark):
    candidates = spark.createDataFrame([(k, kind, 10) for k, kind in enumerate(["sorted", "long_feed", "shuffled", "shuffled", "categories", "pinned", "pinned", "page1", "page1", "categories"])], "candidate int, kind string, n int")
    tries = [(2, 1, 5, True, True), (2, 2, 8, True, False), (2, 3, 9, False, True), (2, 4, 12, True, True), (3, 1, 5, None, True), (3, 2, 6, True, True), (4, 1, 7, True, False), (5, 1, 7, True, True), (6, 1, 7, True, False), (9, 1, 3, False, True)]
    pages = [(7, 1, 20, True), (7, 2, 40, False), (0, 1, 99, True)]
    got = S.outcomes(candidates, spark.createDataFrame(tries, "candidate int, pos int, n int, sorts boolean, agrees boolean"), spark.createDataFrame(pages, "candidate int, step int, n int, is_partial boolean"))
    assert sorted(map(tuple, got.collect())) == [(0, 1, True, 10, False), (1, 1, True, 10, False), (2, 1, False, 8, False), (4, 1, False, 7, False), (5, 1, True, 7, False), (7, 1, True, 20, True), (7, 2, True, 40, False)]
    assert S.outcomes(candidates.where("false"), spark.createDataFrame(tries, "candidate int, pos int, n int, sorts boolean, agrees boolean"), spark.createDataFrame(pages, "candidate int, step int, n int, is_partial boolean")).count() == 0


def test_last_before_failure(spark):
    rows = spark.createDataFrame([("a", 1, True), ("a", 2, True), ("a", 3, False), ("a", 4, True), ("b", 1, False), ("c", 1, True), ("d", 1, None)], "k string, i int, ok boolean")
    assert sorted((r.k, r.i) for r in S.last_before_failure(rows, ["k"], ["i"], F.col("ok")).collect()) == [("a", 2), ("c", 1)]
