"""Lists that hold a feed in any order, against a loop over lists."""

import random

from loomwork.functions.text import archives_threshold
from loomwork.operators import archives as A


def enough(n):
    return n if n <= 3 else n - 1 if n <= 7 else n - 2 if n <= 25 else n - 3 if n <= 62 else n - 7


def looked_at(lists, feed, on_page, known):
    """What one page shows: lists by (stars, number)."""
    feed, out = set(feed), []
    least, dated = (known[0] + 1, known[1]) if known else (1, False)
    if feed and len(feed) >= least:
        for stars in (1, 2, 3):
            best = None
            for (s, _), keys in sorted(lists.items()):
                if s == stars and len(keys) < len(feed) and len(keys) >= enough(len(feed)) and len(set(keys) & feed) >= enough(len(feed)) and set(keys) <= feed and (best is None or len(keys) > best):
                    best = len(set(keys))
            if best is not None:
                out.append(("almost_feed", stars, None, len(feed)))
                least, dated = len(feed) + 1, False
                break
    for kind in ("shuffled", "shuffled_almost"):
        for stars in (1, 2, 3):
            best = None
            for (s, number), keys in sorted(lists.items()):
                n_in = len(set(keys) & feed)
                has = n_in == len(feed) if kind == "shuffled" else enough(len(feed)) <= n_in < len(feed)
                if s == stars and feed and not dated and has and len(keys) >= len(feed) and len(keys) >= least and (best is None or len(keys) > best[1]):
                    best = (number, len(set(keys)))
            if best:
                out.append((kind, stars, *best))
                least = best[1] + 1
    if len(feed) >= 31 and len(feed) >= least and feed <= set(on_page):
        out.append(("long_feed", None, None, len(feed)))
    return out or [("none", None, None, None)]


def test_unordered_matches(spark):
    rng = random.Random(8)
    lists, feeds, on_page, known = {}, {}, {}, {}
    for p in range(150):
        n = rng.choice([0, 1, 3, 5, 10, 30, 31, 40])
        feeds[p] = [f"f{i}" for i in range(n)]
        lists[p] = {}
        for number in range(rng.randint(0, 6)):
            kept = [k for k in feeds[p] if rng.random() < rng.choice([1, 1, 0.95, 0.6])]
            more = [f"x{i}" for i in range(rng.choice([0, 0, 1, 3, 12]))]
            keys = kept + more + rng.choices(kept, k=rng.choice([0, 0, 2])) if kept else more
            rng.shuffle(keys)
            if keys:
                lists[p][rng.choice([1, 2, 3]), number] = keys
        on_page[p] = [k for keys in lists[p].values() for k in keys] + [k for k in feeds[p] if rng.random() < rng.choice([1, 0.5])] + ["home"]
        if rng.random() < 0.3:
            known[p] = (rng.choice([2, 8, 35]), rng.random() < 0.5)
    got = {}
    rows = A.unordered_matches(
        spark.createDataFrame([(p, s, m, i, k) for p, own in lists.items() for (s, m), keys in own.items() for i, k in enumerate(keys)] + [(0, 1, 99, 0, None)], "page int, stars int, list long, pos int, key string"),
        spark.createDataFrame([(p, k) for p, keys in feeds.items() for k in keys], "page int, key string"),
        spark.createDataFrame([(p, k) for p, keys in on_page.items() for k in keys], "page int, key string"),
        spark.createDataFrame([(p, *x) for p, x in known.items()], "page int, n int, dated boolean"),
        archives_threshold,
    )
    for r in sorted(rows.collect(), key=lambda r: (r.page, r.seq)):
        got.setdefault(r.page, []).append((r.kind, r.stars, r.list, r.n))
    want = {p: looked_at(lists[p], feeds[p], on_page[p], known.get(p)) for p in range(150)}
    assert got == want
    assert {x[0] for found in want.values() for x in found} == {"almost_feed", "shuffled", "shuffled_almost", "long_feed", "none"}
