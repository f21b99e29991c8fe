"""Search for the page with a blog's whole history, for all blogs at once, in batch rounds over tables of pages and links.

A blog's queue has three ranks: links to archives, to main pages, to other pages; the first rank that is not empty is asked first, each in the order in which its
links were found. All waiting archives are asked in one round, as nothing of a lower rank can come between them; of lower ranks one page a
round. The queue of all blogs is one table (blog, url, rank, seq, phase, round, n), written anew each round: `round` is null while a link waits, `n` is the length of the history
found on its page. Links stay in that table; the driver sees only whether any blog goes on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.sources.storage import dropped, staged

#: A history of so many links ends a phase once its archives are done, or so many requests; of so many ends the search after its phase.
ENOUGH_IN_PHASE, MOST_REQUESTS, ENOUGH = 21, 60, 11
ARCHIVES, MAIN, OTHER = 0, 1, 2
STATE = ["blog", "url", "rank", "seq", "phase", "round", "n"]
ROUND_BITS = 40  #: places of a link within its round


def _added(state: DataFrame | None, links: DataFrame, results: DataFrame, phase: int, turn: int) -> DataFrame:
    """The links (blog, url, rank, pos) that the state doesn't have yet, each once, as rows of the state."""
    first = links.groupBy("blog", "url").agg(F.min(F.struct("pos", "rank")).alias("f")).select("blog", "url", "f.rank", "f.pos")
    if state is not None:
        first = first.join(state.select("blog", "url"), ["blog", "url"], "left_anti")
    seq = F.lit(turn << ROUND_BITS) + F.row_number().over(Window.partitionBy("blog").orderBy("pos", "url"))
    rows = first.withColumns({"seq": seq, "phase": F.lit(phase), "round": F.lit(None).cast("int")})
    keys = ["blog", "url"] if "blog" in results.columns else ["url"]
    return rows.join(results.withColumnRenamed("page", "url").select(*keys, "n"), keys, "left").select(*STATE)


def _progress(state: DataFrame, phase: int, extra: int) -> DataFrame:
    """(blog, requests, best, next, waits_for_archives, had_archives): best is struct(minus_n, round, seq, url)."""
    asked = F.col("round").isNotNull()
    return state.groupBy("blog").agg(
        (F.count("round") + extra).alias("requests"),
        F.min(F.when(asked & F.col("n").isNotNull(), F.struct((-F.col("n")).alias("minus_n"), "round", "seq", "url"))).alias("best"),
        F.min(F.when(~asked, F.struct("rank", "seq"))).alias("next"),
        F.coalesce(F.bool_or(~asked & (F.col("rank") == ARCHIVES)), F.lit(False)).alias("waits_for_archives"),
        F.coalesce(F.bool_or((F.col("rank") == ARCHIVES) & (F.col("phase") == phase)), F.lit(False)).alias("had_archives"),
        F.max("round").alias("last"),
    )


def _phase(state: DataFrame, links: DataFrame, results: DataFrame, phase: int, turn: int, enough: int, requests: int, extra: int = 0) -> tuple[DataFrame, int]:
    """Rounds until every blog has asked all its links or found enough. state: staged, and dropped; the state after the last round and its number."""
    while True:
        begun = turn
        now = _progress(state, phase, extra)
        found = (F.col("had_archives") | (F.col("requests") >= requests)) & ~F.col("waits_for_archives") & (-F.col("best.minus_n") >= enough)
        going = now.where(F.col("next").isNotNull() & ~F.coalesce(found, F.lit(False))).select("blog", "next")
        waiting = state.where("round IS NULL").join(going, "blog")
        turns = waiting.where((F.col("rank") == F.col("next.rank")) & ((F.col("rank") == ARCHIVES) | (F.col("seq") == F.col("next.seq"))))
        picked = staged(turns.select("blog", "url", F.col("seq").alias("_at")), "picked")
        if not picked.take(1):
            dropped(picked)
            return state, begun
        turn += 1
        # links of pages asked earlier come first; a page's own links are in order of their places
        shown = links.join(picked.select("blog", F.col("url").alias("page"), "_at"), ["blog", "page"])
        new = _added(state, shown.select("blog", "url", "rank", F.struct("_at", "pos").alias("pos")), results, phase, turn)
        asked = state.join(picked.select("blog", "url", F.lit(turn).alias("_turn")), ["blog", "url"], "left").withColumn("round", F.coalesce("round", "_turn")).select(*STATE)
        after = staged(asked.unionByName(new), "search")
        dropped(state, picked)
        state = after


def _best(state: DataFrame, phase: int, extra: int = 0) -> DataFrame:
    """(blog, phase, url, n, requests): what the blogs of the state have found so far."""
    rows = _progress(state, phase, extra)
    return rows.select("blog", F.lit(phase).alias("phase"), "best.url", (-F.col("best.minus_n")).alias("n"), "requests")


def search_rounds(starts: DataFrame, links: DataFrame, results: DataFrame, enough: int = ENOUGH_IN_PHASE, requests: int = MOST_REQUESTS) -> DataFrame:
    """(blog, url, n, requests): the page with the longest history that each blog's search comes to, null without any, and how many pages it asked for.

    starts (blog, pos, url, rank): where a search begins. links (blog, page, pos, url, rank): the pages' links to allowed hosts. results (page, n, or blog, page, n): the length of the history on
    a page, one row each. The search of a blog ends when no archives wait and it has had some, or asked for `requests` pages, and the best history has `enough` links; else when nothing waits.
    Of equally long histories the one found first counts. Links of rank OTHER are not followed. A page without links or result counts as asked for.
    """
    links, results = staged(links.where(F.col("rank") < OTHER), "links"), staged(results, "results")  # read in every round
    state, _ = _phase(staged(_added(None, starts.where(F.col("rank") < OTHER), results, 1, 0), "search"), links, results, 1, 0, enough, requests)
    dropped(links, results)
    return _best(state, 1).drop("phase")


def search_in_phases(blogs: DataFrame, starts: DataFrame, links: DataFrame, results: DataFrame, enough: int = ENOUGH, enough_in_phase: int = ENOUGH_IN_PHASE, requests: int = MOST_REQUESTS) -> DataFrame:
    """(blog, phase, url, n, requests): the search in three phases, each from more links; a blog ends with the first phase whose best history has `enough` links.

    blogs (blog, n_entries, ends_early). starts (blog, phase, pos, url, rank): phase 1 begins with the start page's links, phase 2 with those common to two entries (two more requests), phase
    3 with other links too, of rank OTHER. A feed of fewer than two entries has only the first phase, and fails without enough; where ends_early there is no third. A
    blog that never has enough ends with the best it found; without any it has no row.
    """
    links, results = staged(links.where(F.col("rank") < OTHER), "links"), staged(results, "results")  # read in every round
    state, turn, ended = None, 0, None
    for phase in (1, 2, 3):
        extra = 0 if phase == 1 else 2
        own = starts.where(F.col("phase") == phase).where(F.col("rank") <= (OTHER if phase == 3 else MAIN))
        if phase > 1:  # blogs that go on
            on = blogs.where("n_entries >= 2" + (" AND NOT ends_early" if phase == 3 else "")).select("blog").join(ended.where(F.col("n") >= enough).select("blog"), "blog", "left_anti")
            own = own.join(on, "blog", "left_semi")
        turn += 1
        new = _added(state, own.select("blog", "url", "rank", F.col("pos").cast("long").alias("pos")), results, phase, turn)
        if phase > 1:
            new = state.join(on, "blog", "left_semi").unionByName(new)
        before = state
        state, turn = _phase(staged(new, "search"), links, results, phase, turn, enough_in_phase, requests, extra)
        if before is not None:
            dropped(before)
        found = staged(_best(state, phase, extra).where("n IS NOT NULL"), "found")
        ended = found if ended is None else ended.join(found, "blog", "left_anti").unionByName(found)
    dropped(links, results, state)
    return ended.join(blogs.select("blog", "n_entries"), "blog").where((F.col("n_entries") >= 2) | (F.col("n") >= enough)).drop("n_entries")


def settled(candidates: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(blog, candidate, n, matches): which candidate is left when the best one is always looked at more closely, and put back with its new rank if it turns out worse.

    candidates (blog, candidate, pos, n): found in the order of pos, with the length that they seem to have. outcomes (candidate, step, matches, n, is_partial):
    what a closer look gives; a candidate without step 1 fails. Step 2 belongs to partial ones: their whole history, without which they fail. Candidates rank by whether they match their
    feed (taken for granted at first), then length, then order; one that is put back comes after its equals. After a closer look one is taken if none is left that ranks better, equal ones being no better than a whole history.
    Each round looks at the first candidate of every blog that isn't settled, so there are at most three times as many rounds as the longest list.
    """
    step = lambda n: outcomes.where(F.col("step") == n).select("candidate", F.struct("matches", "n", "is_partial").alias(f"_{n}"))
    start = candidates.join(step(1), "candidate", "left").join(step(2), "candidate", "left")
    state = staged(start.select("blog", "candidate", F.lit(True).alias("matches"), F.col("n").cast("long").alias("n"), F.struct(F.lit(0).alias("turn"), F.col("pos").cast("long").alias("pos")).alias("seq"), F.lit(0).alias("step"), "_1", "_2"), "candidates")
    done, turn = [], 0
    own = Window.partitionBy("blog").orderBy(F.desc("matches"), F.desc("n"), "seq")
    while True:
        turn += 1
        key = lambda m, n: F.struct(F.col(m) if isinstance(m, str) else m, n)
        rows = state.withColumns({"_i": F.row_number().over(own), "_next": F.lead(key("matches", F.col("n"))).over(own)})
        first = F.col("_i") == 1
        # what the closer look gives: the next step's outcome, or for a whole history itself
        whole = F.struct("matches", "n", F.lit(False).alias("is_partial"))
        seen = F.when(F.col("step") == 0, F.col("_1")).when((F.col("step") == 1) & F.col("_1.is_partial"), F.col("_2")).otherwise(whole)
        rows = rows.withColumn("_seen", F.when(first, seen))
        order = key(F.col("_seen.matches"), F.col("_seen.n").cast("long").alias("n"))
        better = F.col("_next").isNull() | (order > F.col("_next")) | (~F.col("_seen.is_partial") & (order == F.col("_next")))
        taken = first & F.col("_seen").isNotNull() & better
        last = F.when(F.col("_seen.is_partial"), F.col("_2")).otherwise(F.col("_seen"))  # a partial one that is taken is looked at to its end
        rows = staged(rows.withColumns({"_taken": F.coalesce(taken & last.isNotNull(), F.lit(False)), "_last": last, "_lost": first & (F.col("_seen").isNull() | (better & last.isNull()))}), "looked-at")
        dropped(state)
        out = rows.where("_taken").select("blog", "candidate", F.col("_last.n").cast("long").alias("n"), "_last.matches")
        done.append(staged(out, "settled"))
        moved = F.col("_i") == 1
        left = rows.where("NOT _lost").join(done[-1].select("blog"), "blog", "left_anti")
        state = staged(
            left.select(
                "blog", "candidate",
                F.when(moved, F.col("_seen.matches")).otherwise(F.col("matches")).alias("matches"),
                F.when(moved, F.col("_seen.n").cast("long")).otherwise(F.col("n")).alias("n"),
                F.when(moved, F.struct(F.lit(turn).alias("turn"), F.col("seq.pos").alias("pos"))).otherwise(F.col("seq")).alias("seq"),
                F.when(moved, F.when((F.col("step") == 0) & F.col("_seen.is_partial"), 1).otherwise(2)).otherwise(F.col("step")).alias("step"),
                "_1", "_2",
            ),
            "candidates",
        )
        dropped(rows)
        if not state.take(1):
            dropped(state)
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def last_before_failure(rows: DataFrame, keys: list[str], order: list[str], ok: Column) -> DataFrame:
    """Of each group the last row, in order, before the first that isn't ok (null: it isn't); none if the first row isn't."""
    own = Window.partitionBy(*keys).orderBy(*order)
    good = rows.withColumn("_ok", F.coalesce(ok, F.lit(False)))
    good = good.withColumns({"_all": F.bool_and("_ok").over(own), "_after": F.lead("_ok").over(own)})
    return good.where(F.col("_all") & ~F.coalesce("_after", F.lit(False))).drop("_ok", "_all", "_after")


def outcomes(candidates: DataFrame, tries: DataFrame, pages: DataFrame) -> DataFrame:
    """(candidate, step, matches, n, is_partial): what a closer look at candidates (candidate, kind, n) gives, for `settled`.

    tries (candidate, pos, n, sorts, agrees): lists that have to be put in order by dates first, one for a candidate of kind `categories` or `pinned`, several
    of growing length for `shuffled`, of which the last that can be sorted before the first that can't is taken; for a pinned one the order must agree with the feed as well. pages (candidate, step, n, is_partial): the histories over
    several pages that are there: step 1 for kind `page1` after a look at its second page, step 2 for the rest of the pages. Lists of kind `sorted` and `long_feed` are taken as they are.
    """
    kind = F.col("kind")
    plain = candidates.where(kind.isin("sorted", "long_feed")).select("candidate", F.lit(1).alias("step"), F.lit(True).alias("matches"), "n", F.lit(False).alias("is_partial"))
    tried = candidates.where(kind.isin("shuffled", "categories", "pinned")).select("candidate", "kind").join(tries, "candidate")
    sorts = F.col("sorts") & ((kind != "pinned") | F.col("agrees"))
    last = last_before_failure(tried, ["candidate"], ["n", "pos"], sorts)
    sorted_ = last.select("candidate", F.lit(1).alias("step"), F.coalesce("agrees", F.lit(False)).alias("matches"), "n", F.lit(False).alias("is_partial"))
    paged = candidates.where(kind == "page1").select("candidate").join(pages, "candidate")
    paged = paged.select("candidate", "step", F.lit(True).alias("matches"), "n", ((F.col("step") == 1) & F.col("is_partial")).alias("is_partial"))
    return plain.unionByName(sorted_).unionByName(paged)
