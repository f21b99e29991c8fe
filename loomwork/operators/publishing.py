"""Publication on a schedule, for all subscriptions at once.

subscriptions: sub_id, user_id, is_paused, set_up_at. posts: sub_id, index (0 is the oldest), post_id,
published_at (null: not yet). schedule: sub_id, day_of_week, count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions import schedule as S
from loomwork.functions import text as X
from loomwork.operators.ranking import cap_per_group

FEED_ITEMS = 30


def due_posts(subscriptions: DataFrame, posts: DataFrame, schedule: DataFrame, day: Column) -> DataFrame:
    """(sub_id, index, post_id): of each running subscription the first unpublished posts, as many as its weekday says."""
    counts = schedule.where(F.col("day_of_week") == S.day_of_week(day)).where("count > 0").select("sub_id", "count")
    live = subscriptions.where(~F.col("is_paused")).select("sub_id").join(counts, "sub_id")
    rows = posts.where("published_at IS NULL").select("sub_id", "index", "post_id").join(live, "sub_id")
    n = F.row_number().over(Window.partitionBy("sub_id").orderBy("index"))
    return rows.withColumn("_n", n).where(F.col("_n") <= F.col("count")).select("sub_id", "index", "post_id")


def finishing(subscriptions: DataFrame, posts: DataFrame, due: DataFrame) -> DataFrame:
    """(sub_id, n_new, is_final): is nothing left after the due posts? True also where nothing was left before."""
    unpublished = posts.where("published_at IS NULL").groupBy("sub_id").agg(F.count("*").alias("n_left"))
    new = due.groupBy("sub_id").agg(F.count("*").alias("n_new"))
    rows = subscriptions.select("sub_id").join(unpublished, "sub_id", "left").join(new, "sub_id", "left")
    n = F.coalesce("n_new", F.lit(0))
    return rows.select("sub_id", n.alias("n_new"), (n == F.coalesce("n_left", F.lit(0))).alias("is_final"))


def marked_published(posts: DataFrame, due: DataFrame, now: Column) -> DataFrame:
    """posts with the due ones published now."""
    hit = due.select("sub_id", "index").withColumn("_due", F.lit(True))
    out = posts.join(hit, ["sub_id", "index"], "left")
    return out.withColumn("published_at", F.when(F.col("_due"), now).otherwise(F.col("published_at"))).drop("_due")


def item_guid() -> Column:
    """The guid of an item (sub_id, kind, post_id)."""
    suffix = F.when(F.col("kind") == "final", F.lit("-final")).when(F.col("kind") == "welcome", F.lit("-welcome")).otherwise(F.lit(""))
    return X.guid(F.concat(F.coalesce(F.col("post_id"), F.col("sub_id")).cast("string"), suffix))


def subscription_feed(subscriptions: DataFrame, posts: DataFrame, due: DataFrame, now: Column, most: int = FEED_ITEMS) -> DataFrame:
    """(sub_id, user_id, position, kind, post_id, published_at, guid), newest first from position 0.

    A final item where nothing is left, then new posts and the latest old ones, then a welcome item if there is room. Only
    old posts are cut: new ones always show.
    """
    subs = subscriptions.select("sub_id", "user_id", "set_up_at")
    marked = posts.join(due.select("sub_id", "index", F.lit(True).alias("_due")), ["sub_id", "index"], "left").withColumn("_due", F.coalesce("_due", F.lit(False)))
    old = ~F.col("_due") & F.col("published_at").isNotNull()
    facts = {"_new": F.count_if("_due"), "_left": F.count_if(F.col("published_at").isNull()), "_old": F.count_if(old)}
    final, room = F.col("_new") == F.col("_left"), F.greatest(F.lit(most) - F.col("_new") - F.col("_final").cast("int"), F.lit(0))
    # counts and places of a subscription's posts share one shuffle
    own = Window.partitionBy("sub_id")
    rows = marked.withColumns({k: v.over(own) for k, v in facts.items()} | {"_n": F.row_number().over(own.orderBy(F.when(old, 0).otherwise(1), F.desc("index")))}).withColumn("_final", final)
    shown = rows.where(F.col("_due") | (old & (F.col("_n") <= room))).join(subs, "sub_id")
    kind = F.when(F.col("_due"), "new").otherwise("old")
    shown = shown.select("sub_id", "user_id", "set_up_at", F.col("index").cast("long").alias("index"), kind.alias("kind"), F.col("post_id").cast("long").alias("post_id"), F.when(F.col("_due"), now).otherwise(F.col("published_at")).alias("at"))
    # what stands above and below the posts, of subscriptions without posts as well
    ends = subs.join(marked.groupBy("sub_id").agg(*[v.alias(k) for k, v in facts.items()]), "sub_id", "left").fillna(0, list(facts)).withColumn("_final", final)
    fits = F.col("_new") + F.least(F.col("_old"), room) + F.col("_final").cast("int") < most
    item = lambda index, kind, at: F.struct(F.lit(index).cast("long").alias("index"), F.lit(kind).alias("kind"), F.lit(None).cast("long").alias("post_id"), at.alias("at"))
    around = F.array_compact(F.array(F.when(F.col("_final"), item(2**40, "final", now)), F.when(fits, item(-1, "welcome", F.col("set_up_at")))))
    items = shown.unionByName(ends.select("sub_id", "user_id", "set_up_at", F.explode(around).alias("i")).select("sub_id", "user_id", "set_up_at", "i.*"))
    place = F.row_number().over(Window.partitionBy("sub_id").orderBy(F.desc("index"))) - 1
    return items.withColumn("position", place).select(
        "sub_id", "user_id", "position", "kind", "post_id", F.col("at").alias("published_at"), item_guid().alias("guid"), "set_up_at"
    )


def user_feed(feeds: DataFrame, most: int = FEED_ITEMS) -> DataFrame:
    """(user_id, position, sub_id, kind, post_id, published_at, guid): all feeds of a user merged, latest day first.

    Of equal times the subscription set up last comes first, then the feed's own order. Guids, longer than all else and not to be compressed, are made after
    the shuffle by user.
    """
    order = [F.desc("published_at"), F.desc("set_up_at"), F.desc("sub_id"), F.asc("position")]
    w = Window.partitionBy("user_id").orderBy(*order)
    rows = feeds.drop("guid").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    return rows.select("user_id", (F.col("_n") - 1).alias("position"), "sub_id", "kind", "post_id", "published_at", item_guid().alias("guid"))


def schedule_preview(posts: DataFrame, last: int = 2, ahead: int = 5) -> DataFrame:
    """(sub_id, part, index, post_id, more): the last published and the next posts, and whether there are more of them."""
    out = []
    for part, state, order, n in (("published", "published_at IS NOT NULL", F.desc("index"), last), ("next", "published_at IS NULL", F.asc("index"), ahead)):
        rows = posts.where(state).select("sub_id", "index", "post_id")
        counts = rows.groupBy("sub_id").agg((F.count("*") > n).alias("more"))
        out.append(cap_per_group(rows, ["sub_id"], [order], n).join(counts, "sub_id").withColumn("part", F.lit(part)))
    return out[0].unionByName(out[1]).select("sub_id", "part", "index", "post_id", "more")


def names_by_day(subscriptions: DataFrame, schedule: DataFrame) -> DataFrame:
    """(user_id, day_of_week, sub_id, n): other subscriptions of a user by weekday, each named as often as it publishes."""
    rows = schedule.where("count > 0").join(subscriptions.select("sub_id", "user_id"), "sub_id")
    return rows.select("user_id", "day_of_week", "sub_id", F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))).alias("n"))


def published_on(posts: DataFrame, day: Column, zone: str) -> DataFrame:
    """(sub_id): subscriptions that already published on a local day; the guard against a second run."""
    return posts.where(S.local_date(F.col("published_at"), zone) == day).select("sub_id").distinct()


def crawl_outcome(before: DataFrame, after: DataFrame) -> DataFrame:
    """(blog_id, n_before, n_after, shrank): does a fresh crawl have fewer posts than the latest version before?"""
    a = before.groupBy("blog_id").agg(F.count("*").alias("n_before"))
    b = after.groupBy("blog_id").agg(F.count("*").alias("n_after"))
    rows = a.join(b, "blog_id", "full").fillna(0, ["n_before", "n_after"])
    return rows.withColumn("shrank", F.col("n_after") < F.col("n_before"))


def merge_action(status: Column, update_action: Column, diff_status: Column) -> Column:
    """What becomes of a known blog that is added again: recrawl, update, fail or nothing."""
    failed = status.isin("crawl_failed", "update_from_feed_failed")
    return (
        F.when(failed | (update_action == "recrawl"), "recrawl")
        .when((update_action == "update_from_feed_or_fail") & (diff_status == "no_match"), "fail")
        .when((update_action == "update_from_feed_or_fail") & (diff_status == "ok"), "update")
        .otherwise("none")
    )


def rss_document(items: DataFrame, title: str, link: str) -> DataFrame:
    """(feed, xml) of items (feed, position, title, link, guid, description, published_at)."""
    x = X.escaped_xml
    item = F.concat(
        F.lit("    <item>\n      <title>"), x(F.col("title")), F.lit("</title>\n      <link>"), x(F.col("link")), F.lit('</link>\n      <guid isPermaLink="false">'), F.col("guid"),
        F.lit("</guid>\n      <description>"), x(F.col("description")), F.lit("</description>\n      <pubDate>"), S.rfc1123z(F.col("published_at")), F.lit("</pubDate>\n    </item>\n"),
    )
    rows = items.select("feed", F.struct("position", item.alias("xml")).alias("item")).groupBy("feed").agg(F.array_sort(F.collect_list("item")).alias("items"))
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<rss version="2.0">\n  <channel>\n    <title>{title}</title>\n    <link>{link}</link>\n'
    return rows.select("feed", F.concat(F.lit(head), F.array_join(F.transform("items", lambda i: i["xml"]), ""), F.lit("  </channel>\n</rss>\n")).alias("xml"))
