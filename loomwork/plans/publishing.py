"""Publication over the star schema: a customer is a user, an order a subscription, a line item a post.

Posts shipped by NOW are published; an order of status P is paused; on each day 1 to 3 posts are due.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomwork.operators import publishing as P
from loomwork.plans.registry import Registry
from loomwork.sources.storage import staged

R = Registry()
NOW = "1996-06-12 10:00:00"  # a Wednesday

MODEL_SQL = f"""subs AS (SELECT o_orderkey AS sub_id, o_custkey AS user_id, o_orderstatus = 'P' AS is_paused, o_orderdate AS set_up_at, 1 + o_orderkey % 3 AS k FROM orders),
posts AS (SELECT l_orderkey AS sub_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_linenumber) - 1 AS index,
  CASE WHEN l_shipdate <= TIMESTAMP '{NOW}' THEN l_shipdate END AS published_at FROM lineitem),
due AS (SELECT sub_id, index FROM (SELECT p.*, k, row_number() OVER (PARTITION BY sub_id ORDER BY index) AS n FROM posts p JOIN subs USING (sub_id) WHERE published_at IS NULL AND NOT is_paused) WHERE n <= k),
ends AS (SELECT sub_id, coalesce(n_new, 0) AS n_new, coalesce(n_new, 0) = coalesce(n_left, 0) AS is_final FROM subs
  LEFT JOIN (SELECT sub_id, count(*) AS n_left FROM posts WHERE published_at IS NULL GROUP BY 1) USING (sub_id) LEFT JOIN (SELECT sub_id, count(*) AS n_new FROM due GROUP BY 1) USING (sub_id))"""


def model(t):
    subs = t.orders.select(F.col("o_orderkey").alias("sub_id"), F.col("o_custkey").alias("user_id"), (F.col("o_orderstatus") == "P").alias("is_paused"), F.col("o_orderdate").alias("set_up_at"))
    order = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_partkey", "l_suppkey", "l_linenumber")
    index = (F.row_number().over(order) - 1).cast("long")
    published = F.when(F.col("l_shipdate") <= F.lit(NOW).cast("timestamp_ntz"), F.col("l_shipdate"))
    posts = t.lineitem.select(F.col("l_orderkey").alias("sub_id"), index.alias("index"), (F.col("l_orderkey") * 100 + index).alias("post_id"), published.alias("published_at"))
    days = F.array(*[F.lit(d) for d in ("sun", "mon", "tue", "wed", "thu", "fri", "sat")])
    schedule = t.orders.select(F.col("o_orderkey").alias("sub_id"), F.explode(days).alias("day_of_week"), (F.col("o_orderkey") % 3 + 1).alias("count"))
    return subs, posts, schedule


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def _due(t):
    subs, posts, schedule = model(t)
    # the index is a window over all posts, and feeds read it several times
    posts = staged(posts, "posts")
    return subs, posts, staged(P.due_posts(subs, posts, schedule, F.to_date(now())), "due")


@R.add("g01_due_posts", f"WITH {MODEL_SQL} SELECT sub_id, index FROM due")
def due(t):
    return _due(t)[2].select("sub_id", "index")


@R.add("g02_final_detection", f"WITH {MODEL_SQL} SELECT sub_id, n_new, is_final FROM ends")
def final(t):
    return P.finishing(*_due(t))


FEED_SQL = f"""{MODEL_SQL},
old AS (SELECT sub_id, index, published_at AS tm FROM (SELECT p.*, row_number() OVER (PARTITION BY sub_id ORDER BY index DESC) AS n, greatest(30 - n_new - is_final::INT, 0) AS room FROM posts p JOIN ends USING (sub_id) WHERE published_at IS NOT NULL) WHERE n <= room),
shown AS (SELECT sub_id, index, TIMESTAMP '{NOW}' AS tm, 'new' AS kind FROM due UNION ALL SELECT sub_id, index, tm, 'old' FROM old),
items AS (SELECT * FROM shown UNION ALL SELECT sub_id, 1099511627776, TIMESTAMP '{NOW}', 'final' FROM ends WHERE is_final
  UNION ALL SELECT sub_id, -1, set_up_at, 'welcome' FROM subs JOIN ends USING (sub_id) LEFT JOIN (SELECT sub_id, count(*) AS n FROM shown GROUP BY 1) USING (sub_id) WHERE coalesce(n, 0) + is_final::INT < 30),
feed AS (SELECT sub_id, kind, index, tm, row_number() OVER (PARTITION BY sub_id ORDER BY index DESC) - 1 AS position,
  sha256(CASE kind WHEN 'final' THEN sub_id || '-final' WHEN 'welcome' THEN sub_id || '-welcome' ELSE (sub_id * 100 + index)::VARCHAR END) AS guid FROM items)"""


@R.add("g03_subscription_feed", f"WITH {FEED_SQL} SELECT sub_id, position, kind, guid, strftime(tm, '%Y-%m-%d') AS day FROM feed")
def feed(t):
    return P.subscription_feed(*_due(t), now()).select("sub_id", F.col("position").cast("long").alias("position"), "kind", "guid", F.date_format("published_at", "yyyy-MM-dd").alias("day"))


@R.add(
    "g04_user_feed",
    f"""WITH {FEED_SQL}, m AS (SELECT user_id, sub_id, kind, guid, row_number() OVER (PARTITION BY user_id ORDER BY tm DESC, set_up_at DESC, sub_id DESC, position) - 1 AS position FROM feed JOIN subs USING (sub_id))
SELECT user_id, position, sub_id, kind, guid FROM m WHERE position < 30""",
)
def merged_feed(t):
    return P.user_feed(P.subscription_feed(*_due(t), now())).select("user_id", F.col("position").cast("long").alias("position"), "sub_id", "kind", "guid")


@R.add("g05_marked_published", f"WITH {MODEL_SQL} SELECT sub_id, index, coalesce(published_at, CASE WHEN (sub_id, index) IN (SELECT (sub_id, index) FROM due) THEN TIMESTAMP '{NOW}' END) IS NOT NULL AS is_published FROM posts")
def marked(t):
    _, posts, due = _due(t)
    return P.marked_published(posts, due, now()).select("sub_id", "index", F.col("published_at").isNotNull().alias("is_published"))


@R.add("g06_double_run_guard", f"WITH {MODEL_SQL} SELECT DISTINCT sub_id FROM posts WHERE timezone('America/Los_Angeles', timezone('UTC', published_at))::DATE = DATE '1996-06-10'")
def guard(t):
    return P.published_on(model(t)[1], F.lit("1996-06-10").cast("date"), "America/Los_Angeles")


@R.add(
    "g08_schedule_preview",
    f"""WITH {MODEL_SQL}, a AS (SELECT *, row_number() OVER (PARTITION BY sub_id ORDER BY index DESC) AS n, count(*) OVER (PARTITION BY sub_id) AS c FROM posts WHERE published_at IS NOT NULL),
b AS (SELECT *, row_number() OVER (PARTITION BY sub_id ORDER BY index) AS n, count(*) OVER (PARTITION BY sub_id) AS c FROM posts WHERE published_at IS NULL)
SELECT sub_id, 'published' AS part, index, c > 2 AS more FROM a WHERE n <= 2 UNION ALL SELECT sub_id, 'next', index, c > 5 FROM b WHERE n <= 5""",
)
def preview(t):
    return P.schedule_preview(model(t)[1]).drop("post_id")


@R.add("g09_names_by_day", "SELECT o_custkey AS user_id, d AS day_of_week, o_orderkey AS sub_id, count(*) AS n FROM orders, (VALUES ('sun'), ('mon'), ('tue'), ('wed'), ('thu'), ('fri'), ('sat')) v(d), range(1, 4) r(i) WHERE i <= 1 + o_orderkey % 3 GROUP BY ALL")
def names(t):
    subs, _, schedule = model(t)
    return P.names_by_day(subs, schedule).groupBy("user_id", "day_of_week", "sub_id").agg(F.count("*").alias("n"))


@R.add("g11_cleanup", "SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-06-05' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-06-05')")
def cleanup(t):
    """What is older than the limit and not referred to by anything fresh."""
    limit = F.lit("1996-06-05").cast("timestamp_ntz")
    fresh = t.lineitem.where(F.col("l_shipdate") >= limit).select(F.col("l_orderkey").alias("o_orderkey"))
    return t.orders.where(F.col("o_orderdate") < limit).select("o_orderkey").join(fresh, "o_orderkey", "left_anti")


@R.add("g13_expired", "SELECT o_orderkey, o_orderdate < TIMESTAMP '1996-06-12 10:00:00' - INTERVAL '23 hours 30 minutes' AS expired FROM orders")
def expired(t):
    return t.orders.select("o_orderkey", (F.col("o_orderdate") < now() - F.expr("INTERVAL '23:30' HOUR TO MINUTE")).alias("expired"))


@R.add("g14_merge_action", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' OR o_orderpriority = '1-URGENT' THEN 'recrawl' WHEN o_orderpriority = '2-HIGH' AND o_orderkey % 2 = 0 THEN 'fail' WHEN o_orderpriority = '2-HIGH' THEN 'update' ELSE 'none' END AS action FROM orders")
def actions(t):
    status = F.when(F.col("o_orderstatus") == "F", "crawl_failed").otherwise("crawled")
    wanted = F.when(F.col("o_orderpriority") == "1-URGENT", "recrawl").when(F.col("o_orderpriority") == "2-HIGH", "update_from_feed_or_fail").otherwise("no_op")
    diff = F.when(F.col("o_orderkey") % 2 == 0, "no_match").otherwise("ok")
    return t.orders.select("o_orderkey", P.merge_action(status, wanted, diff).alias("action"))


@R.add("g15_shrink_warning", "SELECT coalesce(a.k, b.k) AS blog_id, coalesce(na, 0) AS n_before, coalesce(nb, 0) AS n_after, coalesce(nb, 0) < coalesce(na, 0) AS shrank FROM (SELECT l_suppkey AS k, count(*) AS na FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY 1) a FULL JOIN (SELECT l_suppkey AS k, count(*) AS nb FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY 1) b ON a.k = b.k")
def shrink(t):
    rows = t.lineitem.select(F.col("l_suppkey").alias("blog_id"), "l_linenumber")
    return P.crawl_outcome(rows.where("l_linenumber % 2 = 0"), rows.where("l_linenumber % 2 = 1"))


@R.add("g16_wait_durations", "SELECT o_orderkey, date_diff('day', o_orderdate::DATE, max(l_shipdate)::DATE) AS days FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderdate")
def waits(t):
    last = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("last"))
    return t.orders.join(last, "o_orderkey").select("o_orderkey", F.datediff("last", "o_orderdate").cast("long").alias("days"))


@R.add("g20_account_discard", "SELECT o_orderkey, o_custkey % 10 = 0 AND o_orderstatus <> 'P' AS paused_now, o_orderstatus = 'P' OR o_custkey % 10 = 0 AS is_paused FROM orders")
def discards(t):
    """All running subscriptions of discarded users are paused."""
    gone = t.customer.where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("o_custkey")).withColumn("gone", F.lit(True))
    rows = t.orders.join(gone, "o_custkey", "left").withColumn("gone", F.coalesce("gone", F.lit(False)))
    paused = F.col("o_orderstatus") == "P"
    return rows.select("o_orderkey", (F.col("gone") & ~paused).alias("paused_now"), (paused | F.col("gone")).alias("is_paused"))


@R.add("g23_selection", "SELECT o_orderkey FROM orders WHERE o_orderpriority = '3-MEDIUM' UNION SELECT o_orderkey FROM orders WHERE o_orderkey IN (1, 2, 3, 7, 1000000000)")
def selection(t):
    """All posts of a category, and explicit ids as far as the blog has them."""
    ids = t.spark.createDataFrame([(i,) for i in (1, 2, 3, 7, 1_000_000_000)], "o_orderkey long")
    chosen = t.orders.join(F.broadcast(ids), "o_orderkey", "left_semi").select("o_orderkey")
    return t.orders.where("o_orderpriority = '3-MEDIUM'").select("o_orderkey").union(chosen).distinct()


@R.add("s21_rss_document", f"WITH {FEED_SQL} SELECT sub_id AS feed, count(*) AS n FROM feed WHERE kind <> 'final' GROUP BY sub_id")
def rss(t):
    """RSS text of each subscription, read back by counting its items."""
    items = P.subscription_feed(*_due(t), now()).where("kind <> 'final'")
    items = items.select(F.col("sub_id").alias("feed"), "position", F.concat(F.lit("Post <"), F.col("kind"), F.lit(">")).alias("title"), F.lit("https://example.com/?a=1&b=2").alias("link"), "guid", F.col("kind").alias("description"), "published_at")
    return P.rss_document(items, "Posts", "https://example.com/").select("feed", F.size(F.regexp_extract_all("xml", F.lit("<item>"), F.lit(0))).cast("long").alias("n"))
