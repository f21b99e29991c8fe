"""The search for archives over a graph of the star schema: nations as blogs, parts as pages, and a link from each line of an order to the next one's part."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomwork.operators import chains as C
from loomwork.operators import search as S
from loomwork.plans.registry import Registry

R = Registry()

#: Of nations divisible by 4 no page is an archive, so that their searches end by the number of requests.
GRAPH_SQL = """k AS (SELECT p_partkey AS url, CASE WHEN p_size <= 4 THEN 0 WHEN p_size <= 20 THEN 1 ELSE 2 END AS rank, CASE WHEN p_size % 3 <> 0 THEN p_size // 2 + p_partkey % 9 END::BIGINT AS n FROM part),
o AS (SELECT c_nationkey AS blog, l_orderkey, l_partkey AS page, lead(l_partkey) OVER w AS url, row_number() OVER w AS i
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)),
l AS (SELECT blog, page, url, CASE WHEN blog % 4 = 0 AND rank = 0 THEN 1 ELSE rank END AS rank, min(l_orderkey) AS pos FROM o JOIN k USING (url) GROUP BY ALL),
f AS (SELECT blog, page AS url, CASE WHEN blog % 4 = 0 AND rank = 0 THEN 1 ELSE rank END AS rank, min(l_orderkey) AS pos, i FROM o JOIN k ON k.url = page WHERE i <= 3 AND l_orderkey % 32 = 0 GROUP BY ALL)"""

#: A queue for each blog, one page at a time, with the queues and the pages that it has seen as lists.
LOOP_SQL = """g AS (SELECT blog, page, list({'url': url, 'rank': rank} ORDER BY pos, url) AS links FROM l WHERE rank < 2 GROUP BY 1, 2),
s AS (SELECT blog, list({'url': url, 'rank': rank} ORDER BY pos, url) AS q FROM (SELECT blog, url, rank, min(pos) AS pos FROM f WHERE i = 1 AND rank < 2 GROUP BY 1, 2, 3) GROUP BY 1),
loop(blog, archives, main, seen, had, requests, best, url, ended) AS (
  SELECT blog, [x.url FOR x IN q IF x.rank = 0], [x.url FOR x IN q IF x.rank = 1], [x.url FOR x IN q], len([x FOR x IN q IF x.rank = 0]) > 0, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, false FROM s
  UNION ALL
  SELECT blog, archives, main, seen, had, requests, best, url, (had OR requests >= 6) AND len(archives) = 0 AND coalesce(best, 0) >= 9 FROM (
    SELECT blog, list_concat(rest_a, [x.url FOR x IN new IF x.rank = 0]) AS archives, list_concat(rest_m, [x.url FOR x IN new IF x.rank = 1]) AS main, list_concat(seen, [x.url FOR x IN new]) AS seen,
      had OR len([x FOR x IN new IF x.rank = 0]) > 0 AS had, requests + 1 AS requests, CASE WHEN n > coalesce(best, -1) THEN n ELSE best END AS best, CASE WHEN n > coalesce(best, -1) THEN page ELSE url END AS url
    FROM (SELECT t.*, k.n, [x FOR x IN coalesce(links, []) IF NOT list_contains(seen, x.url)] AS new FROM (
      SELECT *, CASE WHEN len(archives) > 0 THEN archives[1] ELSE main[1] END AS page, CASE WHEN len(archives) > 0 THEN archives[2:] ELSE archives END AS rest_a,
        CASE WHEN len(archives) > 0 THEN main ELSE main[2:] END AS rest_m FROM loop WHERE NOT ended AND len(archives) + len(main) > 0) t
      LEFT JOIN g ON g.blog = t.blog AND g.page = t.page LEFT JOIN k ON k.url = t.page)))"""


def _graph(t):
    """(links, firsts, results): the graph, and the first three lines of some orders."""
    rank = F.when(F.col("p_size") <= 4, S.ARCHIVES).when(F.col("p_size") <= 20, S.MAIN).otherwise(S.OTHER)
    parts = t.part.select(F.col("p_partkey").alias("url"), rank.alias("_rank"), F.when(F.col("p_size") % 3 != 0, F.floor(F.col("p_size") / 2) + F.col("p_partkey") % 9).alias("n"))
    blogs = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")).join(t.customer.select("c_custkey", F.col("c_nationkey").alias("blog")), "c_custkey")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    rows = t.lineitem.withColumns({"url": F.lead("l_partkey").over(order), "i": F.row_number().over(order)}).join(blogs, "l_orderkey")
    rows = rows.select("blog", F.col("l_partkey").alias("page"), "url", F.col("l_orderkey").alias("pos"), "i")
    own = F.when((F.col("blog") % 4 == 0) & (F.col("_rank") == S.ARCHIVES), S.MAIN).otherwise(F.col("_rank")).alias("rank")
    links = rows.join(parts, "url").select("blog", "page", "url", own, "pos").groupBy("blog", "page", "url", "rank").agg(F.min("pos").alias("pos"))
    firsts = rows.where("i <= 3 AND pos % 32 = 0").select("blog", F.col("page").alias("url"), "pos", "i").join(parts, "url").select("blog", "url", own, "pos", "i")
    # links of one order come to a page at once; places are told apart by the target
    return links.withColumn("pos", F.struct("pos", "url")), firsts, parts.where("n IS NOT NULL").select(F.col("url").alias("page"), "n")


@R.add("x13_page_search", f"WITH RECURSIVE {GRAPH_SQL}, {LOOP_SQL} SELECT blog, url, best AS n, requests FROM loop QUALIFY row_number() OVER (PARTITION BY blog ORDER BY requests DESC) = 1")
def page_search(t):
    """Archives first, then main pages, until a page of 9 links is found; nations without archives ask for six pages at least."""
    links, firsts, results = _graph(t)
    starts = firsts.where("i = 1").groupBy("blog", "url", "rank").agg(F.struct(F.min("pos"), F.col("url")).alias("pos"))
    return S.search_rounds(starts, links, results, enough=9, requests=6)


SETTLE_SQL = """c AS (SELECT o_custkey AS blog, o_orderkey AS candidate, floor(o_totalprice / 20000)::BIGINT AS n, o_orderstatus <> 'P' AS ok1, NOT (o_orderkey % 3 = 0) AS m1, greatest(0, floor(o_totalprice / 20000)::BIGINT - o_orderkey % 9) AS n1, o_orderpriority LIKE '1%' AS partial,
  o_orderkey % 4 > 0 AS ok2, floor(o_totalprice / 20000)::BIGINT + o_orderkey % 3 AS n2 FROM orders),
q AS (SELECT blog, list_sort(list({'m': 0, 'n': -n, 'turn': 0::BIGINT, 'pos': candidate, 'step': 0})) AS queue FROM c GROUP BY 1),
loop(blog, queue, turn, taken, n, matches) AS (
  SELECT blog, queue, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BOOLEAN FROM q
  UNION ALL
  SELECT blog, CASE WHEN keep AND NOT won THEN list_sort(list_append(rest, {'m': pm, 'n': pn, 'turn': turn + 1, 'pos': candidate, 'step': CASE WHEN step = 0 AND pp THEN 1 ELSE 2 END})) ELSE rest END,
    turn + 1, CASE WHEN won AND NOT (pp AND NOT ok2) THEN candidate END, CASE WHEN pp THEN n2 ELSE -pn END, CASE WHEN pp THEN true ELSE pm = 0 END
  FROM (SELECT *, keep AND (len(rest) = 0 OR pm < rest[1].m OR pm = rest[1].m AND (pn < rest[1].n OR pn = rest[1].n AND NOT pp)) AS won FROM (
    SELECT l.blog, l.turn, l.queue[2:] AS rest, h.step, c.candidate, c.ok2, c.n2,
      CASE h.step WHEN 0 THEN ok1 WHEN 1 THEN ok2 ELSE true END AS keep, h.step = 0 AND partial AS pp,
      CASE h.step WHEN 0 THEN CASE WHEN m1 THEN 0 ELSE 1 END WHEN 1 THEN 0 ELSE h.m END AS pm, CASE h.step WHEN 0 THEN -n1 WHEN 1 THEN -n2 ELSE h.n END AS pn
    FROM (SELECT *, queue[1] AS h FROM loop WHERE taken IS NULL AND len(queue) > 0) l JOIN c ON c.candidate = h.pos)))"""


@R.add("x14_settled_candidates", f"WITH RECURSIVE {SETTLE_SQL} SELECT blog, taken AS candidate, n, matches FROM loop WHERE taken IS NOT NULL")
def settled(t):
    """Orders as candidates of their customers; some fail at a closer look, some lose links or their match with the feed, some have more pages."""
    n = F.floor(F.col("o_totalprice") / 20000)
    c = t.orders.select(F.col("o_custkey").alias("blog"), F.col("o_orderkey").alias("candidate"), n.alias("n"), "o_orderstatus", F.col("o_orderpriority").startswith("1").alias("p"))
    k = F.col("candidate")
    first = c.where("o_orderstatus <> 'P'").select("candidate", F.lit(1).alias("step"), (k % 3 != 0).alias("matches"), F.greatest(F.lit(0), F.col("n") - k % 9).alias("n"), F.col("p").alias("is_partial"))
    second = c.where((k % 4 > 0) & F.col("p")).select("candidate", F.lit(2).alias("step"), F.lit(True).alias("matches"), (F.col("n") + k % 3).alias("n"), F.lit(False).alias("is_partial"))
    return S.settled(c.select("blog", "candidate", k.alias("pos"), "n"), first.unionByName(second))


@R.add(
    "x21_shuffled_lists",
    """WITH c AS (SELECT l_orderkey AS candidate, l_partkey AS list, count(*) OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) AS i, l_quantity AS n, l_shipdate > o_orderdate + INTERVAL 15 DAY AS sorts FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
f AS (SELECT candidate, min(i) AS bad FROM c WHERE NOT sorts GROUP BY 1) SELECT candidate, max_by(n, i) AS n FROM c LEFT JOIN f USING (candidate) WHERE i < coalesce(bad, 1000) GROUP BY 1""",
)
def shuffled(t):
    """Lists of growing length, line items of an order by quantity; the last that can be sorted before the first that can't."""
    orders = t.dealt("orders", "o_orderkey", by="lineitem").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    rows = t.dealt("lineitem", "l_orderkey").join(orders, "l_orderkey")
    ok = F.col("l_shipdate") > F.col("o_orderdate") + F.expr("INTERVAL 15 DAY")
    found = S.last_before_failure(rows, ["l_orderkey"], ["l_quantity", "l_partkey", "l_suppkey"], ok)
    return found.select(F.col("l_orderkey").alias("candidate"), F.col("l_quantity").alias("n"))


@R.add(
    "x21_outcomes",
    """WITH c AS (SELECT o_orderkey AS candidate, CASE o_orderkey % 6 WHEN 0 THEN 'sorted' WHEN 1 THEN 'long_feed' WHEN 2 THEN 'shuffled' WHEN 3 THEN 'categories' WHEN 4 THEN 'pinned' ELSE 'page1' END AS kind, floor(o_totalprice / 1000)::BIGINT AS n FROM orders),
t AS (SELECT l_orderkey AS candidate, sum(l_quantity) OVER w AS n, row_number() OVER w AS i, l_returnflag <> 'R' AS sorts, l_linestatus = 'O' AS agrees FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING)),
a AS (SELECT t.*, kind, sorts AND (kind <> 'pinned' OR agrees) AS ok FROM t JOIN c USING (candidate) WHERE kind = 'shuffled' OR kind IN ('categories', 'pinned') AND i = 1), b AS (SELECT candidate, min(i) AS bad FROM a WHERE NOT ok GROUP BY 1)
SELECT candidate, 1 AS step, true AS matches, n, false AS is_partial FROM c WHERE kind IN ('sorted', 'long_feed')
UNION ALL SELECT candidate, 1, arg_max(agrees, i), max(a.n)::BIGINT, false FROM a LEFT JOIN b USING (candidate) WHERE i < coalesce(bad, 1000) GROUP BY 1
UNION ALL SELECT candidate, i::INT, true, t.n::BIGINT, i = 1 AND sorts FROM t JOIN c USING (candidate) WHERE kind = 'page1' AND i <= 2""",
)
def closer_looks(t):
    """What a closer look at candidates of each kind gives: orders as candidates, running quantities of their lines as lists and pages."""
    kinds = F.array(*[F.lit(k) for k in ("sorted", "long_feed", "shuffled", "categories", "pinned", "page1")])
    candidates = t.orders.select(F.col("o_orderkey").alias("candidate"), F.get(kinds, (F.col("o_orderkey") % 6).cast("int")).alias("kind"), F.floor(F.col("o_totalprice") / 1000).alias("n"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    rows = t.lineitem.select(F.col("l_orderkey").alias("candidate"), F.row_number().over(order).alias("pos"), F.sum("l_quantity").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint").alias("n"), (F.col("l_returnflag") != "R").alias("sorts"), (F.col("l_linestatus") == "O").alias("agrees"))
    one = candidates.where("kind IN ('categories', 'pinned')").select("candidate")
    tries = rows.join(one, "candidate", "left_anti").unionByName(rows.where("pos = 1").join(one, "candidate", "left_semi"))
    pages = rows.where("pos <= 2").select("candidate", F.col("pos").alias("step"), "n", F.col("sorts").alias("is_partial"))
    return S.outcomes(candidates, tries, pages)


@R.add("x20_search_in_phases")
def in_phases(t):
    """All three phases over the same graph: the first, second and third lines of some orders as the links of start pages, of two entries, and others. Tests hold it against a queue in Python."""
    links, firsts, results = _graph(t)
    starts = firsts.groupBy("blog", F.col("i").alias("phase"), "url", "rank").agg(F.min("pos").alias("pos"))
    blogs = t.nation.select(F.col("n_nationkey").alias("blog"), (F.col("n_nationkey") % 5).alias("n_entries"), (F.col("n_nationkey") == 3).alias("ends_early"))
    return S.search_in_phases(blogs, starts, links, results.where("n % 3 = 0"), enough=10, enough_in_phase=10, requests=6)


CHAIN_SQL = """p AS (SELECT o_custkey AS blog, o_orderkey AS page, row_number() OVER w AS i, lead(o_orderkey) OVER w AS following, first_value(o_orderkey) OVER w AS first, o_orderstatus, o_orderpriority
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
e AS (SELECT o_custkey AS blog, l_orderkey AS page, l_partkey AS key, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
h AS (SELECT DISTINCT blog, page FROM e),
x AS (SELECT blog, page, CASE WHEN o_orderpriority LIKE '5%' AND i > 4 THEN first ELSE following END AS target FROM p WHERE following IS NOT NULL
  UNION SELECT blog, page, first - 1 FROM p WHERE o_orderpriority LIKE '1%' AND o_orderstatus = 'F' AND i > 2 AND following IS NOT NULL),
n AS (SELECT blog, page, count(*) AS k, min(target) AS target FROM x GROUP BY 1, 2),
r(blog, page, number, seen) AS (SELECT blog, page, 1, [page] FROM p SEMI JOIN h USING (blog, page) WHERE i = 1
  UNION ALL SELECT r.blog, n.target, number + 1, list_append(seen, n.target) FROM r JOIN n ON n.blog = r.blog AND n.page = r.page AND k = 1 JOIN h ON h.blog = r.blog AND h.page = n.target WHERE NOT list_contains(seen, n.target)),
z AS (SELECT r.blog, number AS n_pages, CASE WHEN k IS NULL THEN 'last' WHEN k > 1 THEN 'ambiguous' WHEN list_contains(seen, n.target) THEN 'cyclic' ELSE 'broken' END AS ending
  FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY blog ORDER BY number DESC) = 1) r LEFT JOIN n ON n.blog = r.blog AND n.page = r.page),
a AS (SELECT blog, number, e.pos, key, row_number() OVER (PARTITION BY blog ORDER BY number, e.pos) AS place FROM r JOIN e USING (blog, page)),
f AS (SELECT blog, key, row_number() OVER (PARTITION BY blog ORDER BY i, e.pos) AS place FROM p JOIN e USING (blog, page) WHERE i <= 2 AND NOT (i = 2 AND e.pos = 2 AND blog % 5 = 0)),
m AS (SELECT a.blog, bool_and(a.key = f.key) AS fits FROM a JOIN f ON a.blog = f.blog AND a.place = f.place GROUP BY 1),
s AS (SELECT blog, count(*) AS n_links FROM a GROUP BY 1),
v AS (SELECT DISTINCT a.blog FROM a JOIN a b ON a.blog = b.blog AND a.key = b.key AND a.number = 1 AND b.number = 2)"""


@R.add(
    "x12_stitched_pages",
    f"""WITH RECURSIVE {CHAIN_SQL} SELECT blog, CASE WHEN ending IN ('ambiguous', 'broken') THEN ending WHEN ending = 'cyclic' THEN 'too_long' WHEN n_pages = 1 THEN 'single' WHEN v.blog IS NOT NULL THEN 'overlap'
WHEN NOT coalesce(fits, true) THEN 'not_feed' ELSE 'whole' END AS outcome, n_pages::BIGINT AS n_pages, n_links FROM z JOIN s USING (blog) LEFT JOIN v USING (blog) LEFT JOIN m USING (blog)""",
)
def stitched_pages(t):
    """A customer's orders as pages, in order of their keys; late ones of low priority lead back to the first, urgent ones to a page that isn't there as well, and orders without lines are no pages."""
    own = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    p = t.orders.select(F.col("o_custkey").alias("blog"), F.col("o_orderkey").alias("page"), F.row_number().over(own).alias("i"), F.lead("o_orderkey").over(own).alias("following"), F.first("o_orderkey").over(own).alias("first"), "o_orderstatus", "o_orderpriority")
    place = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    lines = t.dealt("lineitem", "l_orderkey").select(F.col("l_orderkey").alias("page"), F.row_number().over(place).alias("pos"), F.col("l_partkey").alias("key"))
    entries = lines.join(t.dealt("orders", "o_orderkey", by="lineitem").select(F.col("o_orderkey").alias("page"), F.col("o_custkey").alias("blog")), "page")
    on = p.where("following IS NOT NULL")
    back = F.when(F.col("o_orderpriority").startswith("5") & (F.col("i") > 4), F.col("first")).otherwise(F.col("following"))
    lost = on.where(F.col("o_orderpriority").startswith("1") & (F.col("o_orderstatus") == "F") & (F.col("i") > 2)).select("blog", "page", (F.col("first") - 1).alias("target"))
    nexts = on.select("blog", "page", back.alias("target")).unionByName(lost)
    newest = entries.join(p.where("i <= 2").select("page", "i"), "page").where("NOT (i = 2 AND pos = 2 AND blog % 5 = 0)")
    feed = newest.select(F.col("blog").alias("feed"), (F.row_number().over(Window.partitionBy("blog").orderBy("i", "pos")) - 1).alias("pos"), "key", F.lit(None).cast("timestamp").alias("at"))
    return C.stitched(p.where("i = 1").select("blog", "page"), nexts, entries, feed)
