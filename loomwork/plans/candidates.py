"""Wrapper induction over the star schema: orders as pages, line items as their links, suppliers as feeds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomwork.functions import schedule as S
from loomwork.functions import text as X
from loomwork.functions import urls as U
from loomwork.operators import archives as A
from loomwork.operators import candidates as C
from loomwork.operators import sequences as Q
from loomwork.plans.registry import Registry
from loomwork.plans.sequences import FEED_SQL, feed

R = Registry()


@R.add("x05_order_flags", "SELECT o_custkey, bool_and(d IS NULL OR o_totalprice >= d) AS is_ascending, bool_and(d IS NULL OR o_totalprice <= d) AS is_descending, count(*) AS n FROM (SELECT o_custkey, o_totalprice, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS d FROM orders) GROUP BY 1")
def order_flags(t):
    return C.order_flags(t.orders, ["o_custkey"], "o_totalprice", ["o_orderkey"])


MATCH_SQL = """feed AS (SELECT DISTINCT l_suppkey AS feed, l_partkey AS key FROM lineitem WHERE l_returnflag = 'R'),
lists AS (SELECT DISTINCT l_suppkey * 10 + l_linenumber AS list, l_suppkey AS feed, l_partkey AS key FROM lineitem),
n AS (SELECT feed, count(*) AS n_feed FROM feed GROUP BY 1)"""


@R.add("x10_match_kinds", f"WITH {MATCH_SQL}, m AS (SELECT list, lists.feed, count(feed.key) AS n_match FROM lists LEFT JOIN feed ON feed.feed = lists.feed AND feed.key = lists.key GROUP BY 1, 2) SELECT list, n_match, n_feed, CASE WHEN n_match = n_feed THEN 'all' WHEN n_match >= n_feed - CASE WHEN n_feed <= 3 THEN 0 WHEN n_feed <= 7 THEN 1 WHEN n_feed <= 25 THEN 2 WHEN n_feed <= 62 THEN 3 ELSE 7 END THEN 'almost' ELSE 'none' END AS kind FROM m JOIN n USING (feed)")
def match_kinds(t):
    entries = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("feed"), F.col("l_partkey").alias("key")).distinct()
    lists = t.lineitem.select((F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("list"), F.col("l_suppkey").alias("feed"), F.col("l_partkey").alias("key"))
    return C.match_kinds(lists, entries, X.archives_threshold)


@R.add("x11_covering_triples", "WITH m AS (SELECT s_nationkey AS c, bit_or(1::BIGINT << (s_suppkey % 9)::INT) AS bits FROM supplier GROUP BY 1) SELECT a.c AS c1, b.c AS c2, d.c AS c3 FROM m a JOIN m b ON a.c > b.c JOIN m d ON b.c > d.c WHERE ((a.bits | b.bits | d.bits) & 511) = 511")
def covering(t):
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("s_suppkey", F.lit(9)).cast("int"))
    m = t.supplier.groupBy(F.col("s_nationkey").alias("c")).agg(F.bit_or(bit).alias("bits"))
    return C.covering_sets(m, F.lit(511).cast("bigint"), 3)


@R.add("x15_date_path", "SELECT c_custkey AS page_set, CASE c_custkey % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'meta' WHEN 2 THEN 'time' END AS source, CASE c_custkey % 4 WHEN 0 THEN '/p[1]' WHEN 1 THEN '/meta[1]' ELSE '/time[1]' END AS xpath FROM customer WHERE c_custkey % 4 <> 3")
def date_path(t):
    """Sets with one path, with one meta among others, with one time, and with nothing to choose by."""
    k = F.col("c_custkey") % 4
    row = lambda s, x: F.struct(F.lit(s).alias("source"), F.lit(x).alias("xpath"))
    two = [row("text", "/p[1]"), row("text", "/p[2]")]
    found = F.when(k == 0, F.array(two[0])).when(k == 1, F.array(row("meta", "/meta[1]"), *two, row("time", "/time[1]"))).when(k == 2, F.array(row("time", "/time[1]"), *two)).otherwise(F.array(*two))
    return C.date_path(t.customer.select(F.col("c_custkey").alias("page_set"), F.explode(found).alias("f")).select("page_set", "f.*"))


@R.add("x16_missing_titles", "SELECT p_partkey AS key, CASE WHEN p_partkey % 4 = 0 THEN p_name WHEN p_partkey % 4 = 1 THEN 'feed ' || p_brand WHEN p_partkey % 4 = 2 THEN 'page ' || p_type ELSE p_partkey::VARCHAR END AS title FROM part")
def titles(t):
    key, k = F.col("p_partkey").alias("key"), F.col("p_partkey") % 4
    links = t.part.select(key, F.when(k == 0, F.col("p_name")).otherwise("").alias("title"))
    a = t.part.where(k == 1).select(key, F.concat(F.lit("feed "), F.col("p_brand")).alias("title"))
    b = t.part.where((k == 1) | (k == 2)).select(key, F.concat(F.lit("page "), F.col("p_type")).alias("title"))
    return C.best_titles(links, a, b)


@R.add("x22_partly_known_dates", "SELECT l_orderkey, l_partkey, coalesce(CASE WHEN l_linenumber % 2 = 0 THEN l_shipdate::DATE END, o_orderdate::DATE) AS day FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def known_dates(t):
    """Dates of links where the link has one, else those of its page."""
    pages = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.to_date("o_orderdate").alias("page_day"))
    own = F.when(F.col("l_linenumber") % 2 == 0, F.to_date("l_shipdate"))
    return t.lineitem.join(pages, "l_orderkey").select("l_orderkey", "l_partkey", F.coalesce(own, "page_day").alias("day"))


@R.add("x24_public_and_total", "SELECT o_custkey, count(*) FILTER (o_orderstatus <> 'P') AS n_public, count(*) AS n_total FROM orders GROUP BY 1")
def public_counts(t):
    return t.orders.groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") != "P").alias("n_public"), F.count("*").alias("n_total"))


@R.add("e05_match_except_first", f"WITH {FEED_SQL} SELECT feed, key AS first_key FROM b WHERE pos = 0")
def except_first(t):
    rows = feed(t)
    rest = rows.where("pos > 0").select("feed", (F.col("pos") - 1).alias("pos"), "key")
    lonely = rows.groupBy("feed").agg(F.count("*").alias("n")).where("n = 1").select("feed")
    found = Q.match_except_first(rows, rest)
    # a feed of one entry has nothing after it: its entry is the first one
    return found.unionByName(rows.join(lonely, "feed", "left_semi").select("feed", F.col("key").alias("first_key")))


@R.add("p14_not_seen", "SELECT page_id FROM pages WHERE url NOT LIKE '%spam-farm%' AND url NOT IN (SELECT url FROM pages WHERE page_id % 5 = 0)")
def not_seen(t):
    seen = t.pages.where("page_id % 5 = 0").select("url").distinct()
    return t.pages.where(~F.col("url").contains("spam-farm")).join(seen, "url", "left_anti").select("page_id")


@R.add("p18_later_links", """WITH l AS (SELECT l_orderkey AS page, l_partkey AS url, l_linenumber % 3 AS depth, l_partkey % 10 = 0 AS is_feed, CASE WHEN l_partkey % 3 = 0 THEN 'post' ELSE 'other' END AS class, l_orderkey % 2 = 0 AS from_start FROM lineitem),
k AS (SELECT * FROM l WHERE NOT is_feed AND (NOT from_start OR depth <= 1)), c AS (SELECT page, count(*) AS n FROM k GROUP BY 1) SELECT page, url FROM k JOIN c USING (page) WHERE n <= 4 OR class <> 'post'""")
def later(t):
    key = F.col("l_partkey")
    links = t.lineitem.select(
        F.col("l_orderkey").alias("page"), key.alias("url"), (F.col("l_linenumber") % 3).alias("depth"), (key % 10 == 0).alias("is_feed"),
        F.when(key % 3 == 0, "post").otherwise("other").alias("class"), (F.col("l_orderkey") % 2 == 0).alias("from_start"),
    )
    return C.later_links(links, 4).select("page", "url")


ZONES = (("America/New_York", "Eastern"), ("America/Detroit", "Eastern"), ("Europe/Paris", "Central Europe"), ("America/Port_of_Spain", "Atlantic"), ("America/Halifax", "Atlantic"))


@R.add("d20_zone_labels", f"WITH z AS (SELECT n_name, CASE WHEN n_regionkey > 1 THEN {[z for z, _ in ZONES]}[n_nationkey % 5 + 1] ELSE 'Europe/Paris' END AS zone, CASE WHEN n_regionkey > 1 THEN {[n for _, n in ZONES]}[n_nationkey % 5 + 1] ELSE 'Central Europe' END AS name FROM nation), c AS (SELECT name, count(DISTINCT zone) AS n FROM z GROUP BY 1) SELECT n_name, CASE WHEN n > 1 THEN name || ' (' || replace(split_part(zone, '/', 2), '_', ' ') || ')' ELSE name END AS label FROM z JOIN c USING (name)")
def zone_labels(t):
    """Nations and the labels of their zones, which name the city where several zones in use share a name."""
    at = lambda i: F.get(F.array(*[F.lit(z[i]) for z in ZONES]), F.when(F.col("n_regionkey") > 1, F.col("n_nationkey") % 5).otherwise(2).cast("int"))
    own = t.nation.select("n_name", at(0).alias("zone"), at(1).alias("name"))
    return own.select("n_name", "zone").join(C.zone_labels(own.select("zone", "name").distinct()), "zone").select("n_name", "label")


@R.add("d21_start_pages", r"""WITH b AS (SELECT page_id, regexp_extract(url, '^[^?#]*') AS base FROM pages), p AS (SELECT DISTINCT base FROM b WHERE page_id % 2 = 0)
SELECT page_id, (SELECT max_by(p.base, length(p.base)) FROM p WHERE rtrim(b.base, '/') || '/x' LIKE rtrim(p.base, '/') || '/%') AS start FROM b""")
def start_pages(t):
    """For each address the nearest page at or above it, among those that loaded."""
    base = F.regexp_extract("url", r"^[^?#]*", 0)
    loaded = t.pages.where("page_id % 2 = 0").select(base.alias("start")).distinct().withColumn("step", F.regexp_replace("start", r"/+$", ""))
    steps = t.pages.select("page_id", F.explode(U.path_ladder(F.col("url"))).alias("step"))
    best = steps.join(loaded, "step").groupBy("page_id").agg(F.max(F.struct(F.length("start").alias("n"), "start")).alias("b"))
    return t.pages.select("page_id").join(best, "page_id", "left").select("page_id", F.col("b.start").alias("start"))


@R.add("g07_stale_dates", "SELECT o_orderkey, o_orderdate::DATE < DATE '1996-06-12' AS stale, greatest(o_orderdate::DATE, DATE '1996-06-12') AS day FROM orders")
def stale(t):
    day, today = F.to_date("o_orderdate"), F.lit("1996-06-12").cast("date")
    return t.orders.select("o_orderkey", (day < today).alias("stale"), F.greatest(day, today).alias("day"))


@R.add("g17_stalled_jobs", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1996-06-12 10:00:00' - INTERVAL 1 HOUR")
def stalled(t):
    now = F.lit("1996-06-12 10:00:00").cast("timestamp_ntz")
    return t.orders.where((F.col("o_orderstatus") == "O") & (F.col("o_orderdate") < now - F.expr("INTERVAL 1 HOUR"))).select("o_orderkey")


@R.add("g19_rescheduled", "SELECT o_orderkey, strftime(timezone('UTC', timezone('Pacific/Auckland', o_orderdate::DATE::TIMESTAMP)) + INTERVAL 2 HOURS, '%Y-%m-%d %H:%M') AS run_at, coalesce(sent > stored, false) AS accepted FROM orders LEFT JOIN (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'A') AS sent, count(*) FILTER (l_returnflag = 'R') AS stored FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def rescheduled(t):
    """The same local date in a new zone; a change counts only with a greater version."""
    run = S.run_time(F.to_date("o_orderdate"), "Pacific/Auckland")
    versions = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_if(F.col("l_returnflag") == "A").alias("sent"), F.count_if(F.col("l_returnflag") == "R").alias("stored"))
    rows = t.orders.join(versions, "o_orderkey", "left")
    return rows.select("o_orderkey", F.date_format(run, "yyyy-MM-dd HH:mm").alias("run_at"), F.coalesce(F.col("sent") > F.col("stored"), F.lit(False)).alias("accepted"))


@R.add("g22_adopted", "SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' AND o_orderkey % 2 = 0 THEN 42 ELSE o_custkey END AS o_custkey FROM orders")
def adopted(t):
    """Anonymous subscriptions that a new user brings along become that user's."""
    mine = t.orders.where("o_orderpriority = '1-URGENT' AND o_orderkey % 2 = 0").select("o_orderkey", F.lit(42).cast("bigint").alias("_user"))
    return t.orders.select("o_orderkey", "o_custkey").join(mine, "o_orderkey", "left").select("o_orderkey", F.coalesce("_user", "o_custkey").alias("o_custkey"))


@R.add("f43_show_today", "SELECT event_id, event_id % 2 = 0 AND hour(timezone('America/Los_Angeles', timezone('UTC', ts))) < 5 AS now FROM events")
def show_today(t):
    return t.events.select("event_id", ((F.col("event_id") % 2 == 0) & S.is_early_morning(F.col("ts"), "America/Los_Angeles")).alias("now"))


@R.add("f23_user_agents", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Crawler' WHEN 1 THEN 'Firefox' ELSE 'Safari' END AS browser, CASE c_custkey % 3 WHEN 0 THEN 'Crawler' WHEN 1 THEN 'Linux' ELSE 'iOS' END AS os_name, CASE WHEN c_custkey % 3 = 0 THEN 'Bingbot' END AS bot_name FROM customer")
def user_agents(t):
    k = F.col("c_custkey") % 3
    agent = (
        F.when(k == 0, "Mozilla/5.0 (compatible; bingbot/2.0)")
        .when(k == 1, "Mozilla/5.0 (X11; Linux x86_64; rv:120.0) Gecko/20100101 Firefox/120.0")
        .otherwise("Mozilla/5.0 (iPhone; CPU iPhone OS 16_1 like Mac OS X) AppleWebKit/605 Version/16.1 Mobile/15E Safari/604.1")
    )
    return t.customer.select("c_custkey", X.user_platform(agent).alias("p")).select("c_custkey", "p.browser", "p.os_name", "p.bot_name")


_SAME = "(SELECT max(i) FROM range(0, least(length({0}), length({1})) + 1) r(i) WHERE substr({0}, 1, i) = substr({1}, 1, i))"


@R.add(
    "a21_title_ends",
    f"""WITH t AS (SELECT p_brand, p_type, p_brand || ' - ' || p_name || '... | ' || p_type AS title FROM part),
    b AS (SELECT p_brand, p_type, min(title) AS lo, max(title) AS hi, min(reverse(title)) AS rlo, max(reverse(title)) AS rhi, min(length(title)) AS shortest FROM t GROUP BY 1, 2),
    e AS (SELECT *, substr(lo, 1, {_SAME.format("lo", "hi")}) AS head, reverse(substr(rlo, 1, {_SAME.format("rlo", "rhi")})) AS tail FROM b),
    s AS (SELECT *, CASE WHEN starts_with(tail, '...') THEN substr(tail, 4) ELSE tail END AS rest FROM e)
    SELECT p_brand, p_type, CASE WHEN length(head) + length(rest) < shortest THEN head ELSE '' END AS prefix,
    CASE WHEN length(head) + length(rest) < shortest THEN rest ELSE '' END AS suffix FROM s""",
)
def title_ends(t):
    """Titles of one brand and type share the site's name before, and an ellipsis and the type behind."""
    title = F.concat("p_brand", F.lit(" - "), "p_name", F.lit("... | "), "p_type")
    return C.title_ends(t.part.select("p_brand", "p_type", title.alias("title")), ["p_brand", "p_type"])


def _unordered_sql() -> str:
    """A step after another over one list for each number of stars; each step that finds a list raises the least length."""
    head = """r AS (SELECT CASE WHEN o_custkey < 750 THEN o_custkey ELSE 100000 + o_custkey % 100 END AS page, l_partkey AS key, l_returnflag AS f, l_quantity AS q, l_discount AS d FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
feed AS (SELECT DISTINCT page, key AS feed_key FROM r WHERE f = 'R'),
x AS (SELECT page, 1 AS stars, key FROM r WHERE f = 'R' AND q <= 47 UNION ALL SELECT page, 2, key FROM r WHERE d > 0.005 UNION ALL SELECT page, 3, key FROM r WHERE f <> 'A' OR q > 3),
s AS (SELECT x.page, stars, count(*) AS n, count(DISTINCT key) AS nd, count(DISTINCT feed_key) AS ni FROM x LEFT JOIN feed ON feed.page = x.page AND feed_key = key GROUP BY 1, 2),
v AS (SELECT page, """ + ", ".join(f"max({c}) FILTER (stars = {k}) AS {c}{k}" for k in (1, 2, 3) for c in ("n", "nd", "ni")) + """ FROM s GROUP BY 1),
b AS (SELECT p.page, coalesce(nf, 0) AS nf, CASE WHEN nf <= 3 THEN nf WHEN nf <= 7 THEN nf - 1 WHEN nf <= 25 THEN nf - 2 WHEN nf <= 62 THEN nf - 3 ELSE nf - 7 END AS e, v.* EXCLUDE page, CASE WHEN p.page % 7 = 0 THEN 6 + p.page % 40 ELSE 1 END AS least, p.page % 14 = 0 AS dated
  FROM (SELECT DISTINCT page FROM r) p LEFT JOIN (SELECT page, count(*) AS nf FROM feed GROUP BY 1) USING (page) LEFT JOIN v USING (page)),
a AS (SELECT *, CASE WHEN nf > 0 AND nf >= least THEN CASE """ + " ".join(f"WHEN n{k} < nf AND n{k} >= e AND ni{k} >= e AND ni{k} = nd{k} THEN {k}" for k in (1, 2, 3)) + """ END END AS t0 FROM b),
w0 AS (SELECT * REPLACE (CASE WHEN t0 IS NOT NULL THEN nf + 1 ELSE least END AS least, dated AND t0 IS NULL AS dated) FROM a)"""
    rows, n = ["SELECT page, 'almost_feed' AS kind, t0 AS stars, nf AS n FROM z WHERE t0 IS NOT NULL"], 0
    for kind, has in (("shuffled", "ni{k} = nf"), ("shuffled_almost", "ni{k} < nf AND ni{k} >= e")):
        for k in (1, 2, 3):
            took = f"coalesce(NOT dated AND nf > 0 AND n{k} >= nf AND n{k} >= least AND {has.format(k=k)}, false)"
            head += f",\nw{n + 1} AS (SELECT * REPLACE (CASE WHEN {took} THEN nd{k} + 1 ELSE least END AS least), {took} AS t{n + 1} FROM w{n})"
            rows.append(f"SELECT page, '{kind}', {k}, nd{k} FROM z WHERE t{n + 1}")
            n += 1
    head += f",\nz AS (SELECT *, nf >= 31 AND nf >= least AS t7 FROM w{n})"
    none = " AND ".join(["t0 IS NULL", *(f"NOT t{i}" for i in range(1, 8))])
    return f"WITH {head}\n" + "\nUNION ALL ".join([*rows, "SELECT page, 'long_feed', NULL, nf FROM z WHERE t7", f"SELECT page, 'none', NULL, NULL FROM z WHERE {none}"])


@R.add("x10_unordered_matches", _unordered_sql())
def unordered(t):
    """A customer's (or several customers') line items as a page: what was returned is the feed, and three selections are its lists."""
    page = F.when(F.col("o_custkey") < 750, F.col("o_custkey")).otherwise(100000 + F.col("o_custkey") % 100)
    orders = t.dealt("orders", "o_orderkey", by="lineitem").select(F.col("o_orderkey").alias("l_orderkey"), page.alias("page"))
    rows = t.dealt("lineitem", "l_orderkey").join(orders, "l_orderkey").select("page", F.col("l_partkey").alias("key"), "l_returnflag", "l_quantity", "l_discount")
    # a page's links meet by page and key, as a page may hold a large part of them
    rows = rows.repartition(t.parts("lineitem"), "page", "key")
    one = lambda k, where: F.when(F.expr(where), F.lit(k))
    stars = F.array_compact(F.array(one(1, "l_returnflag = 'R' AND l_quantity <= 47"), one(2, "l_discount > 0.005"), one(3, "l_returnflag <> 'A' OR l_quantity > 3")))
    lists = rows.select("page", F.explode(stars).alias("stars"), "key").select("page", "stars", F.col("stars").cast("long").alias("list"), F.lit(0).alias("pos"), "key")
    pages = rows.select("page").distinct()
    known = pages.where("page % 7 = 0").select("page", (5 + F.col("page") % 40).alias("n"), (F.col("page") % 14 == 0).alias("dated"))
    found = A.unordered_matches(lists, rows.where("l_returnflag = 'R'").select("page", "key"), rows.select("page", "key"), known, X.archives_threshold)
    return found.select("page", "kind", "stars", F.col("n").cast("long").alias("n"))


@R.add(
    "x05_extraction_records",
    """WITH x AS (SELECT l_orderkey AS list, (l_orderkey % 3 + 1)::INT AS stars, l_partkey % 6 AS key, CASE WHEN l_returnflag <> 'R' OR l_orderkey % 2 = 0 THEN CASE WHEN l_orderkey % 5 = 0 THEN o_orderdate ELSE l_shipdate END END AS day, CASE WHEN l_linestatus = 'O' THEN l_shipdate END AS url_day, l_quantity > 25 AS in_feed,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos, o_orderpriority NOT LIKE '5%' AS dated FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
e AS (SELECT DISTINCT list, key FROM x WHERE in_feed), n AS (SELECT list, count(*) AS feed FROM e GROUP BY 1),
r AS (SELECT * FROM (SELECT *, lag(key) OVER (PARTITION BY list ORDER BY pos) AS b FROM x) WHERE b IS NULL OR b <> key),
m AS (SELECT list, count(*) AS n_links, bool_and(day IS NOT NULL) AS whole, any_value(dated) AS dated, any_value(stars) AS stars FROM r GROUP BY 1),
t AS (SELECT r.list, count(DISTINCT r.key) AS met FROM r JOIN e ON e.list = r.list AND e.key = r.key GROUP BY 1),
f AS (SELECT m.*, coalesce(feed, 0) AS feed, coalesce(met, 0) AS met, CASE WHEN coalesce(feed, 0) <= 3 THEN coalesce(feed, 0) ELSE feed - 1 END AS enough FROM m LEFT JOIN n USING (list) LEFT JOIN t USING (list)),
k AS (SELECT r.*, lag(day) OVER (PARTITION BY r.list ORDER BY pos) AS last FROM r JOIN f USING (list) WHERE NOT (f.dated AND met > enough) OR day IS NOT NULL),
a AS (SELECT list, count(*) AS n_kept, count(*) <> count(DISTINCT key) AS has_duplicates, count(url_day) AS n_url_days, bool_and(last IS NULL OR day IS NULL OR last >= day) AS down, bool_and(last IS NULL OR day IS NULL OR last <= day) AS up FROM k GROUP BY 1),
g AS (SELECT f.*, a.* EXCLUDE list, CASE WHEN f.dated AND (met > enough OR whole) THEN CASE WHEN met = feed THEN 'all' WHEN met >= enough THEN 'almost' ELSE 'some' END END AS dates FROM f LEFT JOIN a USING (list))
SELECT list, n_links, coalesce(n_kept, 0) AS n_kept, coalesce(has_duplicates, false) AS has_duplicates, coalesce(n_url_days, 0) AS n_url_days, dates, CASE WHEN stars >= 2 AND dates IS NOT NULL THEN down END AS is_sorted, CASE WHEN stars >= 2 AND dates IS NOT NULL THEN up END AS is_reverse_sorted FROM g""",
)
def extractions(t):
    """Orders as lists: parts in few classes, so that links repeat, with dates beside some; lines of large quantities are the feed."""
    place = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    lines, orders = t.dealt("lineitem", "l_orderkey"), t.dealt("orders", "o_orderkey", by="lineitem")
    rows = lines.withColumn("pos", F.row_number().over(place)).join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    key = F.col("l_orderkey")
    day = F.when((F.col("l_returnflag") != "R") | (key % 2 == 0), F.when(key % 5 == 0, F.col("o_orderdate")).otherwise(F.col("l_shipdate")))
    links = rows.select(key.alias("list"), (key % 3 + 1).cast("int").alias("stars"), "pos", (F.col("l_partkey") % 6).alias("key"), day.alias("day"), F.when(F.col("l_linestatus") == "O", F.col("l_shipdate")).alias("url_day"))
    dated = orders.where("o_orderpriority NOT LIKE '5%'").select(F.col("o_orderkey").alias("list"))
    feed = lines.join(orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi").where("l_quantity > 25").select(key.alias("list"), (F.col("l_partkey") % 6).alias("key"))
    return C.extraction_records(links, dated, feed, X.archives_threshold)
