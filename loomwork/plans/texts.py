"""URL, title, date and label functions over pages, documents, orders and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.functions import dates as D
from loomwork.functions import schedule as S
from loomwork.functions import text as X
from loomwork.functions import urls as U
from loomwork.plans.registry import Registry

R = Registry()

PARTS_SQL = r"""p AS (SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host,
 replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '//', '/') AS path, regexp_extract(url, '\?([^#]*)', 1) AS query FROM pages)"""


@R.add("f01_canonical_link", f"WITH {PARTS_SQL} SELECT page_id, scheme || '://' || host || path || CASE WHEN query = '' THEN '' ELSE '?' || query END AS link FROM p")
def canonical_links(t):
    return t.pages.select("page_id", U.canonical_link(F.col("url")).alias("link"))


@R.add(
    "f02_canonical_uri",
    rf"""WITH {PARTS_SQL}, q AS (SELECT page_id, unnest(string_split(query, '&')) AS tok FROM p WHERE query <> ''),
k AS (SELECT page_id, string_agg(tok, '&' ORDER BY tok) AS query FROM q WHERE regexp_extract(tok, '^[^=]*') IN ('page','year','m','start','offset','skip','updated-max','sort','order','format') GROUP BY page_id)
SELECT p.page_id, host || CASE WHEN path = '/' AND p.query = '' THEN '' ELSE path END || coalesce('?' || k.query, '') AS canonical FROM p LEFT JOIN k USING (page_id)""",
)
def canonical_uris(t):
    return t.pages.select("page_id", U.canonical_string(U.canonical_uri(U.canonical_link(F.col("url")))).alias("canonical"))


@R.add(
    "f03_uri_key",
    rf"""WITH {PARTS_SQL}, q AS (SELECT page_id, unnest(string_split(query, '&')) AS tok FROM p WHERE query <> ''),
k AS (SELECT page_id, string_agg(tok, '&' ORDER BY tok) AS query FROM q WHERE regexp_extract(tok, '^[^=]*') IN ('page','year','m','start','offset','skip','updated-max','sort','order','format') GROUP BY page_id)
SELECT p.page_id, CASE WHEN host IN ('ththre.example.com', 'blog.ththre.example.com') THEN '__same_hosts' ELSE host END || rtrim(path, '/') || coalesce('?' || k.query, '') AS k FROM p LEFT JOIN k USING (page_id)""",
)
def uri_keys(t):
    curi = U.canonical_uri(U.canonical_link(F.col("url")))
    return t.pages.select("page_id", U.uri_key(curi, ["ththre.example.com", "blog.ththre.example.com"]).alias("k"))


@R.add("f05_normalize_title", r"SELECT page_id, regexp_replace(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), ' +', ' ', 'g') AS title FROM pages")
def titles(t):
    return t.pages.select("page_id", X.normalized_title(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"))


@R.add("f06_equalize_title", "SELECT doc_id, md5(lower(replace(replace(replace(replace(replace(replace(text, '’', ''''), '‘', ''''), '”', '\"'), '“', '\"'), '…', '...'), chr(8202), ' '))) AS digest FROM documents")
def equal_titles(t):
    return t.documents.select("doc_id", F.md5(X.equalized_title(F.col("text"))).alias("digest"))


@R.add(
    "f07_post_slug",
    """WITH w AS (SELECT page_id, regexp_extract_all(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), '[A-Za-z0-9_]+')[1:10] AS w FROM pages),
l AS (SELECT page_id, w, list_filter(range(1, len(w) + 1), lambda i: length(array_to_string(w[1:i], '-')) <= 100) AS fits FROM w)
SELECT page_id, CASE WHEN len(w) = 0 THEN '' WHEN len(fits) = 0 THEN substr(w[1], 1, 100) ELSE array_to_string(w[1:list_max(fits)], '-') END AS slug FROM l""",
)
def slugs(t):
    return t.pages.select("page_id", X.post_slug(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("slug"))


@R.add("f08_guid", "SELECT o_orderkey, sha256(o_orderkey || '-welcome') AS welcome, sha256(o_orderkey || '-final') AS final FROM orders")
def guids(t):
    of = lambda s: X.guid(F.concat(F.col("o_orderkey").cast("string"), F.lit(s)))
    return t.orders.select("o_orderkey", of("-welcome").alias("welcome"), of("-final").alias("final"))


@R.add("f09_rfc1123z", "SELECT o_orderkey, strftime(o_orderdate, '%a, %d %b %Y %H:%M:%S +0000') AS pub_date FROM orders")
def pub_dates(t):
    return t.orders.select("o_orderkey", S.rfc1123z(F.col("o_orderdate")).alias("pub_date"))


@R.add("f10_parse_rfc1123", "SELECT o_orderkey, strftime(date_trunc('second', o_orderdate), '%Y-%m-%d %H:%M:%S') AS parsed FROM orders")
def parsed_dates(t):
    parsed = S.parse_rfc1123(S.rfc1123z(F.col("o_orderdate")))
    return t.orders.select("o_orderkey", F.date_format(parsed, "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@R.add("f11_parse_iso", "SELECT o_orderkey, strftime(o_orderdate - INTERVAL 2 HOURS, '%Y-%m-%d %H:%M') AS parsed FROM orders")
def parsed_iso(t):
    text = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))
    return t.orders.select("o_orderkey", F.date_format(S.parse_iso8601(text), "yyyy-MM-dd HH:mm").alias("parsed"))


@R.add("f12_url_date", "SELECT o_orderkey, o_orderdate::DATE AS day FROM orders")
def url_dates(t):
    url = F.concat(F.lit("https://example.com/"), F.date_format("o_orderdate", "yyyy/MM/dd"), F.lit("/title/"))
    return t.orders.select("o_orderkey", U.url_date(url).alias("day"))


@R.add(
    "f15_zones",
    """SELECT event_id, strftime(timezone('America/Los_Angeles', timezone('UTC', ts)), '%Y-%m-%d %H:%M:%S') AS local_time,
timezone('America/Los_Angeles', timezone('UTC', ts))::DATE AS local_date, lower(strftime(timezone('America/Los_Angeles', timezone('UTC', ts)), '%a')) AS dow FROM events""",
)
def zones(t):
    at = S.local(F.col("ts"), "America/Los_Angeles")
    return t.events.select("event_id", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("local_time"), F.to_date(at).alias("local_date"), S.day_of_week(at).alias("dow"))


@R.add("f16_early_morning", "SELECT event_id, hour(timezone('Pacific/Auckland', timezone('UTC', ts))) < 5 AS early FROM events")
def early(t):
    return t.events.select("event_id", S.is_early_morning(F.col("ts"), "Pacific/Auckland").alias("early"))


@R.add(
    "f17_next_run",
    """WITH d AS (SELECT o_orderkey, o_orderdate::DATE AS day, timezone('UTC', timezone('America/Los_Angeles', (o_orderdate::DATE + i::INT)::TIMESTAMP)) + INTERVAL 2 HOURS AS run, i
FROM orders, range(1, 15) r(i))
SELECT o_orderkey, strftime(min(run), '%Y-%m-%d %H:%M') AS run_at, min(i) - 1 AS skipped FROM (SELECT d.*, day + 3 + INTERVAL 10 HOURS AS now FROM d) WHERE run >= now GROUP BY 1""",
)
def next_runs(t):
    day = F.to_date("o_orderdate")
    run = S.next_run(day, "America/Los_Angeles", F.date_add(day, 3).cast("timestamp_ntz") + F.expr("INTERVAL 10 HOURS"))
    return t.orders.select("o_orderkey", run.alias("r")).select("o_orderkey", F.date_format("r.run_at", "yyyy-MM-dd HH:mm").alias("run_at"), F.col("r.skipped").cast("long").alias("skipped"))


@R.add("f18_realistic_date", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN (CASE WHEN hour(ts) < 5 THEN ts::DATE ELSE ts::DATE + 1 END) WHEN event_id % 3 = 1 THEN ts::DATE ELSE ts::DATE + 2 END AS day FROM events")
def realistic(t):
    ts = F.col("ts")
    scheduled = F.when(F.col("event_id") % 3 == 1, F.date_sub(F.to_date(ts), 4)).when(F.col("event_id") % 3 == 2, F.date_add(F.to_date(ts), 2))
    return t.events.select("event_id", S.realistic_date(scheduled, ts, "UTC").alias("day"))


@R.add("f19_retry_delay", "SELECT n_nationkey AS attempts, CAST(power(n_nationkey, 4) + 5 AS BIGINT) AS delay, n_nationkey >= 25 AS failed, CAST(least(power(5, n_nationkey), 600) AS BIGINT) AS backoff FROM nation")
def retries(t):
    n = F.col("n_nationkey")
    return t.nation.select(n.alias("attempts"), S.retry_delay(n).alias("delay"), (n >= 25).alias("failed"), S.backoff(n).alias("backoff"))


@R.add("f21_redacted_ip", "SELECT c_custkey, (c_custkey % 200) || '.' || (c_custkey % 100) || '.0.1' AS ip FROM customer")
def ips(t):
    k = F.col("c_custkey")
    ip = F.concat_ws(".", *[(k % m).cast("string") for m in (200, 100, 50, 7)])
    return t.customer.select("c_custkey", X.redacted_ip(ip).alias("ip"))


@R.add("f22_referrer", "SELECT page_id, CASE WHEN regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) IN ('ththre.example.com') THEN 'own' ELSE url END AS referrer FROM pages")
def referrers(t):
    return t.pages.select("page_id", U.collapsed_referrer(F.col("url"), ["ththre.example.com"], "own").alias("referrer"))


@R.add("f25_ordinal", "SELECT c_custkey, CASE WHEN c_custkey % 100 IN (11, 12, 13) THEN 'th' WHEN c_custkey % 10 = 1 THEN 'st' WHEN c_custkey % 10 = 2 THEN 'nd' WHEN c_custkey % 10 = 3 THEN 'rd' ELSE 'th' END AS suffix FROM customer")
def ordinals(t):
    return t.customer.select("c_custkey", X.ordinal_suffix(F.col("c_custkey")).alias("suffix"))


@R.add("f27_regex_capture", "SELECT c_custkey, nullif(regexp_extract(c_name, '#0*([0-9]+)', 1), '') AS first_argument FROM customer")
def captures(t):
    return t.customer.select("c_custkey", F.nullif(F.regexp_extract("c_name", "#0*([0-9]+)", 1), F.lit("")).alias("first_argument"))


@R.add("f28_casts", "SELECT p_partkey, try_cast(regexp_replace(p_brand, 'Brand#1', '') AS BIGINT) AS number, CAST(p_size > 10 AS INT) AS flag, CASE WHEN p_brand IN ('Brand#11', 'Brand#12') THEN p_brand END AS brand FROM part")
def casts(t):
    number = F.regexp_replace("p_brand", "Brand#1", "").try_cast("bigint")
    return t.part.select("p_partkey", number.alias("number"), (F.col("p_size") > 10).cast("int").alias("flag"), X.one_of(F.col("p_brand"), ["Brand#11", "Brand#12"]).alias("brand"))


@R.add("f29_concat_nulls", "SELECT p_partkey, concat(nullif(p_brand, 'Brand#11'), '/', p_size) AS ignoring, nullif(p_brand, 'Brand#11') || '/' || p_size AS strict FROM part")
def concats(t):
    brand = F.nullif(F.col("p_brand"), F.lit("Brand#11"))
    return t.part.select("p_partkey", F.concat_ws("", brand, F.lit("/"), F.col("p_size").cast("string")).alias("ignoring"), F.concat(brand, F.lit("/"), F.col("p_size").cast("string")).alias("strict"))


@R.add(
    "f31_path_ladder",
    r"""WITH b AS (SELECT page_id, regexp_extract(url, '^[a-z]+://') AS head, string_split(regexp_replace(rtrim(regexp_extract(url, '^[^?#]*'), '/'), '^[a-z]+://', ''), '/') AS parts FROM pages)
SELECT page_id, unnest(range(len(parts), 0, -1)) AS n, head || array_to_string(parts[1:n], '/') AS step FROM b""",
)
def ladders(t):
    steps = t.pages.select("page_id", F.posexplode(U.path_ladder(F.col("url"))).alias("i", "step"))
    parts = F.size(F.split(F.regexp_replace("step", "^[a-z]+://", ""), "/"))
    return steps.select("page_id", parts.cast("long").alias("n"), "step")


@R.add("p15_path_class", r"SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'archives' WHEN o_orderkey % 4 = 1 THEN 'main' WHEN o_orderkey % 4 = 2 THEN 'post' ELSE 'other' END AS class FROM orders")
def path_classes(t):
    k = F.col("o_orderkey") % 4
    path = F.when(k == 0, F.lit("/x/blog-archive.html")).when(k == 1, F.lit("/essays")).when(k == 2, F.date_format("o_orderdate", "'/'yyyy'/'MM'/'dd")).otherwise(F.lit("/posts/hello"))
    return t.orders.select("o_orderkey", U.path_class(path).alias("class"))


@R.add("f33_xpath_masks", r"SELECT c_custkey, regexp_replace('/html[1]/body[1]/div[' || (c_custkey % 9 + 1) || ']/a[' || c_custkey || ']', '\[[0-9]+\]$', '[*]') AS mask FROM customer")
def xpath_masks(t):
    from loomwork.operators.masks import masked, segments

    path = F.format_string("/html[1]/body[1]/div[%d]/a[%d]", F.col("c_custkey") % 9 + 1, F.col("c_custkey"))
    return t.customer.select("c_custkey", masked(segments(path), F.lit(4)).alias("mask"))


@R.add("f34_classes", "SELECT p_partkey, array_to_string(list_sort(string_split(lower(p_type || ' ' || p_brand), ' ')), ' ') AS classes FROM part")
def class_lists(t):
    classes = F.concat_ws(" ", "p_type", F.concat(F.lit("post-"), F.col("p_partkey").cast("string")), "p_brand")
    return t.part.select("p_partkey", X.normalized_classes(classes).alias("classes"))


@R.add("f35_thresholds", "SELECT n, n - CASE WHEN n <= 3 THEN 0 WHEN n <= 7 THEN 1 WHEN n <= 25 THEN 2 WHEN n <= 62 THEN 3 ELSE 7 END AS archives, n - CASE WHEN n <= 9 THEN 0 WHEN n <= 19 THEN 1 ELSE 2 END AS categories FROM (SELECT DISTINCT p_size * 2 AS n FROM part)")
def thresholds(t):
    n = t.part.select((F.col("p_size") * 2).alias("n")).distinct()
    return n.select("n", X.archives_threshold(F.col("n")).alias("archives"), X.categories_threshold(F.col("n")).alias("categories"))


@R.add("f37_series", "SELECT c_custkey, 4 AS n, round((c_custkey % 7) + (c_custkey % 5) + 1 + 0.5, 4) AS total FROM customer")
def number_series(t):
    k = F.col("c_custkey")
    text = F.concat_ws(";", (k % 7).cast("string"), (k % 5).cast("string"), F.lit("1"), F.lit("0.5"))
    return t.customer.select("c_custkey", X.series(text).alias("s")).select("c_custkey", F.size("s").alias("n"), F.round(F.aggregate("s", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@R.add("a17_rms_deviation", "SELECT c_custkey, round(sqrt((power(c_custkey % 7 - 2, 2) + power(c_custkey % 5 - 3, 2)) / 2), 6) AS rms FROM customer")
def rms(t):
    k = F.col("c_custkey")
    a = X.series(F.concat_ws(";", (k % 7).cast("string"), (k % 5).cast("string")))
    return t.customer.select("c_custkey", F.round(X.rms_deviation(a, X.series(F.lit("2;3"))), 6).alias("rms"))


@R.add("a24_nice_axis", "WITH m AS (SELECT o_orderpriority, max(o_totalprice) AS x FROM orders GROUP BY 1), t AS (SELECT *, power(10, ceil(log10(x))) AS ten FROM m) SELECT o_orderpriority, round(CASE WHEN ten / x >= 5 THEN ten / 5 WHEN ten / x >= 2 THEN ten / 2 ELSE ten END, 2) AS axis FROM t")
def nice_axis(t):
    return t.orders.groupBy("o_orderpriority").agg(F.round(X.nice_maximum(F.max("o_totalprice")), 2).alias("axis"))


@R.add("f38_json_maps", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\"}' AS js FROM events")
def json_maps(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.to_json(F.struct("event_id", "event_type")).alias("js"))


@R.add("f39_truncated_payload", "SELECT doc_id, strlen(text) > 4000 AS refetch, CASE WHEN strlen(text) <= 4000 THEN md5(text) END AS digest FROM documents")
def payloads(t):
    return t.documents.select("doc_id", X.truncated_payload(F.col("text")).alias("p")).select("doc_id", F.col("p.refetch").alias("refetch"), F.md5("p.payload").alias("digest"))


@R.add("f40_xml_escape", "SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&#34;'), '''', '&#39;')) AS digest FROM pages")
def xml_escapes(t):
    return t.pages.select("page_id", F.md5(X.escaped_xml(F.col("html"))).alias("digest"))


@R.add("f41_percent", "SELECT o_orderpriority, (t // 10) || '.' || (t % 10) || '%' AS done FROM (SELECT o_orderpriority, (2000 * count(*) FILTER (o_orderstatus = 'F') + count(*)) // (2 * count(*)) AS t FROM orders GROUP BY 1)")
def percents(t):
    return t.orders.groupBy("o_orderpriority").agg(X.percent(F.count_if(F.col("o_orderstatus") == "F"), F.count("*")).alias("done"))


@R.add("f44_strip_suffix", r"SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '[0-9]+/?$', '') AS root FROM pages")
def stripped(t):
    return t.pages.select("page_id", F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), r"[0-9]+/?$", "").alias("root"))


@R.add("d17_urls_in_text", r"SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS link FROM pages")
def urls_in_text(t):
    return t.pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("link"))


@R.add("a21_common_prefix", "SELECT p_type, min(p_name) AS low, max(p_name) AS high FROM part GROUP BY 1")
def prefix_bounds(t):
    """The least and the greatest title of a group hold the prefix that all of it has in common."""
    return t.part.groupBy("p_type").agg(F.min("p_name").alias("low"), F.max("p_name").alias("high"))


@R.add("a21_common_prefix_text", "SELECT p_brand, (SELECT max(i) FROM range(0, least(length(low), length(high)) + 1) r(i) WHERE substr(low, 1, i) = substr(high, 1, i)) AS n FROM (SELECT p_brand, min(p_name) AS low, max(p_name) AS high FROM part GROUP BY 1)")
def common_prefixes(t):
    bounds = t.part.groupBy("p_brand").agg(F.min("p_name").alias("low"), F.max("p_name").alias("high"))
    return bounds.select("p_brand", F.length(X.common_prefix(F.col("low"), F.col("high"))).cast("long").alias("n"))


@R.add("f42_zone_fallback", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'Europe/Paris' WHEN c_custkey % 3 = 1 THEN 'Etc/GMT' || CASE WHEN c_custkey % 5 > 0 THEN '+' || (c_custkey % 5) ELSE '' END ELSE 'UTC' END AS zone FROM customer")
def zone_fallback(t):
    """A known id, else a group of the whole-hour offset in minutes, else UTC."""
    k = F.col("c_custkey")
    sent = t.customer.select("c_custkey", F.when(k % 3 == 0, "Europe/Paris").otherwise("Mars/Base").alias("id"), F.when(k % 3 == 1, (k % 5) * 60 + 30).otherwise(F.lit(9999)).alias("offset"))
    ids = t.spark.createDataFrame([("Europe/Paris",), ("America/New_York",)], "id string").withColumn("known", F.col("id"))
    groups = t.spark.createDataFrame([(h, "Etc/GMT" + (f"+{h}" if h else "")) for h in range(13)], "hours int, by_offset string")
    joined = sent.join(F.broadcast(ids), "id", "left").join(F.broadcast(groups), F.col("hours") == F.floor(F.col("offset") / 60), "left")
    return joined.select("c_custkey", F.coalesce("known", "by_offset", F.lit("UTC")).alias("zone"))


#: Forms of one date, and what of it each says.
DATE_FORMS = ("d MMMM yyyy", "MMM d, yyyy", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-DDD", "dd-MMM-yyyy", "yyyy/MM/dd", "d.M.yyyy", "yyyyMMdd", "''yy", "MMMM", "h:mm a 'EST'")


@R.add(
    "f14_parsed_dates",
    """SELECT o_orderkey, CASE WHEN k < 9 THEN year(d) END AS y, CASE WHEN k IN (8, 10) THEN NULL ELSE month(d) END AS m, CASE WHEN k < 8 THEN day(d) END AS d, CASE k WHEN 2 THEN hour(d) WHEN 10 THEN hour(d) END AS h, (CASE k WHEN 2 THEN 0 WHEN 10 THEN -300 END)::BIGINT AS zone
FROM (SELECT o_orderkey, o_orderdate + INTERVAL 1 MINUTE * (o_orderkey % 1440) AS d, o_orderkey % 11 AS k FROM orders)""",
)
def parsed_dates(t):
    """Order dates, with a time from the key, written in eleven ways; the parts that each way has come back."""
    at = F.col("o_orderdate") + F.make_dt_interval(mins=(F.col("o_orderkey") % 1440).cast("int"))
    text = F.lit(None).cast("string")
    for k, form in enumerate(DATE_FORMS):
        text = F.when(F.col("o_orderkey") % len(DATE_FORMS) == k, F.concat(F.lit("on "), F.date_format(at, form))).otherwise(text)
    rows = t.orders.select("o_orderkey", D.parsed_date(text).alias("p"))
    return rows.select("o_orderkey", *[F.col(f"p.{a}").cast("long").alias(b) for a, b in (("year", "y"), ("month", "m"), ("day", "d"), ("hour", "h"), ("offset", "zone"))])
