"""Projections, predicates, joins, aggregates, sorts and set operations over the star schema."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomwork.operators import ranking, sets
from loomwork.operators.candidates import few
from loomwork.plans.registry import Registry

R = Registry()
CUTOFF = "1996-01-01"


@R.add("p01_constants_and_nulls", "SELECT o_orderkey, 'post' AS kind, CAST(NULL AS BIGINT) AS parent FROM orders")
def constants(t):
    return t.orders.select("o_orderkey", F.lit("post").alias("kind"), F.lit(None).cast("bigint").alias("parent"))


@R.add("p02_bound_parameters", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 7 AND o_orderstatus <> 'F'")
def bound_parameters(t):
    return t.spark.sql("SELECT o_orderkey, o_custkey FROM {orders} WHERE o_custkey = :cust AND o_orderstatus <> :status", args={"cust": 7, "status": "F"}, orders=t.orders)


@R.add("p03_null_states", "SELECT (discarded IS NULL) AS live, count(*) AS n FROM (SELECT nullif(o_orderstatus, 'F') AS discarded FROM orders) GROUP BY ALL")
def null_states(t):
    state = F.nullif(F.col("o_orderstatus"), F.lit("F"))
    return t.orders.select(state.isNull().alias("live")).groupBy("live").agg(F.count("*").alias("n"))


@R.add("p04_in_list", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def in_list(t):
    return t.customer.select("c_custkey", "c_mktsegment").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))


@R.add("p05_not_in_list", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
def not_in_list(t):
    return t.customer.select("c_custkey", "c_mktsegment").where(~F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))


@R.add("p06_case_insensitive_like", "SELECT p_partkey, p_name FROM part WHERE p_type ILIKE '%s%' AND (p_name NOT ILIKE '%1%' OR p_size > 10)")
def like(t):
    return t.part.where(F.col("p_type").ilike("%s%") & (~F.col("p_name").ilike("%1%") | (F.col("p_size") > 10))).select("p_partkey", "p_name")


@R.add("p07_pattern_from_columns", "SELECT p_partkey FROM part WHERE contains(p_name, lower(substr(p_type, 1, 1))) AND starts_with(p_brand, 'Brand#1')")
def pattern_from_columns(t):
    return t.part.where(F.col("p_name").contains(F.lower(F.substring("p_type", 1, 1))) & F.col("p_brand").startswith("Brand#1")).select("p_partkey")


@R.add("p08_older_than", f"SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '{CUTOFF}'")
def older_than(t):
    return t.orders.where(F.col("o_orderdate") < F.lit(CUTOFF).cast("timestamp_ntz")).select("o_orderkey")


@R.add("p09_boolean_column", "SELECT c_custkey, (c_acctbal < 0 OR c_mktsegment = 'BUILDING') AS is_paused FROM customer")
def boolean_column(t):
    return t.customer.select("c_custkey", ((F.col("c_acctbal") < 0) | (F.col("c_mktsegment") == "BUILDING")).alias("is_paused"))


@R.add("p10_case_mapping", "SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'crawling' WHEN o_orderpriority = '2-HIGH' THEN 'default' ELSE 'other' END AS worker FROM orders")
def case_mapping(t):
    p = F.col("o_orderpriority")
    return t.orders.select("o_orderkey", F.when(p == "1-URGENT", "crawling").when(p == "2-HIGH", "default").otherwise("other").alias("worker"))


@R.add("p11_boolean_sort_key", "SELECT n_nationkey, n_name FROM nation ORDER BY (n_nationkey IN (3, 5)) DESC, n_nationkey LIMIT 5")
def boolean_sort_key(t):
    return t.nation.orderBy(F.col("n_nationkey").isin(3, 5).desc(), "n_nationkey").limit(5).select("n_nationkey", "n_name")


@R.add("p12_best_value", "SELECT p_partkey, coalesce(nullif(p_type, 'PROMO'), p_brand) AS best FROM part")
def best_value(t):
    return t.part.select("p_partkey", F.coalesce(F.nullif(F.col("p_type"), F.lit("PROMO")), F.col("p_brand")).alias("best"))


PUBLISHED_SQL = f"""c AS (SELECT l_orderkey, count(*) AS total, count(*) FILTER (l_shipdate <= TIMESTAMP '{CUTOFF}') AS published FROM lineitem GROUP BY l_orderkey)"""


def published_counts(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("total"), F.count_if(F.col("l_shipdate") <= F.lit(CUTOFF).cast("timestamp_ntz")).alias("published"))


@R.add("p16_three_buckets", f"WITH {PUBLISHED_SQL} SELECT l_orderkey, CASE WHEN published = 0 THEN 'setting_up' WHEN published < total THEN 'active' ELSE 'finished' END AS bucket FROM c")
def three_buckets(t):
    state = F.when(F.col("published") == 0, "setting_up").when(F.col("published") < F.col("total"), "active").otherwise("finished")
    return published_counts(t).select("l_orderkey", state.alias("bucket"))


@R.add("p19_existence", f"SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '1998-01-01') AS is_fresh FROM customer")
def existence(t):
    fresh = t.orders.where(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")).select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("_f", F.lit(True))
    return t.customer.select("c_custkey").join(fresh, "c_custkey", "left").select("c_custkey", F.coalesce("_f", F.lit(False)).alias("is_fresh"))


@R.add("j01_fact_dimension", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P'")
def fact_dimension(t):
    return t.orders.where("o_orderstatus = 'P'").join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@R.add(
    "j02_two_aggregates",
    """SELECT c_custkey, n_orders, n_lines FROM customer JOIN (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY 1) a ON a.o_custkey = c_custkey
JOIN (SELECT o_custkey, count(*) AS n_lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) b ON b.o_custkey = c_custkey""",
)
def two_aggregates(t):
    a = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n_orders"))
    b = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.count("*").alias("n_lines"))
    return t.customer.select("c_custkey").join(a.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey").join(b.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")


@R.add("j03_left_count", "SELECT c_custkey, coalesce(n, 0) AS n_open FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) ON o_custkey = c_custkey")
def left_count(t):
    counts = t.orders.where("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return t.customer.select("c_custkey").join(counts, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_open"))


@R.add(
    "j04_star",
    "SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_totalprice > 100000",
)
def star(t):
    o = t.orders.where("o_totalprice > 100000").join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return o.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("o_orderkey", "c_name", "n_name", "r_name")


@R.add("j05_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def semi(t):
    return t.customer.select("c_custkey").join(t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")


@R.add("j06_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderpriority = '1-URGENT')")
def anti(t):
    return t.customer.select("c_custkey").join(t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@R.add(
    "j07_null_aware_anti",
    """SELECT 'with a null' AS side, n_nationkey AS k FROM nation WHERE n_nationkey NOT IN (SELECT nullif(r_regionkey, 0) FROM region)
UNION ALL SELECT 'without', n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT r_regionkey FROM region)
UNION ALL SELECT 'empty', nullif(n_nationkey, 3) FROM nation WHERE nullif(n_nationkey, 3) NOT IN (SELECT r_regionkey FROM region WHERE r_regionkey < 0)""",
)
def null_aware(t):
    """Against a side with a null, one without, and an empty one."""
    k, r = t.nation.select(F.col("n_nationkey").alias("k")), t.region.select(F.col("r_regionkey").alias("k"))
    sides = {
        "with a null": sets.null_aware_anti(k, r.select(F.nullif(F.col("k"), F.lit(0)).alias("k")), "k"),
        "without": sets.null_aware_anti(k, r, "k"),
        "empty": sets.null_aware_anti(k.select(F.nullif(F.col("k"), F.lit(3)).alias("k")), r.where("k < 0"), "k"),
    }
    return sets.tagged_union(sides, "side")


@R.add("j07_extracted_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT CAST(regexp_extract(c_name, '([0-9]+)$', 1) AS BIGINT) FROM customer WHERE c_acctbal > 0 AND regexp_matches(c_name, '[0-9]+$'))")
def extracted_anti(t):
    ids = t.customer.where("c_acctbal > 0").select(F.nullif(F.regexp_extract("c_name", r"([0-9]+)$", 1), F.lit("")).try_cast("bigint").alias("c_custkey")).where("c_custkey IS NOT NULL")
    return t.customer.select("c_custkey").join(ids, "c_custkey", "left_anti")


@R.add("j09_scalar_lookup", "SELECT c_custkey, (SELECT n_name FROM nation WHERE n_nationkey = c_nationkey) AS nation FROM customer")
def scalar_lookup(t):
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", F.col("n_name").alias("nation"))


@R.add("j10_scalar_count", "SELECT n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS n FROM nation")
def scalar_count(t):
    counts = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    return t.nation.select("n_nationkey").join(counts, "n_nationkey", "left").select("n_nationkey", F.coalesce("n", F.lit(0)).alias("n"))


@R.add(
    "j11_top_in_group",
    "SELECT o_orderstatus, o_orderpriority AS top, k FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS k, row_number() OVER (PARTITION BY o_orderstatus ORDER BY count(*) DESC, o_orderpriority) AS n FROM orders GROUP BY 1, 2) WHERE n = 1",
)
def top_in_group(t):
    counts = t.orders.groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("k"))
    return ranking.cap_per_group(counts, ["o_orderstatus"], [F.desc("k"), F.asc("o_orderpriority")], 1).select("o_orderstatus", F.col("o_orderpriority").alias("top"), "k")


@R.add("j12_nested_lookups", "SELECT o_orderkey, (SELECT (SELECT (SELECT r_name FROM region WHERE r_regionkey = n_regionkey) FROM nation WHERE n_nationkey = c_nationkey) FROM customer WHERE c_custkey = o_custkey) AS region FROM orders WHERE o_orderstatus = 'P'")
def nested_lookups(t):
    o = t.orders.where("o_orderstatus = 'P'").join(t.customer, F.col("c_custkey") == F.col("o_custkey"), "left").join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return o.join(t.region, F.col("r_regionkey") == F.col("n_regionkey"), "left").select("o_orderkey", F.col("r_name").alias("region"))


@R.add("j14_update_from_values", "SELECT n_nationkey, coalesce(v.name, n_name) AS n_name FROM nation LEFT JOIN (VALUES (1, 'ONE'), (2, 'TWO')) v(k, name) ON k = n_nationkey")
def update_from_values(t):
    fresh = t.spark.createDataFrame([(1, "ONE"), (2, "TWO")], "n_nationkey int, name string")
    return t.nation.join(F.broadcast(fresh), "n_nationkey", "left").select("n_nationkey", F.coalesce("name", "n_name").alias("n_name"))


@R.add("j15_unmatched_report", "SELECT (c_custkey IS NOT NULL) AS matched, count(*) AS n FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey GROUP BY ALL")
def unmatched_report(t):
    good = t.customer.where("c_acctbal > 0").select("c_custkey")
    return t.orders.join(good, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy(F.col("c_custkey").isNotNull().alias("matched")).agg(F.count("*").alias("n"))


@R.add("j16_containment", "SELECT l_suppkey, count(*) FILTER (p_partkey IS NOT NULL) AS n_in, count(*) AS n FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_size < 10) ON p_partkey = l_partkey GROUP BY 1")
def containment(t):
    few = t.part.where("p_size < 10").select("p_partkey")
    return t.lineitem.join(few, F.col("p_partkey") == F.col("l_partkey"), "left").groupBy("l_suppkey").agg(F.count("p_partkey").alias("n_in"), F.count("*").alias("n"))


@R.add(
    "j17_positional_zip",
    """WITH a AS (SELECT c_nationkey AS k, c_custkey AS x, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS pos FROM customer),
b AS (SELECT s_nationkey AS k, s_suppkey AS y, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS pos FROM supplier)
SELECT k, pos, x, y FROM a FULL JOIN b USING (k, pos)""",
)
def positional_zip(t):
    at = lambda k, x: F.row_number().over(Window.partitionBy(k).orderBy(x)).cast("long")
    a = t.customer.select(F.col("c_nationkey").alias("k"), at("c_nationkey", "c_custkey").alias("pos"), F.col("c_custkey").alias("x"))
    b = t.supplier.select(F.col("s_nationkey").alias("k"), at("s_nationkey", "s_suppkey").alias("pos"), F.col("s_suppkey").alias("y"))
    return a.join(b, ["k", "pos"], "full")


@R.add(
    "j19_cover_pairs",
    """WITH m AS (SELECT s_nationkey AS c, bit_or(1::BIGINT << (s_suppkey % 40)::INT) AS bits FROM supplier GROUP BY 1)
SELECT a.c AS c1, b.c AS c2, bit_count(a.bits | b.bits)::BIGINT AS covered FROM m a JOIN m b ON a.c > b.c""",
)
def cover_pairs(t):
    """All pairs of categories and how many posts they cover together. Bitmaps are a row for each category."""
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("s_suppkey", F.lit(40)).cast("int"))
    m = t.supplier.groupBy(F.col("s_nationkey").alias("c")).agg(F.bit_or(bit).alias("bits"))
    a, b = m.select(F.col("c").alias("c1"), F.col("bits").alias("x")), m.select(F.col("c").alias("c2"), F.col("bits").alias("y"))
    return a.join(few(b), F.col("c1") > F.col("c2")).select("c1", "c2", F.bit_count(F.col("x").bitwiseOR(F.col("y"))).cast("long").alias("covered"))


@R.add("a01_published_of_total", f"WITH {PUBLISHED_SQL} SELECT l_orderkey, published, total FROM c")
def published_of_total(t):
    return published_counts(t)


@R.add("a02_global_count", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'O'")
def global_count(t):
    return t.orders.where("o_orderstatus = 'O'").agg(F.count("*").alias("n"))


@R.add("a03_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 15")
def having(t):
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")).where("n >= 15")


@R.add("a04_duplicates_by_key", "SELECT p_brand || '/' || p_size AS k, p_partkey FROM part WHERE (p_brand, p_size) IN (SELECT (p_brand, p_size) FROM part GROUP BY p_brand, p_size HAVING count(*) > 1)")
def duplicates_by_key(t):
    """The rows of keys that occur more than once, a row each, so that no group is gathered."""
    rows = t.part.select(F.concat("p_brand", F.lit("/"), F.col("p_size").cast("string")).alias("k"), "p_partkey")
    return rows.join(rows.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k"), "k", "left_semi")


@R.add("a05_many_aggregates", "SELECT l_returnflag, max(l_quantity) AS max_q, max(l_extendedprice) AS max_p, count(*) FILTER (l_discount > 0.05) AS n_disc, count(*) FILTER (l_tax > 0.05) AS n_tax, count(*) AS n FROM lineitem GROUP BY 1")
def many_aggregates(t):
    return t.lineitem.groupBy("l_returnflag").agg(
        F.max("l_quantity").alias("max_q"), F.max("l_extendedprice").alias("max_p"), F.count_if(F.col("l_discount") > 0.05).alias("n_disc"), F.count_if(F.col("l_tax") > 0.05).alias("n_tax"), F.count("*").alias("n")
    )


@R.add("a06_next_index", "SELECT o_custkey, coalesce(max(o_orderkey) FILTER (o_orderstatus = 'P') + 1, 0) AS next_index FROM orders GROUP BY 1")
def next_index(t):
    return t.orders.groupBy("o_custkey").agg(F.coalesce(F.max(F.when(F.col("o_orderstatus") == "P", F.col("o_orderkey"))) + 1, F.lit(0)).alias("next_index"))


@R.add("a07_distinct", "SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders")
def distinct(t):
    return t.orders.select("o_orderpriority", "o_orderstatus").distinct()


@R.add("a13_entities", "SELECT p_type, count(DISTINCT p_brand) AS n_brands, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS brands FROM part GROUP BY 1")
def entities(t):
    return t.part.groupBy("p_type").agg(F.array_sort(F.collect_set("p_brand")).alias("b")).select("p_type", F.size("b").cast("long").alias("n_brands"), F.array_join("b", ",").alias("brands"))


@R.add("a14_histogram_text", "SELECT s, string_agg(p || ': ' || k, ', ' ORDER BY k DESC, p) AS histogram FROM (SELECT o_orderstatus AS s, o_orderpriority AS p, count(*) AS k FROM orders GROUP BY 1, 2) GROUP BY s")
def histogram_text(t):
    counts = t.orders.groupBy(F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p")).agg(F.count("*").alias("k"))
    rows = F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("k"), "p")))
    return counts.groupBy("s").agg(rows.alias("r")).select("s", F.array_join(F.transform("r", lambda x: F.concat(x["p"], F.lit(": "), (-x["k"]).cast("string"))), ", ").alias("histogram"))


@R.add(
    "a15_status_score",
    """WITH u AS (UNPIVOT (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'success' WHEN o_orderstatus = 'O' THEN 'failure' ELSE 'neutral' END AS status,
CASE WHEN o_orderpriority < '3' THEN 'success' WHEN o_orderpriority > '4' THEN 'failure' ELSE 'neutral' END AS priority FROM orders) ON status, priority INTO NAME col VALUE state)
SELECT col, count(*) FILTER (state = 'success') AS n_success, count(*) FILTER (state = 'neutral') AS n_neutral, count(*) FILTER (state = 'failure') AS n_failure,
count(*) FILTER (state = 'success') * 100 // count(*) AS score FROM u GROUP BY col""",
)
def status_score(t):
    status = F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "failure").otherwise("neutral")
    priority = F.when(F.col("o_orderpriority") < "3", "success").when(F.col("o_orderpriority") > "4", "failure").otherwise("neutral")
    rows = t.orders.select("o_orderkey", status.alias("status"), priority.alias("priority")).unpivot("o_orderkey", ["status", "priority"], "col", "state")
    n = lambda s: F.count_if(F.col("state") == s)
    return rows.groupBy("col").agg(
        n("success").alias("n_success"), n("neutral").alias("n_neutral"), n("failure").alias("n_failure"), F.floor(n("success") * 100 / F.count("*")).alias("score")
    )


@R.add("a16_group_sort_key", "SELECT o_orderkey, o_orderpriority, max(o_orderdate) OVER (PARTITION BY o_orderpriority)::DATE AS latest FROM orders WHERE o_orderstatus = 'P'")
def group_sort_key(t):
    """The latest date of each class beside its rows, by a join of the aggregate, so that a hot class isn't gathered."""
    p = t.orders.where("o_orderstatus = 'P'")
    latest = p.groupBy("o_orderpriority").agg(F.to_date(F.max("o_orderdate")).alias("latest"))
    return p.select("o_orderkey", "o_orderpriority").join(latest, "o_orderpriority").select("o_orderkey", "o_orderpriority", "latest")


@R.add("a18_weekly", "SELECT o_custkey, sum(n)::BIGINT AS total, count(*) FILTER (n > 0) AS active_days, round(sum(n) / count(*) FILTER (n > 0), 4) AS per_day FROM (SELECT o_custkey, dayofweek(o_orderdate) AS d, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1")
def weekly(t):
    days = t.orders.groupBy("o_custkey", F.dayofweek("o_orderdate").alias("d")).agg(F.count("*").alias("n"))
    return days.groupBy("o_custkey").agg(F.sum("n").alias("total"), F.count_if(F.col("n") > 0).alias("active_days")).withColumn("per_day", F.round(F.col("total") / F.col("active_days"), 4))


@R.add("a20_snapshot_changes", "SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' ELSE 'removed' END AS change FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F') a FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P') b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL")
def snapshot_changes(t):
    k = F.col("o_custkey").alias("k")
    return sets.snapshot_changes(t.orders.where("o_orderstatus = 'F'").select(k), t.orders.where("o_orderstatus = 'P'").select(k), "k")


@R.add("a25_category_state", "SELECT p_type, count(*) AS total, count(*) FILTER (p_size <= 25) AS checked, bool_and(p_size <= 25) AS all_checked, bool_or(p_size <= 25) AS some_checked FROM part GROUP BY 1")
def category_state(t):
    on = F.col("p_size") <= 25
    return t.part.groupBy("p_type").agg(F.count("*").alias("total"), F.count_if(on).alias("checked"), F.bool_and(on).alias("all_checked"), F.bool_or(on).alias("some_checked"))


@R.add("a26_selected_fraction", "SELECT p_brand, round(count(*) FILTER (p_size <= 25) / count(*), 6) AS fraction FROM part GROUP BY 1")
def selected_fraction(t):
    return t.part.groupBy("p_brand").agg(F.round(F.count_if(F.col("p_size") <= 25) / F.count("*"), 6).alias("fraction"))


@R.add("w05_first_last_flags", "SELECT o_orderkey, row_number() OVER w = 1 AS is_first, row_number() OVER w = count(*) OVER (PARTITION BY o_custkey) AS is_last FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def first_last(t):
    return ranking.flagged_ends(t.orders.select("o_orderkey", "o_custkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_orderkey", "is_first", "is_last")


@R.add(
    "w06_head_middle_tail",
    """SELECT o_orderkey, CASE WHEN s <= 12 THEN 'all' WHEN n <= 5 THEN 'head' WHEN n > s - 5 THEN 'tail' ELSE 'middle' END AS part
FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, count(*) OVER (PARTITION BY o_custkey) AS s FROM orders)""",
)
def head_middle_tail(t):
    return ranking.head_middle_tail(t.orders.select("o_orderkey", "o_custkey"), ["o_custkey"], ["o_orderkey"]).select("o_orderkey", "part")


@R.add(
    "w08_adjacent_collapse",
    """WITH c AS (SELECT *, CASE WHEN lag(o_orderstatus) OVER w IS NULL OR lag(o_orderstatus) OVER w <> o_orderstatus THEN 1 ELSE 0 END AS f FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
r AS (SELECT *, sum(f) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS run FROM c)
SELECT o_custkey, CAST(run AS BIGINT) AS run, any_value(o_orderstatus) AS status, count(*) AS n, string_agg(o_orderkey::VARCHAR, '|' ORDER BY o_orderdate, o_orderkey) AS titles FROM r GROUP BY o_custkey, run""",
)
def adjacent_collapse(t):
    runs = ranking.collapsed_runs(t.orders.select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderstatus")
    rows = F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey")))
    out = runs.groupBy("o_custkey", "run").agg(F.first("o_orderstatus").alias("status"), F.count("*").alias("n"), rows.alias("r"))
    return out.select("o_custkey", "run", "status", "n", F.array_join(F.transform("r", lambda x: x["o_orderkey"].cast("string")), "|").alias("titles"))


@R.add("w10_monotonic", "SELECT o_custkey, bool_and(d IS NULL OR o_totalprice >= d) AS ascending, bool_and(d IS NULL OR o_totalprice <= d) AS descending FROM (SELECT o_custkey, o_totalprice, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS d FROM orders) GROUP BY 1")
def monotonic(t):
    before = F.lag("o_totalprice").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    rows = t.orders.select("o_custkey", "o_totalprice", before.alias("d"))
    holds = lambda c: F.bool_and(F.col("d").isNull() | c)
    return rows.groupBy("o_custkey").agg(holds(F.col("o_totalprice") >= F.col("d")).alias("ascending"), holds(F.col("o_totalprice") <= F.col("d")).alias("descending"))


@R.add("w12_sectioned_sort", "SELECT o_orderpriority, o_orderkey, is_header FROM (SELECT o_orderpriority, o_orderkey, false AS is_header FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT DISTINCT o_orderpriority, CAST(NULL AS BIGINT), true FROM orders WHERE o_orderstatus = 'P')")
def sectioned(t):
    """Rows with a header row before each class; the order is (class, header first, key)."""
    p = t.orders.where("o_orderstatus = 'P'").select("o_orderpriority", "o_orderkey", F.lit(False).alias("is_header"))
    headers = p.select("o_orderpriority").distinct().select("o_orderpriority", F.lit(None).cast("bigint").alias("o_orderkey"), F.lit(True).alias("is_header"))
    return p.unionByName(headers).orderBy("o_orderpriority", F.desc("is_header"), "o_orderkey")


@R.add("w13_retention", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n > 10")
def retention(t):
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    return t.orders.select("o_orderkey", n.alias("n")).where("n > 10").select("o_orderkey")


@R.add("w14_latest_allowed", "SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P') GROUP BY 1")
def latest_allowed(t):
    return t.orders.where("o_orderstatus IN ('F', 'P')").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


@R.add("t01_null_placement", "SELECT o_orderkey, urgent FROM (SELECT o_orderkey, nullif(o_orderpriority, '1-URGENT') AS urgent FROM orders) ORDER BY urgent DESC NULLS FIRST, o_orderkey LIMIT 50")
def null_placement(t):
    return t.orders.select("o_orderkey", F.nullif(F.col("o_orderpriority"), F.lit("1-URGENT")).alias("urgent")).orderBy(F.desc_nulls_first("urgent"), "o_orderkey").limit(50)


@R.add("t02_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_k(t):
    return t.orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@R.add("t03_branch_limits", "(SELECT 'old' AS kind, o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 5) UNION ALL (SELECT 'new', o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 7)")
def branch_limits(t):
    old, new = t.orders.orderBy("o_orderdate", "o_orderkey").limit(5), t.orders.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(7)
    return sets.tagged_union({"old": old.select("o_orderkey"), "new": new.select("o_orderkey")})


@R.add("t06_queue_pick", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderpriority, o_orderdate, o_orderkey LIMIT 1")
def queue_pick(t):
    return t.orders.where("o_orderstatus = 'O'").orderBy("o_orderpriority", "o_orderdate", "o_orderkey").limit(1).select("o_orderkey")


@R.add("t08_ranked_candidates", "SELECT s_suppkey, n FROM (SELECT s_suppkey, s_acctbal > 0 AS m, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey) AS n FROM supplier) ORDER BY m DESC, n DESC, s_suppkey LIMIT 10")
def ranked_candidates(t):
    counts = t.lineitem.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"))
    rows = t.supplier.select("s_suppkey", (F.col("s_acctbal") > 0).alias("m")).join(counts, "s_suppkey", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.orderBy(F.desc("m"), F.desc("n"), "s_suppkey").limit(10).select("s_suppkey", "n")


@R.add("t09_six_keys", "SELECT o_orderkey FROM orders ORDER BY o_orderstatus, o_orderpriority DESC, o_orderdate::DATE, o_custkey, o_totalprice DESC, o_orderkey LIMIT 40")
def six_keys(t):
    return t.orders.orderBy("o_orderstatus", F.desc("o_orderpriority"), F.to_date("o_orderdate"), "o_custkey", F.desc("o_totalprice"), "o_orderkey").limit(40).select("o_orderkey")


@R.add("t11_look_ahead", "SELECT o_custkey, o_orderkey, n > 5 AS has_more FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS m, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE m <= 5")
def look_ahead(t):
    counts = t.orders.groupBy("o_custkey").agg((F.count("*") > 5).alias("has_more"))
    return ranking.cap_per_group(t.orders.select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"], 5).join(counts, "o_custkey")


@R.add("t12_composite_key", "SELECT o_orderkey, concat_ws('|', o_orderstatus, o_orderpriority, printf('%012d', o_orderkey)) AS sort_key FROM orders ORDER BY sort_key LIMIT 30")
def composite_key(t):
    key = F.concat_ws("|", "o_orderstatus", "o_orderpriority", F.format_string("%012d", "o_orderkey"))
    return t.orders.select("o_orderkey", key.alias("sort_key")).orderBy("sort_key").limit(30)


@R.add("u01_tagged_union", "SELECT 'customer' AS kind, c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier UNION ALL SELECT 'part', p_partkey, p_name FROM part UNION ALL SELECT 'nation', n_nationkey, n_name FROM nation")
def tagged_union(t):
    part = lambda df, k, n: df.select(F.col(k).cast("bigint").alias("id"), F.col(n).alias("name"))
    return sets.tagged_union({
        "customer": part(t.customer, "c_custkey", "c_name"), "supplier": part(t.supplier, "s_suppkey", "s_name"),
        "part": part(t.part, "p_partkey", "p_name"), "nation": part(t.nation, "n_nationkey", "n_name"),
    })


U_SQL = "a AS (SELECT p_brand || p_size AS k, p_partkey AS pos FROM part WHERE p_partkey % 2 = 0), b AS (SELECT p_brand || p_size AS k, p_partkey AS pos FROM part WHERE p_partkey % 3 = 0)"


def _two_lists(t):
    rows = t.part.select(F.concat("p_brand", F.col("p_size").cast("string")).alias("k"), F.col("p_partkey").alias("pos"))
    return rows.where("pos % 2 = 0"), rows.where("pos % 3 = 0")


@R.add("u02_ordered_union", f"WITH {U_SQL} SELECT k, pos FROM (SELECT k, pos, row_number() OVER (PARTITION BY k ORDER BY f, pos) AS n FROM (SELECT 0 AS f, * FROM a UNION ALL SELECT 1, * FROM b)) WHERE n = 1")
def ordered_union(t):
    return sets.ordered_union(_two_lists(t), "k", "pos").select("k", "pos")


@R.add("u03_ordered_except", f"WITH {U_SQL} SELECT k, pos FROM a WHERE k NOT IN (SELECT k FROM b)")
def ordered_except(t):
    a, b = _two_lists(t)
    return sets.ordered_except(a, b, "k")


@R.add("u04_ordered_intersect", f"WITH {U_SQL} SELECT k, pos FROM a WHERE k IN (SELECT k FROM b)")
def ordered_intersect(t):
    a, b = _two_lists(t)
    return sets.ordered_intersect(a, b, "k")


@R.add("u05_set_equality", "SELECT a.s_nationkey AS n1, b.s_nationkey AS n2, list_sort(a.k) = list_sort(b.k) AS same FROM (SELECT s_nationkey, list(DISTINCT s_suppkey % 2) AS k FROM supplier GROUP BY 1) a JOIN (SELECT s_nationkey, list(DISTINCT s_suppkey % 2) AS k FROM supplier GROUP BY 1) b ON a.s_nationkey = b.s_nationkey + 1")
def set_equality(t):
    s = t.supplier.groupBy("s_nationkey").agg(F.array_sort(F.collect_set(F.col("s_suppkey") % 2)).alias("k"))
    a, b = s.select(F.col("s_nationkey").alias("n1"), F.col("k").alias("x")), s.select(F.col("s_nationkey").alias("n2"), F.col("k").alias("y"))
    return a.join(b, F.col("n1") == F.col("n2") + 1).select("n1", "n2", (F.col("x") == F.col("y")).alias("same"))


@R.add("u06_union_minus", "SELECT DISTINCT p_brand AS k FROM part WHERE p_size < 20 AND p_brand NOT IN ('Brand#11', 'Brand#12') UNION SELECT DISTINCT p_brand FROM part WHERE p_size > 30 AND p_brand NOT IN ('Brand#11', 'Brand#12')")
def union_minus(t):
    rows = t.part.where("p_size < 20").select(F.col("p_brand").alias("k")).union(t.part.where("p_size > 30").select("p_brand"))
    return rows.distinct().where(~F.col("k").isin("Brand#11", "Brand#12"))


@R.add("u07_alias_dedup", "SELECT k, min(p_partkey) AS first FROM (SELECT p_partkey, regexp_replace(lower(p_brand), '#[0-9]', '#') AS k FROM part) GROUP BY k")
def alias_dedup(t):
    """Twins by a normalised key: the first of each stays."""
    rows = t.part.select("p_partkey", F.regexp_replace(F.lower("p_brand"), "#[0-9]", "#").alias("k"))
    return rows.groupBy("k").agg(F.min("p_partkey").alias("first"))


@R.add("u08_case_insensitive_merge", "SELECT lower(b) AS name, min(b) AS shown, p_partkey AS link FROM (SELECT CASE WHEN p_partkey % 2 = 0 THEN upper(p_brand) ELSE p_brand END AS b, p_partkey FROM part) GROUP BY lower(b), p_partkey")
def case_insensitive_merge(t):
    """Categories whose names differ in case are one; their links stay rows."""
    rows = t.part.select(F.when(F.col("p_partkey") % 2 == 0, F.upper("p_brand")).otherwise(F.col("p_brand")).alias("b"), F.col("p_partkey").alias("link"))
    return rows.groupBy(F.lower("b").alias("name"), "link").agg(F.min("b").alias("shown")).select("name", "shown", "link")


@R.add("u09_two_newest", "WITH r AS (SELECT *, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders), l AS (SELECT o_custkey, n, l_suppkey, min(l_linenumber) AS pos FROM r JOIN lineitem ON l_orderkey = o_orderkey WHERE n <= 2 GROUP BY 1, 2, 3) SELECT b.o_custkey, b.l_suppkey, b.pos FROM l b JOIN l a ON a.o_custkey = b.o_custkey AND a.l_suppkey = b.l_suppkey AND a.n = 1 AND b.n = 2")
def two_newest(t):
    """What the two newest entries have in common, in the order of the second."""
    n = F.dense_rank().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderkey")))
    newest = t.orders.select("o_custkey", "o_orderkey", n.alias("n")).where("n <= 2")
    links = newest.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "n", "l_suppkey").agg(F.min("l_linenumber").alias("pos"))
    return sets_by(links, 2).join(sets_by(links, 1).select("o_custkey", "l_suppkey"), ["o_custkey", "l_suppkey"], "left_semi").select("o_custkey", "l_suppkey", "pos")


def sets_by(links, n):
    return links.where(F.col("n") == n)


@R.add("s16_upsert", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey >= 3 UNION ALL SELECT * FROM (VALUES (0, 'ZERO'), (1, 'ONE'), (2, 'TWO'), (99, 'NEW'))")
def upsert(t):
    fresh = t.spark.createDataFrame([(0, "ZERO"), (1, "ONE"), (2, "TWO"), (99, "NEW")], "n_nationkey int, n_name string")
    return sets.upsert(t.nation.select("n_nationkey", "n_name"), fresh, ["n_nationkey"])


@R.add("s24_rows_to_json", "SELECT r_regionkey, '[' || string_agg('{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}', ',' ORDER BY n_nationkey) || ']' AS js FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def rows_to_json(t):
    rows = F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))
    return t.nation.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.to_json(rows).alias("js"))


@R.add("s29_values", "SELECT n_nationkey, name FROM nation JOIN (VALUES (1, 'a'), (2, 'b'), (3, NULL)) v(id, name) ON id = n_regionkey")
def values(t):
    """Rows given in the query itself beside those of a table."""
    given = t.spark.sql("SELECT id, name FROM VALUES (1, 'a'), (2, 'b'), (3, NULL) AS v(id, name)")
    return t.nation.join(F.broadcast(given), F.col("n_regionkey") == F.col("id")).select("n_nationkey", "name")


@R.add("g10_versioned_upsert", "SELECT n_nationkey AS k, CASE WHEN n_nationkey < 10 AND n_nationkey % 2 = 1 THEN 2 ELSE 1 END AS version FROM nation UNION ALL SELECT 100, 1")
def versioned_upsert(t):
    stored = t.nation.select(F.col("n_nationkey").alias("k"), F.lit(1).alias("version"))
    fresh = t.nation.where("n_nationkey < 10").select(F.col("n_nationkey").alias("k"), F.when(F.col("n_nationkey") % 2 == 1, 2).otherwise(1).alias("version"))
    return sets.versioned_upsert(stored, fresh.union(t.spark.createDataFrame([(100, 1)], "k int, version int")), ["k"], "version")


@R.add("g12_demoted_versions", "SELECT o_custkey, o_orderkey, CASE WHEN n = 1 THEN c ELSE c - n + 1 END AS version FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n, count(*) OVER (PARTITION BY o_custkey) AS c FROM orders)")
def demoted(t):
    down = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderkey")))
    up = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long")
    history = t.orders.select("o_custkey", "o_orderkey", F.when(down == 1, F.lit(1_000_000).cast("long")).otherwise(up).alias("version"))
    return sets.demoted_versions(history, "o_custkey", "version")
