"""Evaluation: a crawl's result against what was expected of it."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.operators import evaluation as V
from loomwork.plans.registry import Registry

R = Registry()
FIELDS = ["segment", "nation", "links"]

STATES_SQL = """s AS (SELECT c_custkey AS k, CASE WHEN c_acctbal < 0 THEN 'neutral' WHEN c_custkey % 5 = 0 THEN 'failure' ELSE 'success' END AS segment,
 CASE WHEN c_custkey % 7 = 0 THEN 'failure' ELSE 'success' END AS nation, CASE WHEN c_custkey % 7 = 0 OR c_custkey % 11 = 0 THEN 'failure' ELSE 'success' END AS links FROM customer),
u AS (SELECT k, 'segment' AS field, segment AS state FROM s UNION ALL SELECT k, 'nation', nation FROM s UNION ALL SELECT k, 'links', links FROM s)"""


def _states(t):
    """Every fifth segment differs, every seventh customer has no result for nation and links, every eleventh list has another order."""
    k = F.col("c_custkey")
    links = F.array(k, k + 1)
    want = t.customer.select(k, F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("segment"), F.col("c_nationkey").alias("nation"), links.alias("links"))
    got = t.customer.select(
        k,
        F.when(k % 5 == 0, "?").otherwise(F.col("c_mktsegment")).alias("segment"),
        F.when(k % 7 != 0, F.col("c_nationkey")).alias("nation"),
        F.when(k % 7 != 0, F.when(k % 11 == 0, F.reverse(links)).otherwise(links)).alias("links"),
    )
    return V.field_states(want, got, "c_custkey", FIELDS)


@R.add("i01_field_states", f"WITH {STATES_SQL} SELECT k AS c_custkey, field, state FROM u")
def states(t):
    return _states(t)


@R.add("i02_scores", f"WITH {STATES_SQL} SELECT field, count(*) FILTER (state = 'success') AS n_success, count(*) FILTER (state = 'neutral') AS n_neutral, count(*) FILTER (state = 'failure') AS n_failure, count(*) FILTER (state = 'success') * 100 // count(*) AS score FROM u GROUP BY 1")
def scores(t):
    return V.scores(_states(t))


@R.add("i03_regressions", f"WITH {STATES_SQL}, n AS (SELECT k, bool_and(state <> 'failure') AS ok FROM u GROUP BY 1) SELECT k AS c_custkey, CASE WHEN k % 4 = 0 THEN 'unknown' WHEN ok = (k % 3 = 0) THEN 'expected' WHEN ok THEN 'newly_ok' ELSE 'newly_failed' END AS outcome FROM n")
def regressions(t):
    known = t.customer.where("c_custkey % 4 <> 0").select("c_custkey", (F.col("c_custkey") % 3 == 0).alias("ok"))
    return V.regressions(_states(t), known, "c_custkey")
