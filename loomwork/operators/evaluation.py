"""Results against expectations: a status for each field, counters and a score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def field_states(expected: DataFrame, actual: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, field, state): success where both agree, neutral where nothing was expected, else failure.

    Arrays agree if they are equal place by place. A key without a result fails in all fields that were expected.
    """
    a = expected.select(key, *[F.col(f).alias(f"_e_{f}") for f in fields])
    b = actual.select(key, *[F.col(f).alias(f"_a_{f}") for f in fields])
    both = a.join(b, key, "left")
    state = lambda f: F.when(F.col(f"_e_{f}").isNull(), "neutral").when(F.col(f"_e_{f}").eqNullSafe(F.col(f"_a_{f}")), "success").otherwise("failure")
    rows = both.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), state(f).alias("state")) for f in fields])).alias("s"))
    return rows.select(key, "s.field", "s.state")


def scores(states: DataFrame) -> DataFrame:
    """(field, n_success, n_neutral, n_failure, score): the score is the whole percentage of successes."""
    n = lambda s: F.count_if(F.col("state") == s)
    rows = states.groupBy("field").agg(n("success").alias("n_success"), n("neutral").alias("n_neutral"), n("failure").alias("n_failure"))
    return rows.withColumn("score", F.expr("n_success * 100 div (n_success + n_neutral + n_failure)"))


def regressions(states: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """(key, outcome) of keys: expected, newly_ok, newly_failed or unknown, against a table of known results (key, ok)."""
    now = states.groupBy(key).agg(F.bool_and(F.col("state") != "failure").alias("_now"))
    both = now.join(known.select(key, F.col("ok").alias("_was")), key, "left")
    outcome = F.when(F.col("_was").isNull(), "unknown").when(F.col("_was") == F.col("_now"), "expected").when(F.col("_now"), "newly_ok").otherwise("newly_failed")
    return both.select(key, outcome.alias("outcome"))
