"""What the corpus operators share: exact column picking, staged tables, size-checked broadcasts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.sources.storage import removed, scratch, shared_folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Rows and bytes of a side that may be broadcast; a side is measured first, and beyond these the join is left to shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 32 << 20


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only, by exact name, even where others differ from them in case or are repeated."""
    plain, at = numbered(df, *names)
    return plain.select(*[F.col(c).alias(n) for c, n in zip(at, names, strict=True)])


def numbered(df: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """df with the columns c0, c1, ..., and which of them the named ones are; `df.toDF(*columns)` undoes it whatever the names."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]), [f"c{df.columns.index(n)}" for n in names]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, through Spark's reader only (the folder may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else. Pure ASCII takes the fast built-in, which agrees there."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on a local master one of our own where that is unset."""
    return shared_folder(spark)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back.

    Later steps then survive lost executors without the steps before, and a
    value computed once (ids, picks) is the same for all who read it. Columns are numbered in the file, so their names may clash.
    """
    spark = df.sparkSession
    path = scratch(spark, f"loomwork-{name}")
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    plain.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(plain.schema).parquet(path).toDF(*df.columns)
    out._staged_at = path
    return out


def unstage(*frames: DataFrame) -> None:
    """Remove staged tables that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "_staged_at", None):
            removed(df.sparkSession, path)


def small(df: DataFrame, most: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it is measured to have at most `most` rows and `most_bytes` bytes, else as it is (Spark then shuffles)."""
    size = F.lit(16 + 8 * len(df.columns))
    for name, kind in df.dtypes:
        if kind in ("string", "binary"):
            size += F.coalesce(F.octet_length(name), F.lit(0))
        elif kind.startswith(("array", "map", "struct")):
            size += F.coalesce(F.octet_length(F.to_json(F.struct(name))), F.lit(0))
    n, total = df.agg(F.count("*"), F.sum(size)).first()
    return F.broadcast(df) if n <= most and (total or 0) <= most_bytes else df


def copies_of(n: Column) -> Column:
    """Explode to n equal rows."""
    return F.explode(F.sequence(F.lit(1).cast("long"), n.cast("long")))


def all_of(conditions: Iterable[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out
