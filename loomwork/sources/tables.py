"""The driver's Parquet tables by attribute, with the columns that plans rely on, and derived link tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table that `dealt` gives to one task.
ROWS_A_TASK = 100_000


class Tables:
    """`Tables(spark, folder).orders` reads `folder/orders.parquet`; nothing is read before it is used."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def parts(self, name: str) -> int:
        """How many tasks a table's rows are for: the files' own counts, so that a task's memory doesn't grow with the table."""
        return max(self.spark.sparkContext.defaultParallelism, -(-getattr(self, name).count() // ROWS_A_TASK))

    def dealt(self, name: str, key: str, by: str | None = None) -> DataFrame:
        """The table shuffled by a key into as many partitions as it, or the table `by`, has rows for: joins, windows and groups by that key need no other shuffle, and tables dealt by one table meet without one."""
        return getattr(self, name).repartition(self.parts(by or name), key)

    def links(self) -> DataFrame:
        """Mentions of items: (link_id, root, url, author, channel, ts) from line items, their orders and parts.

        link_id is a string of the unique key, padded so that its order is that of the numbers.
        """
        parts = self.part.select("p_partkey", "p_brand")
        orders = self.orders.select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
        key = F.format_string("%010d-%03d-%08d-%06d", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
        return (
            self.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
            .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(parts, F.col("l_partkey") == F.col("p_partkey"))
            .select(
                key.alias("link_id"),
                F.col("p_brand").alias("root"),
                F.col("l_partkey").alias("url"),
                F.col("o_custkey").alias("author"),
                F.col("o_orderpriority").alias("channel"),
                F.col("o_orderdate").alias("ts"),
            )
        )


#: The same as SQL, for oracles.
LINKS_SQL = """links AS (SELECT printf('%010d-%03d-%08d-%06d', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS link_id, p_brand AS root,
  l_partkey AS url, o_custkey AS author, o_orderpriority AS channel, o_orderdate AS ts
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""
