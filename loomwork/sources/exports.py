"""Message exports, search pages and line lists: JSON and text as rows, with replace-partition loads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXPORT_SCHEMA = "channel struct<id:string,categoryId:string>, messages array<struct<id:bigint,timestamp:string,content:string,author:struct<name:string>>>"
SEARCH_SCHEMA = "hits array<struct<created_at:string,points:int,title:string,url:string>>"


def links_in_text(text: Column) -> Column:
    """http(s) addresses in free text; those of the local host don't count."""
    found = F.regexp_extract_all(text, F.lit(r"https?://[^\s<>()\"']+"), F.lit(0))
    return F.filter(F.transform(found, lambda u: F.regexp_replace(u, r"[.,;:!?]+$", "")), lambda u: ~u.rlike(r"^https?://localhost(?:[:/]|$)"))


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """(url, timestamp, message_id, thread_id, channel, author): a row for each address in each message of the exports."""
    return message_links(spark.read.schema(EXPORT_SCHEMA).json(path, multiLine=True))


def message_links(docs: DataFrame) -> DataFrame:
    """As read_messages, of exports (see EXPORT_SCHEMA) that are read already."""
    rows = docs.select("channel", F.explode("messages").alias("m"))
    return rows.select(
        F.explode(links_in_text(F.col("m.content"))).alias("url"), F.col("m.timestamp").alias("timestamp"), F.col("m.id").alias("message_id"),
        F.when(F.col("channel.categoryId").isNotNull(), F.col("channel.id")).alias("thread_id"), F.coalesce("channel.categoryId", "channel.id").alias("channel"), F.col("m.author.name").alias("author"),
    )


def read_search_pages(spark: SparkSession, path: str) -> DataFrame:
    """(url, title, created_at, points) of search pages; hits without an address are left out."""
    return search_hits(spark.read.schema(SEARCH_SCHEMA).json(path, multiLine=True))


def search_hits(docs: DataFrame) -> DataFrame:
    """As read_search_pages, of pages (see SEARCH_SCHEMA) that are read already."""
    hits = docs.select(F.explode("hits").alias("h")).where("h.url IS NOT NULL")
    created = F.date_format(F.to_timestamp(F.regexp_replace("h.created_at", r"(?:\.\d+)?Z$", ""), "yyyy-MM-dd'T'HH:mm:ss"), "yyyy-MM-dd HH:mm:ss")
    return hits.select("h.url", "h.title", created.alias("created_at"), "h.points")


def parsed_lines(text: DataFrame, column: str = "text") -> DataFrame:
    """(..., line_no, url, label, error) of "url label" lines, numbered from 1, beside the other columns of `text`; blank lines are left out."""
    others = [c for c in text.columns if c != column]
    rows = text.select(*others, F.posexplode(F.split(F.col(column), r"\r?\n")).alias("i", "line")).where(F.trim("line") != "")
    url = F.regexp_extract("line", r"^\s*(https?://\S+)\s+(\S.*?)\s*$", 1)
    label = F.regexp_extract("line", r"^\s*(https?://\S+)\s+(\S.*?)\s*$", 2)
    bad = F.when(url == "", F.format_string("line %d is not a url and a label", F.col("i") + 1))
    return rows.select(*others, (F.col("i") + 1).alias("line_no"), F.nullif(url, F.lit("")).alias("url"), F.nullif(label, F.lit("")).alias("label"), bad.alias("error"))


def replace_partitions(df: DataFrame, path: str, *columns: str) -> None:
    """Write df, replacing the partitions that it has rows of and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*columns).parquet(path)
