r"""A content-addressed WARC archive: payload bytes once by digest, exact record heads apart, records by join.

An archive is two tables in one folder:

* ``payloads`` (digest, sha1, n_bytes, holder, copies, payload): each distinct payload once, keyed by its SHA-256;
* ``heads`` (digest, head): per record the exact bytes before its payload (WARC header
  and HTTP header) and the key of the payload it has or refers to.

Payloads are deduplicated by a grouped ``first``, whose partial aggregate leaves one row for each digest and task
before the shuffle, so a payload with copies in a third of all rows isn't gathered anywhere. Reading back
joins heads and payloads (written tables on both sides, so that adaptive execution may split a hot digest), puts the
record's bytes together, parses them, and verifies both digests against the bytes.

Defined cases: null html is an empty payload; a null url is an empty target; line breaks in a url are
percent-encoded; a null page_id sorts below all others; rows that repeat
with the largest page_id of their payload are all responses; payloads under `least` bytes are never revisited; an
empty table makes an empty archive; a very long payload is one binary value (2 GB at most, as everywhere in Spark); columns are picked by exact name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm.common import pick

#: The time of capture where none is given: pages have none, and equal pages make equal archives.
CAPTURED = "1970-01-01T00:00:00Z"
EOL, GAP = "\r\n", "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def _id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def _payloads(pages: DataFrame) -> DataFrame:
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    return pick(pages, "page_id", "url", "html").select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))


def write_archive(pages: DataFrame, folder: str, least: int = 1000, date: str = CAPTURED) -> None:
    """Write the records of pages (page_id, url, html) to `folder`. `date` is the time of capture (UTC, ISO 8601) of all records."""
    spark = pages.sparkSession
    rows = _payloads(pages)
    rows.groupBy("digest").agg(
        F.max("page_id").alias("holder"), F.count("*").alias("copies"), F.first("payload").alias("payload")
    ).select(
        "digest", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("n_bytes"), "holder", "copies", "payload"
    ).write.option("compression", "zstd").parquet(f"{folder}/payloads")

    known = spark.read.parquet(f"{folder}/payloads").select("digest", "sha1", "n_bytes", "holder", "copies")
    joined = rows.select("page_id", "url", "digest").join(known, "digest")
    revisit = (F.col("n_bytes") >= least) & (F.col("copies") > 1) & ~F.col("page_id").eqNullSafe(F.col("holder"))
    url = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), F.col("n_bytes").cast("string"), F.lit(GAP)
    )
    block = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("n_bytes"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(EOL))
    head = F.concat(
        F.lit(f"WARC/1.1{EOL}"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", _id(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", _id(F.col("holder"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", block.cast("string")),
        F.lit(EOL),
        http,
    )
    joined.select("digest", F.encode(head, "UTF-8").alias("head")).write.option("compression", "zstd").parquet(f"{folder}/heads")


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """(record, payload, digest): each record's exact bytes, and the full payload it has or refers to."""
    heads, payloads = spark.read.parquet(f"{folder}/heads"), spark.read.parquet(f"{folder}/payloads").select("digest", "payload")
    is_revisit = F.locate(f"{EOL}WARC-Type: revisit{EOL}", F.col("head").cast("string")) > 0
    return heads.join(payloads, "digest").select(
        F.concat(F.col("head"), F.when(is_revisit, F.lit(b"")).otherwise(F.col("payload")), F.lit(GAP.encode())).alias("record"),
        "payload",
        "digest",
    )


def _field(header: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(header, rf"\r\n{name}: ([^\r\n]*)", 1), F.lit(""))


def _page(urn: Column) -> Column:
    return F.regexp_extract(urn, r"<urn:page:(-?\d+)>", 1).try_cast("long")


def parse_records(records: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to), parsed from the records' bytes.

    A record whose block hasn't the stated length, or whose payload hasn't the stated SHA-1 and the SHA-256 of
    its key, raises an error.
    """
    text = F.col("record").cast("string")
    header = F.substring_index(text, GAP, 1)
    http = F.substring_index(F.substring_index(text, GAP, 2), GAP, -1)
    rows = records.select(
        header.alias("header"),
        (F.octet_length("record") - F.octet_length(header) - 2 * len(GAP)).alias("block_bytes"),
        F.octet_length(http).alias("http_bytes"),
        F.sha1("payload").alias("sha1"),
        F.sha2("payload", 256).alias("sha256"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        "digest",
    )
    kind = _field(F.col("header"), "WARC-Type")
    whole = (
        (F.concat(F.lit("sha1:"), F.col("sha1")) == _field(F.col("header"), "WARC-Payload-Digest"))
        & (F.col("sha256") == F.col("digest"))
        & (F.col("block_bytes") == _field(F.col("header"), "Content-Length").cast("long"))
        & (F.col("block_bytes") == F.col("http_bytes") + len(GAP) + F.when(kind == "revisit", 0).otherwise(F.col("payload_bytes")))
    )
    return rows.select(
        _page(_field(F.col("header"), "WARC-Record-ID")).alias("page_id"),
        F.coalesce(_field(F.col("header"), "WARC-Target-URI"), F.lit("")).alias("url"),
        "payload_bytes",
        F.when(whole, F.col("sha1")).otherwise(F.raise_error(F.lit("a WARC record doesn't verify"))).alias("payload_digest"),
        kind.alias("record_type"),
        _page(_field(F.col("header"), "WARC-Refers-To")).alias("refers_to"),
    )
