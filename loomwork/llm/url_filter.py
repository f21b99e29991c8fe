"""URL filtering: host-suffix and path-prefix expressions, joined on short hash prefixes.

Each URL becomes the expressions (host suffix, path prefix) that any rule could
have: only suffixes of as many labels, and prefixes of as many characters, as some
rule has. So the number of expressions of a URL is bounded by the shapes of the rules,
however long the URL. Expressions and rules meet in an equi-join on
the first 32 bits of their SHA-256; the whole digest then confirms, and the longest
confirmed rule decides.

Defined cases: a null URL, or one without "://", has an empty host and path, and no rule fits it unless
its host is empty; page rows that repeat are judged each; of rules of the same length
the one with the longer host wins, then block before allow. A page that no rule fits gets `default`; so do all
without rules; a very long URL has no more expressions than a short one; empty pages give no rows; columns are picked by exact name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import UPPER, copies_of, pick, small

PREFIX_HEX = 8  #: hex digits of the short hash: 32 bits


def host_of(url: Column) -> Column:
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url)))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict), one row per row of pages.

    pages: page_id, url. rules: host, path, verdict ("allow" or "block"); a rule fits its
    host and all subdomains where the path starts with the rule's.
    """
    rules = pick(rules, "host", "path", "verdict").where("host is not null").fillna("", ["path"])
    shapes = rules.agg(
        F.collect_set(_labels(F.col("host"))).alias("labels"), F.collect_set(F.length("path")).alias("lengths")
    ).first()
    digest = F.sha2(F.concat("host", "path"), 256)
    rules = rules.select(
        digest.substr(1, PREFIX_HEX).alias("prefix"),
        digest.alias("rule_digest"),
        F.struct(
            F.length(F.concat("host", "path")).alias("size"),
            F.length("host").alias("host_size"),
            "verdict",
            F.concat("host", "path").alias("rule"),
        ).alias("hit"),
    ).distinct()

    ints = lambda values: F.array(*[F.lit(v) for v in sorted(values)]).cast("array<int>")
    urls = pick(pages, "page_id", "url").select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    hosts = F.transform(
        F.filter(ints(shapes["labels"]), lambda n: n <= _labels(F.col("host"))),
        lambda n: F.call_function("substring_index", F.col("host"), F.lit("."), -n),
    )
    paths = F.transform(
        F.filter(ints(shapes["lengths"]), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n)
    )
    digests = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.sha2(F.concat(h, p), 256))))
    # the null stands for the row itself, so that pages without a hit stay and repeated rows are counted
    exploded = urls.select(
        "page_id", "url", F.explode(F.concat(F.array(F.lit(None).cast("string")), digests)).alias("digest")
    ).withColumn("prefix", F.col("digest").substr(1, PREFIX_HEX))
    met = exploded.join(small(rules), "prefix", "left").where(F.col("digest").isNull() | (F.col("digest") == F.col("rule_digest")))
    judged = met.groupBy("page_id", "url").agg(
        F.count_if(F.col("digest").isNull()).alias("copies"), F.max("hit").alias("hit")
    )
    return judged.withColumn("_copy", copies_of(F.col("copies"))).select(
        "page_id",
        host_of(F.col("url")).alias("host"),
        path_of(F.col("url")).alias("path"),
        F.col("hit.rule").alias("rule"),
        F.coalesce("hit.verdict", F.lit(default)).alias("verdict"),
    )
