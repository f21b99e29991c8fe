r"""Benchmark decontamination by winnowing. Native: DataFrame functions only.

Words are hashed in k-grams of K; of each W k-grams in a row the least hash is kept (the rightmost of equals). A span of
K + W - 1 = WINDOW words that document and item share has the same k-grams, hence the same least one, so both keep
it: no shared window is missed. Kept fingerprints of documents meet those of the benchmark; around a hit,
the windows that hold the k-gram are compared in full with the benchmark's windows, which extends hits over the
whole shared span and drops hash collisions. Items of fewer words than WINDOW are one short window each; for each
short length that occurs, every run of so many words in a document is a fingerprint.

A document's words are split once. Its positions are exploded, filtered and joined in one
generated stage, so only hits and one row for each document leave it. The benchmark's fingerprints are broadcast in
blocks of at most BLOCK_ROWS, with one pass over the documents for each block; a larger
benchmark costs more passes, not more memory.

Defined cases: null text has no words; rows of documents that repeat are judged each; a null item_id counts as the item "null"; items
that repeat count once; an empty benchmark leaves every document clean, empty documents give no
rows; a very long text is one row's array of words; columns are picked by exact name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import ascii_lower, copies_of, numbered, pick, small, stage

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K, W = 5, 6
WINDOW = K + W - 1
BLOCK_ROWS = 500_000


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _ints(a: Column, b: Column) -> Column:
    """a, a + 1, ... b; empty where b < a."""
    return F.when(b >= a, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))


def _hash(words: Column, at: Column, n: int) -> Column:
    """The hash of n words from position `at`, counted from 0."""
    return F.xxhash64(*[F.get(words, at + i) for i in range(n)])


def _kept(grams: Column, at: Column) -> Column:
    """Is the k-gram at this position the rightmost least of some W in a row? That is so if it has W - 1 neighbours that are no better."""

    def run(step: int) -> Column:
        out = F.lit(W - 1)
        for i in reversed(range(1, W)):
            other = F.get(grams, at + step * i)
            holds = other >= F.get(grams, at) if step < 0 else other > F.get(grams, at)
            out = F.when(F.coalesce(holds, F.lit(False)), out).otherwise(F.lit(i - 1))
        return out

    return run(-1) + run(1) >= W - 1


def _grams(rows: DataFrame) -> DataFrame:
    """rows with the hashes of all k-grams of `words`; none where no whole window fits."""
    n = F.size("words")
    hashes = F.transform(_ints(F.lit(0), n - K), lambda i: _hash(F.col("words"), i, K))
    return rows.withColumn("grams", F.when(n >= WINDOW, hashes).otherwise(F.array().cast("array<bigint>")))


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """(item, size, at, words, window): the windows of all items, by position; window is the words with a space between."""
    items = pick(benchmark, "item_id", "text").select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), words_of(F.col("text")).alias("words"))
    items = items.where(F.size("words") > 0).distinct().withColumn("size", F.least(F.size("words"), F.lit(WINDOW)))
    placed = items.withColumn("at", F.explode(_ints(F.lit(0), F.size("words") - F.col("size"))))
    return placed.select("item", "size", "at", "words", F.array_join(F.slice("words", F.col("at") + 1, F.col("size")), " ").alias("window"))


def _benchmark_prints(benchmark: DataFrame) -> DataFrame:
    """(size, fp): the kept fingerprints of long items (size WINDOW), and the hashes of short ones (their size)."""
    words = pick(benchmark, "text").select(words_of(F.col("text")).alias("words")).where(F.size("words") > 0).distinct()
    long = _grams(words).withColumn("at", F.explode(_ints(F.lit(0), F.size("grams") - 1))).where(_kept(F.col("grams"), F.col("at")))
    out = long.select(F.lit(WINDOW).alias("size"), F.get("grams", F.col("at")).alias("fp"))
    for n in range(1, WINDOW):
        out = out.unionByName(words.where(F.size("words") == n).select(F.lit(n).alias("size"), _hash(F.col("words"), F.lit(0), n).alias("fp")))
    return out.distinct()


def find_hits(documents: DataFrame, benchmark: DataFrame, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest, n_words, at, size, window): a row with null `at` for each document row, and its windows that occur in items; and the items' (item, size, window)."""
    windows = stage(benchmark_windows(benchmark).select("item", "size", "window").distinct(), "windows")
    prints = stage(_benchmark_prints(benchmark), "prints")
    shorts = sorted(r["size"] for r in prints.where(F.col("size") < WINDOW).select("size").distinct().collect())  # WINDOW - 1 rows at most
    blocks = max(1, -(-prints.count() // block_rows))

    docs = _grams(pick(documents, "doc_id", "text").select("doc_id", F.md5("text").alias("digest"), words_of(F.col("text")).alias("words")))
    at, words, grams = F.col("at"), F.col("words"), F.col("grams")
    # -1 stands for the document itself
    last = F.size("words") - 1 if shorts else F.size("grams") - 1
    placed = docs.withColumn("at", F.explode(F.sequence(F.lit(-1), last)))
    own = F.when(_kept(grams, at), F.get(grams, at))
    if shorts:
        prints_of = [F.struct(F.lit(WINDOW).alias("size"), own.alias("fp"))]
        prints_of += [F.struct(F.lit(n).alias("size"), F.when(at + n <= F.size("words"), _hash(words, at, n)).alias("fp")) for n in shorts]
        rows = placed.withColumn("print", F.explode(F.when(at < 0, F.array(F.struct(F.lit(WINDOW).alias("size"), F.lit(None).cast("bigint").alias("fp")))).otherwise(F.array(*prints_of))))
        rows = rows.withColumns({"size": F.col("print.size"), "fp": F.col("print.fp")}).drop("print")
    else:
        rows = placed.withColumns({"size": F.lit(WINDOW), "fp": F.when(at >= 0, own)})
    rows = rows.where((at < 0) | F.col("fp").isNotNull())

    found = []
    for b in range(blocks):
        block = prints.where(F.pmod("fp", F.lit(blocks)) == b).withColumn("known", F.lit(True))
        met = rows.join(F.broadcast(block), ["size", "fp"], "left").where(((at < 0) & F.lit(b == 0)) | F.col("known"))
        first = F.when(F.col("size") < WINDOW, at).otherwise(F.greatest(at - (W - 1), F.lit(0)))
        final = F.when(F.col("size") < WINDOW, at).otherwise(F.least(at, F.size("words") - WINDOW))
        starts = F.when(at < 0, F.array(F.lit(-1))).otherwise(_ints(first, final))
        found.append(
            met.select("doc_id", "digest", F.size("words").cast("long").alias("n_words"), "words", "size", F.explode(starts).alias("at")).select(
                "doc_id", "digest", "n_words", "size", "at", F.when(at >= 0, F.array_join(F.slice(words, at + 1, F.col("size")), " ")).alias("window")
            )
        )
    near = reduce(DataFrame.unionByName, found)
    known = small(windows.select("size", "window").distinct().withColumn("known", F.lit(True)))
    hits = near.join(known, ["size", "window"], "left").where((F.col("at") < 0) | F.col("known"))
    return hits.select("doc_id", "digest", "n_words", F.when(at >= 0, at).alias("at"), "size", "window"), windows


def _covered(spans: Column) -> Column:
    """The number of positions in the union of spans (start, end), sorted by start."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    return F.aggregate(
        spans,
        start,
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(s["end"] - F.greatest(s["start"], acc["end"]), F.lit(0))).alias("n"), F.greatest(acc["end"], s["end"]).alias("end")
        ),
        lambda acc: acc["n"],
    )


def decontaminate(documents: DataFrame, benchmark: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans), one row for each row of documents.

    n_hit: words inside a window that occurs in the document; items_sha256: of the ids of items with
    occurring windows, sorted as strings, comma between; spans: the windows' (start, end) in words.
    """
    hits, windows = find_hits(documents, benchmark, block_rows)
    hits = stage(hits, "hits")
    key = ["doc_id", "digest"]
    span = F.struct(F.col("at").alias("start"), (F.col("at") + F.col("size")).alias("end"))
    per_doc = hits.groupBy(*key).agg(
        F.max("n_words").alias("n_words"),
        F.count_if(F.col("at").isNull()).alias("copies"),
        F.array_sort(F.collect_set(F.when(F.col("at").isNotNull(), span))).alias("spans"),
    )
    pairs = hits.where(F.col("at").isNotNull()).select(*key, "size", "window").distinct()
    items = pairs.join(small(windows), ["size", "window"]).select(*key, "item").distinct()
    items = items.groupBy(*key).agg(F.array_sort(F.collect_set("item")).alias("items")).select(F.col("doc_id").alias("d"), F.col("digest").alias("g"), "items")
    joined = per_doc.join(items, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("digest").eqNullSafe(F.col("g")), "left")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return joined.withColumn("copy", copies_of(F.col("copies"))).select(
        "doc_id",
        "n_words",
        _covered(F.col("spans")).alias("n_hit"),
        F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join(listed, ","), "UTF-8"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        "spans",
    )


def clean_documents(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of documents, all columns, in which no window of the benchmark occurs."""
    hits, _ = find_hits(documents, benchmark)
    bad = stage(hits.where(F.col("at").isNotNull()).select("doc_id", "digest").distinct(), "contaminated")
    plain, (doc_id, text) = numbered(documents, "doc_id", "text")
    same = F.col(doc_id).eqNullSafe(F.col("doc_id")) & F.md5(text).eqNullSafe(F.col("digest"))
    return plain.join(small(bad), same, "left_anti").toDF(*documents.columns)
