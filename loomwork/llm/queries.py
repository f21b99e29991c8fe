"""The queries opN_* and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm.common import stage, table
from loomwork.sources.storage import scratch


def op1_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomwork.llm.warc import parse_records, read_records, write_archive

    folder = scratch(spark, "loomwork-warc")
    write_archive(table(spark, sf_dir, "pages"), folder)
    return parse_records(read_records(spark, folder)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_mpeg_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomwork.llm.mpegts import read_streams, store_streams

    return read_streams(stage(store_streams(table(spark, sf_dir, "documents")), "media"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomwork.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False).drop("ids")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomwork.llm.toxicity import score_toxicity, train

    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, train(docs, table(spark, sf_dir, "labels")))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomwork.llm.license_scan import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomwork.llm.decontaminate import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomwork.llm.quality import score_quality, train

    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, train(docs, table(spark, sf_dir, "labels")))


#: The rules of op8_url_filter: host, path, verdict.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomwork.llm.url_filter import judge_urls

    return judge_urls(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomwork.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2).drop("text_md5")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomwork.llm.chat_format import format_chats, read_chats
    from loomwork.llm.common import pick

    said = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = pick(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text").unionByName(own)
    made = stage(format_chats(turns), "chats")
    read = read_chats(made.select("conv_id", "formatted", "segments"))
    said_by = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(said_by, "UTF-8"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss_text", "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomwork.llm.common import pick
    from loomwork.llm.hard_negatives import mine

    rows = pick(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", shifted))


def op12_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomwork.llm.chat_repair import damaged, repair

    turns = table(spark, sf_dir, "conversations")
    return repair(damaged(turns), turns)


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from loomwork.llm.token_files import read_tokens, write_tokens

    folder = scratch(spark, "loomwork-token-files")
    write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return read_tokens(spark, folder, with_ids=False).drop("ids")


SQL_OP1 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
g AS (SELECT payload_digest, max(page_id) AS holder FROM d GROUP BY payload_digest)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
  CASE WHEN d.payload_bytes >= 1000 AND d.page_id <> g.holder THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN d.payload_bytes >= 1000 AND d.page_id <> g.holder THEN g.holder END AS refers_to
FROM d JOIN g USING (payload_digest)
"""

SQL_OP6 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
  coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item,
  regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item, w, least(len(w), 10) AS size, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, size, array_to_string(w[i:i + size - 1], ' ') AS win FROM bi),
sizes AS (SELECT DISTINCT size FROM bw),
di AS (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size),
h AS (SELECT DISTINCT rid, i, di.size, item FROM di JOIN bw ON di.size = bw.size AND array_to_string(w[i:i + di.size - 1], ' ') = win),
p AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(i, i + size)) AS pos FROM (SELECT DISTINCT rid, i, size FROM h)) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN p USING (rid) LEFT JOIN t USING (rid)
"""

SQL_OP8 = r"""
WITH r(rhost, rpath, rverdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
s AS (SELECT row_number() OVER () AS rid, page_id,
  CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT rid, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM s),
m AS (SELECT u.*, rhost || rpath AS rule, rverdict,
  row_number() OVER (PARTITION BY rid ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS n
  FROM u LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict FROM m WHERE n = 1
"""

SQL_OP10 = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
e AS (SELECT *, replace(replace(replace(replace(replace(replace(text, '\', '\\'), '### System:', '#\## System:'), '### User:', '#\## User:'),
  '### Assistant:', '#\## Assistant:'), '### =', '#\## ='), '</turn>', '<\/turn>') AS escaped FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('### ' || role || ':' || chr(10)) + CASE WHEN role IN ('system', 'user', 'assistant') THEN 0 ELSE 1 END
    + length(escaped) + length('</turn>' || chr(10))) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

SQL_OP11 = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT * FROM (SELECT a.r AS ar, a.vec_id AS anchor_id, a.label AS al, a.e AS ae, b.vec_id AS positive_id, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS positive_score,
    row_number() OVER (PARTITION BY a.r ORDER BY list_inner_product(a.e, b.e) DESC, b.vec_id, b.r) AS n
  FROM v a JOIN v b ON a.label = b.label AND a.r <> b.r WHERE a.vec_id % 100 = 0) WHERE n <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM (
  SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, negative_score,
    CAST(row_number() OVER (PARTITION BY ar, n ORDER BY negative_score DESC, vec_id, r) AS INTEGER) AS rank
  FROM (SELECT p.*, c.r, c.vec_id, CAST(list_inner_product(ae, c.e) AS BIGINT) AS negative_score FROM p JOIN v c ON p.al <> c.label)
  WHERE 30 * positive_score <= 100 * negative_score AND 100 * negative_score <= 90 * positive_score) WHERE rank <= 10
"""

SQL_OP12 = r"""
WITH RECURSIVE k AS (SELECT conv_id, dense_rank() OVER (ORDER BY conv_id) AS c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS bytes
  FROM conversations),
w AS (SELECT *, xor(list_reduce(bytes, lambda a, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384 * (y & 1)), xor(a, b)), CAST(4294967295 AS BIGINT)), 4294967295) % 20 AS which FROM k),
d AS (SELECT c, turn, CASE WHEN which = 4 THEN 'user' ELSE role END AS role,
    CASE which WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM w, (VALUES (1), (2)) x(cp) WHERE which <> 0 AND (cp = 1 OR which = 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS place FROM d),
f AS (SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY c ORDER BY place) || left(role, 1) AS pair,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
      WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY place) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault FROM o),
n AS (SELECT c, max(place) AS n_rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY c),
i(q, ins, q2, nxt, q3) AS (VALUES (0, '', 0, 'u', 2), (0, 'I', 2, 'a', 3), (0, 'II', 3, 'u', 2), (1, '', 1, 'u', 2), (1, 'I', 2, 'a', 3), (1, 'II', 3, 'u', 2),
  (2, '', 2, 'a', 3), (2, 'I', 3, 'u', 2), (3, '', 3, 'u', 2), (3, 'I', 2, 'a', 3)),
dp(c, pos, q, best) AS (
  SELECT c, CAST(0 AS BIGINT), 0, {'cost': CAST(0 AS BIGINT), 'audit': ''} FROM n
  UNION ALL
  SELECT c, pos, q, min(best) FROM (
    SELECT dp.c, f.place AS pos, CASE m.edit WHEN 'D' THEN i.q2 WHEN 'K' THEN CASE f.initial WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END ELSE i.q3 END AS q,
      {'cost': best.cost + 5 * length(ins) + m.cost + CASE WHEN m.edit <> 'D' AND f.fault = 'truncated' THEN 5 ELSE 0 END, 'audit': best.audit || ins || m.edit} AS best
    FROM dp JOIN i USING (q) JOIN f ON f.c = dp.c AND f.place = dp.pos + 1,
      (VALUES ('K', 0), ('R', 1), ('D', 2)) m(edit, cost)
    WHERE m.edit = 'D' OR f.fault NOT IN ('blank', 'duplicate') AND (m.edit = 'R' OR f.initial = nxt OR f.initial = 's' AND i.q2 = 0)) GROUP BY c, pos, q),
e AS (SELECT c, min({'cost': best.cost + 5 * length(ins), 'audit': best.audit || ins}) AS best FROM dp JOIN n USING (c) JOIN i USING (q) WHERE pos = n_rows AND q2 IN (0, 3) GROUP BY c),
s AS (SELECT c, j, substr(best.audit, j, 1) AS edit, length(replace(left(best.audit, j), 'I', '')) AS place, length(replace(left(best.audit, j), 'D', '')) AS nth
  FROM (SELECT c, best, unnest(range(1, length(best.audit) + 1)) AS j FROM e)),
t AS (SELECT c, j, edit, nth, f.role, f.text, coalesce(bool_or(edit = 'K' AND initial = 's') OVER (PARTITION BY c), false) AS after_system FROM s LEFT JOIN f USING (c, place) WHERE edit <> 'D'),
r AS (SELECT c, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (nth % 2 = 1) = after_system THEN 'assistant' ELSE 'user' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY j)) AS sha FROM t GROUP BY c)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(e.best.cost, 0) AS cost, coalesce(e.best.audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, c FROM k) LEFT JOIN n USING (c) LEFT JOIN e USING (c) LEFT JOIN r USING (c)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_archive": op1_warc_archive,
    "op2_mpeg_ts": op2_mpeg_ts,
    "op3_packing": op3_packing,
    "op4_toxicity": op4_toxicity,
    "op5_license_scan": op5_license_scan,
    "op6_decontamination": op6_decontamination,
    "op7_quality": op7_quality,
    "op8_url_filter": op8_url_filter,
    "op9_near_dedup": op9_near_dedup,
    "op10_chat_format": op10_chat_format,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_chat_repair": op12_chat_repair,
    "op13_token_files": op13_token_files,
}
ORACLE_SQL: dict[str, str] = {"op1_warc_archive": SQL_OP1, "op6_decontamination": SQL_OP6, "op8_url_filter": SQL_OP8, "op10_chat_format": SQL_OP10, "op11_hard_negatives": SQL_OP11, "op12_chat_repair": SQL_OP12}
