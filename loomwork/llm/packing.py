"""Concatenate and cut: documents become one stream of token ids, cut into sequences of fixed length.

First pass: each partition encodes its documents once and writes (part, local start, ids) to a staged table. The
partitions' token totals, a row each, get running sums: the offset of each partition in the whole stream. Second
pass: each document's global start is its partition's offset plus its local start, and
its ids are cut where a window of `size` ids ends; a document over a boundary leaves a record on either side.
No ids are shuffled, and nothing but the totals is in one place.

Only the last sequence can be short; it is padded to a power of two (`padded_to`).

Defined cases: null and empty texts are the end id alone; repeated rows are packed each; an empty table
gives no pieces; a very long text is encoded whole, in one task, and cut into as many pieces as it needs; columns are picked by exact name. The order of the stream is that of the scan, fixed once by the staged table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.common import pick, small, stage
from loomwork.llm.pieces import encoder

SIZE, END_ID = 4096, 2


def encode_documents(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """(part, doc_id, start, n_tokens, width, ids): ids with the end id; start counts ids in the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, at = encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        end = np.array([end_id], own.type).tobytes()
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                rows = batch.slice(first, 512)
                ids = [own.encode(x or "") + end for x in rows.column(1).to_pylist()]
                n = np.array([len(x) for x in ids], np.int64) // own.type.itemsize
                starts = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), part, np.int32)), rows.column(0), pa.array(starts), pa.array(n), pa.array(np.full(len(ids), own.type.itemsize, np.int32)), pa.array(ids, pa.binary())],
                    names=["part", "doc_id", "start", "n_tokens", "width", "ids"],
                )

    return pick(docs, "doc_id", "text").mapInArrow(run, "part int, doc_id long, start long, n_tokens long, width int, ids binary")


def pack(docs: DataFrame, tokenizer_path: str, size: int = SIZE, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_to, ids), one row per piece.

    `ids` are the piece's ids, packed little-endian with 32 bits each; null without with_ids, where only the layout is of interest.
    """
    encoded = stage(encode_documents(docs, tokenizer_path, end_id), "tokens")
    totals = encoded.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each partition of the scan
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("part_start"),
        F.sum("tokens").over(Window.partitionBy(F.lit(1))).alias("total"),
    )
    located = encoded.join(small(offsets), "part").select("doc_id", (F.col("part_start") + F.col("start")).alias("at"), "total", "width", "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 2048):
                rows = []
                for doc_id, at, total, width, packed in zip(*[c.to_pylist() for c in batch.slice(first, 2048).columns], strict=True):
                    ids = np.frombuffer(packed, f"<u{width}").astype("<u4").tobytes()
                    n, start = len(ids) // 4, 0
                    while start < n:
                        sequence, offset = divmod(at + start, size)
                        length = min(size - offset, n - start)
                        piece = ids[4 * start : 4 * (start + length)]
                        left = total - sequence * size
                        rows.append((doc_id, start, length, zlib.crc32(piece), n, sequence, offset, size if left >= size else min(size, 1 << (left - 1).bit_length()), piece if with_ids else None))
                        start += length
                kinds = [pa.int64()] * 8 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True) if rows else [[]] * 9, kinds, strict=True)], names=names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_to long, ids binary"
    names = [x.split()[0] for x in schema.split(", ")]
    return located.mapInArrow(cut, schema)
