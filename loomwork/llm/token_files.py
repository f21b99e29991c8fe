r"""Token ids as Arrow stream files of equal-length sequences with masks.

Documents are dealt out in ascending order of their ids to range partitions, each of which writes one file: an Arrow stream of
sequences (`input_ids`: fixed-size list of ids, `mask`: fixed-size list of bits, `length`), and behind it a second Arrow stream that lists the
file's documents (doc_id, n_tokens). Every record batch of sequences has ROWS rows and equal metadata, so all take the same number of bytes:
batch k begins at header + k * stride, and a sequence is a view on the mapped file (`SequenceFile`), without a copy or a search.
Only a file's last sequences are padded (mask 0, id 0); a document may go on in the next sequence of its file, never in another file.

Files are written by Spark's text writer from the batches' bytes (a batch's last byte is always zero, which is the writer's line end), so they are
committed as any other output of a job, in any file system, and a lost task is written again. A file's size is bounded
by the number of ranges, and no task holds more than a batch of ids. `read_tokens` reads the files back; the place of a document in
the whole stream is the running sum of the files' totals, a row each, and its place in its file.

Texts are encoded by pieces (`pieces`).

Defined cases: null and empty texts are the end id alone; a null doc_id comes before all others; documents with one doc_id are ordered by the hash
of their text, and equal rows are written each; an empty table writes no sequence; a very long text is encoded whole, in one task; columns are picked by exact name.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.llm.common import pick, small, stage
from loomwork.llm.pieces import encoder

SIZE, ROWS, END_ID = 1024, 32, 0  #: ids in a sequence, sequences in a batch, the id behind each document
SHARD_BYTES = 16 << 20  #: of text in a file, about
END_OF_STREAM = b"\xff\xff\xff\xff\0\0\0\0"


def sequence_schema(kind: np.dtype, size: int) -> pa.Schema:
    return pa.schema([("input_ids", pa.list_(pa.from_numpy_dtype(kind), size)), ("mask", pa.list_(pa.bool_(), size)), ("length", pa.uint32())])


DOCUMENTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])


def _sequences(ids: bytes, kind: np.dtype, size: int, rows: int) -> bytes:
    """One record batch, padded to `rows` sequences."""
    n = len(ids) // kind.itemsize
    flat = np.zeros(rows * size, kind)
    flat[:n] = np.frombuffer(ids, kind)
    lengths = np.clip(n - size * np.arange(rows), 0, size).astype(np.uint32)
    bits = np.packbits(np.arange(rows * size) < n, bitorder="little")
    mask = pa.Array.from_buffers(pa.bool_(), rows * size, [None, pa.py_buffer(bits)])
    columns = [pa.FixedSizeListArray.from_arrays(pa.array(flat), size), pa.FixedSizeListArray.from_arrays(mask, size), pa.array(lengths)]
    return pa.RecordBatch.from_arrays(columns, schema=sequence_schema(kind, size)).serialize().to_pybytes()


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = END_ID, size: int = SIZE, shard_bytes: int = SHARD_BYTES) -> None:
    """Write the ids of all documents (doc_id, text), by ascending doc_id, to Arrow stream files in `folder`. size: a multiple of 8."""
    if size % 8 or size <= 0:
        raise ValueError("a sequence has a multiple of 8 ids")
    rows = pick(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(-(-total // shard_bytes), docs.sparkSession.sparkContext.defaultParallelism)
    # equal ids may be a third of all rows: the text's hash and, for equal rows, any number deal them out
    keyed = rows.select("doc_id", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("row"), "text")
    dealt = keyed.repartitionByRange(int(shards), "doc_id", "h", "row").sortWithinPartitions("doc_id", "h", "row").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer_path)
        kind = own.type
        end, full = np.array([end_id], kind).tobytes(), ROWS * size * kind.itemsize
        doc_ids, counts, left, head = [], array("q"), bytearray(), sequence_schema(kind, size).serialize().to_pybytes()
        as_row = lambda data: pa.RecordBatch.from_arrays([pa.array([data[:-1]], pa.binary())], names=["chunk"])

        def chunk(ids: bytes) -> pa.RecordBatch:
            nonlocal head
            data, head = head + _sequences(ids, kind, size, ROWS), b""
            return as_row(data)

        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                some = batch.slice(first, 256)
                doc_ids += some.column(0).to_pylist()
                for ids in map(own.encode, some.column(1).to_pylist()):
                    counts.append(len(ids) // kind.itemsize + 1)
                    left += ids + end
                    at = 0
                    while len(left) - at >= full:
                        yield chunk(bytes(left[at : at + full]))
                        at += full
                    del left[:at]
        if not doc_ids:
            return
        if left:
            yield chunk(bytes(left))
        index = [pa.RecordBatch.from_arrays([pa.array(doc_ids[a : a + 65536], pa.int64()), pa.array(counts[a : a + 65536], pa.int64())], schema=DOCUMENTS).serialize().to_pybytes() for a in range(0, len(doc_ids), 65536)]
        yield as_row(END_OF_STREAM)
        yield as_row(DOCUMENTS.serialize().to_pybytes() + index[0])
        for data in index[1:]:
            yield as_row(data)
        yield as_row(END_OF_STREAM)

    dealt.mapInArrow(run, "chunk binary").select(F.col("chunk").cast("string")).write.option("lineSep", "\0").text(folder)


class SequenceFile:
    """One file of `write_tokens`, mapped or in memory. Sequences are views on it."""

    def __init__(self, data):
        self.data = data if isinstance(data, pa.Buffer) else pa.py_buffer(data)
        source = pa.BufferReader(self.data)
        self.schema = pa.ipc.read_schema(source)
        self.header = source.tell()
        kind = self.schema.field("input_ids").type
        self.size, self.type = kind.list_size, np.dtype(kind.value_type.to_pandas_dtype())
        pa.ipc.read_message(source)
        self.stride = source.tell() - self.header
        self.rows = pa.ipc.read_record_batch(self.data.slice(self.header, self.stride), self.schema).num_rows
        end = self.header
        while end + 8 <= self.data.size and self.data.slice(end, 8).to_pybytes() != END_OF_STREAM:
            end += self.stride
        if end + 8 > self.data.size:
            raise ValueError("a file of sequences has no end")
        self.batches, self.end = (end - self.header) // self.stride, end + 8

    def __len__(self) -> int:
        return self.batches * self.rows

    def batch(self, k: int) -> pa.RecordBatch:
        return pa.ipc.read_record_batch(self.data.slice(self.header + k * self.stride, self.stride), self.schema)

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """(ids, mask) of sequence i, without a copy."""
        k, row = divmod(i, self.rows)
        batch = self.batch(k)
        return batch.column(0).values.to_numpy()[row * self.size : (row + 1) * self.size], batch.column(1).values.slice(row * self.size, self.size)

    def ids(self) -> np.ndarray:
        """All ids that masks and lengths leave, in order; only the end of the file is padded."""
        batches = [self.batch(k) for k in range(self.batches)]
        flat = np.concatenate([b.column(0).values.to_numpy() for b in batches])
        n = sum(int(b.column(2).to_numpy().sum()) for b in batches)
        if sum(b.column(1).values.true_count for b in batches) != n or n and not batches[-1].column(1).values.slice(0, n - (self.batches - 1) * self.rows * self.size).true_count:
            raise ValueError("masks and lengths differ")
        return flat[:n]

    def documents(self) -> pa.Table:
        """(doc_id, n_tokens) of the file's documents, in order."""
        source = pa.BufferReader(self.data.slice(self.end))
        return pa.ipc.open_stream(source).read_all()


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids): each document as its file has it; start counts the ids of all documents before it.

    `ids` are packed little-endian with 32 bits each; null without with_ids. Files that don't agree with their own lists raise an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = batch.column(1)[i].as_buffer()
                if not data.size:
                    continue
                file = SequenceFile(data)
                flat, listed = file.ids(), file.documents()
                n = listed.column(1).to_numpy()
                if int(n.sum()) != len(flat):
                    raise ValueError("a file's documents and sequences differ")
                starts = np.cumsum(n) - n
                for a in range(0, len(n), 1024):
                    part = [flat[s : s + k].astype("<u4").tobytes() for s, k in zip(starts[a : a + 1024].tolist(), n[a : a + 1024].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([batch.column(0)[i].as_py()] * len(part), pa.int32()), listed.column(0).slice(a, 1024).combine_chunks(), pa.array(starts[a : a + 1024]), pa.array(n[a : a + 1024])]
                        + [pa.array([zlib.crc32(x) for x in part], pa.int64()), pa.array(part if with_ids else [None] * len(part), pa.binary())],
                        names=["shard", "doc_id", "at", "n_tokens", "ids_crc32", "ids"],
                    )

    files = spark.read.format("binaryFile").load(folder).where(F.col("length") > 0)
    shard = F.regexp_extract("path", r"/part-(\d+)[^/]*$", 1).cast("int").alias("shard")
    found = stage(files.select(shard, "content").mapInArrow(run, "shard int, doc_id long, at long, n_tokens long, ids_crc32 long, ids binary"), "read-tokens")
    totals = found.groupBy("shard").agg(F.sum("n_tokens").alias("tokens"))
    # a row for each file
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("shard", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("shard_start"))
    return found.join(small(offsets), "shard").select("doc_id", (F.col("shard_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "ids")
