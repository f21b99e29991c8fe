"""MPEG transport streams: bytes in 188-byte packets, with program tables, continuity counters and timestamps.

`mux` and `demux` work on one stream; `store_streams`, `read_streams` and `access_units` apply them to
a table in Arrow batches. A stream has a PAT and a PMT, repeated before each access unit that is a random-access
point, and one elementary stream of private data. A PES packet has one access unit and a
presentation timestamp of 90 kHz ticks; its first packet has a clock reference, and marks random access for each `EVERY`-th unit.

Reading takes the program's PID from the PAT and the stream's PID from the PMT, whose sections may reach over packets; checks their CRC-32, checks continuity
counters for each PID, and reassembles PES packets. What the standard allows is read: null packets, other streams, packets with an adaptation
field only, a packet sent twice, stuffing anywhere, a stated discontinuity, PES packets of no stated length. What doesn't verify raises ValueError: bytes
outside packets, a lost sync byte, a gap in a counter, a PES packet shorter than stated. `access_units` is the index for seeking: of each unit its timestamp, its
first packet's place, and whether a decoder may begin there.

Defined cases: null and empty texts become one block of zero bytes; equal payloads, repeated rows among them, make equal streams
(nothing of a stream depends on its row); a stream is held in memory one row at a time, a very long text as 2 GB at most; an empty table gives no rows; columns are
picked by exact name.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomwork.llm.common import pick

PACKET, SYNC = 188, 0x47
PMT_PID, DATA_PID, NULL_PID, PROGRAM, PRIVATE_DATA = 0x1000, 0x0100, 0x1FFF, 1, 0x06
UNIT_BYTES, TICKS, EVERY = 8192, 3600, 8  #: bytes and 90 kHz ticks of an access unit; random access at each EVERY-th
BLOCK = 64


def _crc_table() -> np.ndarray:
    """CRC-32/MPEG-2 of each byte: polynomial 0x04C11DB7, most significant bit first."""
    out = np.arange(256, dtype=np.uint64) << 24
    for _ in range(8):
        out = ((out << 1) ^ np.where(out & 0x80000000, 0x04C11DB7, 0).astype(np.uint64)) & 0xFFFFFFFF
    return out


_CRC = [int(x) for x in _crc_table()]


def crc32_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for b in data:
        crc = ((crc << 8) & 0xFFFFFFFF) ^ _CRC[(crc >> 24) ^ b]
    return crc


def _section(table_id: int, number: int, body: bytes) -> bytes:
    """A program table section as one packet's payload, pointer field first."""
    head = bytes([table_id]) + (0xB000 | (5 + len(body) + 4)).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return b"\x00" + head + body + crc32_mpeg(head + body).to_bytes(4, "big")


PAT = _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")).ljust(184, b"\xff")
PMT = _section(
    2, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_DATA]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00"
).ljust(184, b"\xff")


def _head(pid: int, start: bool, control: int, counter: int) -> bytes:
    return bytes([SYNC, (0x40 if start else 0) | pid >> 8, pid & 0xFF, control << 4 | counter & 15])


def _pes(unit: bytes, pts: int) -> bytes:
    stamp = bytes([0x21 | (pts >> 29) & 0x0E, (pts >> 22) & 0xFF, (pts >> 14) & 0xFE | 1, (pts >> 7) & 0xFF, (pts << 1) & 0xFE | 1])
    return b"\x00\x00\x01\xbd" + (8 + len(unit)).to_bytes(2, "big") + b"\x84\x80\x05" + stamp + unit


def mux(payload: bytes) -> bytes:
    """The transport stream of a payload."""
    out, tables, counter = [], 0, 0
    for n, at in enumerate(range(0, len(payload), UNIT_BYTES)):
        access = n % EVERY == 0
        if access:
            out += [_head(0, True, 1, tables), PAT, _head(PMT_PID, True, 1, tables), PMT]
            tables += 1
        pes = _pes(payload[at : at + UNIT_BYTES], n * TICKS & (1 << 33) - 1)
        # the first packet has an adaptation field with flags and clock, the last one is stuffed through its own
        first = pes[:176]
        stuffing = 176 - len(first)
        clock = ((n * TICKS & (1 << 33) - 1) << 15 | 0x3F << 9).to_bytes(6, "big")
        out += [_head(DATA_PID, True, 3, counter), bytes([7 + stuffing, 0x50 if access else 0x10]), clock, b"\xff" * stuffing, first]
        counter += 1
        whole, rest = divmod(len(pes) - len(first), 184)
        if whole:
            body = np.empty((whole, PACKET), np.uint8)
            body[:, 0], body[:, 1], body[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 0xFF
            body[:, 3] = 0x10 | (counter + np.arange(whole)) & 15
            body[:, 4:] = np.frombuffer(pes, np.uint8, whole * 184, len(first)).reshape(whole, 184)
            out.append(body.tobytes())
            counter += whole
        if rest:
            stuffing = 183 - rest
            field = bytes([stuffing]) + (b"\x00" + b"\xff" * (stuffing - 1) if stuffing else b"")
            out += [_head(DATA_PID, False, 3, counter), field, pes[-rest:]]
            counter += 1
    return b"".join(out)


def _section_body(payloads: list[bytes], table_id: int) -> bytes:
    """The body of the first section in the payloads of a PID, the first of which begins one."""
    data = payloads[0][1 + payloads[0][0] :] + b"".join(payloads[1:])
    section = data[: 3 + (int.from_bytes(data[1:3], "big") & 0xFFF)]
    if len(section) < 12 or section[0] != table_id or crc32_mpeg(section):
        raise ValueError("a program table doesn't verify")
    return section[8:-4]


def _streams(pmt: bytes) -> list[tuple[int, int]]:
    """(type, PID) of the elementary streams of a PMT's body."""
    at, out = 4 + (int.from_bytes(pmt[2:4], "big") & 0xFFF), []
    while at + 5 <= len(pmt):
        out.append((pmt[at], int.from_bytes(pmt[at + 1 : at + 3], "big") & 0x1FFF))
        at += 5 + (int.from_bytes(pmt[at + 3 : at + 5], "big") & 0xFFF)
    return out


def _checked(packets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of one PID's packets (their places) those with a payload, without repeats, in order; a gap in the counter raises ValueError."""
    at = at[packets[at, 3] & 0x10 > 0]
    counters = packets[at, 3].astype(np.int16) & 15
    steps = np.diff(counters) & 15
    odd = np.flatnonzero(steps != 1)
    twice = np.zeros(len(at), bool)
    for i in odd.tolist():
        a, b = packets[at[i]], packets[at[i + 1]]
        if steps[i] == 0 and (a[4:] == b[4:]).all() and not twice[i]:
            twice[i + 1] = True
        elif not (b[3] & 0x20 and b[4] and b[5] & 0x80):  # unless a discontinuity is stated
            raise ValueError("a continuity counter has a gap")
    return at[~twice]


def demux(stream: bytes) -> tuple[bytes, dict, list[tuple[int | None, int, bool]]]:
    """The payload of a transport stream, what its structure says, and its access units: (timestamp, place of the first packet, random access)."""
    if not stream or len(stream) % PACKET:
        raise ValueError("not whole transport packets")
    packets = np.frombuffer(stream, np.uint8).reshape(-1, PACKET)
    if (packets[:, 0] != SYNC).any():
        raise ValueError("a sync byte is missing")
    pids = (packets[:, 1].astype(np.int32) & 0x1F) << 8 | packets[:, 2]
    of = {pid: _checked(packets, np.flatnonzero(pids == pid)) for pid in np.unique(pids).tolist() if pid != NULL_PID}
    skip = np.where(packets[:, 3] & 0x20, packets[:, 4].astype(np.int64) + 1, 0) + 4

    def table(pid: int, table_id: int) -> bytes:
        own = of.get(pid, np.zeros(0, np.int64))
        begins = np.flatnonzero(packets[own, 1] & 0x40)
        if not len(begins):
            raise ValueError("a program table is missing")
        upto = begins[1] if len(begins) > 1 else len(own)
        return _section_body([stream[i * PACKET + skip[i] : (i + 1) * PACKET] for i in own[begins[0] : upto].tolist()], table_id)

    pat = table(0, 0)
    programs = [(int.from_bytes(pat[i : i + 2], "big"), int.from_bytes(pat[i + 2 : i + 4], "big") & 0x1FFF) for i in range(0, len(pat), 4)]
    program, pmt_pid = next(p for p in programs if p[0])  # 0 names the network's table
    kind, pid = next((s for s in _streams(table(pmt_pid, 2)) if s[0] == PRIVATE_DATA), (0, 0))
    own = of.get(pid, np.zeros(0, np.int64))
    begins = np.flatnonzero(packets[own, 1] & 0x40)
    if not pid or not len(begins):
        raise ValueError("the program has no stream of private data")
    out, units = [], []
    for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(own)], strict=True):
        at = own[a:b]
        cuts = np.flatnonzero((skip[at] > 4) | np.r_[True, np.diff(at) > 1])  # runs of packets in a row with nothing but payload
        pes = []
        for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(at)], strict=True):
            pes.append(stream[at[i] * PACKET + skip[at[i]] : (at[i] + 1) * PACKET])
            if j - i > 1:
                pes.append(packets[at[i] + 1 : at[j - 1] + 1, 4:].tobytes())
        data = b"".join(pes)
        size = int.from_bytes(data[4:6], "big")
        if data[:3] != b"\x00\x00\x01" or size and size != len(data) - 6:
            raise ValueError("a PES packet isn't whole")
        s = data[9:14]
        pts = (s[0] & 0x0E) << 29 | s[1] << 22 | (s[2] & 0xFE) << 14 | s[3] << 7 | s[4] >> 1 if data[7] & 0x80 else None
        first = int(at[0])
        units.append((pts, first, bool(packets[first, 3] & 0x20 and packets[first, 4] and packets[first, 5] & 0x40)))
        out.append(data[9 + data[8] :])
    points = [u[0] for u in units if u[2]]
    facts = {
        "program": program, "pmt_pid": pmt_pid, "pid": pid, "stream_type": kind, "packets": len(packets), "units": len(units),
        "first_pts": units[0][0], "last_pts": units[-1][0], "random_access": len(points), "access_pts_step": points[1] - points[0] if len(points) > 1 else 0,
    }
    return b"".join(out), facts, units


def padded(text: bytes) -> bytes:
    """The payload of a text: zero bytes appended, up to a positive multiple of 64."""
    return text.ljust(max(BLOCK, -(-len(text) // BLOCK) * BLOCK), b"\x00")


def store_streams(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) of docs (doc_id, text), one row per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # so that a batch of long texts makes small ones
                part = batch.slice(at, 256)
                texts = [(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([mux(padded(t)) for t in texts], pa.binary())],
                    names=["doc_id", "n_bytes", "media"],
                )

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def _rows(stored: DataFrame, schema: str, kinds: list[pa.DataType], of: Callable[[bytes], list[tuple]], keep: tuple[str, ...]) -> DataFrame:
    """The rows that `of` makes of each stream, after the columns in keep."""
    names = [x.split()[0] for x in schema.split(", ") if " " in x][: len(keep) + len(kinds)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
            made = [of(media.as_py()) for media in batch.column(len(keep))]
            at = pa.array([i for i, rows in enumerate(made) for _ in rows], pa.int32())
            flat = [row for rows in made for row in rows]
            columns = [pa.array(x, k) for x, k in zip(zip(*flat, strict=True) if flat else [[]] * len(kinds), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(len(keep))), *columns], names=names)

    return stored.select(*keep, "media").mapInArrow(run, schema)


def read_streams(stored: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of stored streams, one row per stream."""

    def of(media: bytes) -> list[tuple]:
        payload, facts, _ = demux(media)
        return [(len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), json.dumps(facts))]

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return _rows(stored, schema, [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()], of, ("doc_id", "n_bytes"))


def access_units(stored: DataFrame) -> DataFrame:
    """(doc_id, unit, pts, packet, random_access): the access units of stored streams, by which one can seek; packet counts the stream's packets from 0."""
    of = lambda media: [(n, *u) for n, u in enumerate(demux(media)[2])]
    return _rows(stored, "doc_id long, unit long, pts long, packet long, random_access boolean", [pa.int64(), pa.int64(), pa.int64(), pa.bool_()], of, ("doc_id",))
