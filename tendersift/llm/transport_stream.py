"""MPEG transport streams as a media column.

mux() stores a payload losslessly as a transport stream: a program association table,
a program map table, and one elementary stream of private data whose packets (PES)
carry the payload in access units with timestamps; each GROUP-th unit is a random
access point with a clock reference.  demux() parses the program tables, checks the
continuity counters, reassembles the elementary packets and lists the timestamps with
their random access points.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendersift.llm.common import read_table

# Fixed values of the format.
PACKET, SYNC = 188, 0x47
PAT_PID, NULL_PID = 0x0000, 0x1FFF
PRIVATE_DATA, PRIVATE_STREAM = 0x06, 0xBD

#: What mux() writes.
PROGRAM, PMT_PID, DATA_PID = 1, 0x0100, 0x0101
UNIT, TICKS, GROUP = 32_768, 3_600, 8


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint64) << np.uint64(24)
    for _ in range(8):
        high = table & np.uint64(0x80000000)
        table = ((table << np.uint64(1)) ^ np.where(high, np.uint64(0x04C11DB7), np.uint64(0))) & np.uint64(0xFFFFFFFF)
    return table


_CRC = _crc_table().tolist()


def crc32_mpeg(data: bytes) -> int:
    """The CRC of program tables; 0 over a table with its CRC."""
    crc = 0xFFFFFFFF
    for b in data:
        crc = (crc << 8 & 0xFFFFFFFF) ^ _CRC[crc >> 24 ^ b]
    return crc


def _section(table: int, number: int, body: bytes) -> bytes:
    """A packet payload: pointer field and one section of a table."""
    head = bytes([table, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 255, number >> 8, number & 255, 0xC1, 0, 0])
    return b"\0" + head + body + crc32_mpeg(head + body).to_bytes(4, "big")


def _table_packet(pid: int, payload: bytes, counter: int = 0) -> bytes:
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10 | counter]) + payload).ljust(PACKET, b"\xff")


def _tables() -> bytes:
    pid = lambda flags, value: bytes([flags | value >> 8, value & 255])
    pat = _section(0, 1, PROGRAM.to_bytes(2, "big") + pid(0xE0, PMT_PID))
    pmt = _section(2, PROGRAM, pid(0xE0, DATA_PID) + b"\xf0\0" + bytes([PRIVATE_DATA]) + pid(0xE0, DATA_PID) + b"\xf0\0")
    return _table_packet(PAT_PID, pat) + _table_packet(PMT_PID, pmt)


_HEAD = _tables()


def _timestamp(mark: int, t: int) -> bytes:
    return bytes([mark << 4 | t >> 29 & 14 | 1, t >> 22 & 255, t >> 14 & 254 | 1, t >> 7 & 255, t << 1 & 254 | 1])


def _unit_packets(unit: bytes, number: int, counter: int) -> np.ndarray:
    """The packets of one access unit."""
    t = number * TICKS % (1 << 33)
    size = len(unit) + 8
    pes = b"\0\0\1" + bytes([PRIVATE_STREAM, size >> 8, size & 255, 0x84, 0x80, 5]) + _timestamp(2, t) + unit
    access = number % GROUP == 0
    field = bytes([7, 0x50, t >> 25 & 255, t >> 17 & 255, t >> 9 & 255, t >> 1 & 255, (t & 1) << 7 | 0x7E, 0]) if access else b""
    room = PACKET - 4 - len(field)
    n = 1 + max(0, -(-(len(pes) - room) // (PACKET - 4)))
    out = np.full((n, PACKET), 0xFF, np.uint8)
    out[:, 0], out[:, 1], out[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 255
    out[0, 1] |= 0x40
    out[:, 3] = 0x10 | (counter + np.arange(n)) & 15
    data = np.frombuffer(pes, np.uint8)
    if access:
        out[0, 3] |= 0x20
        out[0, 4 : 4 + len(field)] = np.frombuffer(field, np.uint8)
    whole = n - 1 if n > 1 else 0
    if whole:
        out[0, 4 + len(field) :] = data[:room]
        out[1:whole, 4:] = data[room : room + (whole - 1) * (PACKET - 4)].reshape(-1, PACKET - 4)
    rest = data[room + (whole - 1) * (PACKET - 4) :] if whole else data
    at = PACKET - len(rest)  # the last packet is filled up by a longer adaptation field
    start = 4 if n > 1 else 4 + len(field)
    if stuffing := at - start:
        out[-1, 3] |= 0x20
        if n == 1 and access:
            out[-1, 4] = len(field) - 1 + stuffing
        else:
            out[-1, 4] = stuffing - 1
            if stuffing > 1:
                out[-1, 5] = 0
    out[-1, at:] = rest
    return out


def mux(payload: bytes) -> bytes:
    """A transport stream that holds the payload; an empty one has its tables only."""
    parts, counter = [_HEAD], 0
    for number, lo in enumerate(range(0, len(payload), UNIT)):
        packets = _unit_packets(payload[lo : lo + UNIT], number, counter)
        counter += len(packets)
        parts.append(packets.tobytes())
    return b"".join(parts)


class Stream(NamedTuple):
    """What demux() finds: programs (number, PMT pid), streams (pid, type), units and faults."""

    payload: bytes
    programs: list[tuple[int, int]]
    streams: list[tuple[int, int]]
    units: list[tuple[int, int, int, int, bool]]  # pid, offset in payload, bytes, timestamp (-1: none), random access
    packets: int
    lost_sync: int
    discontinuities: int
    repeated: int
    bad_tables: int


def _sections(parts: list[tuple[bool, bytes]]) -> Iterator[bytes]:
    """Whole sections from the payloads of one pid, with the starts marked."""
    held = b""
    for start, data in parts:
        if start:
            skip = 1 + data[0] if data else 1
            held += data[1:skip]
            if len(held) >= 3 and len(held) >= (size := 3 + ((held[1] & 15) << 8 | held[2])):
                yield held[:size]
            held = data[skip:]
        elif held:
            held += data
        while len(held) >= 3 and held[0] != 0xFF and len(held) >= (size := 3 + ((held[1] & 15) << 8 | held[2])):
            yield held[:size]
            held = held[size:]


def demux(data: bytes) -> Stream:
    """Parse a transport stream.

    Bytes before a sync byte that repeats a packet later are skipped.  Packets marked as
    damaged or scrambled, null packets and repeats of the packet before are left out;
    a jump of a continuity counter counts as a discontinuity, unless announced, and
    drops the unit it falls into.
    """
    raw = np.frombuffer(data, np.uint8)
    lost, parts, i = 0, [], 0
    while i + PACKET <= len(raw):
        run = raw[i : i + (len(raw) - i) // PACKET * PACKET].reshape(-1, PACKET)
        good = len(run) if (run[:, 0] == SYNC).all() else int(np.argmin(run[:, 0] == SYNC))
        parts.append(run[:good])
        i += good * PACKET
        while i + PACKET <= len(raw) and not (raw[i] == SYNC and (i + PACKET == len(raw) or raw[i + PACKET] == SYNC)):
            i, lost = i + 1, lost + 1
    lost += len(raw) - i
    packets = np.concatenate(parts) if parts else np.empty((0, PACKET), np.uint8)
    pid = (packets[:, 1].astype(np.int64) & 31) << 8 | packets[:, 2]
    usable = (packets[:, 1] & 0x80 == 0) & (packets[:, 3] & 0xC0 == 0) & (pid != NULL_PID)
    flags = packets[:, 3] & 0x30
    extra = np.where(flags & 0x20, packets[:, 4].astype(np.int64) + 1, 0)
    begin = np.minimum(4 + extra, PACKET)
    field = np.where((flags & 0x20 != 0) & (packets[:, 4] > 0), packets[:, 5], 0)
    faults = {"discontinuities": 0, "repeated": 0, "bad_tables": 0}

    def of(which: int) -> tuple[np.ndarray, np.ndarray]:
        """The packets of a pid with payload, and which of them follow a jump."""
        at = np.flatnonzero(usable & (pid == which) & (flags & 0x10 != 0))
        count = packets[at, 3].astype(np.int64) & 15
        step = np.diff(count, prepend=count[:1] - 1) & 15
        same = step == 0
        if same.any():
            same[1:] &= (packets[at[1:], 4:] == packets[at[:-1], 4:]).all(1)
            faults["repeated"] += int(same.sum())
        keep = ~same
        jump = (step != 1) & keep & (field[at] & 0x80 == 0)
        faults["discontinuities"] += int(jump.sum())
        return at[keep], jump[keep]

    def table(which: int, kind: int) -> Iterator[bytes]:
        at, _ = of(which)
        seen = set()
        for s in _sections([(bool(packets[k, 1] & 0x40), packets[k, begin[k] :].tobytes()) for k in at]):
            if s[0] != kind or s in seen:
                continue
            if crc32_mpeg(s):
                faults["bad_tables"] += 1
                continue
            seen.add(s)
            yield s

    programs, streams = [], []
    for s in table(PAT_PID, 0):
        for k in range(8, len(s) - 4, 4):
            number = s[k] << 8 | s[k + 1]
            if number:
                programs.append((number, (s[k + 2] & 31) << 8 | s[k + 3]))
    for _, pmt in programs:
        for s in table(pmt, 2):
            k = 12 + ((s[10] & 15) << 8 | s[11])
            while k + 5 <= len(s) - 4:
                streams.append(((s[k + 1] & 31) << 8 | s[k + 2], s[k]))
                k += 5 + ((s[k + 3] & 15) << 8 | s[k + 4])
    out, units, length = [], [], 0
    for which in dict.fromkeys(p for p, _ in streams):
        at, jump = of(which)
        starts = np.flatnonzero(packets[at, 1] & 0x40)
        for lo, hi in zip(starts, np.append(starts[1:], len(at)), strict=False):
            if jump[lo + 1 : hi].any():
                continue
            mine = at[lo:hi]
            pes = packets[mine[0], begin[mine[0]] :].tobytes() + (packets[mine[1:-1]][:, 4:].tobytes() if len(mine) > 2 and (begin[mine[1:-1]] == 4).all() else b"".join(packets[k, begin[k] :].tobytes() for k in mine[1:-1])) + (packets[mine[-1], begin[mine[-1]] :].tobytes() if len(mine) > 1 else b"")
            if len(pes) < 9 or pes[:3] != b"\0\0\1":
                continue
            size = pes[4] << 8 | pes[5]
            end = 6 + size if size else len(pes)
            if end > len(pes):
                continue
            t = (pes[9] >> 1 & 7) << 30 | pes[10] << 22 | pes[11] >> 1 << 15 | pes[12] << 7 | pes[13] >> 1 if pes[7] & 0x80 and len(pes) >= 14 else -1
            unit = pes[9 + pes[8] : end]
            units.append((int(which), length, len(unit), t, bool(field[mine[0]] & 0x40)))
            out.append(unit)
            length += len(unit)
    return Stream(b"".join(out), programs, streams, units, len(packets), lost, **faults)


_UNITS = "array<struct<pid:int,offset:bigint,bytes:bigint,timestamp:bigint,random_access:boolean>>"
_PARSED = f"struct<payload:binary,programs:array<struct<number:int,pid:int>>,streams:array<struct<pid:int,type:int>>,units:{_UNITS},packets:bigint,lost_sync:bigint,discontinuities:bigint,repeated:bigint,bad_tables:bigint>"


def _with(df: DataFrame, name: str, kind: str, source: str, arrow: pa.DataType, one) -> DataFrame:
    df = df.drop(name)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):  # smaller batches leave sooner
                part = batch.slice(lo, 500)
                made = pa.array([one(x.as_py() or b"") for x in part.column(source)], arrow)
                yield pa.RecordBatch.from_arrays([*part.columns, made], [*part.schema.names, name])

    return df.mapInArrow(run, f"{fields}, `{name}` {kind}")


def muxed(df: DataFrame, payload: str = "payload", media: str = "media") -> DataFrame:
    """df with the transport stream of each binary payload; null is the empty payload; a column of the result's name is replaced."""
    return _with(df, media, "binary", payload, pa.binary(), mux)


def _row(data: bytes) -> dict:
    s = demux(data)
    unit = ("pid", "offset", "bytes", "timestamp", "random_access")
    return s._asdict() | {"programs": [{"number": a, "pid": b} for a, b in s.programs], "streams": [{"pid": a, "type": b} for a, b in s.streams], "units": [dict(zip(unit, u, strict=True)) for u in s.units]}


_I32, _I64 = pa.int32(), pa.int64()
_ARROW = pa.struct(
    [
        ("payload", pa.binary()),
        ("programs", pa.list_(pa.struct([("number", _I32), ("pid", _I32)]))),
        ("streams", pa.list_(pa.struct([("pid", _I32), ("type", _I32)]))),
        ("units", pa.list_(pa.struct([("pid", _I32), ("offset", _I64), ("bytes", _I64), ("timestamp", _I64), ("random_access", pa.bool_())]))),
        *[(n, _I64) for n in ("packets", "lost_sync", "discontinuities", "repeated", "bad_tables")],
    ]
)


def demuxed(df: DataFrame, media: str = "media", parsed: str = "parsed") -> DataFrame:
    """df with a struct of what demux() finds in each binary media value; null is the empty stream.

    A column of the result's name is replaced.  Bytes that are no transport stream give an empty payload and count as lost_sync.
    """
    return _with(df, parsed, _PARSED, media, _ARROW, _row)


def with_payload(docs: DataFrame, payload: str = "payload", n_bytes: str = "n_bytes") -> DataFrame:
    """docs with each whole text's UTF-8 bytes, filled with 0 to a positive multiple of 64, and their number before; columns of these names are replaced.  A null text is empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    size = F.octet_length(text)
    full = F.greatest(F.lit(1), F.ceil(size / 64).cast("int")) * 64
    zeros = F.lit(bytes(64))
    return docs.withColumns({n_bytes: size.cast("bigint"), payload: F.concat(text, F.substring(zeros, 1, full - size))})


def digests(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: sizes, digests of the payload read back and of the stored form, and features.

    feature: program, stream and unit counts, the last timestamp and the random access points.
    """
    media = muxed(with_payload(docs.select("doc_id", "text")).drop("text")).drop("payload")
    read = demuxed(media)
    p = F.col("parsed.payload")
    access = F.transform(F.filter("parsed.units", lambda u: u["random_access"]), lambda u: F.concat_ws("@", u["offset"], u["timestamp"]))
    faults = F.expr("parsed.lost_sync + parsed.discontinuities + parsed.repeated + parsed.bad_tables")
    feature = F.format_string("packets=%d programs=%d streams=%d units=%d faults=%d last=%d access=%s", "parsed.packets", F.size("parsed.programs"), F.size("parsed.streams"), F.size("parsed.units"), faults, F.element_at("parsed.units", -1)["timestamp"], F.array_join(access, ","))
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length(p).cast("bigint").alias("payload_bytes"),
        F.sha2(p, 256).alias("payload_sha256"),
        F.crc32(F.substring(p, -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return digests(read_table(spark, sf_dir, "documents"))
