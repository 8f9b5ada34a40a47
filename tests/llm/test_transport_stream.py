import hashlib
import random
import zlib

from tendersift.llm import transport_stream as ts


def test_round_trip_of_every_length():
    rnd = random.Random(2)
    for n in [*range(0, 800), 32767, 32768, 32769, 65536, 300_001]:
        data = rnd.randbytes(n)
        media = ts.mux(data)
        got = ts.demux(media)
        assert got.payload == data and len(media) % 188 == 0
        assert (got.lost_sync, got.discontinuities, got.repeated, got.bad_tables) == (0, 0, 0, 0)
        assert got.programs == [(1, 0x100)] and got.streams == [(0x101, 6)]
        assert [(u[3], u[4]) for u in got.units] == [(i * 3600, i % 8 == 0) for i in range(-(-n // 32768))]


def test_faults_are_found():
    data = random.Random(3).randbytes(100_000)
    media = ts.mux(data)
    packets = [media[i : i + 188] for i in range(0, len(media), 188)]
    lost = ts.demux(b"".join(packets[:50] + packets[51:]))
    assert lost.discontinuities == 1 and lost.payload == data[32768:] and len(lost.units) == 3
    twice = ts.demux(b"".join(packets[:50] + packets[49:]))
    assert twice.repeated == 1 and twice.payload == data
    noise = ts.demux(b"\x01\x02" + media + b"\x03")
    assert noise.lost_sync == 3 and noise.payload == data
    bad = bytearray(media)
    bad[188 + 20] ^= 1
    assert ts.demux(bytes(bad)).bad_tables == 1
    assert ts.demux(b"").packets == 0 and ts.demux(b"no stream").payload == b""
    null = bytes([0x47, 0x1F, 0xFF, 0x10]).ljust(188, b"\xff")
    assert ts.demux(null.join(packets)).payload == data


def test_query_equals_plain_digests(spark):
    docs = spark.createDataFrame([(1, None, 1), (None, "", 2), (2, "é" * 32, 3), (3, "x" * 65, 4), (3, "x" * 65, 4), (4, "long " * 60_000, 5)], "doc_id bigint, text string, payload int")
    for r, text in zip(ts.digests(docs).collect(), [x.text or "" for x in docs.collect()], strict=True):
        raw = text.encode()
        full = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
        media = ts.mux(full)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        assert "faults=0" in r.feature
    assert ts.digests(docs.limit(0)).count() == 0
    clash = docs.selectExpr("doc_id", "text", "payload", "doc_id AS n_bytes", "doc_id AS Media", "doc_id AS parsed")
    read = ts.demuxed(ts.muxed(ts.with_payload(clash)))
    assert sorted(read.columns) == ["doc_id", "media", "n_bytes", "parsed", "payload", "text"]
    assert all(r.parsed.payload == r.payload and r.n_bytes == len((r.text or "").encode()) for r in read.collect())
