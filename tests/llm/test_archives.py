"""WARC and FLAC."""

import hashlib
import os
import random
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loopgauge.llm import common, flac, warc


def same_as_sql(spark, pages, path):
    pages.write.mode("overwrite").parquet(path)
    got = sorted((tuple(r) for r in warc.archived(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{path}/*.parquet'")
    assert got == sorted(con.execute(warc.ORACLE).fetchall(), key=str)
    return got


def test_copies_and_odd_pages(spark, tmp_path):
    big, other = "é" * 600, "b" * 1000
    rows = [(1, "http://a", big), (2, None, big), (3, "u", other), (9, "u", big), (5, "sp ace\n", other), (6, "u", "small"), (7, "u", "small"), (8, "u", None), (10, "u", ""), (None, "u", "n" * 2000), (11, "u", "n" * 2000), (12, "u", "WARC/1.1\r\n\r\n" + "z" * 2000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = same_as_sql(spark, pages.withColumn("file", pages.url), str(tmp_path / "p"))
    kinds = {r[0]: (r[3], r[4]) for r in got}
    assert kinds[1] == kinds[2] == ("revisit", 9) and kinds[9] == ("response", None) and kinds[None] == ("revisit", 11) and kinds[6] == ("response", None)
    assert warc.archived(pages.limit(0)).count() == 0


def test_repeated_page_ids(spark):
    rows = [(1, "u", "x" * 1500), (1, "u", "x" * 1500), (0, "u", "x" * 1500)]
    got = warc.archived(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in got) == [(0, "revisit", 1), (1, "response", None), (1, "response", None)]


def test_op5(spark, sf, tmp_path):
    same_as_sql(spark, common.table(spark, sf, "pages"), str(tmp_path / "p"))


def test_members_stand_alone(spark):
    pages = spark.createDataFrame([(i, "u", str(i) * 50) for i in range(20)], "page_id long, url string, html string")
    for r in warc.archived(pages).collect():
        name = next(os.path.join(d, r.file) for d, _, names in os.walk(common.shared_dir(spark).removeprefix("file://")) if r.file in names)
        with open(name, "rb") as f:
            f.seek(r.offset)
            member = zlib.decompress(f.read(r.length), 31)
        assert f"WARC-Page-Id: {r.page_id}\r\n".encode() in member and member.endswith(str(r.page_id).encode() * 50 + b"\r\n\r\n")


@given(st.lists(st.binary(max_size=60), max_size=6), st.integers(1, 40))
def test_records_in_any_pieces(payloads, step):
    data = b"".join(warc.record("response", i, "u", p, "d", len(p)) for i, p in enumerate(payloads))
    reader, got = warc.Records(), []
    for i in range(0, len(data), step):
        got += [warc.payload_of(b) for _, b in reader.feed(data[i : i + step])]
    reader.close()
    assert got == payloads


@given(st.lists(st.binary(max_size=3000), max_size=5), st.integers(1, 90), st.integers(0, 3))
def test_members_of_a_stream_are_all_inflated(parts, step, zeros):
    import gzip
    import io
    from unittest import mock

    data = b"".join(gzip.compress(p) + bytes(zeros) for p in parts)
    with mock.patch.object(warc, "CHUNK", step):
        pieces = list(warc.inflated(io.BytesIO(data)))
        assert b"".join(pieces) == b"".join(parts) and all(len(p) <= step for p in pieces)
        if parts and not zeros:
            with pytest.raises(ValueError):
                list(warc.inflated(io.BytesIO(data[:-3])))


def test_a_page_that_stands_very_often(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "HOT", 4)  # above a fourth of all rows
    rows = [(i, "u", "hot" * 500 if i % 2 else f"{i // 6} " * 500) for i in range(60)]
    got = same_as_sql(spark, spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "p"))
    assert sum(r[4] == 59 for r in got) == 29


def crc_by_bits(data, poly, width):
    c = 0
    for x in data:
        c ^= x << width - 8
        for _ in range(8):
            c = (c << 1 ^ (poly if c >> width - 1 & 1 else 0)) & (1 << width) - 1
    return c


def test_checksums():
    data = os.urandom(257)
    assert flac.crc8(data) == crc_by_bits(data, 0x07, 8)
    got = flac.crc16(np.frombuffer(data, np.uint8), np.array([0, 0, 7]), np.array([257, 256, 31]))
    assert got.tolist() == [crc_by_bits(d, 0x8005, 16) for d in (data, data[:256], data[7:38])]


def unpacked(streams):
    return [b"".join(b[-1] for b in blocks) for blocks in flac.decode(streams)]


LPCS = [None, ((3, -2), 1), ((100, 20, -30, 7), 7)]


@settings(deadline=None, max_examples=25)
@given(st.lists(st.one_of(st.binary(min_size=1, max_size=200), st.text(max_size=400).map(lambda t: t.encode("utf-8", "replace"))), min_size=1, max_size=5), st.sampled_from(LPCS))
def test_round_trip(parts, lpc):
    payloads = [p * 12 + bytes(-len(p * 12) % 64 or 64) for p in parts]
    assert unpacked(flac.encode(payloads, lpc)) == payloads


def test_predictors_and_long_streams():
    t = np.arange(300_000)
    wave = (128 + 100 * np.sin(t / 300)).astype(np.uint8).tobytes()
    noise, flat = os.urandom(6400), b"\x07" * 6400
    streams = flac.encode([wave, noise, flat])
    assert unpacked(streams) == [wave, noise, flat]
    kinds = [{b[3] for b in blocks} for blocks in flac.decode(streams)]
    assert kinds[0] & {flac.FIXED + 1, flac.FIXED + 2, flac.LPC + flac.ORDER - 1} and kinds[1] == {flac.VERBATIM} and kinds[2] == {flac.CONSTANT}
    assert [flac.parse_header(flac.frame_header(n, 1024)) for n in (0, 127, 128, 70_000, 3_000_000)] == [(n, 1024) for n in (0, 127, 128, 70_000, 3_000_000)]


def test_damage_is_seen():
    stream = flac.encode([b"some words, " * 400 + bytes(32)])[0]
    rng = random.Random(1)
    for _ in range(20):
        at = rng.randrange(130, len(stream))
        with pytest.raises((ValueError, IndexError)):
            flac.decode([stream[:at] + bytes([stream[at] ^ 1 << rng.randrange(8)]) + stream[at + 1 :]])


def test_linear_predictors_are_chosen_and_depend_on_the_frame_alone():
    rng = np.random.default_rng(3)
    x = np.zeros(40_000)
    for i in range(2, len(x)):
        x[i] = 1.6 * x[i - 1] - 0.8 * x[i - 2] + rng.normal(0, 6)
    payload = (np.clip(x, -120, 120) + 128).astype(np.uint8).tobytes()
    blocks = flac.decode(flac.encode([payload]))[0]
    assert sum(b[3] == flac.LPC + flac.ORDER - 1 for b in blocks) > 30 and b"".join(b[-1] for b in blocks) == payload
    words = b"plain words of a text, again " * 40
    assert flac.encode([payload, words, b"z" * 64])[1] == flac.encode([words])[0]
    for first, _, offset, *_, pcm in blocks:  # the offset leads to the frame of that sample
        assert flac.parse_header(flac.encode([payload])[0][offset : offset + flac.header_length(flac.encode([payload])[0], offset)])[0] == first // flac.FRAME and pcm == payload[first : first + flac.FRAME]


def frame(number: int, samples: int, subframe: str) -> bytes:
    head = flac.frame_header(number, samples)
    body = head + int(subframe + "0" * (-len(subframe) % 8), 2).to_bytes(-(-len(subframe) // 8), "big")
    return body + crc_by_bits(body, 0x8005, 16).to_bytes(2, "big")


def stream_of(samples: list[int], frames: list[bytes], table: bytes = b"") -> bytes:
    raw = np.array(samples, np.int8).tobytes()
    info = bytes([0, 64, 0, 64]) + bytes(6) + (8000 << 44 | 7 << 36 | len(raw)).to_bytes(8, "big") + hashlib.md5(raw).digest()
    seek = b"\x03" + len(table).to_bytes(3, "big") + table if table else b""
    return b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + seek + b"\x81" + bytes([0, 0, 2]) + bytes(2) + b"".join(frames)


def bits(v: int, n: int) -> str:
    return format(v & (1 << n) - 1, f"0{n}b") if n else ""


def rice(v: int, k: int) -> str:
    u = v << 1 if v >= 0 else -2 * v - 1
    return "0" * (u >> k) + "1" + bits(u, k)


def test_streams_of_other_writers():
    """Escaped partitions, 5-bit parameters, wasted bits, and frames that no seek table lists, written bit by bit."""
    rng = random.Random(5)
    a = [rng.randrange(-128, 128) for _ in range(64)]
    cut = "".join
    escaped = "0" + bits(flac.FIXED, 6) + "0" + "00" + bits(1, 4) + bits(15, 4) + bits(8, 5) + cut(bits(v, 8) for v in a[:32]) + bits(3, 4) + cut(rice(v, 3) for v in a[32:])
    b = [rng.randrange(-128, 128) for _ in range(64)]
    five = "0" + bits(flac.FIXED + 1, 6) + "0" + bits(b[0], 8) + "01" + bits(0, 4) + bits(5, 5) + cut(rice(v - u, 5) for u, v in zip(b, b[1:]))
    c = [4 * rng.randrange(-32, 32) for _ in range(64)]
    wasted = "0" + bits(flac.FIXED, 6) + "1" + "01" + "00" + bits(0, 4) + bits(4, 4) + cut(rice(v // 4, 4) for v in c)
    d = [2 * rng.randrange(-64, 64) for _ in range(64)]
    verbatim = "0" + bits(flac.VERBATIM, 6) + "1" + "1" + cut(bits(v // 2, 7) for v in d)
    e = [7] * 64
    zero_wide = "0" + bits(flac.FIXED + 1, 6) + "0" + bits(7, 8) + "00" + bits(0, 4) + bits(15, 4) + bits(0, 5)
    frames = [frame(i, 64, s) for i, s in enumerate([escaped, five, wasted, verbatim, zero_wide])]
    want = bytes((np.array(a + b + c + d + e) + 128).astype(np.uint8))
    point = (0).to_bytes(8, "big") + (0).to_bytes(8, "big") + (64).to_bytes(2, "big")
    assert unpacked([stream_of(a + b + c + d + e, frames), stream_of(a + b + c + d + e, frames, point), flac.encode([want])[0]]) == [want] * 3
    with pytest.raises(ValueError):
        flac.decode([stream_of(a + b + c + d + e, [frames[0], frames[1][:-1] + b"\x00", *frames[2:]])])


def test_op9(spark, sf, odd, empty):
    texts = {r.doc_id: r.text for r in common.table(spark, sf, "documents").collect()}
    for r in flac.op9(spark, sf).collect():
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    rows = flac.media_digest(flac.media_column(odd)).collect()
    assert len(rows) == odd.count() and len({(r.media_sha256, r.feature) for r in rows if r.doc_id in (1, 2)}) == 1
    assert flac.media_digest(flac.media_column(empty)).count() == 0


def test_pcm_blocks(spark, odd):
    blocks = flac.pcm_blocks(flac.media_column(odd.filter("doc_id = 7"))).orderBy("block").collect()
    assert [(b.first_sample, b.n_samples) for b in blocks] == [(0, 1024), (1024, 1024), (2048, 960)]
    assert b"".join(bytes(b.pcm) for b in blocks) == b"x" * 3000 + bytes(8)
