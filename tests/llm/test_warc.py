"""WARC archives: round trip, revisits, other readers' frames, and faults that must stop a read."""

import hashlib
import struct

import pytest
import zstandard

from gapline.llm import warc

LONG, BIG = "p" * 100, "q" * 3_000_000
ROWS = [(5, "http://a", LONG), (3, None, LONG), (9, "http://c\r\nX: y", LONG), (1, "u", "short"),
        (2, "u", "short"), (4, "u", None), (6, "u", ""), (7, "u", BIG), (8, "u", BIG + "é")]


@pytest.mark.parametrize("size", [1 << 20, 1 << 30])
def test_round_trip(spark, tmp_path, size):
    df = spark.createDataFrame([(i, u, h, "x") for i, u, h in ROWS],
                               "page_id bigint, url string, html string, digest string")
    warc.write_archives(df, str(tmp_path / "w"), archive_bytes=size)
    got = {r.page_id: r for r in warc.read_archives(spark, str(tmp_path / "w")).collect()}
    assert len(got) == len(ROWS)
    for i, _, h in ROWS:
        raw = (h or "").encode()
        assert got[i].payload_digest == hashlib.sha256(raw).hexdigest()
        assert got[i].payload_bytes == len(raw)
        later = h == LONG and i != 3
        assert (got[i].record_type, got[i].refers_to) == (("revisit", 3) if later else ("response", None))
        assert got[i].payload is None if later else bytes(got[i].payload) == raw


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "page_id bigint, url string, html string")
    warc.write_archives(df, str(tmp_path / "w"))
    assert warc.read_archives(spark, str(tmp_path / "w")).count() == 0


def archive(parts, level=3):
    given = zstandard.train_dictionary(2048, [f"row {i} of text {i * i}".encode() * 9 for i in range(400)])
    pack = zstandard.ZstdCompressor(level=level, dict_data=given)
    raw = zstandard.ZstdCompressor().compress(given.as_bytes())      # a compressed dictionary
    head = struct.pack("<II", warc.DICTIONARY_MAGIC, len(raw)) + raw
    return head + b"".join(pack.compress(p) for p in parts)


def test_reads_compressed_dictionary_and_streamed_frames():
    one = warc.record(1, "u", b"abc", hashlib.sha256(b"abc").hexdigest(), 3, None)
    data = archive([one, one])
    stream = zstandard.ZstdCompressor().compressobj()                # no content size in the frame
    data += stream.compress(one * 1) + stream.flush()
    found = [warc.parse(c, "f", at) for at, c in warc.frames(data, "f")]
    assert [b for _, b in found] == [b"abc"] * 3


@pytest.mark.parametrize("spoil", [
    lambda r: r.replace(b"Content-Length: 3", b"Content-Length: 4"),
    lambda r: r.replace(b"WARC-Date", b"WARC-Dat"),
    lambda r: r.replace(b"WARC/1.1", b"HTTP/1.1"),
    lambda r: r.replace(b"abc", b"abd"),
    lambda r: r[:-1],
])
def test_faults_are_named(spoil):
    one = warc.record(1, "u", b"abc", hashlib.sha256(b"abc").hexdigest(), 3, None)
    data = archive([spoil(one)])
    with pytest.raises(ValueError, match="f at byte"):
        [warc.parse(c, "f", at) for at, c in warc.frames(data, "f")]


@pytest.mark.parametrize("cut", [1, 5, 40])
def test_cut_off_archive(cut):
    one = warc.record(1, "u", b"abc", hashlib.sha256(b"abc").hexdigest(), 3, None)
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(warc.frames(archive([one])[:-cut], "f"))
