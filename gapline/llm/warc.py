"""WARC archives in Zstandard, written and read with Spark's own file sources.

An archive is a .warc.zst file: a leading skippable frame that holds the dictionary, then one frame
per record. Spark's text writer puts the frames down one after the other; the line separator it
adds is an empty skippable frame, which every Zstandard reader passes over. So archives are written
to and read from any store that Spark reaches.

Writing: payloads are known by their SHA-256. Of equal payloads of `min_revisit` bytes or more the
one with the smallest id is a response, the others are revisits that refer to it and carry no
payload; shorter ones are all responses. A null id counts as the smallest. Only digests are grouped.

Reading: the dictionary comes from the leading frame of the same file, each further frame is one
record. Frame magic, content size, version line, required headers, lengths, and the block digest are
checked; any fault stops the job and names the file and the place.

Result of `read_archives`, one row per record: uri, record_id, page_id, record_type, refers_to,
payload_bytes, payload_digest, payload (null for revisits). Null payloads are empty, null urls
become urn:page:<id>. Rows that repeat the smallest id of their payload are all
responses. An empty table gives no archive and no rows.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapline.llm.common import NO_ID
from gapline.operators.scale import cut_lineage

# Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D     # skippable frame that holds the dictionary
SKIP_FIRST, SKIP_LAST = 0x184D2A50, 0x184D2A5F
FRAME_MAGIC = 0xFD2FB528
VERSION = b"WARC/1.1"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

SEPARATOR = struct.pack("<II", SKIP_FIRST, 0).decode("ascii")     # an empty skippable frame
DICTIONARY_BYTES = 64 << 10
SAMPLE_ROWS = 1_000               # payloads that the dictionary is trained on, about
SAMPLE_BYTES = 8 << 10            # of each of them
ARCHIVE_BYTES = 32 << 20          # payload bytes of one archive, about
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"

_RECORD = ("uri string, record_id string, page_id bigint, record_type string, refers_to bigint, "
           "payload_bytes bigint, payload_digest string, payload binary")


def train_dictionary(df: DataFrame, payload: str, rows: int) -> bytes:
    """A dictionary from about SAMPLE_ROWS of the `rows` payloads, taken by their hash."""
    head = F.substring(F.col(payload), 1, SAMPLE_BYTES)
    place = F.pmod(F.xxhash64(payload), F.lit(1 << 30))
    taken = df.filter(place < float(SAMPLE_ROWS) / max(rows, SAMPLE_ROWS) * (1 << 30))
    samples = sorted(bytes(r["p"]) for r in
                     taken.select(head.alias("p")).filter(F.length("p") > 0).distinct().collect())
    if not samples:
        return b""
    try:
        size = min(DICTIONARY_BYTES, max(1024, sum(map(len, samples)) // 8))
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:     # too little to train on: the samples are the dictionary
        return b"".join(samples)[-DICTIONARY_BYTES:]


def record_id(page: int | None) -> str:
    return f"<urn:page-record:{'none' if page is None else page}>"


def record(page, url, payload: bytes | None, digest: str, size: int, refers) -> bytes:
    """The bytes of one record. `payload` is None for a revisit."""
    block = payload or b""
    kind = "response" if payload is not None else "revisit"
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id(page)), ("WARC-Date", DATE),
            ("WARC-Target-URI", " ".join(url.split()) if url else f"urn:page:{page}"),
            ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(size)),
            ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}")]
    if payload is None:
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers))]
    head += [("Content-Type", "text/html"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head).encode()
    return VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def _frames(dictionary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = dictionary.value
        held = zstandard.ZstdCompressionDict(given) if given else None
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_checksum=True,
                                          write_content_size=True)
        rows = [struct.pack("<II", DICTIONARY_MAGIC, len(given)) + given] if given else []
        for batch in batches:
            rows += [packer.compress(record(*r)) for r in zip(*(c.to_pylist() for c in batch.columns))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["frame"])
            rows = []
    return run


def write_archives(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
                   payload_col: str = "html", min_revisit: int = 100,
                   archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write archives of about `archive_bytes` of payload, one per partition. Payloads move once."""
    spark = df.sparkSession
    pages = df.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"),
                      F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    pages = pages.withColumn("digest", F.sha2("payload", 256)).withColumn(
        "size", F.length("payload").cast("bigint")).withColumn(
        "key", F.coalesce("page_id", F.lit(NO_ID)))
    narrow = pages.select("key", "digest", "size")
    rows, total = narrow.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    archives = total // archive_bytes + 1
    large = narrow.filter(F.col("size") >= min_revisit)
    equal = large.groupBy("digest").agg(F.min("key").alias("first"), F.max("key").alias("other"))
    revisits = (large.join(equal.filter("first < other").drop("other"), "digest")
                .filter("first < key").select("key", "digest", "first").distinct())
    dictionary = spark.sparkContext.broadcast(train_dictionary(pages, "payload", rows))
    placed = pages.repartition(archives, "key", "digest").join(
        revisits.repartition(archives, "key", "digest"), ["key", "digest"], "left")
    (placed.select("page_id", "url", F.when(F.col("first").isNull(), F.col("payload")), "digest", "size",
                   F.when(F.col("first") != NO_ID, F.col("first")))
     .mapInArrow(_frames(dictionary), "frame binary").select(F.col("frame").cast("string").alias("value"))
     .write.option("lineSep", SEPARATOR).text(folder))


def fault(name: str, at: int, what: str) -> ValueError:
    return ValueError(f"{name} at byte {at}: {what}")


def frames(data: bytes, name: str) -> Iterator[tuple[int, bytes]]:
    """The place and content of every frame of an archive, its dictionary loaded first."""
    at, end, unpacker = 0, len(data), None
    held = None
    while at < end:
        if at + 8 > end:
            raise fault(name, at, "cut off frame")
        magic, size = struct.unpack_from("<II", data, at)
        if SKIP_FIRST <= magic <= SKIP_LAST:
            if at + 8 + size > end:
                raise fault(name, at, "cut off skippable frame")
            if magic == DICTIONARY_MAGIC:
                held = zstandard.ZstdCompressionDict(dictionary_of(data[at + 8:at + 8 + size]))
                unpacker = None
            at += 8 + size
            continue
        if magic != FRAME_MAGIC:
            raise fault(name, at, f"no frame starts here: {magic:#x}")
        if unpacker is None:
            unpacker = zstandard.ZstdDecompressor(dict_data=held)
        told = zstandard.frame_content_size(data[at:at + 18])
        reader = unpacker.decompressobj()
        # A frame is at most a little longer than its content, so little is read too far.
        start, step = at, (told + (told >> 8) + 600 if told >= 0 else 1 << 16)
        parts = []
        while not reader.eof:
            if at >= end:
                raise fault(name, start, "cut off frame")
            parts.append(reader.decompress(data[at:at + step]))
            at = min(at + step, end)
        at -= len(reader.unused_data)
        content = b"".join(parts)
        if told >= 0 and told != len(content):
            raise fault(name, start, f"{len(content)} bytes where the frame says {told}")
        yield start, content


def dictionary_of(data: bytes) -> bytes:
    """The dictionary of a leading frame, which may itself be compressed."""
    if data[:4] == struct.pack("<I", FRAME_MAGIC):
        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    return data


def parse(content: bytes, name: str, at: int) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record, checked."""
    head, gap, rest = content.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or not lines[0].startswith(b"WARC/1."):
        raise fault(name, at, "no WARC record")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        key, colon, value = line.partition(b":")
        if not colon:
            raise fault(name, at, f"broken header {line[:40]!r}")
        headers[key.decode()] = value.strip().decode()
    for key in REQUIRED:
        if key not in headers:
            raise fault(name, at, f"{key} is missing")
    length = headers["Content-Length"]
    if not length.isdigit() or rest[int(length):] != b"\r\n\r\n":
        raise fault(name, at, "Content-Length does not fit the frame")
    block = rest[:int(length)]
    told = headers.get("WARC-Block-Digest", "")
    if told.startswith("sha256:") and told[7:] != hashlib.sha256(block).hexdigest():
        raise fault(name, at, "block digest differs")
    return headers, block


def page_of(name: str | None) -> int | None:
    number = (name or "").rpartition(":")[2].rstrip(">")
    return int(number) if number.lstrip("-").isdigit() else None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in _RECORD.split(", ")]
    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(),
             pa.binary()]
    for batch in batches:
        for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            rows: list[tuple] = []
            held = 0
            for at, content in chain(frames(data.as_py(), name), [(-1, b"")]):
                if at >= 0:
                    h, block = parse(content, name, at)
                    response = h["WARC-Type"] == "response"
                    told = h.get("WARC-Payload-Digest", "").removeprefix("sha256:")
                    size = int(h.get("X-Payload-Length", len(block)))
                    if response and (size != len(block)
                                     or told != hashlib.sha256(block).hexdigest()):
                        raise fault(name, at, "payload differs from its headers")
                    rows.append((h.get("WARC-Target-URI"), h["WARC-Record-ID"],
                                 page_of(h["WARC-Record-ID"]), h["WARC-Type"],
                                 page_of(h.get("WARC-Refers-To")), size, told,
                                 block if response else None))
                    held += len(block)
                if rows and (at < 0 or held > 4 << 20):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                    rows, held = [], 0


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """All records of the archives in a folder. One task reads one archive at a time."""
    files = spark.read.format("binaryFile").load(folder).filter(F.col("length") > 0)
    return files.select("path", "content").mapInArrow(_read, _RECORD)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder beside the checkpoints of the session, which all executors share."""
    cut_lineage(spark.range(1))
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"
