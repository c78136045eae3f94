"""WARC archives of pages, records compressed one by one with a trained dictionary.

An archive is a run of Zstandard frames: first a skippable frame with the archive's
dictionary, itself compressed, then one frame per WARC record, so a record can be
read alone with the dictionary. The dictionary is trained on records of the same
archive, spread over it, up to DICTIONARY_SAMPLE bytes; an archive too small to
train on has none.

Spark's text writer stores the archives, one a file, so tasks commit their files
like any other table's and any store Spark writes to will do. The writer ends each
value with a line feed; the archive's last bytes announce a skippable frame of one
byte, and that line feed is its content.

Of pages with equal payloads of at least `least` bytes the one with the smallest
id is a response, the others are revisits that refer to it; smaller payloads are
always responses. Null html is an empty payload, a null url gives no target. A
null id counts as larger than others and is written as an empty name. Rows that
repeat an id and payload are all responses if that id is the smallest. An empty
table gives no archive and an empty result. Columns beyond id, url and html stay
unread.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gateflow.llm.tables import prepared, stored

LEAST = 100
ARCHIVE_BYTES = 24 << 20
DICTIONARY, DICTIONARY_SAMPLE = 64 << 10, 4 << 20
#: Fixed values of the frame format.
DICTIONARY_MAGIC, SKIP_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0x184D2A50, 0xFD2FB528
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_UNSAFE = re.compile(rb"[\x00-\x20\x7f]")


def skippable(magic: int, content: bytes) -> bytes:
    return struct.pack("<II", magic, len(content)) + content


def name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One WARC record; a revisit (refers_to given) has the HTTP header only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = head if revisit else head + payload
    fields = [
        b"WARC/1.1",
        b"WARC-Type: " + (b"revisit" if revisit else b"response"),
        f"WARC-Record-ID: {name(page_id)}".encode(),
        f"WARC-Date: {date}".encode(),
        f"WARC-Payload-Digest: sha256:{digest}".encode(),
        b"Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}".encode(),
    ]
    if url is not None:
        target = _UNSAFE.sub(lambda m: b"%%%02X" % m[0][0], url.encode("utf-8", "replace"))
        fields.append(b"WARC-Target-URI: " + target)
    if revisit:
        fields += [f"WARC-Refers-To: {name(refers_to)}".encode(), f"WARC-Profile: {_PROFILE}".encode()]
    return b"\r\n".join(fields) + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive(records: list[bytes], level: int = 3) -> bytes:
    """Bytes of one archive, without the line feed that ends it."""
    size = sum(map(len, records))
    step = max(1, -(-size // DICTIONARY_SAMPLE))
    parts = []
    try:
        trained = zstandard.train_dictionary(DICTIONARY, records[::step], level=level)
        parts.append(skippable(DICTIONARY_MAGIC, zstandard.ZstdCompressor(level=level).compress(trained.as_bytes())))
        compressor = zstandard.ZstdCompressor(level=level, dict_data=trained, write_checksum=True)
    except zstandard.ZstdError:  # too little to train on
        compressor = zstandard.ZstdCompressor(level=level, write_checksum=True)
    parts += [compressor.compress(r) for r in records]
    return b"".join(parts) + struct.pack("<II", SKIP_MAGIC, 1)


def frame_end(data: memoryview, at: int) -> int:
    """End of the frame at `at`, from its block headers."""
    checksum = zstandard.get_frame_parameters(data[at : at + 32]).has_checksum
    at += zstandard.frame_header_size(data[at : at + 32])
    last = 0
    while not last:
        block = int.from_bytes(data[at : at + 3], "little")
        last, kind, size = block & 1, block >> 1 & 3, block >> 3
        at += 3 + (1 if kind == 1 else size)
    return at + 4 * checksum


def frames(content: bytes) -> Iterator[bytes]:
    """Records of an archive, or of several in a row."""
    data, at, reader = memoryview(content), 0, zstandard.ZstdDecompressor()
    while at < len(data):
        magic, size = struct.unpack_from("<II", data, at)
        if magic == FRAME_MAGIC:
            end = frame_end(data, at)
            yield reader.decompress(data[at:end])
            at = end
            continue
        if magic & ~0xF != SKIP_MAGIC:
            raise ValueError(f"no frame at byte {at}")
        if magic == DICTIONARY_MAGIC:
            body = bytes(data[at + 8 : at + 8 + size])
            if body[:4] == struct.pack("<I", FRAME_MAGIC):
                body = zstandard.ZstdDecompressor().decompress(body)
            reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body))
        at += 8 + size


def parse(raw: bytes) -> dict:
    """Fields of a record, and its payload (None for a revisit)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
    block = rest[: int(fields[b"Content-Length"])]
    number = lambda key: int(n) if (n := fields.get(key, b"<urn:page:>")[len("<urn:page:") : -1]) else None
    kind = fields[b"WARC-Type"].decode()
    return {
        "page_id": number(b"WARC-Record-ID"),
        "url": fields[b"WARC-Target-URI"].decode() if b"WARC-Target-URI" in fields else None,
        "record_type": kind,
        "refers_to": number(b"WARC-Refers-To"),
        "digest": fields[b"WARC-Payload-Digest"].decode().removeprefix("sha256:"),
        "payload": block.partition(b"\r\n\r\n")[2] if kind == "response" else None,
    }


def write_warc(
    pages: DataFrame,
    path: str,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    least: int = LEAST,
    date: str = "1970-01-01T00:00:00Z",
    archive_bytes: int = ARCHIVE_BYTES,
) -> None:
    """Write archives below `path`, each of about `archive_bytes` of records."""
    prepared(pages.sparkSession)
    payload: Column = F.coalesce(F.col(html).cast("string"), F.lit(""))
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"),
        F.col(url).cast("string").alias("url"),
        payload.alias("html"),
        F.sha2(payload, 256).alias("digest"),
        F.octet_length(payload).alias("bytes"),
    )
    # ids and digests only: one row per task for the copies of a payload
    large = rows.where(F.col("bytes") >= least).select("page_id", "digest")
    shared = (
        large.groupBy("digest")
        .agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 and refers_to is not null")
        .drop("n")
    )
    revisits = large.join(shared, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).distinct()
    # the wide rows are dealt by id, which no payload can skew
    revisits = revisits.select(F.col("page_id").alias("own"), F.col("digest").alias("told"), "refers_to")
    on = F.col("page_id").eqNullSafe(F.col("own")) & (F.col("digest") == F.col("told"))
    told = rows.join(revisits, on, "left").select("page_id", "url", "html", "digest", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        one = lambda: pa.RecordBatch.from_arrays([pa.array([archive(held)], pa.binary())], names=["archive"])
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                i, u, body, digest, first = (v.as_py() for v in row)
                held.append(record(i, u, body.encode("utf-8", "replace"), digest, first, date))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield one()
                    held, size = [], 0
        if held:
            yield one()

    archives = told.mapInArrow(run, "archive binary").select(F.col("archive").cast("string"))
    archives.write.option("maxRecordsPerFile", 1).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, record_type, refers_to, digest, payload) per record."""
    prepared(spark)
    schema = "page_id long, url string, record_type string, refers_to long, digest string, payload binary"
    out = pa.schema(
        [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("digest", pa.string()), ("payload", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                held, size = [], 0
                for raw in frames(content.as_buffer()):
                    held.append(parse(raw))
                    size += len(raw)
                    if size >= 4 << 20:
                        yield pa.RecordBatch.from_pylist(held, out)
                        held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, out)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def payload_index(records: DataFrame) -> DataFrame:
    """One row per record: id, bytes and SHA-256 of the full payload as read back
    (a revisit's from the response it refers to), type and reference."""
    facts = stored(
        records.select(
            "page_id",
            "record_type",
            "refers_to",
            F.col("digest").alias("told"),
            F.octet_length("payload").cast("long").alias("bytes"),
            F.sha2("payload", 256).alias("sha"),
        ),
        "warc-facts",
    )
    responses = (
        facts.where("record_type = 'response'")
        .select(F.col("page_id").alias("at"), F.col("sha").alias("found"), F.col("bytes").alias("b"))
        .distinct()
    )
    joined = facts.join(responses, (F.col("refers_to") == F.col("at")) & (F.col("told") == F.col("found")), "left")
    return joined.select(
        "page_id",
        F.coalesce("bytes", "b").alias("payload_bytes"),
        F.coalesce("sha", "found").alias("payload_digest"),
        "record_type",
        "refers_to",
    )
