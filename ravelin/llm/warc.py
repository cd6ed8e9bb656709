"""WARC archives compressed with Zstandard dictionaries, written and read back.

An archive is a .warc.zst file: a skippable frame (magic number 0x184D2A5D) that holds a dictionary built from the
archive's own records, then a frame for each record, so a reader can start at any record. Records with equal payloads of
at least ``REVISIT_BYTES`` are stored once: the one with the largest page_id is the response, the others are revisit
records (profile identical-payload-digest), whose HTTP header keeps the payload's length.

Which payload is stored is decided by digest: a partial aggregation, then a join whose large partitions the engine can
split, so one payload may be any part of all rows. Archives are rows of a table in the shared folder (a name and the
file's bytes, at most ``ARCHIVE_BYTES`` of payload and one record more), hence any executor can read them again.

Defined cases: a null html is an empty payload, a null url an empty target; a null page_id never is the largest, and
where all of a group's are null, all are responses, as are all rows that share the largest page_id; an empty table gives
an empty one.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from typing import Any, NamedTuple
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm.common import cut, table

REVISIT_BYTES = 1000
ARCHIVE_BYTES, ARCHIVE_RECORDS = 4 << 20, 2000
DICTIONARY_BYTES, SAMPLE_BYTES, PIECE_BYTES = 32 << 10, 1 << 20, 16 << 10
SKIPPABLE = 0x184D2A5D
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = 0x9B1D2C4E5F604718 << 64  # record ids: this, then the page_id; bit 64 tells a null one


class Record(NamedTuple):
    page_id: int | None
    kind: str
    payload_bytes: int
    payload_digest: str
    refers_to: int | None
    url: str
    payload: bytes | None


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.UUID(int=_SPACE | (1 << 64 if page_id is None else page_id & (1 << 64) - 1))}>"


def page_of(identifier: str) -> int | None:
    n = uuid.UUID(identifier[10:-1]).int - _SPACE
    return None if n >> 64 else n - (1 << 64) * (n >> 63)


def _block(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def make_record(page_id: int | None, url: str | None, html: str | None, refers_to: int | None = None, refers_url: str | None = None) -> bytes:
    """A response record, or a revisit one if ``refers_to`` is given."""
    payload = (html or "").encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", quote(url or "", safe="%/:?#[]@!$&'()*+,;=~")),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if refers_to is not None:
        target = quote(refers_url or "", safe="%/:?#[]@!$&'()*+,;=~")
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to)), ("WARC-Refers-To-Target-URI", target), ("WARC-Refers-To-Date", DATE)]
    return _block(fields, http if refers_to is not None else http + payload)


def parse_record(raw: bytes) -> Record | None:
    """What a record says; None for other types. A payload's length and digest are those of the bytes that are there."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if len(block) != int(fields["Content-Length"]):
        raise ValueError(f"record {fields.get('WARC-Record-ID')} is cut off")
    kind = fields["WARC-Type"]
    if kind not in ("response", "revisit"):
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = base64.b32decode(fields["WARC-Payload-Digest"].partition(":")[2]).hex()
    key, url = page_of(fields["WARC-Record-ID"]), fields["WARC-Target-URI"]
    if kind == "revisit":
        length = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        return Record(key, kind, length, stated, page_of(fields["WARC-Refers-To"]), url, None)
    digest = hashlib.sha1(payload).hexdigest()
    if digest != stated:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't have the digest that its record states")
    return Record(key, kind, len(payload), digest, None, url, payload)


def build_dictionary(records: list[bytes]) -> bytes | None:
    """From pieces of records spread evenly over the archive, about SAMPLE_BYTES of them; None where these are too little.

    Long records are sliced, so that there are pieces enough however few the records are."""
    total = sum(map(len, records))
    most = max(64, min(PIECE_BYTES, total // 16))
    pieces = [r[at : at + most] for r in records for at in range(0, len(r), most)]
    samples = pieces[:: max(1, -(-total // SAMPLE_BYTES))]
    if len(samples) < 8:
        return None
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=200, d=8).as_bytes()
    except zstandard.ZstdError:  # samples too short or too much alike
        return None


def write_archive(name: str, records: list[bytes]) -> bytes:
    trained = build_dictionary(records)
    info = _block(
        [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")],
        b"format: WARC File Format 1.1\r\n",
    )
    compressor = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(trained) if trained else None, write_checksum=True)
    frames = [compressor.compress(r) for r in (info, *records)]
    if not trained:
        return b"".join(frames)
    packed = zstandard.ZstdCompressor(level=10).compress(trained)
    return struct.pack("<II", SKIPPABLE, len(packed)) + packed + b"".join(frames)


def read_archive(data: bytes) -> Iterator[bytes]:
    """The records, one frame each."""
    at, trained = 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == SKIPPABLE:
        at = 8 + struct.unpack_from("<I", data, 4)[0]
        packed = data[8:at]
        trained = zstandard.ZstdDecompressor().decompress(packed) if packed[:4] == b"\x28\xb5\x2f\xfd" else packed
    decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)
    while at < len(data):
        frame, parts = decompressor.decompressobj(), []
        while not frame.eof:
            if at >= len(data):
                raise ValueError("the archive is cut off")
            parts.append(frame.decompress(data[at : at + 16384]))
            at += len(data[at : at + 16384])
        at -= len(frame.unused_data)
        yield b"".join(parts)


ARCHIVE_COLUMNS = "archive string, n_records int, content binary"
RECORD_COLUMNS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_ARCHIVE = pa.schema([("archive", pa.string()), ("n_records", pa.int32()), ("content", pa.binary())])
_RECORD = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, count, held, size = TaskContext.get().partitionId(), 0, [], 0

    def flush() -> pa.RecordBatch:
        name = f"part-{part:06d}-{count:05d}.warc.zst"
        return pa.RecordBatch.from_pydict({"archive": [name], "n_records": [len(held)], "content": [write_archive(name, held)]}, schema=_ARCHIVE)

    for batch in batches:
        for row in zip(*batch.columns):
            held.append(make_record(*(x.as_py() for x in row)))
            size += len(held[-1])
            if size >= ARCHIVE_BYTES or len(held) >= ARCHIVE_RECORDS:
                yield flush()
                count, held, size = count + 1, [], 0
    if held:
        yield flush()


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            found = [r for raw in read_archive(content.as_py()) if (r := parse_record(raw))]
            if found:
                columns: dict[str, list[Any]] = {
                    "page_id": [r.page_id for r in found],
                    "payload_bytes": [r.payload_bytes for r in found],
                    "payload_digest": [r.payload_digest for r in found],
                    "record_type": [r.kind for r in found],
                    "refers_to": [r.refers_to for r in found],
                }
                yield pa.RecordBatch.from_pydict(columns, schema=_RECORD)


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url and html of each row, and for a revisit the page_id and url of the response it refers to."""
    rows = pages.select(
        pages[id_col].cast("long").alias("page_id"),
        pages[url_col].cast("string").alias("url"),
        pages[html_col].cast("string").alias("html"),
        F.sha1(F.coalesce(pages[html_col].cast("string"), F.lit(""))).alias("digest"),
    )
    stored = cut(
        rows.where(F.octet_length("html") >= REVISIT_BYTES)
        .groupBy("digest")
        .agg(F.max(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("stored"), F.count("*").alias("n"))
        .where("n > 1 AND stored IS NOT NULL")
        .select("digest", F.col("stored.page_id").alias("stored_id"), F.col("stored.url").alias("stored_url"))
    )
    again = F.col("stored_id").isNotNull() & ~F.coalesce(F.col("page_id") == F.col("stored_id"), F.lit(False))
    return rows.join(stored, "digest", "left").select(
        "page_id", "url", "html", F.when(again, F.col("stored_id")).alias("refers_to"), F.when(again, F.col("stored_url")).alias("refers_url")
    )


def write_archives(pages: DataFrame) -> DataFrame:
    """The archives' names and contents, kept in the shared folder."""
    return cut(plan_records(pages).mapInArrow(_pack, ARCHIVE_COLUMNS))


def read_archives(archives: DataFrame) -> DataFrame:
    return archives.select("content").mapInArrow(_unpack, RECORD_COLUMNS)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archives(write_archives(table(spark, sf_dir, "pages")))


QUERIES = {"op10_warc": op10_warc}
ORACLES = {
    "op10_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
             s AS (SELECT d, max(page_id) AS stored FROM p WHERE n >= 1000 GROUP BY d)
        SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
               CASE WHEN stored IS NOT NULL AND page_id IS DISTINCT FROM stored THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN stored IS NOT NULL AND page_id IS DISTINCT FROM stored THEN stored END AS refers_to
        FROM p LEFT JOIN s ON p.d = s.d
    """
}
