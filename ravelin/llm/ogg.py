"""Ogg media columns: page checksums, packets from lacing values, logical streams and granule timestamps.

A payload is stored as unsigned 8-bit PCM samples in an Ogg physical stream (RFC 3533). Its blocks of samples are dealt
in turn to ``STREAMS`` logical streams, whose pages are interleaved by end time; each stream has a "PCM     " header
packet (begin-of-stream page), a comment packet, and data packets. A granule position is the number of a stream's
samples up to the end of the last packet that a page completes, -1 where it completes none.

Reading checks every page's checksum; a page that fails is left out, its bytes are searched for the next capture pattern,
and a packet that lost a part is dropped and counted, as is each gap in a stream's page numbers. Packets get timestamps by
counting samples back from their page's granule position, which also tells where in the payload a packet belongs: what is
lost leaves a gap of zeros in its place (``assemble``), and never moves what follows.

Defined cases: a null text is stored as an empty one, padded to 64 zero bytes; equal texts give equal media; repeated
rows give repeated rows; an empty table gives an empty one; a null doc_id is kept; ``read`` of a null or garbage column
gives no packets.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ravelin.llm.common import map_rows, table

STREAMS = 2
PACKET_SAMPLES = 4096
RATE = 8000
PAGE_HEADER = struct.Struct("<4sBBqIIIB")
PCM_HEADER = struct.Struct(">8sHHIIBBHI")
CONTINUED, FIRST, LAST = 1, 2, 4
#: Each byte with its bits in reverse order: the checksum's polynomial is that of zlib's, bits the other way round.
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def checksum(page: bytes) -> int:
    """CRC-32 of polynomial 0x04C11DB7, start 0, no reflection, no final complement."""
    crc = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_REVERSED), "big")


def page(kind: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    raw = PAGE_HEADER.pack(b"OggS", 0, kind, granule, serial, number, 0, len(lacing)) + lacing + body
    return raw[:22] + checksum(raw).to_bytes(4, "little") + raw[26:]


def stream_pages(serial: int, headers: list[bytes], packets: list[bytes]) -> list[tuple[int, bytes]]:
    """(granule position so far, page) of one logical stream: a page for each header, then as few as the data need."""
    pages = []
    for n, header in enumerate(headers):
        lacing = b"\xff" * (len(header) // 255) + bytes((len(header) % 255,))
        kind = FIRST * (n == 0) | LAST * (n == len(headers) - 1 and not packets)
        pages.append((0, page(kind, 0, serial, n, lacing, header)))
    lacing = b"".join(b"\xff" * (len(p) // 255) + bytes((len(p) % 255,)) for p in packets)
    body, at, samples, done, opened = b"".join(packets), 0, 0, 0, False
    for start in range(0, len(lacing), 255):
        own = lacing[start : start + 255]
        size = sum(own)
        ends = [i for i, v in enumerate(own) if v < 255]
        if ends:
            samples = at + sum(own[: ends[-1] + 1])
        kind = CONTINUED * opened | LAST * (start + 255 >= len(lacing))
        done = samples if ends else done
        pages.append((at + size, page(kind, samples if ends else -1, serial, len(pages), own, body[at : at + size])))
        at += size
        opened = own[-1] == 255
    return pages


def write(payload: bytes, streams: int = STREAMS, packet_samples: int = PACKET_SAMPLES, rate: int = RATE) -> bytes:
    """The payload as an Ogg physical stream. Serial numbers follow the payload, so equal payloads give equal media."""
    blocks = [payload[i : i + packet_samples] for i in range(0, len(payload), packet_samples)]
    base = zlib.crc32(payload)
    own = []
    for n in range(streams):
        headers = [PCM_HEADER.pack(b"PCM     ", 0, 0, 1, rate, 8, 1, packet_samples, 1), b"ravelin\0" + struct.pack("<HH", n, streams)]
        own.append(stream_pages((base + n) & 0xFFFFFFFF, headers, blocks[n::streams]))
    firsts = b"".join(p[0][1] for p in own)
    rest = sorted((granule, n, i, raw) for n, pages in enumerate(own) for i, (granule, raw) in enumerate(pages) if i)
    return firsts + b"".join(raw for *_, raw in rest)


@dataclass
class Stream:
    """One logical stream: its packets with the granule position after each, or None where no page tells."""

    serial: int
    packets: list[bytes] = field(default_factory=list)
    granules: list[int | None] = field(default_factory=list)
    open: list[bytes] | None = None
    next_page: int | None = None
    ended: bool = False
    lost: int = 0


@dataclass
class Media:
    streams: dict[int, Stream]
    pages: int
    bad_pages: int


def read(media: bytes | None) -> Media:
    """Demultiplexes; pages with a wrong checksum are left out."""
    media = media or b""
    streams: dict[int, Stream] = {}
    pages = bad = 0
    at = media.find(b"OggS")
    while 0 <= at <= len(media) - 27:
        _, version, kind, granule, serial, number, crc, segments = PAGE_HEADER.unpack_from(media, at)
        lacing = media[at + 27 : at + 27 + segments]
        start = at + 27 + segments
        end = start + sum(lacing)
        if version or end > len(media) or checksum(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != crc:
            bad += 1
            at = media.find(b"OggS", at + 1)
            continue
        pages += 1
        stream = streams.setdefault(serial, Stream(serial))
        gap = stream.next_page is not None and stream.next_page != number
        if gap or not kind & CONTINUED:
            stream.lost += gap or stream.open is not None
            stream.open = None
        skip = kind & CONTINUED and stream.open is None
        stream.lost += bool(skip and not gap)
        stream.next_page = number + 1
        first, size = len(stream.packets), 0
        for v in lacing:
            size += v
            if v < 255:
                part = media[start : start + size]
                if skip:
                    skip = False
                else:
                    stream.packets.append(b"".join([*stream.open, part]) if stream.open else part)
                    stream.granules.append(None)
                start, size, stream.open = start + size, 0, None
        if lacing and lacing[-1] == 255 and not skip:
            stream.open = [*(stream.open or []), media[start : start + size]]
        if granule >= 0:
            for i in range(len(stream.packets) - 1, first - 1, -1):
                stream.granules[i] = granule
                granule -= len(stream.packets[i])
        stream.ended |= bool(kind & LAST)
        at = end if media[end : end + 4] == b"OggS" else media.find(b"OggS", end)
    for stream in streams.values():
        stream.lost += stream.open is not None
    return Media(streams, pages, bad)


def assemble(media: Media) -> tuple[bytes, int]:
    """The payload, and how many of its samples are missing, for which there are zeros.

    A data packet's place follows from its stream's number, which the comment packet states, and its granule position.
    What is lost after the last packet that is left isn't known, but shows in a stream that has not ended or has losses."""
    parts: list[tuple[int, bytes]] = []
    for stream in media.streams.values():
        if len(stream.packets) < 2 or stream.packets[0][:8] != b"PCM     " or stream.packets[1][:8] != b"ravelin\0":
            continue
        size = PCM_HEADER.unpack_from(stream.packets[0])[7]
        n, streams = struct.unpack_from("<HH", stream.packets[1], 8)
        for packet, granule in zip(stream.packets[2:], stream.granules[2:]):
            if granule is not None:
                parts.append((((granule - len(packet)) // size * streams + n) * size, packet))
    parts.sort()
    out, at = [], 0
    for start, packet in parts:
        if start > at:
            out.append(bytes(start - at))
        out.append(packet)
        at = max(at, start + len(packet))
    return b"".join(out), at - sum(len(p) for _, p in parts)


def samples(media: Media) -> bytes:
    return assemble(media)[0]


def timestamps(stream: Stream, rate: int = RATE) -> list[float | None]:
    """Start of each data packet in seconds."""
    return [None if g is None else (g - len(p)) / rate for p, g in zip(stream.packets[2:], stream.granules[2:])]


def feature(media: Media, payload: bytes) -> str:
    x = np.frombuffer(payload, np.uint8)
    ends = [g for s in media.streams.values() for g in s.granules[2:] if g is not None]
    packets = sum(max(0, len(s.packets) - 2) for s in media.streams.values())
    histogram = np.bincount(x, minlength=256)
    p = histogram[histogram > 0] / max(1, len(x))
    crossings = int(((x[1:] >= 128) != (x[:-1] >= 128)).sum())
    return (
        f"streams={len(media.streams)};pages={media.pages};packets={packets};bad_pages={media.bad_pages};"
        f"seconds={max(ends, default=0) / RATE:.6f};mean={x.mean() if len(x) else 0:.6f};deviation={x.std() if len(x) else 0:.6f};"
        f"entropy={-(p * np.log2(p)).sum() + 0:.6f};crossings={crossings}"
    )


def pad(text: str | None) -> tuple[int, bytes]:
    """A text's number of bytes, and these padded with zeros to a positive multiple of 64."""
    raw = (text or "").encode("utf-8")
    return len(raw), raw + b"\0" * (-len(raw) % 64 or 64 * (not raw))


def write_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", media_col: str = "media") -> DataFrame:
    """id and the text's payload as Ogg media."""
    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs, [id_col, text_col], lambda: lambda k, t: [(k, write(pad(t)[1]))], f"{id_col} {kind}, {media_col} binary")


def read_column(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """A row for each data packet: its logical stream, number, granule position, start in seconds and bytes."""

    def start() -> Callable[..., Iterable[tuple[Any, ...]]]:
        def each(key: Any, raw: bytes | None) -> Iterable[tuple[Any, ...]]:
            for stream in read(raw).streams.values():
                for n, (p, g, t) in enumerate(zip(stream.packets[2:], stream.granules[2:], timestamps(stream))):
                    yield key, stream.serial, n, g, t, p

        return each

    kind = df.schema[id_col].dataType.simpleString()
    return map_rows(df, [id_col, media_col], start, f"{id_col} {kind}, serial long, packet int, granule long, start_s double, samples binary")


def store_and_read(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text stored as media, the stored bytes read back, and what they hold."""

    def each(key: Any, text: str | None) -> Iterable[tuple[Any, ...]]:
        size, payload = pad(text)
        media = write(payload)
        held = read(media)
        back, missing = assemble(held)
        if missing or held.bad_pages or any(x.lost or not x.ended for x in held.streams.values()):
            raise ValueError(f"the stored media of {key} are damaged: {missing} samples missing")
        yield (
            key, size, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]),
            len(media), hashlib.sha256(media).hexdigest(), feature(held, back),
        )

    kind = docs.schema[id_col].dataType.simpleString()
    columns = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_rows(docs, [id_col, text_col], lambda: each, f"{id_col} {kind}, {columns}")


def op1_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_and_read(table(spark, sf_dir, "documents"))


QUERIES = {"op1_ogg": op1_ogg}
ORACLES: dict[str, str] = {}
