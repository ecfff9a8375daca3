"""Ogg columns: pages with checksums, packets by lacing values, several logical streams, times by granule positions.

The writer stores 8-bit samples losslessly: one logical stream of raw samples (a header packet, then
packets of PACKET samples; the granule position counts samples) and one of comments, multiplexed
page by page. The reader takes any physical stream: it looks for the next page after bytes that
are none, drops pages with a wrong checksum, and keeps what is left of the packets.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textscan import slices

PACKET = 576
RATE = 8_000
FILL = 255
#: Packets that a page holds at most; each takes three lacing values, of 255 that a page can have.
PAGE_PACKETS = 80
CONTINUED, FIRST, LAST = 1, 2, 4
SAMPLES_MAGIC, COMMENTS_MAGIC = b"RAWU8\x00\x01\x00", b"OggComments\x00"
_PAGE = struct.Struct("<4sBBqIIIB")
_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(page: bytes) -> int:
    """The CRC-32 of Ogg: polynomial 04C11DB7, most significant bit first, from 0 and without a final inversion.

    zlib's CRC has the same polynomial with all bits in the other order, so its register over mirrored bytes, from 0, is this one mirrored.
    """
    register = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(register.to_bytes(4, "little").translate(_MIRROR), "big")


def lacing(size: int) -> bytes:
    """255 for each full segment and one value below that, which ends the packet."""
    return b"\xff" * (size // 255) + bytes([size % 255])


def page(serial: int, number: int, granule: int, flags: int, segments: bytes, body: bytes) -> bytes:
    head = _PAGE.pack(b"OggS", 0, flags, granule, serial, number, 0, len(segments)) + segments
    crc = checksum(head + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + body


def pages_of(serial: int, packets: list[bytes], granules: list[int]) -> list[bytes]:
    """The pages of one logical stream. The first packet has the first page alone; a packet that doesn't fit goes on in the next page."""
    out: list[bytes] = []
    segments, body, granule, count, flags = bytearray(), bytearray(), -1, 0, FIRST

    def flush(last: bool, goes_on: bool) -> None:
        nonlocal segments, body, granule, count, flags
        out.append(page(serial, len(out), granule, flags | (LAST if last else 0), bytes(segments), bytes(body)))
        segments, body, granule, count, flags = bytearray(), bytearray(), -1, 0, CONTINUED if goes_on else 0

    for k, (packet, at) in enumerate(zip(packets, granules, strict=True)):
        laces, done = lacing(len(packet)), 0
        while True:
            part = laces[done : done + 255 - len(segments)]
            body += packet[done * 255 : (done + len(part)) * 255]
            segments += part
            done += len(part)
            if done == len(laces):
                break
            flush(False, True)
        granule, count = at, count + 1
        end = k == len(packets) - 1
        if end or k == 0 or count == PAGE_PACKETS or len(segments) == 255:
            flush(end, False)
    return out


def payload_of(data: bytes) -> bytes:
    """``data`` filled up with bytes 255 to a positive multiple of PACKET."""
    size = max(1, -(-len(data) // PACKET)) * PACKET
    return data + bytes([FILL]) * (size - len(data))


def mux(payload: bytes, comments: list[str], rate: int = RATE) -> bytes:
    """An Ogg file of the samples and the comments. Equal arguments give equal bytes: the serial numbers come from the payload."""
    packets = [payload[i : i + PACKET] for i in range(0, len(payload), PACKET)]
    serial = zlib.crc32(payload)
    samples = pages_of(serial, [SAMPLES_MAGIC + struct.pack("<II", rate, PACKET), *packets], [0, *(PACKET * (i + 1) for i in range(len(packets)))])
    notes = [c.encode() for c in comments]
    text = pages_of(serial ^ 0xFFFFFFFF, [COMMENTS_MAGIC, *notes], [0] * (len(notes) + 1))
    first = [samples[0], text[0]]  # all first pages come before any other
    return b"".join([*first, *(p for pair in zip(samples[1:], text[1:]) for p in pair), *samples[len(text) :], *text[len(samples) :]])


@dataclass
class Stream:
    """A logical stream: whole packets, the granule position at which each page that ends packets stands, and what was amiss."""

    serial: int
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    missing_pages: int = 0
    broken_packets: int = 0
    ended: bool = False
    _next: int = -1
    _open: list[bytes] = field(default_factory=list)

    @property
    def last_granule(self) -> int:
        return max(self.granules, default=0)

    def add(self, number: int, granule: int, flags: int, segments: bytes, body: bytes) -> None:
        if self._next >= 0 and number != self._next:
            self.missing_pages += max(0, number - self._next)
            self._drop()
        continued = bool(flags & CONTINUED)
        if not continued and self._open:
            self._drop()
        skipping = continued and not self._open  # the packet's begin is lost
        at, ends = 0, 0
        start = 0
        for lace in segments:
            at += lace
            if lace < 255:
                if skipping:
                    skipping = False
                    self.broken_packets += 1
                else:
                    self.packets.append(b"".join([*self._open, body[start:at]]))
                self._open.clear()
                start, ends = at, ends + 1
        if start < at or (segments and segments[-1] == 255):
            if not skipping:
                self._open.append(body[start:at])
        if ends:
            self.granules.append(granule)
        self.pages, self._next, self.ended = self.pages + 1, number + 1, self.ended or bool(flags & LAST)

    def _drop(self) -> None:
        self.broken_packets += bool(self._open)
        self._open.clear()


@dataclass
class Demuxed:
    streams: dict[int, Stream]
    bad_checksums: int
    skipped_bytes: int


def demux(data: bytes) -> Demuxed:
    """All logical streams of ``data``. Never raises on damage: it is counted."""
    streams: dict[int, Stream] = {}
    bad = skipped = at = 0
    while True:
        found = data.find(b"OggS", at)
        if found < 0:
            return Demuxed(streams, bad, skipped + len(data) - at)
        skipped += found - at
        at = found
        if len(data) - at < _PAGE.size:
            return Demuxed(streams, bad, skipped + len(data) - at)
        _, version, flags, granule, serial, number, crc, count = _PAGE.unpack_from(data, at)
        body_at = at + _PAGE.size + count
        segments = data[at + _PAGE.size : body_at]
        end = body_at + sum(segments)
        if version or len(segments) < count or end > len(data) or checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            bad += 1
            skipped += 4
            at += 4
            continue
        streams.setdefault(serial, Stream(serial)).add(number, granule, flags, segments, data[body_at:end])
        at = end


def samples_stream(found: Demuxed) -> tuple[Stream | None, int]:
    """The stream of raw samples and its rate."""
    for s in found.streams.values():
        if s.packets and s.packets[0].startswith(SAMPLES_MAGIC) and len(s.packets[0]) >= 16:
            return s, struct.unpack_from("<I", s.packets[0], 8)[0]
    return None, 0


def encode_column(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text (null: empty) as UTF-8, stored as an Ogg file of 8-bit samples. One row for each row; other columns are left out."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]
                media = [mux(payload_of(t), [f"bytes={len(t)}"]) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(rows, "doc_id long, n_bytes long, media binary")


FEATURES = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
    "feature string, payload binary, streams int, pages int, packets int, bad_checksums int, missing_pages int, broken_packets int, seconds double"
)


def decode_column(media: DataFrame, keep_payload: bool = True) -> DataFrame:
    """FEATURES of each row's ``media``, read from the stored bytes alone.

    feature: logical streams, pages, packets and damage, the duration in milliseconds by the last granule position, and the mean, root mean
    square around 128 and zero crossings of the samples. A null or damaged column gives counts of what is left, and null digests where no samples are.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "media"):
                out = [_features(m.as_py(), keep_payload) for m in part.column("media")]
                columns = [part.column("doc_id"), part.column("n_bytes"), *(pa.array([o[k] for o in out], schema.field(k + 2).type) for k in range(len(schema) - 2))]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64()}
    schema = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in FEATURES.split(", "))])
    return media.select("doc_id", "n_bytes", "media").mapInArrow(rows, FEATURES)


def _features(media: bytes | None, keep_payload: bool) -> tuple:
    found = demux(media or b"")
    stream, rate = samples_stream(found)
    pages, packets = sum(s.pages for s in found.streams.values()), sum(len(s.packets) for s in found.streams.values())
    damage = found.bad_checksums, sum(s.missing_pages for s in found.streams.values()), sum(s.broken_packets for s in found.streams.values())
    digest = None if media is None else hashlib.sha256(media).hexdigest()
    size = len(media or b"")
    if stream is None:
        feature = f"streams={len(found.streams)};pages={pages};packets={packets};damage={sum(damage)}"
        return None, None, None, size, digest, feature, None, len(found.streams), pages, packets, *damage, None
    payload = b"".join(stream.packets[1:])
    x = np.frombuffer(payload, np.uint8).astype(np.int16) - 128
    crossings = int(np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0)))
    seconds = stream.last_granule / rate if rate else 0.0
    total, squares = int(x.sum(dtype=np.int64)), int((x.astype(np.int64) ** 2).sum())
    n = max(1, len(x))
    feature = (
        f"streams={len(found.streams)};pages={pages};packets={packets};damage={sum(damage)};ms={round(seconds * 1000)};"
        f"mean={total / n:.3f};rms={(squares / n) ** 0.5:.3f};crossings={crossings}"
    )
    return (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), size, digest, feature, payload if keep_payload else None, len(found.streams), pages, packets, *damage, seconds)
