"""Media columns in the Ogg container (RFC 3533).

Reading verifies each page's checksum, reassembles packets from lacing values across pages, demultiplexes logical streams by
serial number and derives timestamps from granule positions. Writing interleaves two logical streams: the payload as unsigned
8-bit PCM and a small index stream.

Defined results: a null media value has no streams; bytes that are no page are skipped up to the next capture pattern; a page with
a wrong checksum is counted and dropped, and so is a packet that misses a page; granule position -1 gives no timestamp.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_HEADER = struct.Struct("<4sBBqIIIB")
_PCM = struct.Struct(">8sHHIIBBHI")
_INDEX = struct.Struct("<8sQ32s")
RATE, PACKET, UNIT = 8000, 1920, 192
#: Each byte with its bits reversed: Ogg's CRC shifts left, zlib's shifts right, and over reversed bits they agree.
_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_checksum(*parts: bytes) -> int:
    """The CRC-32 of RFC 3533: polynomial 0x04C11DB7, no reflection, zero at the start and no final inversion."""
    value = 0xFFFFFFFF
    for part in parts:
        value = zlib.crc32(part.translate(_MIRROR), value)
    return int.from_bytes((value ^ 0xFFFFFFFF).to_bytes(4, "little").translate(_MIRROR), "big")


def pages_of(serial: int, packets: list[bytes], granules: list[int], *, first: int = 0, begins: bool = True, ends: bool = True) -> list[bytes]:
    """The packets of one logical stream as pages of at most 255 segments; a page may end within a packet."""
    lacing = b"".join(b"\xff" * (len(p) // 255) + bytes([len(p) % 255]) for p in packets)
    body, made, done, at, number, open_packet = b"".join(packets), [], 0, 0, first, False
    for i in range(0, len(lacing), 255):
        segments = lacing[i : i + 255]
        content = body[at : at + sum(segments)]
        at += len(content)
        finished = len(segments) - segments.count(255)
        done += finished
        flags = (1 if open_packet else 0) | (2 if begins and not i else 0) | (4 if ends and i + 255 >= len(lacing) else 0)
        head = _HEADER.pack(b"OggS", 0, flags, granules[done - 1] if finished else -1, serial, number, 0, len(segments))
        made.append(head[:22] + struct.pack("<I", page_checksum(head, segments, content)) + head[26:] + segments + content)
        number, open_packet = number + 1, segments[-1] == 255
    return made


@dataclass
class Stream:
    """A logical stream as far as it is read."""

    packets: list[bytes] = field(default_factory=list)
    granules: list[int | None] = field(default_factory=list)
    pages: int = 0
    lost: int = 0
    begun: bool = False
    ended: bool = False
    _partial: list[bytes] | None = None
    _next: int | None = None

    def take(self, flags: int, granule: int, number: int, segments: bytes, body: bytes) -> None:
        self.pages += 1
        self.begun |= bool(flags & 2)
        self.ended |= bool(flags & 4)
        gap = self._next is not None and number != self._next
        self._next = number + 1
        partial = self._partial
        if partial is not None and (gap or not flags & 1):
            self.lost, partial = self.lost + 1, None
        skip = bool(flags & 1) and partial is None  # the rest of a packet whose start is missing
        at, size, last = 0, 0, None
        for value in segments:
            size += value
            if value < 255:
                piece = body[at : at + size]
                if skip:
                    skip = False
                else:
                    self.packets.append(b"".join([*partial, piece]) if partial else piece)
                    self.granules.append(None)
                    last = len(self.packets) - 1
                at, size, partial = at + size, 0, None
        if segments and segments[-1] == 255 and not skip:
            partial = [*(partial or []), body[at:]]
        self._partial = partial
        if last is not None and granule != -1:
            self.granules[last] = granule


@dataclass
class Container:
    streams: dict[int, Stream]
    bad_pages: int
    skipped_bytes: int


def read_container(media: bytes | None) -> Container:
    """All logical streams of a physical stream, in order of their first page."""
    streams, bad, skipped, at = {}, 0, 0, 0
    media = media or b""
    while at < len(media):
        if media[at : at + 4] != b"OggS" or at + 27 > len(media):
            following = media.find(b"OggS", at + 1)
            following = len(media) if following < 0 else following
            skipped, at = skipped + following - at, following
            continue
        _, version, flags, granule, serial, number, checksum, count = _HEADER.unpack_from(media, at)
        segments = media[at + 27 : at + 27 + count]
        end = at + 27 + count + sum(segments)
        body = media[at + 27 + count : end]
        whole = len(segments) == count and end <= len(media)
        if version or not whole or page_checksum(media[at : at + 22], b"\0\0\0\0", media[at + 26 : at + 27], segments, body) != checksum:
            bad, at = bad + 1, at + 4
            continue
        streams.setdefault(serial, Stream()).take(flags, granule, number, segments, body)
        at = end
    return Container(streams, bad, skipped)


def pcm_header(packet: bytes) -> tuple[int, int] | None:
    """(rate, channels) of an 8-bit PCM header packet."""
    if len(packet) < _PCM.size or packet[:8] != b"PCM     ":
        return None
    _, _, _, _, rate, _, channels, _, _ = _PCM.unpack_from(packet)
    return rate, channels


def timestamps(stream: Stream) -> list[float | None]:
    """Seconds at the end of each packet: a page's granule position belongs to the last packet that ends on it, and PCM packets
    before it lie as many samples earlier as the later ones hold."""
    head = pcm_header(stream.packets[0]) if stream.packets else None
    if head is None or not head[0]:
        return [None] * len(stream.packets)
    rate, channels = head
    out: list[float | None] = [None] * len(stream.packets)
    at = None
    for i in range(len(stream.packets) - 1, -1, -1):
        at = stream.granules[i] if stream.granules[i] is not None else at
        out[i] = None if at is None else at / rate
        if at is not None:
            at = max(0, at - (len(stream.packets[i]) // max(1, channels) if i > 1 else 0))
    return out


def store(payload: bytes) -> bytes:
    """payload as 8-bit samples, interleaved with an index stream of its length and digest. The same payload gives the same bytes."""
    serial = zlib.crc32(payload)
    samples = [payload[i : i + PACKET] for i in range(0, len(payload), PACKET)]
    packets = [_PCM.pack(b"PCM     ", 0, 0, 1, RATE, 8, 1, PACKET, 1), b"\x08\0\0\0marigold\0\0\0\0", *samples]
    granules = [0, 0, *(min(len(payload), (i + 1) * PACKET) for i in range(len(samples)))]
    audio = pages_of(serial, packets[:1], granules[:1], ends=False) + pages_of(serial, packets[1:], granules[1:], first=1, begins=False)
    index = [b"\x80index\0\0", _INDEX.pack(b"digest\0\0", len(payload), hashlib.sha256(payload).digest())]
    other = serial ^ 0xFFFFFFFF
    side = pages_of(other, index[:1], [0], ends=False) + pages_of(other, index[1:], [len(payload)], first=1, begins=False)
    return b"".join([audio[0], side[0], *audio[1:-1], side[1], audio[-1]])


def padded(text: bytes) -> bytes:
    return text + b" " * (max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array([store(padded(x)) for x in texts], pa.binary())], ["doc_id", "n_bytes", "media"])


def store_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): every whole text (null: empty), padded by spaces to a positive multiple of 192 bytes, in an Ogg container."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(_stored, "doc_id long, n_bytes long, media binary")


def _sample_features(payload: bytes) -> str:
    x = np.frombuffer(payload, np.uint8).astype(np.int64)
    if not len(x):
        return "mean=0;rms=0;crossings=0;peak=0"
    centred = x - 128
    return f"mean={x.sum() / len(x):.4f};rms={math.sqrt(int((centred * centred).sum()) / len(x)):.4f};crossings={int((np.diff(np.sign(centred)) != 0).sum())};peak={int(np.abs(centred).max())}"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for value in batch.column(2):
            media = value.as_py() or b""
            box = read_container(media)
            audio = next((s for s in box.streams.values() if s.packets and pcm_header(s.packets[0])), Stream())
            payload, ends = b"".join(audio.packets[2:]), timestamps(audio)
            feature = f"streams={len(box.streams)};pages={sum(s.pages for s in box.streams.values())};packets={sum(len(s.packets) for s in box.streams.values())};bad_pages={box.bad_pages};seconds={ends[-1] if ends and ends[-1] is not None else 0:.6f};" + _sample_features(payload)
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def media_features(stored: DataFrame) -> DataFrame:
    """What the stored bytes hold, read back from the container: payload digest, tail checksum and a feature string."""
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(_features, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def _packets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, value in zip(batch.column(0), batch.column(1), strict=True):
            rows = []
            for serial, s in read_container(value.as_py()).streams.items():
                rows += [(key.as_py(), serial, i, g, t, p) for i, (g, t, p) in enumerate(zip(s.granules, timestamps(s), s.packets, strict=True))]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.binary()], strict=True)], ["media_id", "serial", "packet_no", "granule", "seconds", "packet"])


def packets(media: DataFrame, *, id_col: str, media_col: str) -> DataFrame:
    """One row per packet of every logical stream: (media_id, serial, packet_no, granule, seconds, packet)."""
    return media.select(F.col(id_col).cast("long").alias("media_id"), F.col(media_col).alias("media")).mapInArrow(_packets, "media_id long, serial long, packet_no long, granule long, seconds double, packet binary")
