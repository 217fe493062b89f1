"""Media columns: payloads stored as Ogg, read back with checksums verified, and features of the samples.

A file holds one or more logical streams, told apart by serial number, whose pages may alternate; the first page of each
holds its identification header alone, and all first pages come before any other. A page has a header (sequence number,
granule position, checksum), a table of lacing values and the bytes of its segments. A packet is a run of segments that
ends with one shorter than 255 bytes, and may go on over pages. Here a packet is a frame of 8-bit samples and the granule
position counts the samples up to the page's last finished packet, so that a packet's time
follows from the positions around it.

Edge cases: a null text counts as empty; an empty text is stored as one frame of padding; repeated rows are stored
alike and each keeps its row; an empty table gives an empty result; further columns of the input are ignored, whatever
their names. A damaged file raises ValueError naming the page.
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

from .common import plain_text

FRAME, RATE, SERIAL, INFO_SERIAL = 576, 16_000, 1, 2
_HEADER = struct.Struct("<4sBBqIIIB")
#: Identification headers, a stream's first packet: a name, then rate and frame size.
SOUND_HEADER, INFO_HEADER = struct.pack("<8sII", b"\x01u8frame", RATE, FRAME), b"\x01rowinfo"
_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(page: bytes) -> int:
    """Ogg's CRC (polynomial 04C11DB7, most significant bit first, no inversion) by way of zlib's mirrored one."""
    mirrored = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{mirrored:032b}"[::-1], 2)


def _page(serial: int, number: int, granule: int, kind: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEADER.pack(b"OggS", 0, kind, granule, serial, number, 0, len(lacing)) + lacing
    page = bytearray(head + body)
    page[22:26] = struct.pack("<I", checksum(bytes(page)))
    return bytes(page)


def pages(serial: int, packets: list[bytes], granules: list[int]) -> list[bytes]:
    """The pages of one stream: the first packet, its header, alone on the first page. granules: the position after
    each packet."""
    out, last = [], len(packets) - 1
    for first_packet, group in ((0, packets[:1]), (1, packets[1:])):
        laced = [(s, n) for n, p in enumerate(group, first_packet) for s in [255] * (len(p) // 255) + [len(p) % 255]]
        data, at = b"".join(group), 0
        for first in range(0, len(laced), 255):
            part = laced[first : first + 255]
            ended = [n for s, n in part if s < 255]
            size = sum(s for s, _ in part)
            ends = first + 255 >= len(laced) and bool(ended) and ended[-1] == last
            kind = (first > 0 and laced[first - 1][0] == 255) | 2 * (not out) | 4 * ends
            out.append(_page(serial, len(out), granules[ended[-1]] if ended else -1, kind, bytes(s for s, _ in part), data[at : at + size]))
            at += size
    return out


def write(payload: bytes, info: bytes, frame: int = FRAME) -> bytes:
    """A file of two streams, first pages first: the payload's frames, and a packet of information ahead of them."""
    frames = [payload[i : i + frame] for i in range(0, len(payload), frame)]
    ends = np.cumsum([len(x) for x in frames]).tolist()
    sound = pages(SERIAL, [SOUND_HEADER, *frames], [0, *ends])
    other = pages(INFO_SERIAL, [INFO_HEADER, info], [0, 0])
    return b"".join([sound[0], other[0], *other[1:], *sound[1:]])


@dataclass
class Stream:
    #: The identification header, then all other packets.
    header: bytes = b""
    packets: list[bytes] = field(default_factory=list)
    #: (packets finished so far, granule position) of each page that finishes one.
    marks: list[tuple[int, int]] = field(default_factory=list)
    next_page: int = 0
    ended: bool = False


def read(data: bytes) -> dict[int, Stream]:
    """The logical streams by serial number; every page's checksum, number and place are verified."""
    streams: dict[int, Stream] = {}
    open_parts: dict[int, list[bytes]] = {}
    at = 0
    while at < len(data):
        if len(data) < at + 27:
            raise ValueError(f"page at {at} is cut short")
        magic, version, kind, granule, serial, number, crc, n = _HEADER.unpack_from(data, at)
        body = at + 27 + n
        lacing = data[at + 27 : body]
        end = body + sum(lacing)
        if magic != b"OggS" or version or len(lacing) < n or end > len(data):
            raise ValueError(f"no whole page at {at}")
        if checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise ValueError(f"page at {at} has a wrong checksum")
        if kind & 2 and (serial in streams or any(s.next_page > 1 for s in streams.values())):
            raise ValueError(f"page at {at} is out of order: first pages come before all others")
        stream, parts = streams.setdefault(serial, Stream()), open_parts.setdefault(serial, [])
        if number != stream.next_page or bool(kind & 2) != (number == 0) or bool(kind & 1) != bool(parts) or stream.ended:
            raise ValueError(f"page at {at} is out of order in stream {serial}")
        packets, run = [], 0
        for s in lacing:
            run += s
            if s < 255:
                packets.append(b"".join([*parts, data[body : body + run]]))
                body, run = body + run, 0
                parts.clear()
        if run or (lacing and lacing[-1] == 255):
            parts.append(data[body : body + run])
        if number == 0:
            if len(packets) != 1 or parts:
                raise ValueError(f"page at {at} holds more or less than a header")
            stream.header = packets[0]
        elif packets:
            stream.packets += packets
            stream.marks.append((len(stream.packets), granule))
        stream.next_page, stream.ended, at = number + 1, bool(kind & 4), end
    if any(open_parts.values()) or not all(s.ended for s in streams.values()):
        raise ValueError("a stream doesn't end")
    return streams


def packet_times(stream: Stream, rate: int = RATE) -> list[float]:
    """Seconds at which each packet ends: known where a page ends, shared out by size between."""
    ends, done, base = np.cumsum([len(p) for p in stream.packets]).tolist(), 0, 0
    out: list[float] = []
    for count, granule in stream.marks:
        last = ends[count - 1]
        out += [(granule - (last - e)) / rate for e in ends[done:count]]
        done, base = count, granule
    return out


def features(samples: bytes, seconds: float, frames: int) -> str:
    """Frames, duration, mean, spread and zero crossings around the middle of 8-bit samples, in fixed digits."""
    x = np.frombuffer(samples, np.uint8)
    crossings = int(np.count_nonzero(np.diff(x >= 128)))
    return f"frames={frames};seconds={seconds:.4f};mean={x.mean():.4f};std={x.std():.4f};crossings={crossings}"


def padded(data: bytes, frame: int = FRAME) -> bytes:
    return data + b"\xff" * (-len(data) % frame if data else frame)


def media_columns(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each whole text as an Ogg file."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, media = [], []
            for x in b["data"]:
                data = x.as_py()
                n.append(len(data))
                media.append(write(padded(data), struct.pack("<QI", len(data), RATE)))
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", plain_text().cast("binary").alias("data")).mapInArrow(mapped, f"doc_id {kind}, n_bytes long, media binary")


def media_digests(stored_media: DataFrame) -> DataFrame:
    """The contract's columns from stored files: payload and features are read back from `media`."""
    kind = stored_media.schema["doc_id"].dataType.simpleString()

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for x in b["media"]:
                media = x.as_py()
                streams = read(media)
                sound = streams[SERIAL]
                payload = b"".join(sound.packets)
                n_bytes = struct.unpack("<QI", streams[INFO_SERIAL].packets[0])[0]
                seconds = packet_times(sound)[-1]
                rows.append((n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), features(payload, seconds, len(sound.packets))))
            columns = list(zip(*rows)) if rows else [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], *[pa.array(c, k) for c, k in zip(columns, kinds)]], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return stored_media.mapInArrow(mapped, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_features(docs: DataFrame) -> DataFrame:
    """The contract's columns, one row per document."""
    return media_digests(media_columns(docs))
