import hashlib
import os
import struct
import zlib

import pytest

from drillframe.llm import ogg
from drillframe.llm.common import table
from drillframe.llm.queries import op5_ogg

from .cases import no_docs, odd_docs


def slow_checksum(page):
    c = 0
    for b in page:
        c ^= b << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c >> 31 else c << 1) & 0xFFFFFFFF
    return c


def want(d, t):
    data = (t or "").encode()
    payload = data + b"\xff" * ((-len(data)) % 576 if data else 576)
    return d, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])


def test_query(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text").collect()
    assert sorted(tuple(r)[:5] for r in op5_ogg(spark, sf).collect()) == sorted(want(*d) for d in docs)


def test_odd_rows(spark):
    docs = odd_docs(spark)
    got = ogg.media_features(docs).collect()
    assert sorted(str(tuple(r)[:5]) for r in got) == sorted(str(want(r.doc_id, r.text)) for r in docs.collect())
    assert ogg.media_features(no_docs(spark)).count() == 0
    stored = ogg.media_columns(docs).collect()
    assert all(len(r.media) == m.media_bytes and hashlib.sha256(r.media).hexdigest() == m.media_sha256 for r, m in zip(stored, got))


@pytest.mark.parametrize("n", [1, 575, 576, 577, 48_960, 49_536, 300_000])
def test_round_trip(n):
    payload = ogg.padded(os.urandom(n))
    streams = ogg.read(ogg.write(payload, b"x" * 12))
    assert b"".join(streams[ogg.SERIAL].packets) == payload and streams[ogg.INFO_SERIAL].packets == [b"x" * 12]
    times = ogg.packet_times(streams[ogg.SERIAL])
    assert times == [576 * (i + 1) / ogg.RATE for i in range(len(payload) // 576)]


def test_first_pages_hold_headers_alone_and_come_first():
    made = ogg.write(ogg.padded(b"x" * 200_000), b"info")
    streams = ogg.read(made)
    assert (streams[ogg.SERIAL].header, streams[ogg.INFO_SERIAL].header) == (ogg.SOUND_HEADER, ogg.INFO_HEADER)
    at, kinds = 0, []
    while at < len(made):
        kind, n = made[at + 5], made[at + 26]
        kinds.append(kind & 2)
        at += 27 + n + sum(made[at + 27 : at + 27 + n])
    assert kinds[:2] == [2, 2] and not any(kinds[2:])
    one, two = ogg.pages(1, [b"h", b"data"], [0, 4]), ogg.pages(2, [b"h", b"data"], [0, 4])
    assert len(ogg.read(b"".join([one[0], two[0], two[1], one[1]]))) == 2
    with pytest.raises(ValueError, match="first pages"):
        ogg.read(b"".join([one[0], one[1], two[0], two[1]]))
    assert ogg.read(b"".join(ogg.pages(3, [b"only"], [0])))[3].packets == []


def test_packets_over_pages_and_damage():
    assert ogg.checksum(b"OggS hello") == slow_checksum(b"OggS hello")
    packets = [b"head", *[os.urandom(n) for n in (0, 255, 510, 70_000, 3, 140_000, 65_025, 255)]]
    made = ogg.pages(9, packets, list(range(9)))
    assert struct.unpack_from("<q", made[2], 6)[0] == -1 or len(made) > 4
    stream = ogg.read(b"".join(made))[9]
    assert [stream.header, *stream.packets] == packets
    broken = bytearray(b"".join(made))
    broken[400] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        ogg.read(bytes(broken))
    with pytest.raises(ValueError, match="order"):
        ogg.read(b"".join([made[0], made[2]]))
    with pytest.raises(ValueError, match="whole page|cut short"):
        ogg.read(b"".join(made)[:-5])
