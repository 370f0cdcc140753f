"""MPEG audio: versions and layers, tags, tables, damage, and hostile bytes in time."""

import random
import struct
import time

import pytest

from tessera.llm import media


def frame(version, layer, kbps_index, rate_index, protected=False, mono=True, fill=b""):
    """A frame by hand: header, checksum if any, and fill."""
    head = bytes((0xFF, 0xE0 | version << 3 | (4 - layer) << 1 | (not protected), kbps_index << 4 | rate_index << 2, 0xC0 if mono else 0))
    h = media._header(head, 0)
    body = fill.ljust(h.length - 4 - 2 * protected, b"\0")
    check = struct.pack(">H", media.crc16(head[2:] + body[: max(0, h.side)])) if protected else b""
    return head + check + body


#: version bits, layer, bitrate index, rate index: length, samples, rate, from the format's definition.
SHAPES = [
    ((3, 3, 9, 0), (417, 1152, 44_100)),  # 144 * 128000 / 44100
    ((3, 2, 8, 1), (384, 1152, 48_000)),  # 144 * 128000 / 48000
    ((3, 1, 4, 2), (192, 384, 32_000)),  # 12 * 128000 / 32000 * 4
    ((2, 3, 8, 0), (208, 576, 22_050)),  # 72 * 64000 / 22050
    ((2, 1, 8, 1), (256, 384, 24_000)),  # 12 * 128000 / 24000 * 4
    ((2, 2, 8, 2), (576, 1152, 16_000)),  # 144 * 64000 / 16000
    ((0, 3, 4, 0), (208, 576, 11_025)),  # 72 * 32000 / 11025
]


@pytest.mark.parametrize("shape,expected", SHAPES)
@pytest.mark.parametrize("mono", [True, False])
def test_versions_and_layers(shape, expected, mono):
    one = frame(*shape, protected=True, mono=mono, fill=bytes(range(1, 60)))
    found = media.index(one * 5)
    assert len(one) == expected[0] and found["offsets"] == [k * len(one) for k in range(5)]
    assert (found["samples"], found["rate"], found["skipped"]) == (5 * expected[1], expected[2], 0)
    checked = (found["crc_ok"], found["crc_bad"], found["crc_unchecked"])
    assert checked == ((0, 0, 5) if shape[1] == 2 else (5, 0, 0))
    if shape[1] != 2:
        broken = bytearray(one * 5)
        broken[2 * len(one) + 7] ^= 1
        assert media.index(bytes(broken))["crc_bad"] == 1


def test_tags_and_vbri():
    v1 = b"TAG" + b"Title".ljust(30, b"\0") + b"Who".ljust(30) + bytes(30) + b"2001" + bytes(30) + b"\x07"
    frames = frame(3, 3, 9, 0) * 3
    found = media.index(frames + v1)
    assert found["skipped"] == 0 and found["tags"] == {"title": "Title", "artist": "Who", "album": "", "year": "2001", "comment": "", "genre": "7"}
    table = bytes(32) + b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 75, 5000, 3, 2, 10, 2, 2) + struct.pack(">HH", 40, 41)
    found = media.index(frame(3, 3, 9, 0, fill=table) + frames)
    assert found["table"] == {"bytes": 5000, "frames": 3, "steps": [400, 410], "frames_per_step": 2} and len(found["offsets"]) == 3
    body = b"\x01" + "ü".encode("utf-16")
    for version, size in ((3, struct.pack(">I", len(body))), (4, media._syncsafe(len(body)))):
        part = b"TIT2" + size + b"\0\0" + body
        found = media.index(b"ID3" + bytes((version, 0, 0)) + media._syncsafe(len(part)) + part + frames)
        assert found["tags"] == {"TIT2": "ü"} and len(found["offsets"]) == 3


def test_resynchronisation_and_round_trip(spark):
    for size in (192, 1344, 1536, 192 * 23):
        payload = bytes(i % 251 for i in range(size))
        stream = media.mux(payload, size - 3)
        found = media.index(stream)
        assert media.demux(found) == payload and found["crc_bad"] == 0 and found["table"]["frames"] == len(found["offsets"])
    noisy = stream[: found["offsets"][1]] + b"\xff\xfb\x90noise\xff\xff" + stream[found["offsets"][1] :]
    again = media.index(noisy)
    assert again["skipped"] >= 10 and len(again["offsets"]) == len(found["offsets"]) - 1
    texts = [(1, None), (2, ""), (3, "aé" * 700), (3, "aé" * 700), (None, "x"), (5, "long " * 200_000)]
    df = spark.createDataFrame([(*t, "m") for t in texts], "doc_id long, text string, media string")
    got = media.indexed(media.encoded(df)).collect()
    assert sorted((str(x.doc_id), bytes(x.payload).rstrip(b" ")) for x in got) == sorted((str(d), (t or "").encode().rstrip()) for d, t in texts)
    assert all(len(x.payload) % 192 == 0 and x.payload and x.table_ok and x.crc_bad == 0 for x in got)
    # the features by hand, for one text
    x = next(r for r in got if r.doc_id == 3)
    blocks = -(-2100 // 192) * 192
    full, rest = divmod(blocks, 1344)
    assert (x.n_bytes, len(x.payload), x.frames, x.samples, x.duration_ms_floor) == (2100, blocks, full + (rest > 0), 1152 * x.frames, x.frames * 36)
    assert media.indexed(media.encoded(df.limit(0))).count() == 0


def test_hostile_bytes():
    r = random.Random(3)
    for data in (b"", b"ID3", b"ID3\x04\0\0\x7f\x7f\x7f\x7f", b"\xff" * 10**6, b"\xff\xfb" * 500_000, b"\xff\xfb\x90\0" * 250_000, r.randbytes(10**6), b"TAG" + bytes(125)):
        began = time.time()
        found = media.index(data)
        assert time.time() - began < 10 and found["skipped"] <= len(data)
    stream = media.mux(bytes(192 * 20), 9)
    for cut in range(0, len(stream), 97):
        media.index(stream[:cut] + stream[cut + 5 :])
