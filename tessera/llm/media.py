"""MPEG audio columns: build, resynchronise, parse, verify and index streams of MPEG-1, 2 and 2.5, Layers I to III.

``index`` walks a stream: it skips an ID3v2 tag (2.2 to 2.4) and cuts an ID3v1 tag off, resynchronises on frame headers (a header counts when another header of
the same version, layer and rate, or the end of the stream, follows where its frame ends), reads a Xing, Info or VBRI table of
variable bitrates, verifies each protected frame's CRC-16 (over the header's last two bytes and, in Layer III, the side information, in
Layer I the bit allocation; that of Layer II is counted as unchecked), and
keeps the sample count, the exact duration as a fraction of seconds, and the byte offset of every audio frame. Frames of free format are skipped like noise;
cut and damaged tables and tags are read as far as they go.

``mux`` writes any payload losslessly: MPEG-1 Layer III frames of 32 kHz, mono, whose side information declares no coded spectrum (they decode
to silence), so the rest of each frame is ancillary data and holds the payload. Full frames carry 1344 bytes at 320
kbit/s; the last one takes the least bitrate that fits, hence the variable-bitrate table in the first frame. The unit is
a block of 192 bytes, the length of the payload is kept in the ID3v2 tag.

Both work on whole batches in Python, one row at a time, in time proportional to the bytes, so memory is bounded by the largest text. Null and empty texts
give one block of spaces; repeated rows give equal streams; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import struct
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

BLOCK = 192
RATE, SAMPLES = 32_000, 1152
#: kbit/s by the header's bitrate index, from 1, of (MPEG-1 or not, layer); fixed by the format.
BITRATE_TABLES = {
    (True, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
BITRATES = BITRATE_TABLES[True, 3]
#: Sample rates of MPEG-1 by the header's index (halved for MPEG-2, quartered for 2.5), and what the version bits divide them by; fixed by the format.
RATES = (44_100, 48_000, 32_000)
DIVISORS = {3: 1, 2: 2, 0: 4}
HEAD, SIDE = 6, 17
SEEK = 100


def frame_length(kbps: int, rate: int, padded: int) -> int:
    return 144 * kbps * 1000 // rate + padded


def _crc_table() -> list[int]:
    out = []
    for n in range(256):
        c = n << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def crc16(data: bytes) -> int:
    """The CRC-16 of MPEG audio: polynomial 0x8005, start 0xFFFF."""
    c = 0xFFFF
    for b in data:
        c = (c << 8 & 0xFFFF) ^ _CRC[c >> 8 ^ b]
    return c


def _start(index: int) -> bytes:
    """Header, checksum and side information of a silent, protected mono frame."""
    head = bytes((0xFF, 0xFA, index << 4 | 2 << 2, 0xC0))
    side = bytes(SIDE)
    return head + struct.pack(">H", crc16(head[2:] + side)) + side


_STARTS = {i + 1: _start(i + 1) for i in range(len(BITRATES))}
_ROOM = {i + 1: frame_length(k, RATE, 0) - HEAD - SIDE for i, k in enumerate(BITRATES)}
_FULL = _ROOM[len(BITRATES)] // BLOCK * BLOCK


def _syncsafe(n: int) -> bytes:
    return bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127))


def _tag(n_bytes: int) -> bytes:
    body = b"\x03payload_bytes\x00" + str(n_bytes).encode()
    frame = b"TXXX" + _syncsafe(len(body)) + b"\x00\x00" + body
    return b"ID3\x04\x00\x00" + _syncsafe(len(frame)) + frame


def mux(payload: bytes, n_bytes: int) -> bytes:
    """An MPEG stream that holds the payload, a positive multiple of 192 bytes."""
    frames = []
    for at in range(0, len(payload), _FULL):
        part = payload[at : at + _FULL]
        i = next(k for k, room in _ROOM.items() if room >= len(part))
        frames.append(_STARTS[i] + part + bytes(_ROOM[i] - len(part)))
    first = _STARTS[3]
    total = len(first) + _ROOM[3] + sum(map(len, frames))
    ends, at = [], len(first) + _ROOM[3]
    for f in frames:
        ends.append(at)
        at += len(f)
    toc = bytes(min(255, ends[k * len(frames) // SEEK] * 256 // total) for k in range(SEEK))
    table = b"Xing" + struct.pack(">III", 7, len(frames), total) + toc
    return b"".join((_tag(n_bytes), first, table, bytes(_ROOM[3] - len(table)), *frames))


class Header(NamedTuple):
    """What a frame's header says; side: bytes that the checksum covers after it (-1: not known)."""

    length: int
    kbps: int
    rate: int
    samples: int
    layer: int
    protected: bool
    side: int


_HEADERS: dict[bytes, Header | None] = {}


def _header(data: bytes, at: int) -> Header | None:
    """The header at a place, or None."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] < 0xE0:
        return None
    key = data[at + 1 : at + 4]
    if key not in _HEADERS:
        if len(_HEADERS) > 4096:
            _HEADERS.clear()
        _HEADERS[key] = _read_header(*key)
    return _HEADERS[key]


def _read_header(b1: int, b2: int, b3: int) -> Header | None:
    divisor, layer = DIVISORS.get(b1 >> 3 & 3), 4 - (b1 >> 1 & 3)
    if divisor is None or layer == 4 or not 0 < b2 >> 4 < 15 or b2 >> 2 & 3 == 3:
        return None
    kbps, rate, padded = BITRATE_TABLES[divisor == 1, layer][(b2 >> 4) - 1], RATES[b2 >> 2 & 3] // divisor, b2 >> 1 & 1
    samples = (384, 1152, 1152 if divisor == 1 else 576)[layer - 1]
    length = (12 * kbps * 1000 // rate + padded) * 4 if layer == 1 else samples // 8 * kbps * 1000 // rate + padded
    mono, joint = b3 >> 6 == 3, b3 >> 6 == 1
    if layer == 3:
        side = (17 if mono else 32) if divisor == 1 else (9 if mono else 17)
    elif layer == 1:
        bound = (b3 >> 4 & 3) * 4 + 4 if joint else 32
        side = 16 if mono else (32 + bound) // 2
    else:
        side = -1
    return Header(length, kbps, rate, samples, layer, not b1 & 1, side)


def _number(data: bytes, at: int, size: int, bits: int = 8) -> int:
    n = 0
    for b in data[at : at + size]:
        n = n << bits | b & (1 << bits) - 1
    return n


def _id3v2(data: bytes) -> tuple[int, dict]:
    """Where the audio begins, and the text frames of the tag in front of it."""
    tags: dict[str, str] = {}
    if data[:3] != b"ID3" or len(data) < 10:
        return 0, tags
    version, p, end = data[3], 10, min(len(data), 10 + _number(data, 6, 4, 7))
    name_size, head = (3, 6) if version == 2 else (4, 10)
    if data[5] & 64 and version > 2:  # an extended header
        p += _number(data, 10, 4, 7) if version == 4 else 4 + _number(data, 10, 4)
    while p + head <= end and data[p : p + name_size].strip(b"\0"):
        n = _number(data, p + name_size, name_size, 7 if version == 4 else 8)
        name, body = data[p : p + name_size], data[p + head : min(end, p + head + n)]
        wide = body[:1] in (b"\1", b"\2")
        text = body[1:].decode(("latin-1", "utf-16", "utf-16-be", "utf-8")[body[0]] if body and body[0] < 4 else "latin-1", "replace").rstrip("\0")
        if name in (b"TXXX", b"TXX") and (wide or b"\0" in body):
            key, _, value = text.partition("\0")
            tags[key] = value.lstrip("\ufeff")
        else:
            tags[name.decode("latin-1")] = text
        p += head + n
    return end, tags


def _id3v1(data: bytes) -> dict:
    tag = data[-128:]
    cut = {"title": (3, 33), "artist": (33, 63), "album": (63, 93), "year": (93, 97), "comment": (97, 127)}
    return {k: tag[a:b].split(b"\0")[0].decode("latin-1").rstrip() for k, (a, b) in cut.items()} | {"genre": str(tag[127])}


def _table(data: bytes, at: int, h: Header, rest: int, end: int) -> dict | None:
    """The Xing, Info or VBRI table that the frame at ``at`` holds."""
    if data[rest : rest + 4] in (b"Xing", b"Info") and rest + 8 <= end:
        flags, p, table = _number(data, rest + 4, 4), rest + 8, {}
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit and p + 4 <= end:
                table[name] = _number(data, p, 4)
                p += 4
        if flags & 4:
            table["toc"] = data[p : min(end, p + SEEK)]
        return table
    p = at + 36
    if h.layer == 3 and data[p : p + 4] == b"VBRI" and p + 26 <= end:
        entries, scale, size, per = (_number(data, p + k, 2) for k in (18, 20, 22, 24))
        entries = min(entries, (end - p - 26) // size) if size else 0
        steps = [scale * _number(data, p + 26 + k * size, size) for k in range(entries)]
        return {"bytes": _number(data, p + 10, 4), "frames": _number(data, p + 14, 4), "steps": steps, "frames_per_step": per}
    return None


def index(data: bytes) -> dict:
    """Frames, offsets, samples, rate, checksum results, skipped bytes, tags, table and ancillary data of a stream."""
    at, tags = _id3v2(data)
    table, stop = None, len(data)
    if stop - at >= 128 and data[-128:-125] == b"TAG":
        tags = _id3v1(data) | tags
        stop -= 128
        data = data[:stop]
    offsets, kinds, ok, bad, unchecked, skipped, rate, samples, body = [], [], 0, 0, 0, 0, 0, 0, []
    sums: dict[bytes, bytes] = {}
    while at < stop:
        h = _header(data, at)
        end = at + h.length if h else 0
        if not h or end > stop or end < stop and ((n := _header(data, end)) is None or (n.rate, n.layer) != (h.rate, h.layer)):
            found = data.find(b"\xff", at + 1)
            nxt = stop if found < 0 else found
            skipped += nxt - at
            at = nxt
            continue
        side = at + 4 + 2 * h.protected
        rest = side + max(0, h.side)
        if h.protected and h.side < 0:
            unchecked += 1
        elif h.protected:
            key = data[at + 2 : at + 4] + data[side:rest]
            if key not in sums:
                if len(sums) > 4096:
                    sums.clear()
                sums[key] = struct.pack(">H", crc16(key))
            match = sums[key] == data[at + 4 : at + 6]
            ok, bad = ok + match, bad + (not match)
        read = _table(data, at, h, rest, end) if table is None and not offsets else None
        if read is not None:
            table = read
        else:
            offsets.append(at)
            kinds.append(h.kbps)
            rate = rate or h.rate
            samples += h.samples
            body.append(data[rest:end])
        at = end
    found = {"offsets": offsets, "kbps": kinds, "rate": rate, "samples": samples, "crc_ok": ok, "crc_bad": bad, "crc_unchecked": unchecked, "skipped": skipped}
    return found | {"tags": tags, "table": table, "body": body}


def demux(found: dict) -> bytes:
    """The payload that mux() stored, from what index() read."""
    size = -(-max(1, int(found["tags"]["payload_bytes"])) // BLOCK) * BLOCK
    full, part = divmod(size, _FULL)
    return b"".join([b[:_FULL] for b in found["body"][:full]] + [b[:part] for b in found["body"][full : full + 1]])


MEDIA = "doc_id long, n_bytes long, media binary"
INDEX = (
    "doc_id long, n_bytes long, media binary, payload binary, frames long, samples long, sample_rate int, duration_ms_floor long, seek array<long>, "
    "crc_ok long, crc_bad long, skipped long, vbr boolean, table_ok boolean"
)


def encoded(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: the stream of every whole text."""

    def run(batches):
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            sizes, media = [], []
            for x in texts:
                raw = x.as_buffer().to_pybytes() if x.is_valid else b""
                sizes.append(len(raw))
                media.append(mux(raw + b" " * (-len(raw) % BLOCK if raw else BLOCK), len(raw)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    common.byte_batches(docs.sparkSession)
    return common.pick(docs).select("doc_id", F.col("text").cast("binary")).mapInArrow(run, MEDIA)


def indexed(media: DataFrame) -> DataFrame:
    """What index() reads from each stored stream, and the payload."""
    import re

    names = re.findall(r"(\w+) [\w<>]+(?:,|$)", INDEX)

    def run(batches):
        for b in batches:
            out = {n: [] for n in names[3:]}
            for x in b.column(2):
                f = index(x.as_py())
                out["payload"].append(demux(f))
                out["frames"].append(len(f["offsets"]))
                out["samples"].append(f["samples"])
                out["sample_rate"].append(f["rate"])
                out["duration_ms_floor"].append(f["samples"] * 1000 // max(1, f["rate"]))
                out["seek"].append(f["offsets"])
                out["crc_ok"].append(f["crc_ok"])
                out["crc_bad"].append(f["crc_bad"])
                out["skipped"].append(f["skipped"])
                out["vbr"].append(len(set(f["kbps"])) > 1)
                out["table_ok"].append((f["table"] or {}).get("frames") == len(f["offsets"]))
            kinds = {"payload": pa.binary(), "sample_rate": pa.int32(), "seek": pa.list_(pa.int64()), "vbr": pa.bool_(), "table_ok": pa.bool_()}
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *(pa.array(out[n], kinds.get(n, pa.int64())) for n in names[3:])], names)

    return media.mapInArrow(run, INDEX)


def op2_mpeg_audio(spark, sf_dir: str) -> DataFrame:
    got = indexed(common.stored(encoded(common.table(spark, sf_dir, "documents")), "media"))
    feature = F.concat_ws(
        ":", "frames", "samples", "sample_rate", "duration_ms_floor", "crc_ok", "crc_bad", "skipped", "vbr", "table_ok", F.hex(F.crc32(F.array_join("seek", ",").cast("binary")))
    )
    return got.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
        "frames",
        "samples",
        "sample_rate",
        "seek",
    )
