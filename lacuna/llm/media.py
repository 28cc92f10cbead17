"""Media columns: MPEG audio.

`encode` stores bytes losslessly in an MPEG-1 layer III stream: 192 bytes in the ancillary part of each frame of 240 bytes
(48 kHz, 80 kbit/s, one channel, checksums on), after an ID3v2 tag and a frame with a variable-bitrate (Xing) table, before an ID3v1
tag. `parse` reads any such stream: it skips tags, finds frame headers (resynchronising over whatever isn't one: a header counts
when another, or the end, follows at its frame's length), reads the table (Xing, Info or VBRI), verifies each checksum, and gives the exact
duration (samples and rate) and the byte offset of every frame.

Defined results: null text is stored as blanks like empty text; equal texts give equal media; null media parses to no frames;
damaged bytes are skipped and counted; column names of the input don't clash because only the id and the text are read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import map_arrow

UNIT, FRAME, HEAD, SIDE = 192, 240, 4, 17
#: Fixed values of the format: bit rates (kbit/s) by (MPEG-1?, layer), sampling rates, samples in a frame.
BIT_RATES = {
    (True, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
SAMPLE_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
SAMPLES = {(True, 1): 384, (True, 2): 1152, (True, 3): 1152, (False, 1): 384, (False, 2): 1152, (False, 3): 576}

_CRC = []
for _byte in range(256):
    _x = _byte << 8
    for _ in range(8):
        _x = (_x << 1) ^ (0x8005 if _x & 0x8000 else 0)
    _CRC.append(_x & 0xFFFF)


def crc16(data: bytes) -> int:
    """The checksum of MPEG audio: over the header's last two bytes and the side information."""
    x = 0xFFFF
    for b in data:
        x = (x << 8) & 0xFFFF ^ _CRC[(x >> 8) ^ b]
    return x


def header(raw: bytes, at: int = 0) -> tuple | None:
    """(length, samples, rate, kbit/s, has checksum, mono, MPEG-1?, layer) of the frame header at a place, or None."""
    if at + 4 > len(raw) or raw[at] != 0xFF or raw[at + 1] & 0xE0 != 0xE0:
        return None
    version, layer = (raw[at + 1] >> 3) & 3, 4 - ((raw[at + 1] >> 1) & 3)
    rate_no, hz_no = raw[at + 2] >> 4, (raw[at + 2] >> 2) & 3
    if version == 1 or layer == 4 or rate_no in (0, 15) or hz_no == 3:
        return None
    one = version == 3
    hz, kbit, pad = SAMPLE_RATES[version][hz_no], BIT_RATES[one, layer][rate_no - 1], (raw[at + 2] >> 1) & 1
    samples = SAMPLES[one, layer]
    length = (12 * kbit * 1000 // hz + pad) * 4 if layer == 1 else samples // 8 * kbit * 1000 // hz + pad
    return length, samples, hz, kbit, not raw[at + 1] & 1, raw[at + 3] >> 6 == 3, one, layer


def side_length(one: bool, mono: bool) -> int:
    return (17 if mono else 32) if one else (9 if mono else 17)


_HEADER = bytes((0xFF, 0xFA, 0x64, 0xC0))  # MPEG-1 layer III with checksum, 80 kbit/s, 48 kHz, one channel
_PREFIX = _HEADER + struct.pack(">H", crc16(_HEADER[2:] + bytes(SIDE))) + bytes(SIDE)
_SUFFIX = bytes(FRAME - len(_PREFIX) - UNIT)


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The text as UTF-8 with blanks up to a positive multiple of UNIT, and its own length."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * (-len(raw) % UNIT or UNIT * (not raw)), len(raw)


def encode(payload: bytes) -> bytes:
    """payload, a multiple of UNIT bytes, as a stream with tags and a table."""
    n = len(payload) // UNIT
    frames = np.empty((n, FRAME), np.uint8)
    frames[:, : len(_PREFIX)] = np.frombuffer(_PREFIX, np.uint8)
    frames[:, len(_PREFIX) : len(_PREFIX) + UNIT] = np.frombuffer(payload, np.uint8).reshape(n, UNIT)
    frames[:, len(_PREFIX) + UNIT :] = 0
    total = (n + 1) * FRAME
    seek = bytes(min(255, i * (n + 1) // 100 * FRAME * 256 // total) for i in range(100))
    table = _PREFIX + b"Xing" + struct.pack(">III", 7, n, total) + seek
    body = b"TSSE" + struct.pack(">I", 7) + b"\0\0\0lacuna"
    size = len(body)
    tag = b"ID3\4\0\0" + bytes((size >> s) & 127 for s in (21, 14, 7, 0)) + body
    last = b"TAG" + b"payload".ljust(30, b"\0") + bytes(94) + b"\xff"
    return tag + table.ljust(FRAME, b"\0") + frames.tobytes() + last


def parse(raw: bytes | None) -> dict:
    """Frames, duration, checksums, tags and the table of a stream."""
    raw = raw or b""
    out = {"tags": [], "table": None, "skipped": 0, "bad_crc": 0, "checked": 0, "samples": 0, "rate": 0}
    at, end, offsets, lengths = 0, len(raw), [], []
    while raw[at : at + 3] == b"ID3" and end - at >= 10:
        size = sum((raw[at + 6 + i] & 127) << s for i, s in enumerate((21, 14, 7, 0)))
        out["tags"].append(f"ID3v2.{raw[at + 3]}:{size}")
        at += 10 + size + 10 * bool(raw[at + 5] & 16)
    if end - at >= 128 and raw[end - 128 : end - 125] == b"TAG":
        out["tags"].append("ID3v1")
        end -= 128
    good: set[bytes] = set()  # header, checksum and side information whose checksum was right
    synced, kind = False, None
    while at + 4 <= end:
        h = header(raw, at)
        nxt = at + h[0] if h else 0
        # in step, a header of the stream's own kind is enough; otherwise another must follow at its length (or the end)
        alike = synced and h and (h[2], h[4:]) == kind
        if not h or nxt > end or not alike and nxt + 4 <= end and not header(raw, nxt):
            nearest = raw.find(b"\xff", at + 1, end)
            nearest = end if nearest < 0 else nearest
            out["skipped"] += nearest - at
            at, synced = nearest, False
            continue
        synced, kind = True, (h[2], h[4:])
        side = side_length(h[6], h[5])
        start = at + 4 + 2 * h[4]
        if h[4] and h[7] == 3:
            out["checked"] += 1
            guarded = raw[at + 2 : at + 6 + side]
            if guarded not in good:
                if crc16(guarded[:2] + guarded[4:]) == int.from_bytes(guarded[2:4], "big"):
                    good.add(guarded)
                else:
                    out["bad_crc"] += 1
        mark = raw[start + side : start + side + 4]
        if not offsets and out["table"] is None and raw[at + 36 : at + 40] == b"VBRI":
            # the other kind of table: always 32 bytes after the header, with the bytes of each run of frames
            size, frames, entries, scale, width, run = struct.unpack(">IIHHHH", raw[at + 46 : at + 62])
            steps = [int.from_bytes(raw[p : p + width], "big") * scale for p in range(at + 62, at + 62 + entries * width, max(1, width))] if width in (1, 2, 3, 4) else []
            out["table"] = {"frames": frames, "bytes": size, "run": run, "steps": steps}
            at = nxt
            continue
        if not offsets and out["table"] is None and mark in (b"Xing", b"Info"):
            flags, p = int.from_bytes(raw[start + side + 4 : start + side + 8], "big"), start + side + 8
            table = {}
            for bit, name, size in ((1, "frames", 4), (2, "bytes", 4), (4, "seek", 100)):
                if flags & bit:
                    table[name] = raw[p : p + 100] if size == 100 else int.from_bytes(raw[p : p + 4], "big")
                    p += size
            out["table"] = table
        else:
            offsets.append(at)
            lengths.append(h[0])
            out["samples"] += h[1]
            out["rate"] = out["rate"] or h[2]
        at = nxt
    out["skipped"] += max(0, end - at)
    return out | {"offsets": offsets, "lengths": lengths}


def stored_payload(raw: bytes, found: dict) -> bytes:
    """The bytes that encode() put into the frames that parse() found."""
    p = len(_PREFIX)
    return b"".join(raw[o + p : o + p + UNIT] for o in found["offsets"])


def with_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes and media (the stream) of each row."""

    def rows(x):
        made = [payload_of(t) for t in x["t"].to_pylist()]
        return {"doc_id": x["k"], "n_bytes": [n for _, n in made], "media": [encode(p) for p, _ in made]}

    return map_arrow(docs.selectExpr(f"`{key}` as k", f"`{text}` as t"), rows, "doc_id long, n_bytes long, media binary")


def described(media: DataFrame) -> DataFrame:
    """What parse() finds in the media column: payload, duration, seek offsets, feature."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, samples long, sample_rate int, duration_s double, bad_checksums long, skipped_bytes long, tags string, seek_offsets array<long>"

    names = [c.split()[0] for c in schema.split(", ")][2:]

    def rows(x):
        out = []
        for raw in x["media"].to_pylist():
            raw = raw or b""
            found = parse(raw)
            payload = stored_payload(raw, found)
            units = np.frombuffer(payload, np.uint8)
            mean = f"{units.mean():.4f}" if len(units) else "nan"
            n, rate = len(found["offsets"]), found["rate"]
            feature = f"mpeg1-l3;rate={rate};frames={n};samples={found['samples']};table={(found['table'] or {}).get('frames', -1)};checked={found['checked']};bad={found['bad_crc']};skipped={found['skipped']};mean={mean};levels={len(np.unique(units))}"
            out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(raw), hashlib.sha256(raw).hexdigest(), feature, n, found["samples"], rate, found["samples"] / (rate or 1), found["bad_crc"], found["skipped"], ",".join(found["tags"]), found["offsets"]))
        columns = zip(*out, strict=True) if out else [()] * len(names)
        return {"doc_id": x["doc_id"], "n_bytes": x["n_bytes"]} | {k: list(v) for k, v in zip(names, columns, strict=True)}

    return map_arrow(media.select("doc_id", "n_bytes", "media"), rows, schema)


def op3_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = described(with_media(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_frames", "samples", "sample_rate", "duration_s", "bad_checksums", "skipped_bytes", "tags", "seek_offsets")
