"""MPEG audio columns: frames found, tags and variable-bitrate tables read, checksums verified,
exact durations and seek offsets stored; and a writer that carries bytes in silent frames."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the MPEG audio formats: kbit/s by bitrate index, Hz by sampling index.
BITRATES = {
    (1, 1): [0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (1, 2): [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (1, 3): [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (2, 1): [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (2, 2): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (2, 3): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
RATES = {1: [44100, 48000, 32000], 2: [22050, 24000, 16000], 2.5: [11025, 12000, 8000]}


@lru_cache(maxsize=4096)
def header(four: bytes) -> tuple | None:
    """(version, layer, checksum, kbit/s, Hz, frame bytes, samples, channels, side bytes); None: no header."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = {0: 2.5, 2: 2, 3: 1}.get(four[1] >> 3 & 3), {1: 3, 2: 2, 3: 1}.get(four[1] >> 1 & 3)
    rate, bits = four[2] >> 2 & 3, four[2] >> 4
    if version is None or layer is None or rate == 3 or bits in (0, 15) or four[3] & 3 == 2:
        return None
    kbps, hz, pad = BITRATES[1 if version == 1 else 2, layer][bits], RATES[version][rate], four[2] >> 1 & 1
    samples = 384 if layer == 1 else 1152 if layer == 2 or version == 1 else 576
    size = (12000 * kbps // hz + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbps // hz + pad
    channels = 1 if four[3] >> 6 == 3 else 2
    side = 0 if layer != 3 else {(1, 1): 17, (1, 2): 32, (2, 1): 9, (2, 2): 17}[1 if version == 1 else 2, channels]
    return version, layer, not four[1] & 1, kbps, hz, size, samples, channels, side


@lru_cache(maxsize=4096)
def crc16(data: bytes, bits: int | None = None) -> int:
    """The frames' checksum: polynomial 0x8005, from 0xFFFF, over the first so many bits (all of them)."""
    crc = 0xFFFF
    for k in range(8 * len(data) if bits is None else bits):
        bit = data[k >> 3] >> (7 - (k & 7)) & 1
        crc = (crc << 1 ^ 0x8005) & 0xFFFF if (crc >> 15) ^ bit else crc << 1 & 0xFFFF
    return crc


# Fixed values of layer II: how many subbands in a row have an allocation of so many bits.
_ALLOCATION = {"a": [(11, 4), (12, 3), (4, 2)], "b": [(11, 4), (12, 3), (7, 2)], "c": [(2, 4), (6, 3)], "d": [(2, 4), (10, 3)], "low": [(4, 4), (7, 3), (19, 2)]}


def _layer2_table(version, kbps: int, hz: int, channels: int) -> list[int]:
    """Bits of each subband's allocation."""
    each = kbps // channels
    kind = "low" if version != 1 else ("d" if hz == 32000 else "c") if each <= 48 else "a" if hz == 48000 or each <= 80 else "b"
    return [bits for n, bits in _ALLOCATION[kind] for _ in range(n)]


def _checked_bits(data: bytes, at: int, h: tuple) -> int | None:
    """Bits after the checksum that it covers, beside the header's last 16; None: the frame is too short for them."""
    version, layer, _, kbps, hz, size, _, channels, side = h
    mode, extension = data[at + 3] >> 6, data[at + 3] >> 4 & 3
    if layer == 3:
        return 8 * side if 6 + side <= size else None
    bound = 4 * (extension + 1) if mode == 1 else 32
    if layer == 1:
        n = 4 * (32 if channels == 1 else 2 * bound + 32 - bound)
        return n if 48 + n <= 8 * size else None
    room, used, chosen = 8 * (size - 6), 0, 0
    value = int.from_bytes(data[at + 6 : at + size], "big")
    for band, bits in enumerate(_layer2_table(version, kbps, hz, channels)):
        for _ in range(channels if band < bound else 1):
            used += bits
            if used > room:
                return None
            if value >> (room - used) & (1 << bits) - 1:
                chosen += 1 if band < bound else channels
    return used + 2 * chosen if used + 2 * chosen <= room else None


def _tags(data: bytes) -> tuple[dict[str, str], int, int]:
    """Texts of the tags at both ends, and where the audio between them starts and ends."""
    tags, start, end = {}, 0, len(data)
    size7 = lambda b: b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]
    while data[start : start + 3] == b"ID3" and len(data) - start >= 10 and max(data[start + 6 : start + 10]) < 128:
        major, flags, stop = data[start + 3], data[start + 5], min(end, start + 10 + size7(data[start + 6 : start + 10]))
        held = data[start + 10 : stop]
        if flags & 0x80:  # unsynchronised: a zero byte after each 0xFF
            held = held.replace(b"\xff\0", b"\xff")
        at = 0
        if flags & 0x40 and major >= 3 and len(held) >= 4:
            at = size7(held) if major >= 4 else 4 + int.from_bytes(held[:4], "big")
        while at + 10 <= len(held) and held[at : at + 4].isalnum():
            n = size7(held[at + 4 : at + 8]) if major >= 4 else int.from_bytes(held[at + 4 : at + 8], "big")
            body, name = held[at + 10 : at + 10 + n], held[at : at + 4].decode("latin-1")
            if name[0] == "T" and body:
                text = body[1:].decode(["latin-1", "utf-16", "utf-16-be", "utf-8"][body[0]] if body[0] < 4 else "latin-1", "replace").rstrip("\0")
                key, _, value = text.partition("\0") if name == "TXXX" else (name, "", text)
                tags[key] = value
            at += 10 + n
        start = min(end, stop + 10) if flags & 0x10 and major >= 4 else stop
    if end - start >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        for key, a, b in (("TIT2", 3, 33), ("TPE1", 33, 63), ("TALB", 63, 93)):
            if text := data[end + a : end + b].split(b"\0")[0].decode("latin-1").strip():
                tags.setdefault(key, text)
    return tags, start, end


def _table(data: bytes, at: int, h: tuple) -> dict | None:
    """The variable-bitrate table in a layer III frame, whole in that frame; toc holds where its seek points lead, in bytes from the frame's start."""
    _, _, checked, _, _, size, _, _, side = h
    frame = data[at : at + size]
    i = 4 + 2 * checked + side
    number = lambda k, n: int.from_bytes(frame[k : k + n], "big")
    if frame[i : i + 4] in (b"Xing", b"Info"):
        flags, table = number(i + 4, 4), {"kind": "xing"}
        i += 8
        for bit, key in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                table[key] = number(i, 4)
                i += 4
        points = frame[i : i + 100] if flags & 4 else b""
        table["toc"] = [p * table.get("bytes", 0) // 256 for p in points]
        return table
    if frame[36:40] == b"VBRI" and size >= 62:
        entries, scale, width = number(54, 2), number(56, 2), number(58, 2)
        toc, place = [], 0
        for k in range(entries if 1 <= width <= 4 and 62 + entries * width <= size else 0):
            place += scale * number(62 + k * width, width)
            toc.append(place)
        return {"kind": "vbri", "bytes": number(46, 4), "frames": number(50, 4), "toc": toc}
    return None


_SYNC = re.compile(rb"\xff[\xe0-\xff]")


def parse(data: bytes | None) -> dict:
    """What the bytes hold; never raises.

    offsets and sizes: of the audio frames, the table frame aside. skipped: bytes between frames
    that are none; resyncs: how often they came. hz: the first frame's; duration: seconds as an
    exact fraction, each frame by its own rate. Checksums are verified in all three layers. Null,
    empty and foreign bytes: no frames, and duration 0/1. A last frame that is cut off counts as
    skipped, and so does a damaged header up to the next two that fit.
    """
    data = data or b""
    tags, at, end = _tags(data)
    offsets, sizes, kbps, lasts = [], [], [], {}
    skipped = resyncs = good = bad = 0
    table, kinds = None, set()
    while at < end:
        h = header(data[at : at + 4])
        if h is None or at + h[5] > end:
            found = at
            while m := _SYNC.search(data, found + 1, end):
                found = m.start()
                n = header(data[found : found + 4])
                if n and found + n[5] <= end and (found + n[5] == end or header(data[found + n[5] : found + n[5] + 4])):
                    break
                m = None
            if m is None:
                found = end
            skipped, resyncs, at = skipped + found - at, resyncs + 1, found
            continue
        version, layer, checked, rate, hz, size, n, _, _ = h
        if not offsets and table is None and layer == 3 and (table := _table(data, at, h)) is not None:
            at += size
            continue
        if checked:
            bits = _checked_bits(data, at, h)
            ok = bits is not None and crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + -(-bits // 8)], 16 + bits) == int.from_bytes(data[at + 4 : at + 6], "big")
            good, bad = good + ok, bad + (not ok)
        offsets.append(at)
        sizes.append(size)
        kbps.append(rate)
        kinds.add((version, layer))
        lasts[hz] = lasts.get(hz, 0) + n
        at += size
    lasting = sum((Fraction(n, hz) for hz, n in lasts.items()), Fraction(0))
    return {"tags": tags, "table": table, "offsets": offsets, "sizes": sizes, "kbps": sorted(set(kbps)), "kinds": sorted(kinds), "hz": next(iter(lasts), 0), "samples": sum(lasts.values()), "duration": (lasting.numerator, lasting.denominator), "skipped": skipped, "resyncs": resyncs, "crc_good": good, "crc_bad": bad}


# The writer's frames: MPEG-1 layer III, one channel, 32,000 Hz, checksums; all-zero side data (silence), so that a frame's rest is ancillary.
_SIDE = 17
_ROOM = {k: 144 * k // 32 - 4 - 2 - _SIDE for k in BITRATES[1, 3][1:]}


def _head(kbps: int) -> bytes:
    two = bytes([BITRATES[1, 3].index(kbps) << 4 | 2 << 2, 3 << 6])
    return b"\xff\xfa" + two + crc16(two + bytes(_SIDE)).to_bytes(2, "big") + bytes(_SIDE)


def write(payload: bytes) -> bytes:
    """payload in the ancillary bytes of silent frames, after a tag with its size and a table frame."""
    most = max(_ROOM.values())
    full, rest = divmod(len(payload), most)
    frames = np.zeros((full, 144 * 320 // 32), np.uint8)
    frames[:, : 6 + _SIDE] = np.frombuffer(_head(320), np.uint8)
    frames[:, 6 + _SIDE :] = np.frombuffer(payload, np.uint8, full * most).reshape(full, most)
    tail = b""
    if rest:
        k = next(k for k, room in _ROOM.items() if room >= rest)
        tail = _head(k) + payload[full * most :] + bytes(_ROOM[k] - rest)
    count, size = full + bool(rest), frames.size + len(tail)
    first = _head(64)
    total = 144 * 64 // 32 + size
    toc = bytes(min(255, 256 * (144 * 64 // 32 + min(size, 144 * 320 // 32 * (i * count // 100))) // total) for i in range(100)) if count else bytes(100)
    table = (first + b"Xing" + struct.pack(">III", 7, count, total) + toc).ljust(144 * 64 // 32, b"\0")
    text = b"\0payload\0" + str(len(payload)).encode()
    frame = b"TXXX" + len(text).to_bytes(4, "big") + b"\0\0" + text
    n = len(frame)
    return b"ID3\x03\0\0" + bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127]) + frame + table + frames.tobytes() + tail


def read(data: bytes, found: dict | None = None) -> bytes:
    """The payload that write() stored."""
    found = found or parse(data)
    parts = [data[o + 6 + _SIDE : o + n] for o, n in zip(found["offsets"], found["sizes"], strict=True)]
    return b"".join(parts)[: int(found["tags"]["payload"])]


def feature(found: dict) -> str:
    """A line with what was found; its seek part is a crc32 of the frame offsets."""
    table, seek = found["table"], zlib.crc32(np.array(found["offsets"], "<i8").tobytes())
    kinds = ",".join(f"v{v:g}l{la}" for v, la in found["kinds"])
    rates = ",".join(map(str, found["kbps"]))
    vbr = f"{table['kind']}:{table.get('frames', 0)}:{int(table.get('frames') == len(found['offsets']))}" if table else "none"
    return f"mpeg={kinds};hz={found['hz']};frames={len(found['offsets'])};samples={found['samples']};duration={found['duration'][0]}/{found['duration'][1]};kbps={rates};vbr={vbr};crc={found['crc_good']}/{found['crc_bad']};resyncs={found['resyncs']};seek={seek}"


FOUND = "n_frames long, samples long, hz long, duration_num long, duration_den long, seek_offsets array<long>, tags map<string,string>, crc_good long, crc_bad long, resyncs long, skipped long, feature string"


def parse_audio(df: DataFrame, media: str = "media") -> DataFrame:
    """df with a struct column audio: what parse() finds in each row's bytes, exact duration and seek offsets included.

    Null and empty bytes give no frames; an own column named audio is replaced; repeated rows and
    empty tables are nothing special.
    """

    @F.pandas_udf(FOUND)
    def audio(col):
        import pandas as pd

        found = [parse(x) for x in col]
        return pd.DataFrame({"n_frames": [len(x["offsets"]) for x in found], "samples": [x["samples"] for x in found], "hz": [x["hz"] for x in found], "duration_num": [x["duration"][0] for x in found], "duration_den": [x["duration"][1] for x in found], "seek_offsets": [x["offsets"] for x in found], "tags": [x["tags"] for x in found], "crc_good": [x["crc_good"] for x in found], "crc_bad": [x["crc_bad"] for x in found], "resyncs": [x["resyncs"] for x in found], "skipped": [x["skipped"] for x in found], "feature": [feature(x) for x in found]})

    return df.drop("audio").withColumn("audio", audio(F.col(media)))


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: int = 64) -> DataFrame:
    """doc_id, n_bytes and media: each text's UTF-8, zero bytes after it up to a positive multiple of unit, as MPEG audio. Null: empty."""

    def stored(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                got = batch.slice(at, 256)
                raw = [b or b"" for b in got.column(1).to_pylist()]
                media = [write(b.ljust(max(unit, -(-len(b) // unit) * unit), b"\0")) for b in raw]
                yield pa.RecordBatch.from_arrays([got.column(0), pa.array(list(map(len, raw)), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("b")).mapInArrow(stored, "doc_id long, n_bytes long, media binary")


def digests(stored: DataFrame) -> DataFrame:
    """doc_id, n_bytes, and digests of the payload read back from media and of media itself, with the feature line.

    stored: what store_texts() returns, whose media is never null. Null ids stay null, repeated
    rows come again with equal values, an empty table gives none; a medium is read whole.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def read_back(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                got, rows = batch.slice(at, 256), []
                for data in got.column(2).to_pylist():
                    found = parse(data)
                    payload = read(data, found)
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature(found)))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([got.column(0), got.column(1), *(pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True))], names=names)

    return stored.mapInArrow(read_back, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
