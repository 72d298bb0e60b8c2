"""MPEG audio columns: reading frames, tags and variable-bitrate tables; storing bytes losslessly.

``probe`` reads any MPEG-1/2/2.5 Layer I-III stream in a binary column: it
parses an ID3v2.2, 2.3 or 2.4 tag, also an unsynchronised one,
resynchronises on frame headers after damage, verifies the frames' CRC-16
by the rules of their layer, reads the Xing/Info or VBRI table, and returns
the exact duration (samples, rate, and seconds) and the byte offset of
every audio frame. Frames of free format end where the next one begins.

``pack`` stores bytes as a valid stream: Layer III frames of silence whose
ancillary data hold the payload, CRC-protected, after an ID3v2 tag with the
payload's length and a Xing frame with the seek table. ``unpack`` inside
``probe`` gives the payload back.

A null or empty column value, or one without any frame, probes to no
frames, duration 0 and a null payload; junk between frames is counted in
``skipped_bytes``. A payload may be empty. Values are handled one by one,
so memory is bounded by the longest value and its batch.
"""

from __future__ import annotations

import functools
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from waymark.llm.common import small_batches

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by (MPEG-1 or not, layer), and Hz by version.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
CRC_POLYNOMIAL = 0x8005


def crc16(data: bytes) -> int:
    """The frame CRC: polynomial 0x8005, all ones at the start, most significant bit first."""
    value = 0xFFFF
    for byte in data:
        value ^= byte << 8
        for _ in range(8):
            value = (value << 1 ^ CRC_POLYNOMIAL if value & 0x8000 else value << 1) & 0xFFFF
    return value


cached_crc16 = functools.lru_cache(maxsize=4096)(crc16)


def crc16_bits(bits: str) -> int:
    """The frame CRC of a string of 0 and 1."""
    whole = len(bits) // 8 * 8
    value = crc16(int(bits[:whole], 2).to_bytes(whole // 8, "big")) if whole else 0xFFFF
    for bit in bits[whole:]:
        value = (value << 1 ^ CRC_POLYNOMIAL if (value >> 15) ^ int(bit) else value << 1) & 0xFFFF
    return value


def allocation_widths(first: bool, rate: int, kbit: int) -> list[int]:
    """Layer II: the bits of each subband's allocation, by MPEG-1 or not, rate, and kbit/s of a channel (0 for free format)."""
    # Fixed values of ISO/IEC 11172-3 and 13818-3: subbands with 4, 3 and 2 bits.
    if not first:
        counts = (4, 7, 19)
    elif kbit in (32, 48):
        counts = (2, 10 if rate == 32000 else 6, 0)
    else:
        counts = (11, 12, 4 if rate == 48000 or 56 <= kbit <= 80 else 7)
    return [width for width, n in zip((4, 3, 2), counts, strict=True) for _ in range(n)]


def protected_bits(frame: bytes, layer: int, first: bool, rate: int, kbit: int) -> str:
    """Layer I and II: the bits under the CRC, which are half the header, the bit allocations and, in Layer II, which scale
    factors follow."""
    mode, extension = frame[3] >> 6, frame[3] >> 4 & 3
    channels = 1 if mode == 3 else 2
    bound = 4 * (extension + 1) if mode == 1 else 32
    body = "".join(f"{x:08b}" for x in frame[6 : 6 + 160])
    head = f"{frame[2]:08b}{frame[3]:08b}"
    if layer == 1:
        return head + body[: 4 * 32 if channels == 1 else 4 * (32 + bound)]
    at = used = 0
    for band, width in enumerate(allocation_widths(first, rate, kbit // channels)):
        for _ in range(channels if band < bound else 1):
            if "1" in body[at : at + width]:
                used += channels if band >= bound else 1
            at += width
    return head + body[: at + 2 * used]


@functools.lru_cache(maxsize=4096)
def read_header(word: bytes) -> tuple[int, int, int, int, bool, int, int] | None:
    """(version bits, layer, frame bytes, rate, has CRC, samples, side-information bytes), or None if these 4 bytes are no header.

    A frame of free format has 0 bytes here.
    """
    if len(word) < 4 or word[0] != 0xFF or word[1] & 0xE0 != 0xE0:
        return None
    version, layer = word[1] >> 3 & 3, 4 - (word[1] >> 1 & 3)
    rate_index, bit_index = word[2] >> 2 & 3, word[2] >> 4
    if version == 1 or layer == 4 or rate_index == 3 or bit_index == 15:
        return None
    first, rate = version == 3, RATES[version][rate_index]
    bits, padding = BITRATES[first, layer][bit_index] * 1000, word[2] >> 1 & 1
    if layer == 1:
        size, samples = (12 * bits // rate + padding) * 4, 384
    else:
        samples = 576 if layer == 3 and not first else 1152
        size = samples // 8 * bits // rate + padding
    size *= bit_index > 0
    mono = word[3] >> 6 == 3
    side = 0 if layer != 3 else (17 if mono else 32) if first else (9 if mono else 17)
    return version, layer, size, rate, not word[1] & 1, samples, side


def free_size(data: bytes, at: int, stop: int) -> int:
    """The bytes of a frame of free format: up to the next header that differs at most in padding and channel extension, or the
    end; 0 if that is too near to be a frame."""
    found = at + 3
    while (found := data.find(data[at : at + 2], found + 1, stop)) >= 0:
        if found + 4 <= stop and (data[found + 2] ^ data[at + 2]) & 0xFD == 0 and (data[found + 3] ^ data[at + 3]) & 0xC0 == 0:
            break
    size = (found if found >= 0 else stop) - at
    return size if size >= 24 else 0


def read_id3(data: bytes) -> tuple[dict[str, str], int]:
    """The text frames of an ID3v2 tag at the start, and where the audio begins; ({}, 0) without a tag.

    Names are those of versions 2.3 and 2.4, or the three letters of 2.2.
    """
    if data[:3] != b"ID3" or len(data) < 10 or data[3] not in (2, 3, 4):
        return {}, 0
    synchsafe = lambda b: b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]
    plain = lambda b: b.replace(b"\xff\x00", b"\xff")
    major, flags, end = data[3], data[5], min(len(data), 10 + synchsafe(data[6:10]))
    body = data[10:end]
    if flags & 0x80 and major < 4:
        body = plain(body)
    letters, width = (3, 6) if major == 2 else (4, 10)
    at = 0
    if flags & 0x40 and major > 2 and len(body) >= 4:  # an extended header
        at = synchsafe(body[:4]) if major == 4 else 4 + int.from_bytes(body[:4], "big")
    tags = {}
    while at + width <= len(body) and body[at : at + letters].isalnum():
        size = synchsafe(body[at + 4 : at + 8]) if major == 4 else int.from_bytes(body[at + letters : at + 2 * letters], "big")
        name, value = body[at : at + letters].decode("ascii"), body[at + width : at + width + size]
        if major == 4 and body[at + 9] & 0x02:
            value = plain(value)
        if major == 4 and body[at + 9] & 0x01:  # the length before the value
            value = value[4:]
        if name[0] == "T" and value:
            text = value[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(value[0], "latin-1"), errors="replace").rstrip("\0")
            if name in ("TXXX", "TXX"):
                name, _, text = text.partition("\0")
            tags[name] = text
        at += width + size
    return tags, end + (10 if major == 4 and flags & 0x10 else 0)


def read_xing(frame: bytes, side: int) -> dict | None:
    """Frames, bytes and the 100 seek entries of a Xing/Info frame, or None."""
    at = 4 + side
    if frame[at : at + 4] not in (b"Xing", b"Info"):
        return None
    (flags,), at, out = struct.unpack(">I", frame[at + 4 : at + 8]), at + 8, {"frames": None, "bytes": None, "toc": None}
    for bit, name in ((1, "frames"), (2, "bytes")):
        if flags & bit:
            out[name], at = int.from_bytes(frame[at : at + 4], "big"), at + 4
    if flags & 4:
        out["toc"] = list(frame[at : at + 100])
    return out


def read_vbri(frame: bytes) -> dict | None:
    """Frames, bytes and the seek entries (bytes of each run of frames) of a VBRI frame, or None."""
    if frame[36:40] != b"VBRI" or len(frame) < 62:
        return None
    size, frames, entries, scale, width = struct.unpack(">IIHHH", frame[46:60])
    table = [int.from_bytes(frame[i : i + width], "big") * scale for i in range(62, min(len(frame) - width + 1, 62 + entries * width), width)] if width else []
    return {"frames": frames, "bytes": size, "toc": table}


def frames_reach(data: bytes, at: int, stop: int) -> bool:
    """Whether whole frames from ``at`` on, one after another, end exactly at ``stop``."""
    while at < stop:
        head = read_header(data[at : at + 4])
        if not head or not head[2]:
            return False
        at += head[2]
    return at == stop


def audio_end(data: bytes, at: int) -> int:
    """Where the audio that begins at ``at`` ends: before an ID3v1 tag, but TAG inside a frame, when the frames reach the end, is none."""
    if len(data) - at < 128 or data[-128:-125] != b"TAG":
        return len(data)
    return len(data) if frames_reach(data, at, len(data)) else len(data) - 128


def read_stream(data: bytes) -> dict:
    """All that ``probe`` returns, of one value."""
    tags, at = read_id3(data)
    out = {"frames": 0, "samples": 0, "rate": None, "skipped": 0, "crc_good": 0, "crc_bad": 0, "offsets": [], "table": None, "tags": tags}
    body, first, stop = [], True, audio_end(data, at)
    synced, kind = False, None
    while at + 4 <= stop:
        head = read_header(data[at : at + 4])
        if head and not head[2]:
            head = (*head[:2], free_size(data, at, stop), *head[3:])
        if head and not head[2]:
            head = None
        if head and (not synced or (head[0], head[1], head[3]) != kind):  # may be chance: the next header must fit, or the stream end there
            after = at + head[2]
            follows = read_header(data[after : after + 4])
            if after != stop and not (follows and follows[:2] == head[:2] and follows[3] == head[3]):
                head = None
        if not head or at + head[2] > stop:
            synced = False
            found = data.find(b"\xff", at + 1, stop)
            out["skipped"] += (found if found >= 0 else stop) - at
            at = found if found >= 0 else stop
            continue
        _, layer, size, rate, protected, samples, side = head
        frame, synced, kind = data[at : at + size], True, (head[0], layer, rate)
        table = (read_xing(frame, side) or read_vbri(frame)) if first and layer == 3 else None
        first = False
        if table:
            out["table"] = table
        else:
            data_at = 4 + 2 * protected + side
            if protected:
                if layer == 3:
                    value = cached_crc16(frame[2:4] + frame[6:data_at])
                else:
                    value = crc16_bits(protected_bits(frame, layer, kind[0] == 3, rate, BITRATES[kind[0] == 3, layer][frame[2] >> 4]))
                out["crc_good" if value == int.from_bytes(frame[4:6], "big") else "crc_bad"] += 1
            out["frames"] += 1
            out["samples"] += samples
            out["rate"] = out["rate"] or rate
            out["offsets"].append(at)
            body.append(frame[data_at:])
        at += size
    out["skipped"] += stop - at if at < stop else 0
    length = tags.get("payload_bytes", "")
    out["payload"] = b"".join(body)[: int(length)] if length.isdigit() else None
    return out


# What pack() writes: MPEG-1 Layer III, 32 kHz, mono, with 17 bytes of side information that are all zero.
_RATE, _SIDE = 32000, 17
_SIZES = [144 * kbit * 1000 // _RATE for kbit in BITRATES[True, 3]]
_OVERHEAD = 4 + 2 + _SIDE


def _header(bit_index: int, protected: bool) -> bytes:
    return bytes((0xFF, 0xFA | (not protected), bit_index << 4 | 2 << 2, 0xC0))


@functools.lru_cache(maxsize=32)
def _front(bit_index: int) -> bytes:
    head, side = _header(bit_index, True), bytes(_SIDE)
    return head + cached_crc16(head[2:] + side).to_bytes(2, "big") + side


def pack_bytes(payload: bytes) -> bytes:
    """A stream that holds ``payload``."""
    text = b"\x03payload_bytes\0" + str(len(payload)).encode()
    tag = b"TXXX" + len(text).to_bytes(4, "big") + b"\0\0" + text
    n = len(tag)
    tag = b"ID3\x03\0\0" + bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127)) + tag
    frames, at = [], 0
    while True:
        rest = len(payload) - at
        index = next((i for i in range(1, 15) if _SIZES[i] - _OVERHEAD >= rest), 14)
        room = _SIZES[index] - _OVERHEAD
        frames.append(_front(index) + payload[at : at + room].ljust(room, b"\0"))
        at += room
        if at >= len(payload):
            break
    starts = [_SIZES[1]]
    for f in frames:
        starts.append(starts[-1] + len(f))
    toc = bytes(min(255, 256 * starts[len(frames) * i // 100] // starts[-1]) for i in range(100))
    xing = _header(1, False) + bytes(_SIDE) + b"Xing" + struct.pack(">III", 7, len(frames), starts[-1]) + toc
    return tag + xing.ljust(_SIZES[1], b"\0") + b"".join(frames)


def pack(payload: Column) -> Column:
    """A binary column of streams holding the binary ``payload``; null stays null."""
    small_batches()

    @F.pandas_udf("binary")
    def packed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            yield pd.Series([None if v is None else pack_bytes(v) for v in values], dtype=object)

    return packed(payload)


PROBE = "frames long, samples long, rate int, duration_s double, skipped_bytes long, crc_good long, crc_bad long, seek_offsets array<long>, table_frames long, table_bytes long, table_toc array<int>, tags map<string,string>, payload binary"


def probe(media: Column) -> Column:
    """A struct of what each stream holds: see ``PROBE``; the exact duration is ``samples / rate`` seconds."""
    small_batches()

    @F.pandas_udf(PROBE)
    def probed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in PROBE.split(", ")]
        for values in batches:
            rows = []
            for v in values:
                s = read_stream(v or b"")
                t = s["table"] or {"frames": None, "bytes": None, "toc": None}
                rows.append((s["frames"], s["samples"], s["rate"], s["samples"] / s["rate"] if s["rate"] else 0.0, s["skipped"], s["crc_good"], s["crc_bad"], s["offsets"], t["frames"], t["bytes"], t["toc"], s["tags"], s["payload"]))
            df = pd.DataFrame(rows, columns=names)
            for c in ("rate", "table_frames", "table_bytes"):
                df[c] = df[c].astype("Int64")
            yield df

    return probed(media)


def padded_payload(text: Column, unit: int = 64) -> Column:
    """The text's UTF-8 bytes (null: none) with zero bytes up to a positive multiple of ``unit``."""
    raw = F.coalesce(text, F.lit("")).cast("binary")
    whole = F.greatest(F.lit(1), F.ceil(F.octet_length(raw) / F.lit(unit))) * unit
    return F.rpad(raw, whole.cast("int"), F.lit(b"\0"))
