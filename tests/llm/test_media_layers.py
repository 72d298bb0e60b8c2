"""Checksums of every layer, free format, seek tables and tags, on frames made by hand."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from waymark.llm import mpeg


def slow_crc(bits):
    """Long division, a bit at a time."""
    value = 0xFFFF
    for b in bits:
        top = value >> 15 & 1
        value = value << 1 & 0xFFFF
        if top != int(b):
            value ^= 0x8005
    return value


def frame(rng, version, layer, bit_index, rate_index, mode, extension, good=True):
    """A protected frame of noise whose checksum is set by the standard's rule, spelled out."""
    head = bytes((0xFF, 0xE0 | version << 3 | (4 - layer) << 1, bit_index << 4 | rate_index << 2, mode << 6 | extension << 4))
    size = mpeg.read_header(head)[2]
    body = bytes(rng.randrange(0, 255) for _ in range(size - 6))
    bits = "".join(f"{x:08b}" for x in body)
    channels, bound = (1 if mode == 3 else 2), (4 * (extension + 1) if mode == 1 else 32)
    covered = f"{head[2]:08b}{head[3]:08b}"
    if layer == 1:
        n = sum(4 * (channels if sb < bound else 1) for sb in range(32))
    else:
        kbit = mpeg.BITRATES[version == 3, 2][bit_index] // channels
        rate = mpeg.RATES[version][rate_index]
        if version != 3:
            widths = [4] * 4 + [3] * 7 + [2] * 19
        elif kbit < 56:
            widths = [4] * 2 + [3] * (10 if rate == 32000 else 6)
        else:
            widths = [4] * 11 + [3] * 12 + [2] * (4 if kbit <= 80 or rate == 48000 else 7)
        n = selected = 0
        for sb, w in enumerate(widths):
            for ch in range(channels):
                if sb >= bound and ch:
                    selected += value > 0
                    continue
                value = int(bits[n : n + w], 2)
                n += w
                selected += value > 0
        n += 2 * selected
    crc = slow_crc(covered + bits[:n])
    return head + (crc if good else crc ^ 1).to_bytes(2, "big") + body


@pytest.mark.parametrize("layer", [1, 2])
@pytest.mark.parametrize("version", [3, 2, 0])
def test_checksums_by_layer(layer, version):
    rng = random.Random(layer * 10 + version)
    for mode, extension in ((3, 0), (0, 0), (1, 0), (1, 2)):
        for bit_index in (4, 8, 12):
            for rate_index in range(3):
                frames = [frame(rng, version, layer, bit_index, rate_index, mode, extension, good=i != 1) for i in range(4)]
                s = mpeg.read_stream(b"".join(frames))
                assert (s["frames"], s["crc_good"], s["crc_bad"], s["skipped"]) == (4, 3, 1, 0)


def test_free_format_frames_end_at_the_next():
    head = bytes((0xFF, 0xFB, 0x00, 0xC0))
    data = b"".join(head + bytes([i]) * 200 for i in range(5))
    s = mpeg.read_stream(data)
    assert (s["frames"], s["samples"], s["offsets"], s["skipped"]) == (5, 5 * 1152, [0, 204, 408, 612, 816], 0)


def test_vbri_table():
    head = mpeg._header(9, False)
    size = mpeg.read_header(head)[2]
    table = head + bytes(32) + b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 75, 4000, 20, 3, 2, 2, 5) + struct.pack(">HHH", 100, 110, 120)
    s = mpeg.read_stream(table.ljust(size, b"\0") + (head + bytes(size - 4)) * 2)
    assert s["frames"] == 2 and s["table"] == {"frames": 20, "bytes": 4000, "toc": [200, 220, 240]}


def tag(major, frames, flags=0):
    n = len(frames)
    return b"ID3" + bytes((major, 0, flags, n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127)) + frames


def test_tags_of_each_version():
    assert mpeg.read_id3(tag(2, b"TT2" + (5).to_bytes(3, "big") + b"\x00Song")) == ({"TT2": "Song"}, 21)
    raw = b"\x01\xff\xfeS\x00"  # utf-16 with its mark, which unsynchronisation splits
    assert mpeg.read_id3(tag(3, b"TIT2" + len(raw).to_bytes(4, "big") + b"\0\0" + raw.replace(b"\xff", b"\xff\x00"), 0x80))[0] == {"TIT2": "S"}
    spread = raw.replace(b"\xff", b"\xff\x00")
    assert mpeg.read_id3(tag(4, b"TIT2" + len(spread).to_bytes(4, "big") + b"\0\x02" + spread))[0] == {"TIT2": "S"}
    assert mpeg.read_id3(tag(3, (6).to_bytes(4, "big") + bytes(6) + b"TALB" + (2).to_bytes(4, "big") + b"\0\0\x00A", 0x40))[0] == {"TALB": "A"}
    assert mpeg.read_id3(b"ID3\x07\0\0\0\0\0\0") == ({}, 0)


def test_duration_column(spark):
    df = spark.createDataFrame([(mpeg.pack_bytes(b"x" * 5000),), (b"",), (None,)], "m binary")
    rows = df.select(mpeg.probe(F.col("m")).alias("p")).select("p.frames", "p.samples", "p.rate", "p.duration_s").collect()
    assert rows[0].duration_s == rows[0].samples / 32000 > 0 and [r.duration_s for r in rows[1:]] == [0.0, 0.0]
