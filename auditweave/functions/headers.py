"""What the headers of PNG, JPEG and WebP files say, from their bytes: nothing is decoded."""

from __future__ import annotations

import re
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

HEADER = "struct<format:string, width:long, height:long, complete:boolean>"
# Markers of the formats.
PNG = b"\x89PNG\r\n\x1a\n"
SIZES = frozenset(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}  # start of frame
ALONE = frozenset(range(0xD0, 0xD9)) | {0x01}  # markers without a length
IN_SCAN = re.compile(rb"\xff+[^\x00\xd0-\xd7\xff]")  # in coded data: a marker that ends it


def png(data: bytes) -> tuple[int | None, int | None, bool]:
    """Width and height; complete if chunk follows chunk up to the end chunk. What follows that is of no account."""
    if len(data) < 33 or data[12:16] != b"IHDR":
        return None, None, False
    width, height = struct.unpack(">II", data[16:24])
    at = 8
    while at + 12 <= len(data):
        (n,) = struct.unpack(">I", data[at : at + 4])
        if data[at + 4 : at + 8] == b"IEND":
            return width, height, at + 12 + n <= len(data)
        at += 12 + n
    return width, height, False


def jpeg(data: bytes) -> tuple[int | None, int | None, bool]:
    """Width and height of the frame; complete if the segments go on to the end marker, whatever follows it."""
    width = height = None
    at = 2
    while at + 2 <= len(data):
        if data[at] != 0xFF:
            return width, height, False
        marker = data[at + 1]
        if marker == 0xFF:  # fill bytes
            at += 1
            continue
        if marker == 0xD9:
            return width, height, width is not None
        at += 2
        if marker in ALONE:
            continue
        if at + 2 > len(data):
            break
        (n,) = struct.unpack(">H", data[at : at + 2])
        if n < 2:
            break
        if marker in SIZES and at + 7 <= len(data):
            height, width = struct.unpack(">HH", data[at + 3 : at + 7])
        at += n
        if marker == 0xDA:
            found = IN_SCAN.search(data, at)
            if not found:
                break
            at = found.end() - 2
    return width, height, False


def webp(data: bytes) -> tuple[int | None, int | None, bool]:
    """Width and height by the first chunk: lossy, lossless or extended; complete if the file is as long as it says."""
    (n,) = struct.unpack("<I", data[4:8])
    whole, kind, body = len(data) >= n + 8, data[12:16], data[20:30]
    if kind == b"VP8X" and len(body) == 10:
        return 1 + int.from_bytes(body[4:7], "little"), 1 + int.from_bytes(body[7:10], "little"), whole
    if kind == b"VP8L" and body[:1] == b"\x2f":
        bits = int.from_bytes(body[1:5], "little")
        return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF), whole
    if kind == b"VP8 " and body[3:6] == b"\x9d\x01\x2a":
        return int.from_bytes(body[6:8], "little") & 0x3FFF, int.from_bytes(body[8:10], "little") & 0x3FFF, whole
    return None, None, False


def header(data: bytes | None) -> tuple[str | None, int | None, int | None, bool]:
    """(format, width, height, complete); no format for what begins as none of the three."""
    if data and data.startswith(PNG):
        return "PNG", *png(data)
    if data and data.startswith(b"\xff\xd8\xff"):
        return "JPEG", *jpeg(data)
    if data and data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return "WEBP", *webp(data)
    return None, None, None, False


def image_header(content: Column) -> Column:
    def run(content: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([header(None if c is None else bytes(c)) for c in content], columns=["format", "width", "height", "complete"])
        return out.astype({"width": "Int64", "height": "Int64", "complete": bool})

    return F.pandas_udf(run, HEADER)(content)
