"""Random access to ZIP archives: the directory in pieces from the file's tail, and single members where they lie.

Nothing here holds an archive, a directory or the members of one: a piece of DIRECTORY_BYTES and one member at a time."""

from __future__ import annotations

import bz2
import struct
import urllib.parse
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

from pyarrow import fs

DIRECTORY_BYTES, READ_BYTES = 1 << 20, 1 << 18
# Signatures and layouts of the format's records.
END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4"
END_SIZE, LOCATOR_SIZE, ENTRY_SIZE, LOCAL_SIZE = 22, 20, 46, 30
STORED, DEFLATED, BZIP2, LZMA = 0, 8, 12, 14
ENCRYPTED, UTF8, WIDE = 1, 0x800, 0xFFFFFFFF


class BadArchive(ValueError):
    """What can't be read as an archive or a member."""


@dataclass(frozen=True)
class Entry:
    path: str
    mode: int
    size: int
    packed: int
    offset: int
    method: int
    flags: int
    crc: int


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a file that Spark has listed. Stores are those that pyarrow opens: local, HDFS (viewfs too), S3, GCS, Azure."""
    scheme, _, rest = uri.partition(":")
    if not rest or scheme == "file":
        return fs.LocalFileSystem(), "/" + (rest or uri).lstrip("/")
    return fs.FileSystem.from_uri(urllib.parse.quote(uri, safe=":/@+=,"))


def opened(uri: str) -> BinaryIO:
    store, path = place(uri)
    return store.open_input_file(path)


def _directory(file: BinaryIO) -> tuple[int, int, int]:
    """Where the directory begins, its bytes, and what is to be added to the places it tells (of archives behind other data)."""
    length = file.seek(0, 2)
    file.seek(max(0, length - END_SIZE - 0xFFFF))
    tail = file.read()
    at = tail.rfind(END)
    if at < 0 or len(tail) - at < END_SIZE:
        raise BadArchive("no end of directory")
    size, offset = struct.unpack("<II", tail[at + 12 : at + 20])
    end = length - len(tail) + at
    if end >= LOCATOR_SIZE:
        file.seek(end - LOCATOR_SIZE)
        locator = file.read(LOCATOR_SIZE)
        if locator[:4] == LOCATOR64:
            file.seek(struct.unpack("<Q", locator[8:16])[0])
            record = file.read(56)
            if record[:4] != END64 or len(record) < 56:
                raise BadArchive("no wide end of directory")
            size, offset = struct.unpack("<QQ", record[40:56])
            end -= LOCATOR_SIZE + 12 + struct.unpack("<Q", record[4:12])[0]
    if end - size - offset < 0 or end - size < 0:
        raise BadArchive("directory out of place")
    return end - size, size, end - size - offset


def _wide(extra: bytes, values: list[int]) -> list[int]:
    """Sizes and offset, where they are told in the extra field for being too large."""
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack("<HH", extra[at : at + 4])
        if kind == 1:
            own = iter(struct.unpack(f"<{n // 8}Q", extra[at + 4 : at + 4 + n // 8 * 8]))
            try:
                return [next(own) if v == WIDE else v for v in values]
            except StopIteration:
                raise BadArchive("wide sizes are missing") from None
        at += 4 + n
    return values


def entries(file: BinaryIO) -> Iterator[Entry]:
    """The directory in order, read in pieces."""
    start, left, shift = _directory(file)
    file.seek(start)
    held = b""
    while left or held:
        if left:
            piece = file.read(min(left, DIRECTORY_BYTES))
            if not piece:
                raise BadArchive("directory ends early")
            held, left = held + piece, left - len(piece)
        at = 0
        while at + ENTRY_SIZE <= len(held):
            if held[at : at + 4] != ENTRY:
                raise BadArchive("no entry where one should be")
            flags, method = struct.unpack("<HH", held[at + 8 : at + 12])
            crc, packed, size, name, extra, note = struct.unpack("<IIIHHH", held[at + 16 : at + 34])
            attributes, offset = struct.unpack("<II", held[at + 38 : at + 46])
            to = at + ENTRY_SIZE + name + extra + note
            if to > len(held):
                break
            raw = held[at + ENTRY_SIZE : at + ENTRY_SIZE + name]
            size, packed, offset = _wide(held[at + ENTRY_SIZE + name : at + ENTRY_SIZE + name + extra], [size, packed, offset])
            path = raw.decode("utf-8" if flags & UTF8 else "cp437", "replace").split("\0")[0]
            yield Entry(path, attributes >> 16, size, packed, offset + shift, method, flags, crc)
            at = to
        held = held[at:]
        if not left and held:
            raise BadArchive("directory ends within an entry")


def member(file: BinaryIO, entry: Entry, most: int) -> bytes:
    """The content of one member, `most` + 1 bytes at most: what the directory says of its size isn't trusted."""
    file.seek(entry.offset)
    head = file.read(LOCAL_SIZE)
    if head[:4] != LOCAL or len(head) < LOCAL_SIZE or entry.flags & ENCRYPTED:
        raise BadArchive("no readable member where one should be")
    file.seek(entry.offset + LOCAL_SIZE + sum(struct.unpack("<HH", head[26:30])))
    try:
        unpack = {STORED: None, DEFLATED: lambda: zlib.decompressobj(-15), BZIP2: bz2.BZ2Decompressor, LZMA: zipfile.LZMADecompressor}[entry.method]
    except KeyError:
        raise BadArchive(f"method {entry.method}") from None
    own, out, left, total = unpack and unpack(), [], entry.packed, 0
    while left and total <= most:
        piece = file.read(min(left, READ_BYTES))
        if not piece:
            raise BadArchive("member ends early")
        left -= len(piece)
        try:
            if not own:
                out.append(piece)
            elif entry.method == DEFLATED:
                out.append(own.decompress(piece, most + 1 - total))
                while own.unconsumed_tail and total + len(out[-1]) <= most:
                    total += len(out[-1])
                    out.append(own.decompress(own.unconsumed_tail, most + 1 - total))
            else:
                out.append(own.decompress(piece))
        except (zlib.error, OSError, ValueError, EOFError) as e:
            raise BadArchive(str(e)) from None
        total += len(out[-1])
        if own is not None and own.eof:
            break
    content = b"".join(out)[: most + 1]
    if len(content) <= most and (len(content) != entry.size or zlib.crc32(content) != entry.crc or own is not None and not own.eof):
        raise BadArchive("member is not what the directory says")
    return content
