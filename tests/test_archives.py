"""Archives read by places, headers read before pixels."""

import io
import os
import resource
import struct
import sys
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditweave import model as M
from auditweave.functions import headers as H
from auditweave.plans.audit import audit_archive, audit_folder
from auditweave.sources import archives as A
from auditweave.sources import demo, images, zips

PIXEL = demo.png(np.zeros((4, 4, 3), np.uint8))


def zipped(members, method=zipfile.ZIP_DEFLATED, before=b""):
    out = io.BytesIO()
    out.write(before)
    with zipfile.ZipFile(out, "a" if before else "w", method) as z:
        for path, data in members:
            z.writestr(path, data)
    return out.getvalue()


@pytest.mark.parametrize("method", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2, zipfile.ZIP_LZMA])
@pytest.mark.parametrize("before", [b"", b"#!/bin/sh\n" * 100])
@pytest.mark.parametrize("piece", [1 << 20, 64])
def test_entries_and_members_equal_the_standard_library(monkeypatch, method, before, piece):
    monkeypatch.setattr(zips, "DIRECTORY_BYTES", piece)
    rng = np.random.default_rng(1)
    members = [(f"train/é{i}/{'x' * (i % 50)}.png", rng.bytes(i * 37) + b"a" * (i * 91)) for i in range(60)]
    data = zipped(members, method, before)
    file = io.BytesIO(data)
    got = list(zips.entries(file))
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert [(e.path, e.size, e.packed, e.mode) for e in got] == [(i.filename, i.file_size, i.compress_size, i.external_attr >> 16) for i in z.infolist()]
        for e, (path, body) in zip(got, members, strict=True):
            assert zips.member(file, e, 1 << 20) == body == z.read(path)
            assert len(zips.member(file, e, 10)) == min(len(body), 11)


def test_wide_records(tmp_path):
    path = tmp_path / "wide.zip"
    with zipfile.ZipFile(path, "w") as z:
        with z.open("train/a/1.png", "w", force_zip64=True) as f:
            f.write(PIXEL)
        for i in range(70_000):  # more than the narrow end record counts
            z.writestr(f"n{i}", b"")
    with open(path, "rb") as f:
        found = list(zips.entries(f))
        assert len(found) == 70_001 and zips.member(f, found[0], 1000) == PIXEL


def test_broken_archives_and_members():
    for data in (b"", b"nothing", zipped([("a", b"x")])[:-10], b"PK\5\6" + b"\xff" * 18):
        with pytest.raises(zips.BadArchive):
            list(zips.entries(io.BytesIO(data)))
    whole = bytearray(zipped([("a.png", b"content " * 50), ("b.png", b"fine")]))
    a, b = zips.entries(io.BytesIO(bytes(whole)))
    whole[a.offset + 40] ^= 0xFF
    with pytest.raises(zips.BadArchive):
        zips.member(io.BytesIO(bytes(whole)), a, 1000)
    assert zips.member(io.BytesIO(bytes(whole)), b, 1000) == b"fine"
    lying = zips.Entry(**{**vars(b), "size": 99})
    with pytest.raises(zips.BadArchive):
        zips.member(io.BytesIO(bytes(whole)), lying, 1000)


class Watched(io.BytesIO):
    """Tells how much is read, and how much at once."""

    def __init__(self, data):
        super().__init__(data)
        self.total = self.most = 0

    def read(self, n=-1):
        out = super().read(n)
        self.total, self.most = self.total + len(out), max(self.most, len(out))
        return out


def test_the_directory_is_read_without_members():
    data = zipped([(f"train/a/{i}.png", os.urandom(1 << 20)) for i in range(20)], zipfile.ZIP_STORED)
    file = Watched(data)
    found = list(zips.entries(file))
    assert file.total < 80_000 and len(found) == 20
    file.total = 0
    assert len(zips.member(file, found[7], 2 << 20)) == 1 << 20 and file.total < (1 << 20) + 100
    assert file.most <= zips.READ_BYTES


def test_scan_of_a_large_archive_in_little_memory(spark, tmp_path):
    """A sparse archive of 3 GB, beyond what a file of bytes in Spark may have: its directory and the members asked for are read, nothing else."""
    path = tmp_path / "large.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("train/a/1.png", PIXEL)
        z.writestr("train/a/2.png", PIXEL + b" ")
    small = path.read_bytes()
    start = small.index(zips.ENTRY)
    with open(path, "wb") as f:  # the directory moves 3 GB on, members stay
        f.write(small[:start])
        f.truncate(start + (3 << 30))
        f.seek(start + (3 << 30))
        end = bytearray(small[start:])
        at = end.rindex(zips.END)
        end[at + 16 : at + 20] = struct.pack("<I", start + (3 << 30))
        f.write(end)
    before = resource.getrusage(resource.RUSAGE_CHILDREN).ru_maxrss
    got = A.scan(A.archive_entries(spark, str(path))).collect()
    assert [(r.path, bytes(r.content)) for r in sorted(got)] == [("train/a/1.png", PIXEL), ("train/a/2.png", PIXEL + b" ")]
    assert resource.getrusage(resource.RUSAGE_CHILDREN).ru_maxrss - before < 500_000 or sys.platform != "linux"


def test_directory_actions_read_no_member(spark, tmp_path):
    data = bytearray(zipped([(f"train/a/{i}.png", PIXEL + bytes([i])) for i in range(5)]))
    data[: data.index(zips.ENTRY)] = b"\0" * data.index(zips.ENTRY)  # no member can be read any more
    (tmp_path / "a.zip").write_bytes(data)
    entries = A.archive_entries(spark, str(tmp_path / "a.zip"))
    assert entries.count() == 5
    assert {r.reject_reason for r in A.scan(entries).collect()} == {A.BROKEN}
    with pytest.raises(A.IngestError, match="No usable images"):
        A.extract(A.scan(entries), str(tmp_path / "out"))


def test_extract_and_audit_of_an_archive(spark, tmp_path):
    root = str(tmp_path / "pictures")
    demo.generate(spark, root)
    names = sorted(os.path.relpath(os.path.join(d, f), root) for d, _, fs in os.walk(root) for f in fs)
    names = [n for n in names if n.endswith(("png", "jpg")) and not n.rsplit("/", 1)[1].startswith(".")]
    extra = [("../evil.png", PIXEL), ("train/a/fake.png", b"no picture"), ("notes.txt", b"x"), ("loose.png", PIXEL)]
    (tmp_path / "a.zip").write_bytes(zipped([(n, (tmp_path / "pictures" / n).read_bytes()) for n in names] + extra))
    audit, rejected = audit_archive(spark, str(tmp_path / "a.zip"))
    assert {r.path for r in rejected.collect()} == {p for p, _ in extra}
    same = audit_folder(spark, root)
    facts = ["split", "label", "rel_path", "sha256", "phash", "width", "height", "bytes", "img_format", "corrupt", "error"]
    assert sorted(map(tuple, audit.samples.select(*facts).collect()), key=str) == sorted(map(tuple, same.samples.select(*facts).collect()), key=str)
    taken = A.extract(A.scan(A.archive_entries(spark, str(tmp_path / "a.zip"))), str(tmp_path / "out"))
    assert all((tmp_path / "out" / r.file).stat().st_size == r.written for r in A.accepted(taken).collect())
    assert sum(len(fs) for *_, fs in os.walk(tmp_path / "out")) - len([1 for *_,
        fs in os.walk(tmp_path / "out") for f in fs if f.startswith(".")]) == len(names)


def test_image_fetch(spark, tmp_path):
    (tmp_path / "a.zip").write_bytes(zipped([("train/a/1.png", PIXEL), ("train/a/2.jpg", b"no picture")]))
    scanned = A.scan(A.archive_entries(spark, str(tmp_path / "a.zip")))
    assert images.fetch(scanned, "s0000000") == ("image/png", PIXEL)
    for missing in ("s0000001", "s0000007", ""):
        with pytest.raises(images.SampleNotFound):
            images.fetch(scanned, missing)


def jpeg(width=5, height=3, end=b"\xff\xd9", progressive=False, entropy=b"\x12\xff\x00\x34\xff\xd0\x56"):
    segment = lambda marker, body: b"\xff" + bytes([marker]) + struct.pack(">H", len(body) + 2) + body
    frame = segment(0xC2 if progressive else 0xC0, struct.pack(">BHHB", 8, height, width, 1) + b"\1\x11\0")
    return b"\xff\xd8" + segment(0xE0, b"JFIF\0" + b"\0" * 9) + b"\xff" + frame + (segment(0xDA, b"\1\1\0\0\x3f\0") + entropy) * (1 + progressive) + end


def test_headers():
    assert H.header(PIXEL) == ("PNG", 4, 4, True) and H.header(PIXEL + b"more") == ("PNG", 4, 4, True)
    assert H.header(PIXEL[:-13]) == ("PNG", 4, 4, False) and H.header(PIXEL[:20]) == ("PNG", None, None, False)
    assert H.header(jpeg()) == H.header(jpeg(progressive=True)) == ("JPEG", 5, 3, True)
    assert H.header(jpeg() + b"trailing \xff bytes") == ("JPEG", 5, 3, True)
    assert H.header(jpeg(end=b"")) == ("JPEG", 5, 3, False) and H.header(jpeg(end=b"\xff")) == ("JPEG", 5, 3, False)
    thumbnail = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(jpeg()) + 2) + jpeg() + jpeg(9, 8, b"")[2:]  # an end marker within a segment is none
    assert H.header(thumbnail) == ("JPEG", 9, 8, False) and H.header(thumbnail + b"\xff\xd9") == ("JPEG", 9, 8, True)
    riff = lambda kind, body: b"RIFF" + struct.pack("<I", 12 + len(body)) + b"WEBP" + kind + struct.pack("<I", len(body)) + body
    assert H.header(riff(b"VP8L", b"\x2f" + struct.pack("<I", 6 | 9 << 14) + b"\0" * 8)) == ("WEBP", 7, 10, True)
    assert H.header(riff(b"VP8X", b"\0" * 4 + (299).to_bytes(3, "little") + (199).to_bytes(3, "little"))) == ("WEBP", 300, 200, True)
    assert H.header(riff(b"VP8 ", b"\0\0\0\x9d\1\x2a" + struct.pack("<HH", 64, 48) + b"\0" * 9)) == ("WEBP", 64, 48, True)
    assert H.header(riff(b"VP8L", b"\x2f" + struct.pack("<I", 0) + b"\0" * 8)[:-4])[3] is False
    for other in (b"", None, b"GIF89a", b"RIFF1234WAVE", b"\xff\xd8"):
        assert H.header(other) == (None, None, None, False)


def bomb(side):
    """A PNG of side x side black pixels, packed in one megabyte."""
    chunk = lambda tag, data: struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))
    pack = zlib.compressobj(9)
    rows = b"".join(pack.compress(b"\0" * (1 + side // 8)) for _ in range(side)) + pack.flush()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", side, side, 1, 0, 0, 0, 0)) + chunk(b"IDAT", rows) + chunk(b"IEND", b"")


def test_what_a_header_refuses_is_never_decoded(spark, tmp_path):
    folder = tmp_path / "train" / "c"
    folder.mkdir(parents=True)
    webp = b"RIFF" + struct.pack("<I", 26) + b"WEBPVP8L" + struct.pack("<I", 10) + b"\x2f" + struct.pack("<I", 6 | 9 << 14) + b"\0" * 5
    made = {"ok é+1.png": PIXEL, "bomb.png": bomb(30_000), "cut.jpg": jpeg(end=b""), "web.webp": webp, "not.png": b"text"}
    for name, data in made.items():
        (folder / name).write_bytes(data)
    known = images.facts(spark, str(tmp_path)).withColumn("why", images.refusal(M.Limits()))
    refused = [r.origin for r in known.filter("why is not null").collect()]
    opened = images.decoded(spark, str(tmp_path), refused)
    assert len(refused) == 4 and opened.count() == 1 and opened.rdd.getNumPartitions() == 1
    files = A.accepted(A.folder_entries(spark, str(tmp_path)))
    got = {r.rel_path.rsplit("/", 1)[1]: r for r in images.samples(spark, str(tmp_path), files).collect()}
    assert not got["ok é+1.png"].corrupt and (got["ok é+1.png"].width, got["ok é+1.png"].height) == (4, 4) and got["ok é+1.png"].phash is not None
    assert got["bomb.png"].error == "image of 900000000 pixels exceeds the limit of 64000000" and got["bomb.png"].sha256 and got["bomb.png"].phash is None
    assert got["cut.jpg"].error == "image file is truncated" and got["web.webp"].error == "unsupported format WEBP" and got["not.png"].error == "not a recognised image"
    assert all(got[n].corrupt and got[n].embedding is None for n in made if n != "ok é+1.png")


def test_headers_of_a_column(spark):
    df = spark.createDataFrame([(bytearray(PIXEL),), (None,), (bytearray(jpeg()),)], "c binary").repartition(1)
    assert [tuple(r.h) for r in df.select(H.image_header(F.col("c")).alias("h")).collect()] == [("PNG", 4, 4, True), (None, None, None, False),
        ("JPEG", 5, 3, True)]
