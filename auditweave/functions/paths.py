"""Column expressions on paths and leading bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import EXTENSIONS, SPLIT_ALIASES, UNLABELED


def slashed(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def safe_member_name(path: Column) -> Column:
    """False for empty names, NUL, absolute paths, drive letters and parent components."""
    p = slashed(path)
    return F.coalesce((path != "") & ~F.contains(path, F.lit("\0")) & ~p.startswith("/") & (F.substring(p, 2, 1) != ":")
        & ~F.array_contains(F.split(p, "/", -1), ".."), F.lit(False))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(F.rtrim(path, F.lit("/")), "/", -1), -1)


def skip_reason(path: Column) -> Column:
    """Why an entry is of no interest, null if it is."""
    base = file_name(path)
    return (
        F.when(path.endswith("/"), "directory")
        .when(base.startswith("._") | (base == ".DS_Store"), "macOS resource fork")
        .when(F.contains(path, F.lit("__MACOSX/")), "macOS metadata")
        .when(base.startswith("."), "hidden file")
    )


def extension(path: Column) -> Column:
    """The last suffix in lower case, '' if there is none; a leading dot makes no suffix."""
    return F.lower(F.regexp_extract(file_name(path), r"[^.](\.[^.]+)$", 1))


def allowed_extension(path: Column) -> Column:
    return extension(path).isin(*EXTENSIONS)


def classify_path(path: Column) -> Column:
    """struct(split, label) by the first directory that names a split; null if none does."""
    parts = F.filter(F.split(slashed(path), "/", -1), lambda p: (p != "") & (p != "."))
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    names = F.create_map(*[F.lit(x) for kv in SPLIT_ALIASES.items() for x in kv])
    splits = F.transform(folders, lambda p: F.try_element_at(names, F.lower(p)))
    at = F.array_position(F.transform(splits, lambda s: s.isNotNull()), True).cast("int")
    label = F.array_join(F.slice(folders, at + 1, F.greatest(F.size(folders) - at, F.lit(0))), "/")
    return F.when(at > 0, F.struct(F.get(splits, at - 1).alias("split"), F.when(label == "", UNLABELED).otherwise(label).alias("label")))


def sniff_format(content: Column) -> Column:
    """JPEG, PNG or WEBP by the leading bytes, else null."""
    head = F.hex(F.substring(content, 1, 12))
    return F.when(head.startswith("FFD8FF"), "JPEG").when(head.startswith("89504E470D0A1A0A"),
        "PNG").when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "WEBP")


def media_type(path: Column) -> Column:
    e = extension(path)
    return F.when(e.isin(".jpg", ".jpeg"), "image/jpeg").when(e == ".png", "image/png").when(e == ".webp", "image/webp").otherwise("application/octet-stream")


def internal_id(idx: Column) -> Column:
    return F.format_string("s%07d", idx)
