"""Samples from image files: digest, size, format, perceptual hash and descriptor; unreadable files are kept as corrupt.

What a file's header says decides before anything is decoded: format, size in pixels, and whether it is whole. Only files that pass are given to Spark's
image source, which reads JPEG, PNG and what else the JVM reads; other formats are marked unsupported."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model as M
from ..functions import headers as H
from ..functions import images as I
from ..functions import paths as P
from ..operators.order import numbered
from ..storage import materialize

DECODED = ("JPEG", "PNG")
TOO_MANY_PIXELS = "image of %d pixels exceeds the limit of %d"


def facts(spark: SparkSession, root: str) -> DataFrame:
    """origin (as the file listing has it), sha256 and header of every file below root, in one pass over their bytes; written once."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return materialize(files.select(F.col("_metadata.file_path").alias("origin"), F.sha2("content", 256).alias("sha256"),
        H.image_header(F.col("content")).alias("header")), "headers")


def refusal(limits: M.Limits) -> F.Column:
    """Why a file isn't decoded, null if it is."""
    pixels = F.col("header.width") * F.col("header.height")
    return (
        F.when(F.col("header.format").isNull(), "not a recognised image")
        .when(~F.col("header.format").isin(*DECODED), F.concat(F.lit("unsupported format "), "header.format"))
        .when(pixels > limits.image_pixels, F.format_string(TOO_MANY_PIXELS, pixels, F.lit(limits.image_pixels)))
        .when(~F.col("header.complete"), "image file is truncated")
    )


def decoded(spark: SparkSession, root: str, refused: Sequence[str] = ()) -> DataFrame:
    """path and image struct of the files below root but for those refused, which aren't opened; height is -1 where decoding failed.

    refused: origins, as facts() has them. The listing of files leaves them out; they are part of that listing, which the driver holds anyway."""
    images = spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true").load(root)
    return (images.filter(~F.col("_metadata.file_path").isin(list(refused))) if refused else images).select("image.origin", "image")


def normal_path(path: F.Column) -> F.Column:
    return F.regexp_replace(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "^file:/*", "/")


def samples(spark: SparkSession, root: str, files: DataFrame, vectors: str = "auto", limits: M.Limits = M.Limits()) -> DataFrame:
    """files: accepted entries of folder_entries(root), or of extract() with root their folder. One row each, numbered in their order. vectors: a
    provider's name.

    What is told of a picture and of a file is computed where each is read; only that is joined, neither pixels nor contents. A file whose header
    refuses it, as it is no
    picture that can be read, is cut short or has more than limits.image_pixels, is not decoded: it counts as corrupt."""
    _, vectorise = I.provider(vectors)
    base = "/" + root.rstrip("/").removeprefix("file://").removeprefix("file:").lstrip("/") + "/"
    below = lambda origin: F.substr(normal_path(F.col(origin)), F.lit(len(base) + 1)).alias("file")
    known = facts(spark, root).withColumn("refusal", refusal(limits))
    refused = [r.origin for r in known.filter("refusal is not null").select("origin").collect()]
    told = [
        F.col("image.height").alias("decoded"), I.phash(F.col("image")).alias("phash"),
        (vectorise(F.col("image")) if vectorise else F.lit(None).cast("array<float>")).alias("embedding"),
    ]
    pictures = decoded(spark, root, refused).select(below("origin"), *told)
    own = files.select("sample_id", "split", "label", "path",
        F.coalesce("file", "path").alias("file") if "file" in files.columns else F.col("path").alias("file"), "size")
    made = own.join(known.select(below("origin"), "sha256", "header", "refusal"), "file", "left").join(pictures, "file", "left")
    made = made.withColumn("error", F.coalesce("refusal", F.when(F.coalesce("decoded", F.lit(-1)) <= 0, "cannot be decoded")))
    made = made.join(numbered(files.select("sample_id"), "sample_id", "idx"), "sample_id")
    good = lambda c, name: F.when(F.col("error").isNull(), F.col(c)).alias(name)
    return made.select(
        "idx", "sample_id", "split", "label", F.col("path").alias("rel_path"), "sha256", good("phash", "phash"), good("header.width", "width"),
            good("header.height", "height"),
        F.col("size").cast("bigint").alias("bytes"), F.col("header.format").alias("img_format"), F.col("error").isNotNull().alias("corrupt"),
            F.substring("error", 1, 160).alias("error"),
        good("embedding", "embedding"),
    )


class SampleNotFound(KeyError):
    """There is no sample of this id, or its file has gone."""


def sample_content(scanned: DataFrame, sample_id: str) -> DataFrame:
    """The content and media type of one sample."""
    return scanned.filter(F.col("sample_id") == sample_id).select("sample_id", P.media_type(F.col("path")).alias("media_type"), "content")


def fetch(scanned: DataFrame, sample_id: str) -> tuple[str, bytes]:
    """The media type and content of one accepted sample. Raises SampleNotFound for an id that isn't there, was rejected, or whose content is gone."""
    accepted = scanned.filter(F.col("reject_reason").isNull()) if "reject_reason" in scanned.columns else scanned
    found = sample_content(accepted, sample_id).head(1)
    if not found or found[0].content is None:
        raise SampleNotFound(sample_id)
    return found[0].media_type, bytes(found[0].content)
