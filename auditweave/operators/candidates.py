"""Candidate pairs by digest, by Hamming distance and by cosine: a, b (a < b), method, distance, similarity."""

from __future__ import annotations

from pyspark import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.hashing import hamming, similarity
from ..storage import materialize
from . import bands
from .neighbours import BLOCK_ROWS, lists

#: Rows up to which the smaller side of a search goes to every task: 16 bytes each, so 3 MB at most.
NESTED_ROWS = 200_000


def usable(samples: DataFrame, column: str) -> DataFrame:
    return samples.filter(~F.col("corrupt") & F.col(column).isNotNull())


def exact_groups(samples: DataFrame) -> DataFrame:
    """sha256, n, first_idx of digests that more than one sample has."""
    return usable(samples, "sha256").filter("sha256 <> ''").groupBy("sha256").agg(F.count("*").alias("n"), F.min("idx").alias("first_idx")).filter("n > 1")


def exact_pairs(samples: DataFrame) -> DataFrame:
    """All pairs of equal digests. Digests that occur once leave before the join."""
    own = usable(samples, "sha256").filter("sha256 <> ''").select("idx", "sha256")
    own = own.join(exact_groups(samples).select("sha256"), "sha256", "left_semi")
    a, b = own.select(F.col("idx").alias("a"), "sha256"), own.select(F.col("idx").alias("b"), "sha256")
    return a.join(b, "sha256").filter("a < b").select("a", "b", F.lit("sha256").alias("method"), F.lit(0.0).alias("distance"), F.lit(1.0).alias("similarity"))


def _near(pairs: DataFrame) -> DataFrame:
    d = hamming(F.col("h"), F.col("k"))
    return pairs.select("a", "b", F.lit("phash").alias("method"), d.cast("double").alias("distance"), F.round(similarity(d), 6).alias("similarity"))


def hamming_nested(samples: DataFrame, threshold: int) -> DataFrame:
    """Every pair is compared, in a nested loop over a broadcast of at most NESTED_ROWS (idx, hash)."""
    own = usable(samples, "phash")
    a, b = own.select(F.col("idx").alias("a"), F.col("phash").alias("h")), own.select(F.col("idx").alias("b"), F.col("phash").alias("k"))
    return _near(a.join(F.broadcast(b), (F.col("a") < F.col("b")) & (hamming(F.col("h"), F.col("k")) <= threshold)))


def value_pairs(values: DataFrame, threshold: int) -> DataFrame:
    """h, k, d: pairs of distinct hashes (column h), h < k, within the threshold, by bands that the hashes' own frequencies choose."""
    if threshold < 1:
        return values.select("h", F.col("h").alias("k"), F.lit(0).alias("d")).limit(0)
    chosen, _ = bands.plan(values, threshold)
    return bands.pairs(values, chosen, threshold)


def hamming_banded(samples: DataFrame, threshold: int) -> DataFrame:
    """Pairs of hashes by bands, then of their samples. Equal hashes are one row until the end."""
    own = usable(samples, "phash").select("idx", F.col("phash").alias("h"))
    values = materialize(own.groupBy("h").agg(F.count("*").alias("n")), "hashes")
    found = value_pairs(values.select("h"), threshold).select("h", "k").unionByName(values.filter("n > 1").select("h", F.col("h").alias("k")))
    # merges: a caller's plan would broadcast both sides, through the driver, up to some size
    sides = found.join(own.withColumnRenamed("idx", "i").hint("merge"), "h").join(own.select(F.col("h").alias("k"), F.col("idx").alias("j")).hint("merge"), "k")
    sides = sides.filter((F.col("h") != F.col("k")) | (F.col("i") < F.col("j")))
    return _near(sides.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "h", "k"))


def hamming_pairs(samples: DataFrame, threshold: int) -> DataFrame:
    """Nested loop while the hashes fit a small broadcast, bands beyond it. The same pairs either way."""
    few = usable(samples, "phash").select("idx").limit(NESTED_ROWS + 1).count() <= NESTED_ROWS
    return (hamming_nested if few else hamming_banded)(samples, threshold)


def neighbours(samples: DataFrame, top_k: int, threshold: float, visited: tuple[Accumulator, Accumulator] | None = None,
    block_rows: int = BLOCK_ROWS) -> DataFrame:
    """a, b, similarity, rank: of the k + 1 nearest rows by cosine (itself among them) those that aren't a and reach the threshold.

    Ties go to the smaller idx. Blocks of vectors that can hold no such row are not read."""
    near = lists(samples, top_k + 1, threshold, visited, block_rows)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("similarity"), "b")))
    return ranked.filter(F.col("a") != F.col("b")).withColumn("similarity", F.round("similarity", 6))


def cosine_pairs(samples: DataFrame, top_k: int, threshold: float) -> DataFrame:
    """The union of all neighbour lists as undirected pairs."""
    near = neighbours(samples, top_k, threshold)
    pairs = near.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("similarity").alias("similarity"))
    return pairs.select("a", "b", F.lit("embedding").alias("method"), F.round(1 - F.col("similarity"), 6).alias("distance"), "similarity")
