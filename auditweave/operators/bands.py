"""Pairs of 64-bit hashes within a Hamming distance, by bands of bits with distances of their own.

A pair within distance t differs by t_i bits at most in some band i, if the t_i + 1 sum up to t + 1 (a band with t_i = -1 isn't looked at). One
side has each band's value, the other all values within t_i of it; they meet by equi-join. How the distances are dealt to the bands is chosen by
the data: the frequencies of a band's values, 2 ** width of them at most, tell exactly how many pairs a band would bring to each other at each distance."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import BITS, hamming
from ..storage import materialize

#: Bits of the widest band, whose frequencies the driver holds, and the largest distance that is enumerated in one.
WIDEST, FARTHEST = 16, 3
#: Hashes whose bands are counted, when there are more.
SAMPLED = 1 << 20
#: Hashes of one value of a band that meet others as one row.
CHUNK = 1024
#: Numbers of bands that are weighed against each other.
BANDS = (4, 5, 6, 8, 11, 16, 22)


@dataclass(frozen=True)
class Band:
    shift: int
    width: int
    distance: int

    def of(self, h: Column) -> Column:
        return F.shiftrightunsigned(h, self.shift).bitwiseAND(F.lit((1 << self.width) - 1))

    def masks(self) -> list[int]:
        """All differences of up to `distance` bits."""
        return [sum(1 << b for b in bits) for n in range(self.distance + 1) for bits in combinations(range(self.width), n)]


def layout(count: int) -> list[tuple[int, int]]:
    """(shift, width) of bands of nearly equal widths."""
    widths = [BITS // count + (i < BITS % count) for i in range(count)]
    return [(sum(widths[:i]), w) for i, w in enumerate(widths)]


def meetings(frequency: np.ndarray, farthest: int) -> np.ndarray:
    """How many ordered pairs of rows differ by exactly 0, 1 ... farthest bits, for the counts of each value: their autocorrelation by a
    Walsh-Hadamard transform."""
    a, n = frequency.astype(np.float64), len(frequency)
    step = 1
    while step < n:
        pairs = a.reshape(-1, 2, step)
        a = np.stack([pairs[:, 0] + pairs[:, 1], pairs[:, 0] - pairs[:, 1]], axis=1).reshape(-1)
        step *= 2
    a = a * a
    step = 1
    while step < n:
        pairs = a.reshape(-1, 2, step)
        a = np.stack([pairs[:, 0] + pairs[:, 1], pairs[:, 0] - pairs[:, 1]], axis=1).reshape(-1)
        step *= 2
    far = np.array([int(x).bit_count() for x in range(n)])
    return np.bincount(far, a / n, max(farthest, int(far.max())) + 1)[: farthest + 1]


def allotted(costs: list[list[float]], threshold: int) -> tuple[float, list[int]]:
    """The distances (from -1) whose sum of (distance + 1) is threshold + 1 and whose cost is least; costs[i][d + 1] is band i's at distance d."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for n, more in enumerate(own):
                if used + n <= threshold + 1:
                    way = (cost + more, [*chosen, n - 1])
                    if used + n not in new or way[0] < new[used + n][0]:
                        new[used + n] = way
        best = new
    return best.get(threshold + 1, (float("inf"), []))


def plan(values: DataFrame, threshold: int) -> tuple[list[Band], float]:
    """The bands to look at, and the pairs and enumerated rows that are to be expected. values: h, distinct."""
    counts = [c for c in BANDS if c <= threshold + 1 and -(-BITS // c) <= WIDEST] or [max(4, threshold + 1)]
    bands = [(c, i, Band(shift, width, 0)) for c in counts for i, (shift, width) in enumerate(layout(c))]
    share = min(1.0, SAMPLED / max(1, values.count()))
    some = values if share == 1.0 else values.filter(F.shiftrightunsigned(F.xxhash64("h"), 11) < share * (1 << 53))  # what is chosen changes the work alone
    told = some.select(F.inline(F.array(*[F.struct(F.lit(n).alias("band"), b.of(F.col("h")).cast("int").alias("value")) for n, (_, _, b) in enumerate(bands)])))
    rows = told.groupBy("band", "value").agg(F.count("*").alias("n")).toArrow()  # 2 ** width for each band at most
    band, value, n = (rows.column(c).to_numpy() for c in ("band", "value", "n"))
    total, ways = float(n[band == 0].sum()), []
    for c in counts:
        costs, own = [], [(k, b) for k, (count, _, b) in enumerate(bands) if count == c]
        for k, b in own:
            frequency = np.zeros(1 << b.width)
            frequency[value[band == k]] = n[band == k]
            farthest = min(FARTHEST, b.width)
            met = np.cumsum(meetings(frequency, farthest)) / 2
            balls = [sum(1 for _ in combinations(range(b.width), d)) for d in range(farthest + 1)]
            costs.append([0.0, *(met + total * (1 + np.cumsum(balls))).tolist()])
        cost, distances = allotted(costs, threshold)
        ways.append((cost, [Band(b.shift, b.width, d) for (_, b), d in zip(own, distances, strict=False) if d >= 0]))
    cost, chosen = min(ways, key=lambda w: w[0])
    return chosen, cost


def _chunks(distinct: DataFrame, bands: list[Band]) -> tuple[DataFrame, DataFrame]:
    """band, value, chunk, hs: the hashes of each value of a band, CHUNK or so to a row; and (band, value, chunks) where there are several."""
    own = materialize(distinct.select("h", F.inline(F.array(
        *[F.struct(F.lit(i).alias("band"), b.of(F.col("h")).alias("value")) for i, b in enumerate(bands)]))), "banded")
    large = own.groupBy("band", "value").agg(F.ceil(F.count("*") / CHUNK).alias("chunks")).filter("chunks > 1")
    large = materialize(large, "large-values")  # a row for CHUNK hashes at most
    chunk = F.pmod(F.xxhash64("h"), F.coalesce("chunks", F.lit(1)))
    dealt = own.join(F.broadcast(large), ["band", "value"], "left").groupBy("band", "value", chunk.alias("chunk"))
    return materialize(dealt.agg(F.collect_list("h").alias("hs")), "chunks"), large


def pairs(values: DataFrame, bands: list[Band], threshold: int) -> DataFrame:
    """h, k, d: pairs of distinct values, h < k, within the threshold, each at the first band that brings it.

    Balls are enumerated around a band's values, not around hashes, and chunks of hashes meet. The sizes that Spark expects of the enumerated rows
    leave their number out, so the join is told to be a merge: nothing of it goes through the driver."""
    chunks, large = _chunks(values.select("h"), bands)
    ball = F.lit(None).cast("array<bigint>")
    for i, b in enumerate(bands):
        ball = F.when(F.col("band") == i, F.array(*[F.lit(m).cast("bigint") for m in b.masks()])).otherwise(ball)
    # the smaller of two values is the one side's, so two chunks meet once; every chunk of it is a key of its own
    other = chunks.select("band", F.col("value").alias("from"), F.col("chunk").alias("nth"), F.col("hs").alias("ys"), F.explode(ball).alias("mask"))
    other = other.withColumn("value", F.col("from").bitwiseXOR(F.col("mask"))).filter("value <= from").drop("mask")
    other = other.join(F.broadcast(large), ["band", "value"], "left")
    other = other.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("chunks", F.lit(1)) - 1))).drop("chunks")
    met = chunks.hint("merge").join(other, ["band", "value", "chunk"]).filter("value < from or chunk <= nth")
    met = met.withColumn("twice", (F.col("value") == F.col("from")) & (F.col("chunk") == F.col("nth")))
    x, y = F.col("x"), F.col("y")
    met = met.select("band", "twice", "ys", F.explode("hs").alias("x")).select("band", "twice", "x", F.explode("ys").alias("y"))
    met = met.filter((hamming(x, y) <= threshold) & ((x < y) | ~F.col("twice")))
    first = F.lit(len(bands))
    for i in reversed(range(len(bands))):
        first = F.when(F.bit_count(bands[i].of(x.bitwiseXOR(y))) <= bands[i].distance, F.lit(i)).otherwise(first)
    met = met.filter(first == F.col("band"))
    return met.select(F.least("x", "y").alias("h"), F.greatest("x", "y").alias("k"), hamming(x, y).alias("d"))
