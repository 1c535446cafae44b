"""SimHash near-duplicate detection with multi-index hashing.

A fingerprint has 64 bits; two documents are linked if their fingerprints differ in at most
`distance` bits. The bits are cut into segments with a radius each, such that the radii plus one sum to
distance + 1 at least: by the pigeonhole principle linked fingerprints lie within the radius in some
segment. Every distinct fingerprint is entered once in the table of each segment with a small Hamming ball around it; for the search,
the small Hamming ball around each segment's value is enumerated, table matches are fetched by
equi-join and their complete distance is verified inside the join. A pair is emitted at the first
segment that finds it only, so every link comes out once.

Documents with equal fingerprints are one node. Buckets that hold many more nodes than chance gives are dense groups of near
copies: these are tied first, by comparing nodes with some members of each bucket, and the tied members of a bucket's largest group then
meet the others only, so that work and links stay linear in the group. Links stream from the join into a spanning forest within the same task.

Defined results: null and empty texts have no shingles and fingerprint zero, which links as any other; a
text of fewer words than a shingle is one shingle of all its words; repeated shingles
count as often as they occur; rows that repeat each get a row; null ids are components of
their own unless an equal or linked fingerprint has an id; extra columns are ignored whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from .common import PART_BYTES, arrow_limits, id_and_text, mark, materialize, parts, release

BITS = 64
LANES = np.uint64(0x0101010101010101)
BLOCK = 4080


def bit_counts(digests: bytes) -> np.ndarray:
    """How many of the 8-byte digests have each bit set."""
    counts = np.zeros((8, 8), np.int64)  # [bit of byte, byte]
    h = np.frombuffer(digests, np.uint64)
    for j in range(8 if len(h) else 0):
        lanes = np.add.reduceat((h >> np.uint64(j)) & LANES, np.arange(0, len(h), 255))  # a byte lane holds up to 255
        counts[7 - j] = lanes.view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
    return counts.T.reshape(64)


def majority(counts: np.ndarray, n: int) -> bytes:
    """8 bytes: bit set where more than half of n digests have it set."""
    return np.packbits(counts * 2 > n).tobytes()


def shingle_digests(text: bytes, size: int, short: bool = True) -> bytes:
    """The XXH64 digests (seed 42) of all word shingles of a text, in order; short: of fewer words those of the whole sequence."""
    norm = b" ".join(text.lower().split())
    if not norm:
        return b""
    gaps = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
    starts = [0, *(gaps + 1).tolist()]
    ends = [*gaps.tolist(), len(norm)]
    digest = xxhash.xxh64_digest
    if len(starts) < size:
        return digest(norm, 42) if short else b""
    return b"".join([digest(norm[a:b], 42) for a, b in zip(starts, ends[size - 1 :])])  # noqa: B905


def simhash(text: bytes, size: int) -> bytes:
    digests = shingle_digests(text, size)
    return majority(bit_counts(digests), len(digests) // 8)


def fingerprints(docs: DataFrame, size: int = 4, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id and fp, the fingerprint as a long of the same bits. Longer texts than part_bytes are counted in parts."""
    arrow_limits(docs.sparkSession)

    def run(batches):
        counts, n = np.zeros(64, np.int64), 0
        for rows, raw, offs, before, last in parts(batches, size, part_bytes):
            data = raw.tobytes()
            if n or not last:
                digests = shingle_digests(data, size, False)
                counts, n = counts + bit_counts(digests), n + len(digests) // 8
                if not last:
                    continue
                out = majority(counts, n)
                counts, n = np.zeros(64, np.int64), 0
            else:
                out = b"".join([simhash(data[a:b], size) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)])
            yield pa.record_batch([rows.column("doc_id"), pa.array(np.frombuffer(out, ">i8").astype(np.int64))], names=["doc_id", "fp"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, fp long")


def ball_size(width: int, radius: int) -> int:
    out, term = 1, 1
    for i in range(1, radius + 1):
        term = term * (width - i + 1) // i
        out += term
    return out


def segments(distance: int, n: int) -> list[tuple[int, int, int]]:
    """(shift, width, radius) of each segment, for n fingerprints: the plan with the least rows and chance matches."""
    best = None
    for m in range(1, distance + 2):
        widths = [BITS // m + (i < BITS % m) for i in range(m)]
        radii = [distance // m - (i > distance % m) for i in range(m)]  # the radii plus one sum to distance + 1
        balls = [(ball_size(w, r - r // 2), ball_size(w, r // 2), w) for w, r in zip(widths, radii, strict=True) if r >= 0]
        cost = sum(10 * (q + e) + q * e * n / 2**w for q, e, w in balls)
        if best is None or cost < best[0]:
            best = cost, [(sum(widths[:i]), w, r) for i, (w, r) in enumerate(zip(widths, radii, strict=True)) if r >= 0]
    return best[1]


def masks(width: int, radius: int) -> list[int]:
    """All flips of up to `radius` bits within `width` bits."""
    out = [(0, 0)]  # (mask, first bit that may be flipped next)
    done = []
    for _ in range(radius + 1):
        done += [m for m, _ in out]
        out = [(m | 1 << b, b + 1) for m, first in out for b in range(first, width)]
    return done


def part(fp: F.Column, shift: int, width: int) -> F.Column:
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1 if width < BITS else -1))


def ball(segment: int, value: F.Column, flips: list[int]) -> F.Column:
    """The values around `value` that the flips reach, as an array of (segment, value, flip)."""
    return F.transform(F.array(*[F.lit(m).cast("long") for m in flips]),
        lambda m: F.struct(F.lit(segment).alias("segment"), value.bitwiseXOR(m).alias("value"), m.alias("flip")))


def _entries(nodes: DataFrame, plan: list[tuple[int, int, int]], search: bool) -> DataFrame:
    """The nodes with (segment, value, flip) for every value in the balls of the search or of the table."""
    radius = lambda r: r - r // 2 if search else r // 2
    balls = [ball(i, part(F.col("fp"), s, w), masks(w, radius(r))) for i, (s, w, r) in enumerate(plan)]
    return nodes.select("*", F.inline(F.concat(*balls)))


def links(nodes: DataFrame, distance: int, n: int, tied: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Pairs (a, b), a < b, of nodes (node, fp) with fingerprints within `distance`; n: the number of nodes.
    The ball of radius r around a segment's value is enumerated from both ends: the table holds the ball of
    radius r // 2 around its values, the search that of the rest. Of the ways to meet only one counts: the search flips the
    lowest of the bits that differ, as many as it may, and the table the others.

    tied: (node, group) of nodes whose links are known to connect them, and (segment, value, main) of buckets and a group that
    is large there: members of `main` don't meet each other in the bucket.
    """
    plan = segments(distance, n)
    q, e = _entries(nodes, plan, True), _entries(nodes, plan, False)
    if tied:
        groups, main = tied
        q, e = (x.join(groups, "node", "left").join(main, ["segment", "value"], "left") for x in (q, e))
        own = F.coalesce(F.col("group") == F.col("main"), F.lit(False))
        q = q.withColumn("side", F.explode(F.when(F.col("main").isNull() | own, F.array(F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1)))))
        e = e.withColumn("side", F.when(own, 0).otherwise(1))
    else:
        q, e = (x.withColumn("side", F.lit(1)) for x in (q, e))
    q = q.select(F.col("node").alias("a"), F.col("fp").alias("fp_a"), "segment", "value", "flip", "side").alias("q")
    e = e.select(F.col("node").alias("b"), F.col("fp").alias("fp_b"), "segment", "value", "flip", "side").alias("e")
    differ = F.col("fp_a").bitwiseXOR(F.col("fp_b"))
    first, most = F.lit(len(plan)), F.lit(0)
    for i, (s, w, r) in reversed(list(enumerate(plan))):
        first = F.when(F.bit_count(part(differ, s, w)) <= r, F.lit(i)).otherwise(first)
        most = F.when(F.col("q.segment") == i, F.lit(r - r // 2)).otherwise(most)
    flip, rest = F.col("q.flip"), F.col("e.flip")
    lowest = (rest == 0) | ((F.bit_count(flip) == most) & (flip < rest.bitwiseAND(-rest)))
    met = (F.col("q.segment") == F.col("e.segment")) & (F.col("q.value") == F.col("e.value"))
    if tied:
        met &= F.col("q.side") == F.col("e.side")
    return q.join(e, met & (F.col("a") < F.col("b")) & (F.bit_count(differ) <= distance) & lowest & (first == F.col("q.segment"))).select("a", "b")


#: A bucket is dense with DENSE entries and EXCESS times as many as chance gives: below, comparing all its entries costs each of them a
#: bounded time. In a turn each node meets MEMBERS of a bucket. Turns go on while the search would look at DENSE pairs for
#: each entry of dense buckets and a turn halves them. All bear on the work alone.
DENSE, EXCESS, MEMBERS = 4096, 8, 4


def stars(nodes: DataFrame, distance: int, n: int, dense: int = DENSE) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """Ties in dense buckets: pairs (a, b) within `distance`, linear in the entries; what links() takes as `tied`. None without dense buckets.

    In each turn every node meets a few members of each bucket it is in, drawn by hashes; what is within the distance is tied."""
    plan = segments(distance, n)
    table = _entries(nodes, plan, False).select("node", "fp", "segment", "value")
    chance = max(n * ball_size(w, r // 2) / 2**w for _, w, r in plan)
    full = table.groupBy("segment", "value").agg(F.count("*").alias("n")).filter(F.col("n") >= max(dense, EXCESS * chance))
    full = materialize(full.select("segment", "value"), "dense")
    if full.isEmpty():
        return None
    entries = materialize(table.join(full, ["segment", "value"], "left_semi"), "entries")
    many, found, groups, turn, before = entries.count(), None, None, 0, math.inf
    while True:
        drawn = [F.max_by(F.struct("node", "fp"), F.struct(F.xxhash64("node", F.lit(MEMBERS * turn + i)), "node")) for i in range(MEMBERS)]
        picked = entries.groupBy("segment", "value").agg(F.array_distinct(F.array(*drawn)).alias("drawn")).select("segment", "value", F.inline("drawn"))
        x, y = entries.alias("x"), materialize(picked, "picked").alias("y").hint("merge")
        met = (F.col("x.segment") == F.col("y.segment")) & (F.col("x.value") == F.col("y.value")) & (F.col("x.node") != F.col("y.node"))
        near = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= distance
        pairs = x.join(y, met & near).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
        pairs = materialize(pairs, "ties")
        found = pairs if found is None else found.unionByName(pairs)
        groups = materialize(components(found), "tied").select("node", F.col("component").alias("group"))
        sizes = entries.join(groups, "node", "left").groupBy("segment", "value", F.coalesce("group", "node").alias("group")).agg(F.count("*").alias("n"))
        main = sizes.groupBy("segment", "value").agg(F.max_by("group", F.struct("n", "group")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("all"))
        main = materialize(main, "main")
        work = main.agg(F.sum((F.col("all") - F.col("most")) * F.col("all"))).first()[0]
        if work <= dense * many or work > before / 2:
            return found, groups, main.select("segment", "value", "main")
        turn, before = turn + 1, work


def connected(nodes: DataFrame, distance: int, n: int, dense: int = DENSE) -> DataFrame:
    """(node, component) by the links of nodes (node, fp) within `distance`."""
    ties = stars(nodes, distance, n, dense)
    if ties is None:
        return components(links(nodes, distance, n))
    found, groups, main = ties
    return components(links(nodes, distance, n, (groups, main)).unionByName(found))


def near_duplicates(docs: DataFrame, size: int = 4, distance: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable)."""
    since = mark()
    prints = materialize(fingerprints(docs, size), "prints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    groups = connected(nodes.select(F.col("fp").alias("node"), "fp"), distance, nodes.count()).withColumnRenamed("node",
        "fp").withColumnRenamed("component", "group")
    named = materialize(nodes.join(groups, "fp", "left").select("fp", F.coalesce("group", "fp").alias("group"), "least"), "grouped")
    ids = named.groupBy("group").agg(F.min("least").alias("component_id"))
    by_fp = named.select("fp", "group").join(ids, "group").select("fp", "component_id")
    out = materialize(prints.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"), "components")
    release(docs.sparkSession, since)
    return out
