"""Best-fit packing into sequences of bounded length, with certified partitions.

Pieces are dealt to partitions of about PART_ROWS by a hash. Each partition packs its own by best-fit
decreasing and bounds its optimum from below by dual feasible functions. Where bins exceed the bound, the partition takes its loose bins and ever more
of its full ones apart and fills them again, each bin about its largest piece as fully as any others allow, until the bound is met
or EFFORT pieces have been taken apart. A partition whose bin count meets the bound is certified: its bins are final but for the emptiest
one. The loose bins of partitions with a gap, and those emptiest bins, give their pieces back; these are exchanged: dealt
anew to fewer partitions and packed again, until one partition holds all that is left, or PATIENCE rounds in a row have brought neither a smaller gap
nor fewer pieces. What came of it is told with each piece: whether the partition that packed its sequence was certified, and how many bins it has
above its bound (the gap).

Only longer documents are cut, into full sequences and one rest. Token ids never move: a row has a piece's length and checksum.

Defined results: a null or empty text is a document of the end id alone; rows that repeat are packed
each; null ids are packed as any; an empty table gives no rows; extra columns are ignored whatever their names.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, chunks, id_and_text, mark, materialize, release
from .tokens import encoder

#: Pieces that one task packs.
PART_ROWS = 20_000
#: Pieces that a partition with a gap takes apart in all, and rounds without a gain after which the exchange ends.
EFFORT, PATIENCE = 20_000, 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", number long, sequence_id long, offset long, certified boolean, gap int, final boolean"


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and the fill of each bin. Among bins that fit, the fullest takes the item."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by the room they have
    rooms, fills = 0, []  # bit r of rooms: some bin has room r
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(fills)
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += size
        if room > size:
            by_room[room - size].append(b)
            rooms |= 1 << (room - size)
    return bins, offsets, np.array(fills, np.int64)


def fullest(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers: each has the largest item left, and of the rest those that fill it as far as any do, large ones first."""
    by_length: dict[int, list[int]] = {}
    for i in np.argsort(lengths, kind="stable").tolist():
        by_length.setdefault(int(lengths[i]), []).append(i)
    sizes, out = sorted(by_length, reverse=True), []
    while sizes:
        bin_items, room = [by_length[sizes[0]].pop()], capacity - sizes[0]
        sums, steps, mask = 1, [], (1 << room + 1) - 1  # bit s of sums: some of the items looked at have the sum s
        for size in reversed(sizes):  # the smallest first, so that the way back takes the largest first
            if size > room:
                break
            for _ in range(min(len(by_length[size]), room // size)):
                steps.append((size, sums))
                sums |= (sums << size) & mask
            if sums >> room & 1:
                break
        at = sums.bit_length() - 1
        for size, before in reversed(steps):
            if at and not before >> at & 1:
                bin_items.append(by_length[size].pop())
                at -= size
        out.append(bin_items)
        sizes = [s for s in sizes if by_length[s]]
    return out


def tightened(lengths: np.ndarray, capacity: int, bins: np.ndarray, fills: np.ndarray, bound: int, effort: int = EFFORT) -> np.ndarray:
    """The bin of each item after the loose bins, and then twice as many full ones each time, have been filled anew; no more bins than before."""
    full, spent = 0, 0
    while len(fills) > bound:
        order = np.argsort(fills, kind="stable")  # the emptiest first; of full bins the ones opened last, which have the smallest items
        loose = int((fills < capacity).sum())
        order = np.concatenate([order[:loose], order[loose:][::-1][:full]])
        apart = np.flatnonzero(np.isin(bins, order))
        spent += len(apart)
        if spent > effort and full:
            break
        again = fullest(lengths[apart], capacity)
        if len(again) <= len(order):
            names = np.concatenate([order[: len(again)]])
            for name, items in zip(names.tolist(), again, strict=True):
                bins[apart[items]] = name
            left = np.unique(bins)
            bins = np.searchsorted(left, bins)
            fills = np.bincount(bins, lengths, len(left)).astype(np.int64)
        if len(order) == len(fills) and full >= len(fills):
            break
        full = max(2 * full, 4)
        if full > 2 * len(fills):
            break
    return bins


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The largest bound on the bin count that the dual feasible functions give.

    For a function f with sum f(x) <= 1 over every set that fits a bin, sum f over all items bounds the bins. Taken are
    those that round items beyond capacity - t up to a whole bin and drop those below t, for each t up to half
    the capacity, alone and after the rounding to k-ths that keeps multiples of 1/(k + 1), for k up to 12.
    """
    counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1)
    best = 0
    below = np.concatenate([[0], np.cumsum(counts)])
    for k in range(13):
        if k:
            part, rest = np.divmod((k + 1) * x, capacity)  # in units of 1 / (capacity * k)
            value = np.where(rest == 0, x * k, part * capacity)
        else:
            value = x
        unit = capacity * max(k, 1)
        if k:
            # composed with the threshold function: whole bins keep 1, dropped items 0, others value(x)
            worth = np.concatenate([[0], np.cumsum(counts * value)])
        else:
            worth = np.concatenate([[0], np.cumsum(counts * x)])
        t = np.arange(capacity // 2 + 1)
        whole = below[-1] - below[capacity - t + 1]
        middle = worth[capacity - t + 1] - worth[t]
        best = max(best, int(np.max(-(-(whole * unit + middle) // unit))))
    return best


def places(lengths: np.ndarray, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offset of each item in its bin, in the order of items, and the fill of each bin."""
    order = np.argsort(bins, kind="stable")
    ends = np.cumsum(lengths[order])
    fills = np.bincount(bins, lengths).astype(np.int64)
    offsets = np.empty(len(bins), np.int64)
    offsets[order] = ends - lengths[order] - (np.cumsum(fills) - fills)[bins[order]]
    return offsets, fills


def pieces(docs: DataFrame, tokenizer: str, cut: str, capacity: int, end: int = 0) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32."""
    arrow_limits(docs.sparkSession)

    def run(batches):
        own = encoder(tokenizer, cut, end)
        for rows, raw, offs in chunks(batches):
            ids, at = own.encode(raw, offs)
            n = -(-np.diff(at) // capacity)
            doc = np.repeat(np.arange(len(n)), n)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(np.diff(at)[doc] - start, capacity)
            data, a = memoryview(ids.astype("<u4").tobytes()), (at[doc] + start) * 4
            crc = [zlib.crc32(data[p:q]) for p, q in zip(a.tolist(), (a + length * 4).tolist(), strict=True)]
            yield pa.record_batch([rows.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length),
                pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return id_and_text(docs).mapInArrow(run, PIECES)


def packer(capacity: int, r: int, last: bool):
    """Packs the pieces of one partition in round r; `last` makes every bin final."""

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        lengths = group.column("length").to_numpy().astype(np.int64)
        bins, offsets, fills = best_fit_decreasing(lengths, capacity)
        bound = lower_bound(lengths, capacity)
        if len(fills) > bound:
            bins = tightened(lengths, capacity, bins, fills, bound)
            offsets, fills = places(lengths, bins)
        kept = fills == capacity
        gap = len(fills) - bound
        if last:
            kept[:] = True
        elif not gap:
            kept[:] = True
            kept[np.argmin(fills)] = False
        ids, n = (r << 58) + (key[0].as_py() << 32) + bins, len(bins)
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "number"]
        told = [pa.array(np.full(n, not gap)), pa.array(np.full(n, gap, np.int32)), pa.array(kept[bins])]
        return pa.table([*[group.column(c) for c in names], pa.array(ids), pa.array(offsets), *told],
            names=[*names, "sequence_id", "offset", "certified", "gap", "final"])

    return run


def pack(items: DataFrame, capacity: int, part_rows: int = PART_ROWS) -> DataFrame:
    """Adds sequence_id, offset, certified and gap to rows of pieces(). Pieces are dealt by their number in the table, so no id is a hot partition."""
    spark, since = items.sparkSession, mark()
    arrow_limits(spark)
    left = materialize(items.withColumn("number", F.monotonically_increasing_id()), "pieces")
    n, done, before, idle = left.count(), [], None, 0
    for r in itertools.count():
        parts = -(-n // part_rows)
        last = parts <= 1 or idle >= PATIENCE
        dealt = left.withColumn("part", F.pmod(F.xxhash64("number", F.lit(r)), F.lit(max(parts, 1))).cast("long"))
        packed = materialize(dealt.groupBy("part").applyInArrow(packer(capacity, r, last), PACKED), "packed")
        done.append(packed.filter("final").drop("final", "number"))
        if last:
            break
        left = packed.filter("not final").select(*left.columns)
        bins = packed.groupBy(F.shiftright("sequence_id", 32).alias("part")).agg(F.max("gap").alias("gap"))
        now = (bins.agg(F.sum("gap")).first()[0], left.count())
        idle = 0 if before is None or now[0] < before[0] or now[1] < before[1] else idle + 1
        before, n = now, now[1]
        if not n:
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    out = materialize(out, "sequences")
    release(spark, since)
    return out


def pack_documents(docs: DataFrame, tokenizer: str, cut: str = "words", capacity: int = 2048, end: int = 0, part_rows: int = PART_ROWS) -> DataFrame:
    return pack(pieces(docs, tokenizer, cut, capacity, end), capacity, part_rows)
