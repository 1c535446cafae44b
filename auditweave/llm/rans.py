"""Token ids in binary blocks: a static range asymmetric numeral system.

One frequency table, counted over the whole corpus and scaled to 2**SCALE, is shared by all blocks. A
block holds whole documents of at least `block_tokens` ids together and is independent of other blocks.
Its ids are dealt to LANES interleaved states that step together. Checkpoints inside a block (states, place in
the word stream, checksum of the ids up to the next one) let segments be decoded in parallel and found out when damaged.

The files are a Parquet dataset at path/blocks, one row for each block, written and read by Spark so that
any store works and lost tasks are simply run again: part, start (ids of the part before the block), n_tokens, doc_ids,
lengths, payload. Parts are ranges of doc_id in ascending order. path/table holds the frequency table. Payload, all little-endian:

    magic 'RNB1', crc32 of the table, ids, lanes, words, segments            6 x uint32
    for each segment: first step, first word, crc32 of its ids, crc32 of its words   4 x uint32
                      states                                                 lanes x uint64
    words                                                                    words x uint32

Defined results: a null or empty text is the end id alone; null ids come first; rows that repeat are written
each; an empty table writes no blocks and reads as no rows; extra columns are ignored whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import arrow_limits, chunks, fresh_path, id_and_text, mark, materialize, release, remove
from .tokens import encoder

MAGIC = int.from_bytes(b"RNB1", "little")
#: 2**SCALE is the sum of all frequencies; the vocabulary must be smaller. States stay in [2**31, 2**63).
SCALE, LOW = 20, np.uint64(1 << 31)
LANES, SEGMENT_STEPS, BLOCK_TOKENS, PART_TOKENS = 512, 128, 1 << 17, 1 << 23
U32 = np.uint64(32)


class Table:
    """Frequencies of all symbols, at least 1 for each that occurs, with sum 2**SCALE."""

    def __init__(self, frequencies: np.ndarray):
        self.freq = frequencies.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(self.freq)])[:-1].astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(frequencies), dtype=np.uint32), frequencies.astype(np.int64))
        self.crc = zlib.crc32(frequencies.astype("<u4").tobytes())

    @classmethod
    def of_counts(cls, counts: np.ndarray) -> Table:
        total, whole = max(int(counts.sum()), 1), 1 << SCALE
        if (counts > 0).sum() > whole:
            raise ValueError("more symbols than the scale has room for")
        freq = np.where(counts > 0, np.maximum(1, counts.astype(np.float64) * (whole / total)), 0).astype(np.int64)
        while (over := int(freq.sum()) - whole) != 0 and freq.any():
            if over < 0:
                freq[np.argmax(freq)] -= over
            else:  # rare symbols were raised to 1: what that takes comes from the common ones in proportion
                spare = freq - 1
                cut = np.minimum(spare, -(-spare * over // int(spare.sum())))
                excess = np.cumsum(cut) - over
                freq -= np.where(excess > 0, np.maximum(cut - excess, 0), cut)
        return cls(freq)


def encode_block(ids: np.ndarray, table: Table, lanes: int = LANES, segment_steps: int = SEGMENT_STEPS) -> bytes:
    n, steps = len(ids), -(-len(ids) // lanes)
    freq, start = table.freq[ids], table.start[ids]
    if n and not freq.all():
        raise ValueError("an id that the table lacks")
    x = np.full(lanes, LOW, np.uint64)
    out: list[np.ndarray] = []  # the words of each step, last step first
    written, marks = 0, []
    for step in range(steps - 1, -1, -1):
        a = step * lanes
        f, c = freq[a : a + lanes], start[a : a + lanes]
        y = x[: len(f)]
        full = y >= f << np.uint64(63 - SCALE)
        words = y[full]
        out.append((words & np.uint64(0xFFFFFFFF)).astype("<u4"))
        written += len(words)
        y = np.where(full, y >> U32, y)
        q = y // f
        x[: len(f)] = (q << np.uint64(SCALE)) + (y - q * f) + c
        if step % segment_steps == 0:
            marks.append((step, written, x.copy()))
    words = np.concatenate(out[::-1]) if out else np.zeros(0, "<u4")
    parts = []
    for i, (step, after, states) in enumerate(reversed(marks)):
        later = marks[len(marks) - 2 - i] if i + 1 < len(marks) else (steps, 0, None)
        own = ids[step * lanes : later[0] * lanes]
        at = written - after
        parts.append(np.array([step, at, zlib.crc32(own.astype("<u4").tobytes()), zlib.crc32(words[at : written - later[1]].tobytes())], "<u4")
            .tobytes() + states.astype("<u8").tobytes())
    return np.array([MAGIC, table.crc, n, lanes, written, len(parts)], "<u4").tobytes() + b"".join(parts) + words.tobytes()


def segments(block: bytes) -> list[int]:
    """First steps of the block's checkpoints."""
    _, _, _, lanes, _, count = np.frombuffer(block, "<u4", 6)
    return [int(np.frombuffer(block, "<u4", 1, 24 + i * (16 + 8 * int(lanes)))[0]) for i in range(count)]


def decode_segment(block: bytes, i: int, table: Table) -> np.ndarray:
    """The ids of segment i alone; raises ValueError if anything is damaged."""
    magic, crc, n, lanes, written, count = (int(v) for v in np.frombuffer(block, "<u4", 6))
    if magic != MAGIC or crc != table.crc:
        raise ValueError("not a block of this table")
    size = 16 + 8 * lanes
    heads = [np.frombuffer(block, "<u4", 4, 24 + k * size) for k in range(count)]
    step, at, ids_crc, words_crc = (int(v) for v in heads[i])
    to_step, to = (int(heads[i + 1][0]), int(heads[i + 1][1])) if i + 1 < count else (-(-n // lanes), written)
    words = np.frombuffer(block, "<u4", to - at, 24 + count * size + 4 * at)
    if zlib.crc32(words.tobytes()) != words_crc:
        raise ValueError("words are damaged")
    x = np.frombuffer(block, "<u8", lanes, 24 + i * size + 16).astype(np.uint64)
    out, p = np.empty(min(to_step * lanes, n) - step * lanes, np.uint32), 0
    mask = np.uint64((1 << SCALE) - 1)
    for a in range(0, len(out), lanes):
        y = x[: min(lanes, len(out) - a)]
        slot = y & mask
        s = table.symbol[slot]
        out[a : a + len(s)] = s
        y = table.freq[s] * (y >> np.uint64(SCALE)) + slot - table.start[s]
        low = np.flatnonzero(y < LOW)
        y[low] = (y[low] << U32) | words[p : p + len(low)]
        p += len(low)
        x[: len(y)] = y
    if zlib.crc32(out.astype("<u4").tobytes()) != ids_crc:
        raise ValueError("ids are damaged")
    return out


def decode_block(block: bytes, table: Table) -> np.ndarray:
    parts = [decode_segment(block, i, table) for i in range(len(segments(block)))]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def token_rows(docs: DataFrame, tokenizer: str, cut: str, end: int | None) -> DataFrame:
    """doc_id, n and the ids as little-endian binary: 16 bits wide where the vocabulary allows it."""
    arrow_limits(docs.sparkSession)
    width = id_width(tokenizer)

    def run(batches):
        own = encoder(tokenizer, cut, end)
        for rows, raw, offs in chunks(batches):
            ids, at = own.encode(raw, offs)
            data = ids.astype(width).tobytes()
            size = np.dtype(width).itemsize
            own_ids = [data[a * size : b * size] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.record_batch([rows.column("doc_id"), pa.array(np.diff(at)), pa.array(own_ids, pa.binary())], names=["doc_id", "n", "ids"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, n long, ids binary")


def vocabulary(tokenizer: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer).get_vocab_size()


def id_width(tokenizer: str) -> str:
    return "<u2" if vocabulary(tokenizer) <= 1 << 16 else "<u4"


def count_ids(tokens: DataFrame, size: int, width: str) -> np.ndarray:
    """Occurrences of each id over all rows. A task sends a row for each id it has seen, so the vocabulary bounds what meets."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for b in batches:
            total += np.bincount(np.frombuffer(b"".join(b.column("ids").to_pylist()), width), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen, pa.int64()), pa.array(total[seen])], names=["id", "n"])

    counts = np.zeros(size, np.int64)
    for r in tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r.id] = r.n
    return counts


BLOCKS = "part int, start long, n_tokens long, doc_ids array<long>, lengths array<long>, payload binary"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, cut: str = "spaced", end: int | None = 0, block_tokens: int = BLOCK_TOKENS,
    part_tokens: int = PART_TOKENS) -> None:
    """Writes the ids of all documents in ascending doc_id order."""
    spark, width, since = docs.sparkSession, id_width(tokenizer), mark()
    tokens = materialize(token_rows(docs, tokenizer, cut, end), "tokens")
    counts = count_ids(tokens, vocabulary(tokenizer), width)
    table = Table.of_counts(counts)
    spark.createDataFrame([(table.freq.astype("<u4").tobytes(), table.crc)], "frequencies binary, crc long").coalesce(1).write.parquet(f"{path}/table")
    held = spark.sparkContext.broadcast(table.freq.astype(np.int64))
    parts = max(int(counts.sum()) // part_tokens + 1, spark.sparkContext.defaultParallelism)

    def run(batches):
        own, part = Table(held.value), TaskContext.get().partitionId()
        ids, doc_ids, lengths, size, start = [], [], [], 0, 0

        def block():
            all_ids = np.concatenate(ids)
            lists = [pa.array([x], pa.list_(pa.int64())) for x in (doc_ids, lengths)]
            columns = [pa.array([part], pa.int32()), pa.array([start]), pa.array([size]), *lists, pa.array([encode_block(all_ids, own)], pa.binary())]
            return pa.record_batch(columns, names=["part", "start", "n_tokens", "doc_ids", "lengths", "payload"])

        for b in batches:
            for doc, n, data in zip(b.column("doc_id").to_pylist(), b.column("n").to_pylist(), b.column("ids").to_pylist(), strict=True):
                ids.append(np.frombuffer(data, width))
                doc_ids.append(doc)
                lengths.append(n)
                size += n
                if size >= block_tokens:
                    yield block()
                    ids, doc_ids, lengths, size, start = [], [], [], 0, start + size
        if doc_ids:
            yield block()

    tied = tokens.withColumn("tie", F.monotonically_increasing_id())  # rows of one id may go to several parts
    ordered = tied.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    ordered.mapInArrow(run, BLOCKS).write.parquet(f"{path}/blocks")
    release(spark, since, keep=0)


def read_table(spark: SparkSession, path: str) -> Table:
    row = spark.read.parquet(f"{path}/table").first()
    table = Table(np.frombuffer(row.frequencies, "<u4").astype(np.int64))
    if table.crc != row.crc:
        raise ValueError("the frequency table is damaged")
    return table


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and with_ids the ids as binary uint32."""
    arrow_limits(spark)
    held = spark.sparkContext.broadcast(read_table(spark, path).freq.astype(np.int64))
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")

    def run(batches: Iterator[pa.RecordBatch]):
        own = Table(held.value)
        for b in batches:
            for part, start, doc_ids, lengths, payload in zip(*(b.column(c).to_pylist() for c in ("part", "start", "doc_ids", "lengths", "payload")),
                strict=True):
                data = decode_block(payload, own).astype("<u4").tobytes()
                n = np.array(lengths, np.int64)
                ends = np.cumsum(n)
                own_ids = [data[4 * a : 4 * e] for a, e in zip((ends - n).tolist(), ends.tolist(), strict=True)]
                columns = [pa.array(doc_ids, pa.int64()), pa.array([part] * len(n), pa.int32()), pa.array(start + ends - n), pa.array(n),
                    pa.array([zlib.crc32(x) for x in own_ids], pa.int64())]
                columns += [pa.array(own_ids, pa.binary())] * with_ids
                yield pa.record_batch(columns, names=["doc_id", "part", "local", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    # A row for each part, a few million ids each; their running sum is what precedes a part.
    sizes = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("part", before.alias("before"))
    rows = blocks.select("part", "start", "doc_ids", "lengths", "payload").mapInArrow(run,
        "doc_id long, part int, local long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
    return rows.join(offsets, "part").select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32",
        *(["ids"] if with_ids else []))


def round_trip(docs: DataFrame, tokenizer: str, cut: str = "spaced", end: int | None = 0) -> DataFrame:
    """The rows that the files give back; the files go when these are written, or if that fails."""
    spark = docs.sparkSession
    path = fresh_path(spark, "token-files")
    try:
        write_tokens(docs, path, tokenizer, cut, end)
        return materialize(read_tokens(spark, path), "round-trip")
    finally:
        remove(spark, path)
