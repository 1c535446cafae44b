"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, against which the
windows of every training document are scanned; hits are verified word by word.

Words are maximal runs of ASCII letters and digits and of characters beyond ASCII, with A-Z in
lower case. A benchmark item of fewer than `n` words, but not none, is one window of its own length.

Defined results: null and empty texts have no words and no hits; items with a null text have no
windows; items with equal windows all count; null item ids count under the empty name; an empty
benchmark leaves everything clean; rows that repeat are each judged. Extra columns are ignored, or kept
as they are where rows of documents are returned, whatever their names.

Size: the benchmark comes to the driver in blocks of at most `block_bytes` of text (longer items in overlapping parts). One
block is broadcast, all documents are scanned, their hits are written and the broadcast is freed before the next
block is read, so what the driver and the workers hold is bounded whatever the benchmark's size. Documents are judged, and passages
cut, by the hits of all blocks together: the result doesn't depend on the blocks. A benchmark of one block needs no written hits.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import PART_BYTES, arrow_limits, columns, id_and_text, map_rows, mark, materialize, parts, release, text_bytes, unused
from .wordhash import ALPHANUMERIC, ANY_CASE, LOWER, run_hash, run_sums, word_hashes, words

#: Most benchmark text in one broadcast, in bytes; its windows take about 8 times as much in a worker.
BLOCK_BYTES = 4 << 20
FILTER_BITS = 20
#: Hit runs of words of a text: (first, words), in order and apart.
Spans = list[tuple[int, int]]
#: (rows, words of each row, spans of those with hits, items of those with hits).
Judged = tuple[pa.RecordBatch, np.ndarray, dict[int, Spans], dict[int, set[str]]]


def normalised(text: bytes) -> list[bytes]:
    raw = LOWER[np.frombuffer(text, np.uint8)]
    starts, ends, _ = words(raw, np.array([0, len(raw)]), ALPHANUMERIC)
    joined = raw.tobytes()
    return [joined[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def united(spans: Spans) -> Spans:
    out: Spans = []
    for first, n in sorted(spans):
        if out and first <= out[-1][0] + out[-1][1]:
            a, m = out[-1]
            out[-1] = a, max(m, first + n - a)
        else:
            out.append((first, n))
    return out


class WindowSet:
    """Windows of benchmark items by length: sorted hashes, a bit filter, and for each window where its text is and whose it is."""

    def __init__(self, items: list[tuple[str, str]], n: int):
        self.n, self.names = n, [item for item, _ in items]
        texts = [b" ".join(normalised(text.encode())) for _, text in items]
        self.text = b" ".join(texts)
        raw = np.frombuffer(self.text, np.uint8)
        offs = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
        offs[-1] = max(offs[-1] - 1, 0)
        starts, ends, first = words(raw, np.minimum(offs, len(raw)), ALPHANUMERIC)
        sums, many = run_sums(word_hashes(raw, starts, ends), 1), np.diff(first)
        self.lengths = []
        for m in sorted({min(int(x), n) for x in many} - {0}):
            own = np.flatnonzero(many >= n if m == n else many == m)
            count = many[own] - m + 1
            item = np.repeat(own, count)
            at = first[item] + np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
            hashes = run_hash(sums, at, at + m, 1)
            order = np.lexsort((item, hashes))
            hashes, item, a, b = hashes[order], item[order], starts[at[order]], ends[at[order] + m - 1]
            again = np.flatnonzero((hashes[1:] == hashes[:-1]) & (item[1:] == item[:-1])) + 1
            again = [i for i in again.tolist() if self.text[a[i] : b[i]] == self.text[a[i - 1] : b[i - 1]]]  # a window that an item repeats
            hashes, item, a, b = (np.delete(x, again) for x in (hashes, item, a, b))
            bits = np.zeros(1 << FILTER_BITS, bool)
            bits[hashes & np.uint64((1 << FILTER_BITS) - 1)] = True
            self.lengths.append((m, hashes, bits, item.astype(np.int32), a.astype(np.int32), b.astype(np.int32)))

    def owners(self, hashes, item, a, b, q: int, text: bytes) -> list[str]:
        """The items that have the window `text`; q: the first place of its hash."""
        out = []
        for i in range(q, int(np.searchsorted(hashes, hashes[q], "right"))):
            if self.text[a[i] : b[i]] == text:
                out.append(self.names[item[i]])
        return out

    def scan(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, dict[int, Spans], dict[int, set[str]]]:
        """For the texts in a buffer: words, hit runs of words, and the items found."""
        raw = LOWER[raw]
        starts, ends, first = words(raw, offs, ALPHANUMERIC)
        sums = run_sums(word_hashes(raw, starts, ends), 1)
        spans, items, text_of = defaultdict(list), defaultdict(set), None
        for m, hashes, bits, item, a, b in self.lengths:
            if len(starts) < m:
                continue
            at = np.arange(len(starts) - m + 1)
            found = run_hash(sums, at, at + m, 1)
            at = at[bits[found & np.uint64((1 << FILTER_BITS) - 1)]]
            place = np.searchsorted(hashes, found[at])
            same = hashes[np.minimum(place, len(hashes) - 1)] == found[at]
            at, place = at[same], place[same]
            if not len(at):
                continue
            if text_of is None:
                text_of = np.repeat(np.arange(len(offs) - 1), np.diff(first))
            inside = text_of[at] == text_of[at + m - 1]
            at, place = at[inside], place[inside]
            known: dict[bytes, list[str]] = {}
            for p, q, d, s, e in zip(at.tolist(), place.tolist(), text_of[at].tolist(), starts[at].tolist(), ends[at + m - 1].tolist(), strict=True):
                piece = raw[s:e].tobytes()
                if (names := known.get(piece)) is None:
                    names = known[piece] = self.owners(hashes, item, a, b, q, b" ".join(normalised(piece)))
                if names:
                    spans[d].append((p - int(first[d]), m))
                    items[d].update(names)
        return np.diff(first), {d: united(x) for d, x in spans.items()}, dict(items)

    def judge(self, batches: Iterator[pa.RecordBatch], most: int = PART_BYTES) -> Iterator[Judged]:
        """The rows of the batches; a long text is scanned in parts that overlap by a window less one word."""
        held: tuple[Spans, set[str]] | None = None
        for rows, raw, offs, before, last in parts(batches, self.n, most, ANY_CASE):
            n_words, spans, items = self.scan(raw, offs)
            if last and held is None:
                yield rows, n_words, spans, items
                continue
            held = held or ([], set())
            held[0].extend((int(before[0]) + a, n) for a, n in spans.get(0, ()))
            held[1].update(items.get(0, ()))
            if last:
                yield rows, before + n_words, {0: united(held[0])} if held[0] else {}, {0: held[1]} if held[1] else {}
                held = None


def blocks(benchmark: DataFrame, n: int, most: int = BLOCK_BYTES) -> Iterator[list[tuple[str, str]]]:
    """The items as (id, text), in lists of bounded text; at least one list. Longer items come in parts that share n - 1 words."""
    rows, size = [], 0
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.coalesce("text", F.lit("")).alias("t"))
    for r in items.toLocalIterator(prefetchPartitions=False):
        texts = [r.t]
        if len(r.t.encode()) > most:
            batch = pa.record_batch([pa.array([r.t])], names=["text"])
            texts = [raw.tobytes() for _, raw, *_ in parts(iter([batch]), n, most, ANY_CASE)]
            texts = [t.decode() for i, t in enumerate(texts) if not i or len(normalised(t)) >= n]  # no shorter window at the end
        for text in texts:
            own = len(text.encode())
            if rows and size + own > most:
                yield rows
                rows, size = [], 0
            rows.append((r.i, text))
            size += own
    yield rows


def _scanned(docs: DataFrame, benchmark: DataFrame, n: int, block_bytes: int, results: Callable[[Iterator[Judged]], Iterator[pa.RecordBatch]],
    schema: T.StructType) -> DataFrame:
    """The rows that `results` makes of the judged rows of docs."""
    spark = docs.sparkSession
    arrow_limits(spark)
    todo = blocks(benchmark, n, block_bytes)
    block, more = next(todo), next(todo, None)
    if more is None:
        held = spark.sparkContext.broadcast(WindowSet(block, n))
        return map_rows(docs, lambda batches: results(held.value.judge(batches)), schema)
    number, spans, items = unused(docs, "row", "spans", "items")
    names_of = docs.columns
    since = mark()
    numbered = materialize(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    hits = None
    while block is not None:
        held = spark.sparkContext.broadcast(WindowSet(block, n))

        def some(batches, held=held):
            for rows, _, found, names in held.value.judge(batches):
                at = sorted(found)
                struct = [[{"first": a, "words": w} for a, w in found[d]] for d in at]
                columns = [rows.column("row").take(pa.array(at, pa.int64())), pa.array(struct, SPANS),
                    pa.array([sorted(names[d]) for d in at], pa.list_(pa.string()))]
                yield pa.record_batch(columns, names=["row", "spans", "items"])

        texts = numbered.select(F.col(number).alias("row"), "text")
        own = materialize(texts.mapInArrow(some, "row long, spans array<struct<first:long, words:long>>, items array<string>"), "hits")
        held.destroy()
        hits = own if hits is None else hits.unionByName(own)
        block, more = more, next(todo, None)
    whole = hits.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias(spans), F.flatten(F.collect_list("items")).alias(items))
    whole = materialize(whole.withColumnRenamed("row", number), "all-hits")
    judged = materialize(numbered.join(whole, number, "left"), "judged")
    release(spark, since)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[Judged]:
        for rows, raw, offs, before, last in parts(batches, 1, PART_BYTES, ANY_CASE):
            if last:
                n_words = before + np.diff(words(raw, offs, ANY_CASE)[2])
                found = {d: united([(s["first"], s["words"]) for s in x]) for d, x in enumerate(rows.column(spans).to_pylist()) if x}
                names = {d: set(x) for d, x in enumerate(rows.column(items).to_pylist()) if x}
                yield rows.select(names_of), n_words, found, names

    return map_rows(judged.select(*columns(docs), number, spans, items), lambda batches: results(known(batches)), schema)


SPANS = pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())]))


def items_digest(items) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


RESULT = T.StructType().add("doc_id", "long").add("n_words", "long").add("n_hit", "long").add("n_items", "long").add("items_sha256",
    "string").add("contaminated", "boolean")


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row per document: words, hit words, items with occurring windows."""

    def results(judged):
        none = items_digest(())
        for rows, n_words, spans, items in judged:
            n_hit, count, digests = np.zeros(len(n_words), np.int64), np.zeros(len(n_words), np.int64), [none] * len(n_words)
            for d, found in spans.items():
                n_hit[d], count[d], digests[d] = sum(w for _, w in found), len(items[d]), items_digest(items[d])
            values = [rows.column("doc_id"), pa.array(n_words.astype(np.int64)), pa.array(n_hit), pa.array(count), pa.array(digests), pa.array(n_hit > 0)]
            yield pa.record_batch(values, names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return _scanned(id_and_text(docs), benchmark, n, block_bytes, results, RESULT)


def _without(text: bytes, spans: Spans) -> bytes:
    """The text less the bytes from each run's first to its last word."""
    raw = np.frombuffer(text, np.uint8)
    starts, ends, _ = words(LOWER[raw], np.array([0, len(raw)]), ALPHANUMERIC)
    keep, at = [], 0
    for first, n in spans:
        keep.append(text[at : starts[first]])
        at = int(ends[first + n - 1])
    return b"".join([*keep, text[at:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, remove: str = "documents", most_hit: float = 0.0,
    block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with benchmark passages taken out, in the columns of docs.

    remove="documents" drops documents of which more than the share `most_hit` of words is hit;
    remove="spans" keeps every document and cuts the bytes from a hit run's first to its last word.
    """

    def results(judged):
        for rows, n_words, spans, _ in judged:
            if remove == "documents":
                n_hit = np.zeros(len(n_words), np.int64)
                for d, found in spans.items():
                    n_hit[d] = sum(w for _, w in found)
                rows = rows.filter(pa.array(n_hit <= most_hit * n_words))
            elif spans:
                at, column = rows.schema.get_field_index("text"), rows.column("text")
                raw, offs = text_bytes(column)
                texts = column.to_pylist()
                for d, found in spans.items():
                    texts[d] = _without(raw[offs[d] : offs[d + 1]].tobytes(), found).decode()
                rows = rows.set_column(at, "text", pa.array(texts, column.type))
            yield rows

    return _scanned(docs, benchmark, n, block_bytes, results, docs.schema)
