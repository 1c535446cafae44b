"""Substring dedup: documents are factored against a reference index of the whole corpus, in phrases that the content cuts.

This is relative Lempel-Ziv parsing without its greedy part: no longest match is followed and no factor names a place in the reference. A
greedy longest match hides windows that straddle two factors, and needs the blocks of the index one after another. Here phrases begin and end where
the content says so,
which lets one equi-join look up all blocks at once: of each window of `window` consecutive words the anchor is the run of ANCHOR words with the
smallest hash, and a
phrase is a run of windows with the same anchor. Equal windows have equal anchors wherever they stand.

1. Index: for each anchor whether its phrases are all equal, of anchors that occur again. Anchors that occur once are unique text; nothing that
contains them repeats.
2. Factors: phrases whose anchor has equal phrases only are factors as a whole.
3. Factor boundaries: where phrases of one anchor differ, a factor ends inside the phrase. There the windows are checked one by
   one: (anchor, window hash) is counted over all documents, and windows that occur again are factors too.

Words covered by a factor are duplicate spans. Windows to check and windows found are bits, 64 to a number and row, united
by bit_or: what a row needs is linear in its words however often the row itself is repeated. Every count is pre-aggregated
before its shuffle, and counts go back to places by joins of plain exchanges, which adaptive execution can split, so a
passage that a third of all documents share is no hot task. A text beyond PART_BYTES is worked on in parts that
overlap by a window less one word. Hash equality is on 128 bits for phrases (anchor and phrase), on 96 for windows.

Defined results: a null or empty text has no words; texts shorter than a window stay whole; all copies
of a passage are removed, the first as well; repeats within a document and repeated rows count; rows of one
id with different texts don't mix; an empty table gives no rows; extra columns are ignored
whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY, PART_BYTES, arrow_limits, id_and_text, mark, materialize, parts, release, signed, with_key
from .wordhash import BLANK_SEPARATED, mix, run_hash, run_sums, sliding_min, word_hashes, words

#: Words in an anchor; shorter ones are fewer, but more of them are chance repeats.
ANCHOR = 12
PLACE_BITS = 24  # a part has fewer words than 2**24


class Parse:
    """Phrases of the texts in a buffer: text, first window (in words of the text), windows, anchor and phrase hash."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray, window: int):
        anchor = min(ANCHOR, window)
        starts, ends, first = words(raw, offs, BLANK_SEPARATED)
        self.starts, self.ends, self.first, self.window = starts, ends, first, window
        hashes = word_hashes(raw, starts, ends)
        self.sums = run_sums(hashes, 1)
        n = len(starts) - window + 1
        empty = np.zeros(0, np.int64)
        if n <= 0:
            self.text = self.begin = self.windows = self.at = self.anchor = self.phrase = empty
            return
        at = np.arange(len(starts) - anchor + 1)
        grams = run_hash(self.sums, at, at + anchor, 1)
        low = np.uint64((1 << PLACE_BITS) - 1)
        # the leftmost of equal anchors: which one is chosen depends on the window's words alone
        place = (sliding_min((grams & ~low) | at.astype(np.uint64) & low, window - anchor + 1) & low).astype(np.int64)
        text_of = np.repeat(np.arange(len(offs) - 1), np.diff(first))
        whole = text_of[:n] == text_of[window - 1 :]
        head = np.empty(n, bool)
        head[0] = True
        head[1:] = (place[1:] != place[:-1]) | (text_of[1:n] != text_of[: n - 1])
        self.at = np.flatnonzero(head & whole)  # a text's whole windows are a run that starts with its first
        runs = np.diff(np.append(np.flatnonzero(head | ~whole), n))
        self.windows = runs[np.searchsorted(np.flatnonzero(head | ~whole), self.at)]
        self.text = text_of[self.at]
        self.begin = self.at - first[self.text]
        self.anchor = mix(grams[place[self.at]] ^ np.uint64(0xA5A5A5A5A5A5A5A5))
        self.phrase = run_hash(self.sums, self.at, self.at + self.windows + window - 1, 1)


PHRASES = "doc long, row long, begin int, windows int, anchor long, phrase long"


def phrases(texts: DataFrame, window: int, most: int = PART_BYTES) -> DataFrame:
    def run(batches):
        for rows, raw, offs, before, _ in parts(batches, window, most):
            p = Parse(raw, offs, window)
            own = pa.array(p.text)
            columns = [
                *[rows.column(c).take(own) for c in KEY],
                pa.array(p.begin + before[p.text], pa.int32()), pa.array(p.windows, pa.int32()),
                pa.array(signed(p.anchor)), pa.array(signed(p.phrase)),
            ]
            yield pa.record_batch(columns, names=[*KEY, "begin", "windows", "anchor", "phrase"])

    return texts.select(*KEY, "text").mapInArrow(run, PHRASES)


def in_blocks(runs: DataFrame, *more: str) -> DataFrame:
    """(doc, row, block, bits and the columns in more) of runs (doc, row, begin, windows): bit i of a block is window 64 * block + i."""
    end = F.col("begin") + F.col("windows") - 1
    spread = runs.select(*KEY, *more, "begin", end.alias("end"), F.explode(F.sequence(F.shiftright("begin", 6), F.shiftright(end, 6))).alias("block"))
    low, high = F.greatest(F.col("begin") - F.col("block") * 64, F.lit(0)), F.least(F.col("end") - F.col("block") * 64, F.lit(63))
    bits = F.expr("shiftleft(shiftrightunsigned(-1L, 63 - (high - low)), low)")
    return spread.select("*", low.alias("low"), high.alias("high")).select(*KEY, *more, "block", bits.alias("bits"))


def bits_at(lists: pa.ListArray, column: str, first: np.ndarray, n: np.ndarray, reach: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(text, window) of the bits that are set in lists of (block, bits), a list for each text, less those that neither are in
    first ... first + n of their text nor stand up to `reach` before."""
    flat = lists.flatten()
    block, bits = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("block", column))
    text = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    block = block.astype(np.int64) * 64
    use = (block + 63 >= first[text] - reach) & (block < first[text] + n[text])
    text, block, bits = text[use], block[use], bits[use].astype(np.int64)
    i, bit = np.nonzero(np.unpackbits(bits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    at, text = block[i] + bit, text[i]
    use = (at >= first[text] - reach) & (at < first[text] + n[text])
    return text[use], at[use]


def _boundary_windows(texts: DataFrame, lists: DataFrame, window: int, most: int) -> DataFrame:
    """(doc, row, at, hash, more) for every open window."""

    def run(batches):
        for rows, raw, offs, before, _ in parts(batches, window, most):
            starts, ends, first = words(raw, offs, BLANK_SEPARATED)
            hashes = word_hashes(raw, starts, ends)
            text, at = bits_at(rows.column("open"), "open", before, np.maximum(np.diff(first) - window + 1, 0))
            word = first[text] + at - before[text]
            one, two = (run_hash(run_sums(hashes, base), word, word + window, base) for base in (1, 2))
            own = pa.array(text)
            more = pa.array((two >> np.uint64(32)).astype(np.uint32).view(np.int32))
            columns = [*[rows.column(c).take(own) for c in KEY], pa.array(at, pa.int32()), pa.array(signed(one)), more]
            yield pa.record_batch(columns, names=[*KEY, "at", "hash", "more"])

    return texts.select(*KEY, "text").join(lists, KEY).mapInArrow(run, "doc long, row long, at int, hash long, more int")


def factors(texts: DataFrame, window: int, most: int = PART_BYTES) -> DataFrame:
    """Duplicate windows: doc, row, block, bits."""
    found = phrases(texts, window, most)
    index = found.groupBy("anchor").agg(F.count("*").alias("n"), F.min("phrase").alias("least"), F.max("phrase").alias("most")).filter("n > 1")
    index = materialize(index.select("anchor", (F.col("least") != F.col("most")).alias("mixed")), "index")
    known = in_blocks(found.join(index.hint("merge"), "anchor"), "mixed")
    of = lambda mixed: F.bit_or(F.when(F.col("mixed") == F.lit(mixed), F.col("bits")).otherwise(F.lit(0).cast("long")))
    blocks = materialize(known.groupBy(*KEY, "block").agg(of(False).alias("bits"), of(True).alias("open")), "blocks")
    lists = blocks.filter("open <> 0").groupBy(*KEY).agg(F.collect_list(F.struct("block", "open")).alias("open"))
    checked = materialize(_boundary_windows(texts, lists, window, most), "windows")
    again = materialize(checked.groupBy("hash", "more").agg(F.count("*").alias("n")).filter("n > 1").select("hash", "more"), "again")
    edges = in_blocks(checked.join(again.hint("merge"), ["hash", "more"], "left_semi").select(*KEY, F.col("at").alias("begin"), F.lit(1).alias("windows")))
    edges = edges.groupBy(*KEY, "block").agg(F.bit_or("bits").alias("bits"))
    return blocks.filter("bits <> 0").select(*KEY, "block", "bits").unionByName(edges)


def kept_words(raw: np.ndarray, offs: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, keep: np.ndarray) -> list[bytes]:
    """The words of each text that `keep` marks, joined by one space."""
    n = len(offs) - 1
    apart = np.full(len(raw) + n, 32, np.uint8)  # a blank behind each text
    apart[np.arange(len(raw)) + np.repeat(np.arange(n), np.diff(offs))] = raw
    text = np.repeat(np.arange(n), np.diff(first))[keep]
    a, b = starts[keep] + text, ends[keep] + text
    edge = np.zeros(len(apart) + 1, np.int8)
    edge[a] += 1
    edge[b + 1] -= 1
    apart[b] = 32
    out = apart[np.cumsum(edge[:-1], dtype=np.int8).astype(bool)].tobytes()
    to = np.cumsum(np.bincount(text, b + 1 - a, n)).astype(np.int64).tolist()
    return [out[p : max(q - 1, p)] for p, q in zip([0, *to[:-1]], to, strict=True)]


def spans(hit: np.ndarray, before: int) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return [{"first": int(a) + before, "words": int(b - a)} for a, b in zip(edge[::2], edge[1::2], strict=True)]


SPANS = pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())]))


class Row:
    """The result of one document, from its parts in order."""

    def __init__(self):
        self.digest, self.n_words, self.n_removed, self.texts, self.spans = hashlib.sha256(), 0, 0, [], []

    def add(self, kept: bytes, n_words: int, n_removed: int, spans: list[dict]) -> None:
        if n_words > n_removed:
            if self.n_words > self.n_removed:
                self.digest.update(b" ")
            self.digest.update(kept)
        self.n_words += n_words
        self.n_removed += n_removed
        if spans and self.spans and (last := self.spans[-1])["first"] + last["words"] == spans[0]["first"]:
            last["words"] += spans[0]["words"]
            spans = spans[1:]
        self.spans += spans


def deduplicate(docs: DataFrame, window: int = 35, with_text: bool = False, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, and with_text the kept words, joined by a space, and the spans removed.

    part_bytes: longer texts are worked on in parts; the result is the same."""
    arrow_limits(docs.sparkSession)
    texts, since = with_key(id_and_text(docs)), mark()
    found = materialize(factors(texts, window, part_bytes).groupBy(*KEY).agg(F.collect_list(F.struct("block", "bits")).alias("found")), "found")
    release(docs.sparkSession, since)

    def run(batches):
        whole = Row()
        for rows, raw, offs, before, last in parts(batches, 1, part_bytes):
            starts, ends, first = words(raw, offs, BLANK_SEPARATED)
            many = np.diff(first)
            text, at = bits_at(rows.column("found"), "bits", before, many, window - 1)
            at -= before[text]
            begin, end = first[text] + np.maximum(at, 0), first[text] + np.minimum(at + window, many[text])
            hit = np.cumsum(np.bincount(begin, minlength=len(starts) + 1) - np.bincount(end, minlength=len(starts) + 1))[:-1] > 0
            gone = np.concatenate([[0], np.cumsum(hit)])
            results = []
            for i, kept in enumerate(kept_words(raw, offs, starts, ends, first, ~hit)):
                a, b = first[i], first[i + 1]
                whole.add(kept, int(b - a), int(gone[b] - gone[a]), spans(hit[a:b], int(before[i])) if with_text and gone[b] > gone[a] else [])
                if with_text and b - a > gone[b] - gone[a]:
                    whole.texts.append(kept.decode())
                if last:
                    results.append(whole)
                    whole = Row()
            if last:
                columns = [pa.array([r.n_words for r in results], pa.int64()), pa.array([r.n_removed for r in results], pa.int64()),
                    pa.array([r.digest.hexdigest() for r in results])]
                if with_text:
                    columns += [pa.array([" ".join(r.texts) for r in results], pa.string()), pa.array([r.spans for r in results], SPANS)]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256", "text", "removed"]
                yield pa.record_batch([rows.column("doc_id"), *columns], names=names[: len(columns) + 1])

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string, removed array<struct<first:long, words:long>>" * with_text
    return texts.join(found, KEY, "left").select("doc_id", "text", "found").mapInArrow(run, schema)
