"""Quality scores by Bradley-Terry pairwise ranking.

A document's strength is linear in features of its text. The weights are learned from preference pairs (a document
labelled good beats one labelled bad) by logistic loss on feature differences; the threshold is the quantile
of the labelled scores at the share of bad labels. Scores are mapped to (0, 1) such that the threshold becomes `cut`.

Labels are a bounded sample: at most MOST_LABELS rows of the training fold, those of smallest id hash; everything
else covers all documents. Only weights are broadcast.

Defined results: null and empty texts get the score of empty features; labels that are null are not learned from; an id labelled
good and bad counts with both, equal labels of an id count once; of documents with one id and different texts that with the smallest hash is
learned from; rows that repeat are scored each; without labels of both kinds every score is 0.5; an
empty table gives no rows; extra columns are ignored whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PART_BYTES, arrow_limits, id_and_text, map_rows, parts
from .wordhash import BLANK_SEPARATED, byte_class, word_hashes, words

MOST_LABELS = 20_000
#: Pairs for each labelled document of the rarer kind.
PAIRS = 24
FOLDS, HELD_OUT = 5, 0
SYMBOLS = b".,;:!?'\"()|%&$*#@/-_<>{}[]=+\\~^"
BASE = ["log_bytes", "log_words", "mean_word", "sd_word", "blank", "upper", "lower", "digit", "wide", "symbol", "lines_per_word", "capitalised", "shouted",
    "symbol_end", "distinct", "next_same", "one_byte", "long_word", "stop_end"]
NAMES = [*BASE, *[f"has_{chr(c)}" for c in SYMBOLS]]


@dataclass
class Counts:
    """What the features of texts are made of: sums over bytes and words, and the distinct word hashes of each text."""

    sums: np.ndarray
    distinct: list[np.ndarray]
    ends: np.ndarray  # hashes of each text's first and last word, 0 without words

    def __add__(self, more: Counts) -> Counts:
        """Of one text, the parts one after another."""
        sums = self.sums + more.sums
        both = self.ends[0, 1] and self.ends[0, 1] == more.ends[0, 0]
        sums[0, SUMS.index("again")] += bool(both)
        ends = np.array([[self.ends[0, 0] or more.ends[0, 0], more.ends[0, 1] or self.ends[0, 1]]])
        return Counts(sums, [np.union1d(self.distinct[0], more.distinct[0])], ends)


#: Sums of a text, in order; the counts of each symbol follow.
SUMS = ["bytes", "words", "length", "squares", "blank", "upper", "lower", "digit", "wide", "symbol", "lines", "capitalised", "shouted", "symbol_end",
    "again", "one_byte", "long_word", "stop_end"]


def counts(raw: np.ndarray, offs: np.ndarray) -> Counts:
    """Of each text in the buffer."""
    n = len(offs) - 1

    def by_byte(flag: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
        return total[offs[1:]] - total[offs[:-1]]

    starts, ends, first = words(raw, offs, BLANK_SEPARATED)

    def by_word(values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return total[first[1:]] - total[first[:-1]]

    upper, lower = byte_class([(0, 64), (91, 255)])[raw], byte_class([(0, 96), (123, 255)])[raw]
    digit, wide = byte_class([(0, 47), (58, 255)])[raw], byte_class([(0, 127)])[raw]
    table = np.zeros(256, np.uint8)
    table[list(SYMBOLS)] = 1
    symbol = table[raw]
    length = ends - starts
    text = np.repeat(np.arange(n), np.diff(first))
    hashes = word_hashes(raw, starts, ends) | np.uint64(1)
    again = np.zeros(len(starts), np.int64)
    again[1:] = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
    capital = np.concatenate([[0], np.cumsum(upper, dtype=np.int64)])
    small = np.concatenate([[0], np.cumsum(lower, dtype=np.int64)])
    shouted = (capital[ends] - capital[starts] > 1) & (small[ends] == small[starts])
    last = raw[ends - 1] if len(ends) else raw[:0]
    sums = [
        np.diff(offs), np.diff(first), by_word(length), by_word(length**2), by_byte(BLANK_SEPARATED[raw] == 0), by_byte(upper), by_byte(lower), by_byte(digit),
        by_byte(wide), by_byte(symbol), by_byte(raw == 10), by_word(upper[starts] if len(starts) else starts), by_word(shouted), by_word(table[last]),
            by_word(again),
        by_word(length == 1), by_word(length > 20), by_word(last == 46),
    ]
    each = np.zeros((n, len(SYMBOLS)), np.int64)
    at = np.flatnonzero(symbol)
    if len(at):
        number = np.zeros(256, np.int64)
        number[list(SYMBOLS)] = np.arange(len(SYMBOLS))
        owner = np.searchsorted(offs, at, "right") - 1
        each += np.bincount(owner * len(SYMBOLS) + number[raw[at]], minlength=n * len(SYMBOLS)).reshape(n, -1)
    order = np.lexsort((hashes, text))
    sorted_hash, sorted_text = hashes[order], text[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (sorted_hash[1:] != sorted_hash[:-1]) | (sorted_text[1:] != sorted_text[:-1])
    distinct = np.split(sorted_hash[fresh], np.cumsum(np.bincount(sorted_text[fresh], minlength=n))[:-1]) if n else []
    some = np.diff(first) > 0
    outer = np.zeros((n, 2), np.uint64)
    outer[some] = np.column_stack([hashes[first[:-1][some]], hashes[first[1:][some] - 1]])
    return Counts(np.column_stack([*sums, each]), distinct, outer)


def features_of(c: Counts) -> np.ndarray:
    """A row of features for each text."""
    s = {name: c.sums[:, i].astype(np.float64) for i, name in enumerate(SUMS)}
    size, each = np.maximum(s["bytes"], 1), np.maximum(s["words"], 1)
    mean = s["length"] / each
    out = [np.log1p(s["bytes"]), np.log1p(s["words"]), mean, np.sqrt(np.maximum(s["squares"] / each - mean**2, 0))]
    out += [s[x] / size for x in ("blank", "upper", "lower", "digit", "wide", "symbol")]
    out += [s[x] / each for x in ("lines", "capitalised", "shouted", "symbol_end")]
    out += [np.array([len(x) for x in c.distinct], np.float64) / each]
    out += [s[x] / each for x in ("again", "one_byte", "long_word", "stop_end")]
    return np.column_stack([*out, np.sqrt(c.sums[:, len(SUMS) :] / each[:, None])])


def features(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A row of features for each text in the buffer."""
    return features_of(counts(raw, offs))


def featured(batches: Iterator[pa.RecordBatch], most: int = PART_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(rows, features); a long text is counted in parts."""
    held: Counts | None = None
    for rows, raw, offs, _, last in parts(batches, 1, most):
        own = counts(raw, offs)
        own = own if held is None else held + own
        held = None if last else own
        if last:
            yield rows, features_of(own)


@dataclass
class Ranker:
    """score = logistic((x - mean) / sd . weights - threshold + logit(cut))"""

    mean: np.ndarray
    sd: np.ndarray
    weights: np.ndarray
    threshold: float
    cut: float
    fitted: bool = True

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.sd, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), 0.5)
        return 1 / (1 + np.exp(-np.clip(self.strength(x) - self.threshold + np.log(self.cut / (1 - self.cut)), -35, 35)))


def fit(x: np.ndarray, good: np.ndarray, cut: float, l2: float = 1.0, pairs: int = PAIRS, seed: int = 7, steps: int = 25) -> Ranker:
    """Newton steps on the logistic loss of differences good - bad."""
    mean, sd = (x.mean(0), x.std(0)) if len(x) else (np.zeros(len(NAMES)), np.ones(len(NAMES)))
    sd = np.where(sd > 1e-9, sd, 1.0)
    ranker = Ranker(mean, sd, np.zeros(x.shape[1]), 0.0, cut)
    if not len(x) or good.all() or not good.any():
        ranker.fitted = False
        return ranker
    z, rng = np.clip((x - mean) / sd, -8, 8), np.random.default_rng(seed)
    rare = min(good.sum(), (~good).sum())
    winners, losers = (rng.permutation(np.resize(np.flatnonzero(k), rare * pairs)) for k in (good, ~good))
    d = z[winners] - z[losers]
    w = ranker.weights
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(d @ w, -35, 35)))  # chance of the wrong order
        gradient = d.T @ p / pairs - l2 * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / pairs + l2 * np.eye(len(w))
        w = w + (step := np.linalg.solve(hessian, gradient))
        if np.abs(step).max() < 1e-6:
            break
    ranker.weights = w
    s = ranker.strength(x)
    ranker.threshold = float(np.quantile(s, (~good).mean()))
    return ranker


def fold(ids: F.Column) -> F.Column:
    return F.pmod(F.crc32(F.coalesce(ids.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def train(docs: DataFrame, labels: DataFrame, cut: float = 0.3, most: int = MOST_LABELS) -> Ranker:
    """Learns from at most `most` labels outside the held-out fold."""
    arrow_limits(docs.sparkSession)
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"),
        F.col("quality").cast("int").alias("quality")).filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (fold(F.col("doc_id")) != HELD_OUT))
    sample = usable.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(most)

    def run(batches):
        for rows, x in featured(batches):
            own = [rows.column(c) for c in ("doc_id", "quality", "row")]
            yield pa.record_batch([*own, pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "quality", "row", "x"])

    picked = id_and_text(docs).join(F.broadcast(sample), "doc_id").withColumn("row", F.xxhash64("text"))  # `most` rows at most
    found = picked.mapInArrow(run, "doc_id long, quality int, row long, x array<double>")
    rows = found.groupBy("doc_id", "quality").agg(F.min_by("x", "row").alias("x")).toPandas()  # a row for each of the sample at most
    x = np.array(rows["x"].tolist(), np.float64).reshape(-1, len(NAMES))
    order = np.lexsort((*x.T, rows["quality"].to_numpy()))  # as the rows come in any order
    return fit(x[order], rows["quality"].to_numpy()[order] == 1, cut)


def scores(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    held = docs.sparkSession.sparkContext.broadcast(ranker)

    def run(batches):
        for rows, x in featured(batches):
            score = held.value.score(x)
            out = [zlib.crc32(str(i).encode() if i is not None else b"") % FOLDS == HELD_OUT for i in rows.column("doc_id").to_pylist()]
            yield pa.record_batch([rows.column("doc_id"), pa.array(out), pa.array(score), pa.array((score >= held.value.cut).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """The rows of docs that reach the threshold, with all their columns."""
    arrow_limits(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(ranker)

    def run(batches):
        for rows, x in featured(batches):
            yield rows.filter(pa.array(held.value.score(x) >= held.value.cut))

    return map_rows(docs, run, docs.schema)
