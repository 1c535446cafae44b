"""Language identification by compression: a text's language is the one whose zstandard dictionary makes it smallest.

For each language a raw-content dictionary of DICTIONARY bytes is cut from labelled documents: the first PREFIX characters of up to SAMPLE
of them, drawn by hash (a bounded sample, the same for any partitioning), without what several of them share. A whole text, letters alone, in lower
case, one space for what is between them, is compressed in
blocks of BLOCK bytes with every dictionary, each block on its own, so that late parts of long texts are measured against the
languages, not against their own beginning; the sums are compared.

Defined results: a null text or one without a letter is `und` with score 0; so is every text where nothing is learned. A tie goes to the language
with more documents, then to the lesser name. score is a posterior that takes a byte saved for a bit of evidence: 1 / sum of 2 ** (smallest - size)
over the languages. margin is
what the next language needs more, by share of the smallest size (1 where there is no next one); below `margin` a prediction is `rejected`, and
identify() may call
it `und`. A null id is in no fold: it isn't held out and isn't learned from. Rows that repeat are told alike. An empty table gives no rows. Extra
columns are ignored whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import arrow_limits

#: Bytes of a dictionary, labelled documents of a language that it is cut from, and characters of each.
DICTIONARY, SAMPLE, PREFIX = 1 << 15, 600, 400
#: Words in a row that several sampled documents share are kept out of dictionaries.
SHARED = 5
#: Languages at most, those of most documents first: what a task holds grows with them.
LANGUAGES = 256
#: Bytes of text that are compressed at once, and zstandard's level.
BLOCK, LEVEL = 1024, 12
#: Predictions whose smallest size is less than this share below the next are rejected.
MARGIN = 0.01
UNKNOWN = "und"
PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double, margin double, rejected boolean"


@dataclass(frozen=True)
class Model:
    """Languages, those with more documents first, and their dictionaries."""

    languages: tuple[str, ...]
    dictionaries: tuple[bytes, ...]

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        out = []
        for content in self.dictionaries:
            known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False))
        return out


def letters(text: F.Column) -> F.Column:
    """Letters and their marks in lower case, other characters as one space; empty if there is no letter."""
    return F.when(text.rlike(r"\p{L}"), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " "))).otherwise("")


def fold(doc_id: F.Column, of: int) -> F.Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(of))


def train(docs: DataFrame, folds: int = 4, held_out: int = 2) -> Model:
    """A dictionary for each non-null lang of the documents outside the fold `held_out`; ids serve only to draw the sample."""
    learned = docs.filter(F.col("lang").isNotNull() & (fold(F.col("doc_id"), folds) != held_out)).select(F.col("lang").cast("string").alias("lang"),
        "doc_id", "text")
    counts = learned.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not counts:
        return Model((), ())
    # some 2 x SAMPLE rows of each language pass the first filter, however many there are; rows that repeat count once
    draw = F.xxhash64("doc_id", "text")
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, 2.0 * SAMPLE / r["n"])))])
    drawn = learned.withColumn("draw", draw).filter(F.shiftrightunsigned("draw", 11) < F.try_element_at(share, F.col("lang")) * float(1 << 53))
    once = drawn.groupBy("lang", "draw").agg(F.min(F.substring(letters(F.substring("text", 1, 2 * PREFIX)), 1, PREFIX)).alias("part")).filter("part != ''")
    first = once.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("draw"))).filter(F.col("nth") <= SAMPLE)
    parts: dict[str, list[str]] = {}
    for r in first.orderBy("lang", "nth").collect():
        parts.setdefault(r["lang"], []).append(r["part"])
    cut = {lang: " ".join(["", *own, ""]).encode()[:DICTIONARY] for lang, own in unshared(parts).items()}
    own = [r["lang"] for r in counts if len(cut.get(r["lang"], b"")) >= 8]  # zstandard wants 8 bytes at least
    return Model(tuple(own), tuple(cut[lang] for lang in own))


def unshared(parts: dict[str, list[str]]) -> dict[str, list[str]]:
    """The sample without runs of SHARED words that several documents of it have, as they tell of licences and copies, not of a language; the whole parts
    follow, for a dictionary that isn't full without them."""
    holders: dict[tuple[str, ...], set[tuple[str, int]]] = {}
    split = {(lang, i): part.split() for lang, own in parts.items() for i, part in enumerate(own)}
    for place, words in split.items():
        for at in range(len(words) - SHARED + 1):
            holders.setdefault(tuple(words[at : at + SHARED]), set()).add(place)
    left: dict[str, list[str]] = {lang: [] for lang in parts}
    for (lang, _), words in split.items():
        covered = {at + k for at in range(len(words) - SHARED + 1) if len(holders[tuple(words[at : at + SHARED])]) > 1 for k in range(SHARED)}
        left[lang].append(" ".join(w for at, w in enumerate(words) if at not in covered))
    return {lang: [p for p in own if p] + parts[lang] for lang, own in left.items()}


def sizes(compressors: list[zstandard.ZstdCompressor], text: str) -> np.ndarray:
    raw = f" {text} ".encode()
    blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
    return np.array([sum(len(c.compress(b)) for b in blocks) for c in compressors], np.int64)


def identify(docs: DataFrame, model: Model, margin: float = MARGIN, reject: bool = False, folds: int = 4, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score, margin, rejected for every document. reject: rejected ones are `und`."""
    arrow_limits(docs.sparkSession)
    out = F.coalesce(fold(F.col("doc_id"), folds) == held_out, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), out.alias("held_out"), letters(F.coalesce("text", F.lit(""))).alias("text"))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = model.compressors()
        for b in batches:
            lang, score, lead = [], [], []
            for text in b.column("text"):
                text = text.as_py()
                if not text or not compressors:
                    lang.append(UNKNOWN), score.append(0.0), lead.append(0.0)
                    continue
                own = sizes(compressors, text)
                best = int(own.argmin())  # the first of equal ones
                ranked = np.sort(own)
                lead.append(float(ranked[1] - ranked[0]) / float(ranked[0]) if len(own) > 1 else 1.0)
                score.append(float(1 / np.exp2(ranked[0] - ranked.astype(np.float64)).sum()))
                lang.append(model.languages[best])
            narrow = np.array(lead) < margin
            if reject:
                lang = [UNKNOWN if n else x for n, x in zip(narrow, lang, strict=True)]
            yield pa.record_batch([b.column("doc_id"), b.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                pa.array(lead, pa.float64()), pa.array(narrow)],
                                  names=[f.split()[0] for f in PREDICTED.split(", ")])

    return rows.mapInArrow(told, PREDICTED)
