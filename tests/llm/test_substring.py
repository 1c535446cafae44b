import hashlib
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from auditweave.llm.common import id_and_text, parts, with_key
from auditweave.llm.substring import Parse, deduplicate, factors

from .helpers import frame, rows


def brute(data, window):
    split = [re.findall(r"[^\x20\x09-\x0D]+", r[1] or "") for r in data]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for r, w in zip(data, split, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        text = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((r[0], len(w), len(gone), hashlib.sha256(text.encode()).hexdigest(), text))
    return sorted(out, key=repr)


def passages(seed):
    """Documents that share passages of many lengths, at places that overlap and adjoin."""
    rng = random.Random(seed)
    source = [f"v{rng.randrange(400)}" for _ in range(600)]
    out = []
    for i in range(120):
        words = []
        for _ in range(rng.randrange(1, 6)):
            if rng.random() < 0.6:
                a = rng.randrange(560)
                words += source[a : a + rng.choice([5, 12, 30, 34, 35, 36, 50, 90])]
            words += [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(25))]
        out.append((1000 + i, " ".join(words), "en", "s", 1))
    return out


@pytest.mark.parametrize("window", [35, 6])
def test_matches_brute_force(spark, window):
    data = rows() + passages(1) + [(5000, "same " * 200, "en", "s", 1), (5001, "x y " * 90, "en", "s", 1)]
    got = sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.text)
        for r in deduplicate(frame(spark, data, clashing=True), window, with_text=True).collect()], key=repr)
    want = brute(data, window)
    assert got == want
    assert sum(r[2] for r in want) > 500


@pytest.mark.parametrize("part_bytes", [1, 90, 700])
def test_texts_in_parts_give_the_same(spark, part_bytes):
    data = rows() + passages(3) + [(5000, "same " * 200, "en", "s", 1), (5002, "é" * 300 + " " + "x y " * 60, "en", "s", 1)]
    got = sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.text) for r in deduplicate(frame(spark, data), 6, True, part_bytes).collect()], key=repr)
    assert got == brute(data, 6)
    for r in deduplicate(frame(spark, passages(3)), 35, True, part_bytes).collect():
        assert sum(s.words for s in r.removed) == r.n_removed and all(s.words >= 35 for s in r.removed)


def test_repeated_rows_cost_no_more_than_each_a_list(spark):
    """1000 equal rows without an id, one of their passages with another ending elsewhere: the windows to check are those of a row for each."""
    text = " ".join(f"w{i}" for i in range(200))
    data = [(None, text, "en", "s", 1)] * 1000 + [(1, " ".join(f"w{i}" for i in range(150)) + " other end", "en", "s", 1)]
    texts = with_key(id_and_text(frame(spark, data)))
    lists = factors(texts, 35).groupBy("doc", "row").agg(F.count("*").alias("n")).collect()
    assert len(lists) == 2 and max(r.n for r in lists) <= 2 * 4
    got = {(r.doc_id, r.n_words, r.n_removed) for r in deduplicate(frame(spark, data)).collect()}
    assert got == {(None, 200, 200), (1, 152, 150)}


def test_text_of_megabytes_in_bounded_memory(spark):
    """Two texts of 20 MB that share 2 MB; a process of its own tells the memory that one of them takes."""
    rng = random.Random(3)
    tail = " ".join(f"s{rng.randrange(10**9)}" for _ in range(200_000))
    one, two = (" ".join(f"{c}{rng.randrange(10**9)}" for _ in range(1_900_000)) for c in "ab")
    data = [(1, one + " " + tail, "en", "s", 1), (2, two + "\n" + tail + " .", "en", "s", 1)]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in deduplicate(frame(spark, data)).collect()}
    assert got == {1: (2_100_000, 200_000), 2: (2_100_001, 200_000)}
    tracemalloc.start()
    raw = np.frombuffer(data[0][1].encode(), np.uint8)
    batch = pa.record_batch([pa.array([data[0][1]])], names=["text"])
    for _, part, offs, _, _ in parts(iter([batch]), 35):
        Parse(part, offs, 35)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(raw) > 20_000_000 and peak < 200_000_000


def test_spans_name_the_removed_words(spark):
    for r in deduplicate(frame(spark, passages(2)), with_text=True).collect():
        assert sum(s.words for s in r.removed) == r.n_removed and all(s.words >= 35 for s in r.removed)


def test_empty(spark):
    assert deduplicate(frame(spark, [])).count() == 0
