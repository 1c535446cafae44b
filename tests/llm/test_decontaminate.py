import hashlib
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from auditweave.llm.decontaminate import WindowSet, contamination, decontaminate

from .helpers import frame, rows

ITEMS = [("7", "W3 w4, w5 w6 w7 w8 w9 w10 w11 w12 w13"), ("11", "w20 w21 w22"), ("2", "beta gämma"), ("3", None), ("4", " ,; "),
    ("5", "w40 w41 w42 w43 w44 w45 w46 w47 w48 other"), (None, "42 42 42")]


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, n):
    w, hit, found = split(text), set(), set()
    for item, t in items:
        x = split(t)
        m = min(n, len(x))
        for i in range(len(x) - m + 1 if m else 0):
            for p in range(len(w) - m + 1):
                if w[p : p + m] == x[i : i + m]:
                    hit.update(range(p, p + m))
                    found.add(item or "")
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def bench(spark, items=ITEMS):
    return spark.createDataFrame(items, "item_id string, text string")


def test_matches_brute_force_in_one_block_and_in_many(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(60)]
    data = rows() + [(200 + i, " ".join(words[a : a + rng.randrange(5, 30)]).upper(), "en", "s", 1) for i, a in enumerate(rng.choices(range(50), k=30))]
    want = sorted([(r[0], *brute(r[1], ITEMS, 10)) for r in data], key=repr)
    for size in (4 << 20, 30):
        got = sorted([tuple(r) for r in contamination(frame(spark, data, clashing=True), bench(spark), 10, size).collect()], key=repr)
        assert got == want
    assert any(r[5] for r in want) and not all(r[5] for r in want)


def test_windows_that_overlap_are_judged_and_cut_together(spark):
    """Items in one block or in many, and items longer than a block: the same documents stay and the same words are cut."""
    words = [f"a{i}" for i in range(40)]
    items = [("1", " ".join(words[:12])), ("2", " ".join(words[8:20])), ("3", " ".join(words[15:32])), ("4", "a35 a36"),
        ("5", " ".join(f"c{i}" for i in range(60)) + " !")]
    data = [(i, "x " + " ".join(w) + ". Y", "en", "s", 1) for i,
        w in enumerate((words, words[5:25], words[:10], words[12:18], words[30:], [f"c{i}" for i in range(12, 50)], ["x"] * 30 + words[:11]))]
    brutes = {r[0]: brute(r[1], items, 10) for r in data}
    cut = {}
    for size in (4 << 20, 100, 1):
        docs = frame(spark, data, clashing=True).withColumn("spans", F.lit("s")).withColumn("Row", F.lit(1))
        assert {r[0]: tuple(r)[1:] for r in contamination(docs, bench(spark, items), 10, size).collect()} == brutes
        left = decontaminate(docs, bench(spark, items), most_hit=0.5, block_bytes=size)
        assert left.columns == docs.columns
        assert {r.doc_id for r in left.collect()} == {i for i, x in brutes.items() if x[1] <= 0.5 * x[0]}
        cut[size] = sorted((r.doc_id, r.text) for r in decontaminate(docs, bench(spark, items), remove="spans", block_bytes=size).collect())
    assert cut[4 << 20] == cut[100] == cut[1]
    assert [t for _, t in cut[1]][:3] == ["x  a32 a33 a34  a37 a38 a39. Y", "x a5 a6 a7 . Y", "x . Y"]


@pytest.mark.parametrize("most", [1, 30, 200])
def test_long_texts_in_parts(most):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(45)]
    own = WindowSet([(i or "", t or "") for i, t in ITEMS], 10)
    for _ in range(40):
        text = rng.choice([" ", ", "]).join(rng.choice([w, " ".join(words[2:16]), "beta GÄMMA"]) for w in rng.choices(words, k=rng.randrange(30)))
        batch = pa.record_batch([pa.array([text])], names=["text"])
        (_, n_words, spans, items), = own.judge(iter([batch]), most)
        found = items.get(0, set())
        want = brute(text, ITEMS, 10)
        assert (int(n_words[0]), sum(n for _, n in spans.get(0, ())), len(found), bool(found)) == (want[0], want[1], want[2], want[4])


def test_empty_tables(spark):
    assert contamination(frame(spark, []), bench(spark)).count() == 0
    assert not any(r.contaminated for r in contamination(frame(spark), bench(spark, [])).collect())


def test_removal(spark):
    docs = frame(spark, clashing=True)
    left = decontaminate(docs, bench(spark))
    assert left.columns == docs.columns
    assert sorted([r.text or "" for r in left.collect()]) == sorted(r[1] or "" for r in rows() if not brute(r[1], ITEMS, 10)[4])
    cut = decontaminate(docs, bench(spark), remove="spans")
    assert cut.count() == len(rows()) and not any("w20" in (r.text or "").split() and "w21" in r.text for r in cut.collect())
