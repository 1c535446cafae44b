import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
import __spark_entry__

from auditweave.llm import quality
from auditweave.llm.common import materialize, table

from .helpers import SCHEMA, frame, rows
from .test_decontaminate import split
from .test_near import shingle_set
from .test_simhash import brute_components


def corpus(spark, path):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    items = [say(25) for _ in range(5)]
    docs, labels, fate = [], [], {}
    for i in range(400):
        bad = i % 5 == 1
        text = "\n".join(say(rng.randrange(30, 60)) for _ in range(3))
        if bad:
            text = " ".join(w + "%%%" for w in text.split())
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, int(not bad), 0))
        fate[i] = "quality" if bad else "stays"
    for k in range(12):
        docs.append((1000 + k, docs[10 * k][1], "en", "t", 1))  # the larger id stays
        fate[10 * k] = "exact"
        fate[1000 + k] = "stays"
        text = docs[10 * k + 3][1].split()
        text[20] = "changed"
        docs.append((2000 + k, " ".join(text), "en", "t", 1))
        fate[2000 + k] = "near"
        docs.append((3000 + k, say(40) + " " + items[k % 5] + " " + say(40), "en", "t", 1))
        fate[3000 + k] = "benchmark"
    spark.createDataFrame(docs, SCHEMA).repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return fate


def test_each_stage_drops_its_own(spark, tmp_path):
    fate = corpus(spark, str(tmp_path))
    docs = table(spark, str(tmp_path), "documents")
    names = docs.columns
    for (_, stage), why in zip(corpus_pipeline.STAGES[:-1], ("quality", "exact", "near", "benchmark"), strict=True):
        left = materialize(stage(spark, docs, str(tmp_path)), "stage")
        assert left.columns == names
        before, after = ({r.doc_id for r in d.select("doc_id").collect()} for d in (docs, left))
        assert before - after == {i for i, w in fate.items() if w == why}, why
        docs = left
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == {i for i, w in fate.items() if w == "stays"}
    assert {r.doc_id for r in __spark_entry__.queries()["pipeline"](spark, str(tmp_path)).collect()} == {i for i, w in fate.items() if w == "stays"}


def test_stages_take_empty_documents(spark, tmp_path):
    corpus(spark, str(tmp_path))
    docs = table(spark, str(tmp_path), "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs_out = stage(spark, docs, str(tmp_path))
        assert docs_out.count() == 0


def test_stages_take_nulls_ties_repeated_rows_and_clashing_names(spark, tmp_path):
    """Each stage on rows of every kind, against brute force; the columns stay, whatever they are called."""
    path = str(tmp_path)
    corpus(spark, path)
    words = " ".join(f"w{i}" for i in range(40))
    data = [*rows(), *[(None, words, None, None, None)] * 2, (500, words + " end", "en", "s", 1), (501, words, "en", "s", 1), (501, words, "en", "s", 1),
        (502, " ".join(["z"] * 9), None, None, None)]
    docs = frame(spark, data, clashing=True).withColumns({c: F.lit(c) for c in ("doc", "Place", "spans", "row_", "a.b", "c`d")})
    bench = [r.text for r in table(spark, path, "benchmark").collect()]
    data.append((503, "see " + bench[0], "en", "s", 1))
    docs = docs.unionByName(frame(spark, data[-1:], clashing=True).withColumns({c: F.lit(c) for c in ("doc", "Place", "spans", "row_", "a.b", "c`d")}))
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, docs, path)
        assert left.columns == docs.columns
        kept[name] = sorted(((r.doc_id, r.text) for r in left.collect()), key=repr)
    texts = [(r[0], r[1]) for r in data]
    ranker = quality.train(table(spark, path, "documents"), table(spark, path, "labels"), cut=0.3)
    good = [t for t in texts if ranker.score(quality.features(np.frombuffer((t[1] or "").encode(), np.uint8),
        np.array([0, len((t[1] or "").encode())])))[0] >= 0.3]
    order = lambda t: (t[0] is not None, t[0] or 0)
    assert len(kept["quality classifier"]) > 0
    stage = corpus_pipeline.quality_stage(spark, docs, path)
    fresh = quality.train(docs, table(spark, path, "labels"), cut=0.3)
    want = [t for t in texts if fresh.score(quality.features(np.frombuffer((t[1] or "").encode(), np.uint8),
        np.array([0, len((t[1] or "").encode())])))[0] >= 0.3]
    assert good and sorted(((r.doc_id, r.text) for r in stage.collect()), key=repr) == sorted(want, key=repr)
    by_text = {}
    for t in texts:
        if (same := by_text.get(t[1] or "")) is None or order(t) > order(same):
            by_text[t[1] or ""] = t
    assert [(i, t or "") for i, t in kept["exact dedup"]] == sorted(((i, t or "") for i, t in by_text.values()), key=repr)
    sets = [shingle_set(t) for _, t in texts]
    close = lambda a, b: sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) > 0
    groups = {}
    for i, g in brute_components(range(len(texts)), close).items():
        groups.setdefault(g, []).append(i)
    firsts = {min((order(texts[i]) for i in own)) for own in groups.values()}
    found = [order(t) for t in kept["simhash near-dedup"]]
    assert len(found) == len(groups) and all(min(order(texts[i]) for i in own) in found for own in groups.values()) and set(found) == firsts
    clean = [t for t in texts if not any(" ".join(split(b)[i : i + 10]) in " ".join(split(t[1])) for b in bench for i in range(len(split(b)) - 9))]
    assert kept["benchmark decontamination"] == sorted(clean, key=repr) and len(clean) == len(texts) - 1
    packed = corpus_pipeline.packing_stage(spark, docs, path).collect()
    assert sorted({r.doc_id for r in packed}, key=repr) == sorted({t[0] for t in texts}, key=repr) and sum(r.piece == 0 for r in packed) == len(texts)
