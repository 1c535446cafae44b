import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from auditweave.llm import quality as Q
from auditweave.llm.wordhash import BLANK_SEPARATED, words

from .helpers import frame, rows, texts


def buffer(items):
    data = [t.encode() for t in items]
    return np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])


def test_features_do_not_depend_on_neighbours():
    items = [t or "" for t in texts()]
    together = Q.features(*buffer(items))
    assert together.shape[1] == len(Q.NAMES) and np.isfinite(together).all()
    for i, t in enumerate(items):
        assert np.allclose(Q.features(*buffer([t]))[0], together[i]), t[:40]
    raw, offs = buffer(items)
    starts, ends, first = words(raw, offs, BLANK_SEPARATED)
    for i, t in enumerate(items):
        assert [raw[a:b].tobytes() for a, b in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]], strict=True)] == t.encode().split()


def brute_features(text):
    raw = text.encode()
    w = raw.split()
    each, size = max(len(w), 1), max(len(raw), 1)
    lengths = [len(x) for x in w]
    mean = sum(lengths) / each
    of = lambda test: sum(map(test, raw))
    symbols = set(Q.SYMBOLS)
    shout = lambda x: sum(65 <= c <= 90 for c in x) > 1 and not any(97 <= c <= 122 for c in x)
    out = [math.log1p(len(raw)), math.log1p(len(w)), mean, math.sqrt(max(sum(n * n for n in lengths) / each - mean**2, 0))]
    out += [of(lambda c: c in b" \t\n\x0b\x0c\r") / size, of(lambda c: 65 <= c <= 90) / size, of(lambda c: 97 <= c <= 122) / size,
        of(lambda c: 48 <= c <= 57) / size]
    out += [of(lambda c: c > 127) / size, of(lambda c: c in symbols) / size, raw.count(b"\n") / each]
    out += [sum(65 <= x[0] <= 90 for x in w) / each, sum(map(shout, w)) / each, sum(x[-1] in symbols for x in w) / each, len(set(w)) / each]
    out += [sum(a == b for a, b in zip(w, w[1:], strict=False)) / each, lengths.count(1) / each, sum(n > 20 for n in lengths) / each,
        sum(x.endswith(b".") for x in w) / each]
    return [*out, *[math.sqrt(raw.count(bytes([c])) / each) for c in Q.SYMBOLS]]


def test_features_equal_brute_force():
    items = [t or "" for t in texts()]
    assert np.allclose(Q.features(*buffer(items)), [brute_features(t) for t in items])


@pytest.mark.parametrize("most", [1, 9, 60, 900])
def test_features_of_long_texts_in_parts(most):
    items = [t or "" for t in texts()]
    batch = pa.record_batch([pa.array(items)], names=["text"])
    got = np.concatenate([x for _, x in Q.featured(iter([batch]), most)])
    assert np.allclose(got, [brute_features(t) for t in items])


def test_fitted_weights_have_the_least_loss():
    """The loss over the very pairs, by a plain loop: its numerical slope is nought at the weights, and it grows whichever way they move."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, len(Q.NAMES)))
    good = x[:, 0] + x[:, 1] + rng.normal(size=60) > -0.5
    ranker = Q.fit(x, good, 0.3, pairs=5)
    z = np.clip((x - x.mean(0)) / x.std(0), -8, 8)
    pick = np.random.default_rng(7)
    rare = min(good.sum(), (~good).sum())
    pairs = list(zip(*(pick.permutation(np.resize(np.flatnonzero(k), rare * 5)) for k in (good, ~good)), strict=True))

    def loss(w):
        return sum(math.log1p(math.exp(-float((z[a] - z[b]) @ w))) for a, b in pairs) / 5 + 0.5 * float(w @ w)

    least = loss(ranker.weights)
    for i in range(0, len(ranker.weights), 7):
        step = np.zeros(len(ranker.weights))
        step[i] = 1e-3
        assert abs(loss(ranker.weights + step) - loss(ranker.weights - step)) < 1e-6
    assert all(loss(ranker.weights + 0.05 * rng.normal(size=len(ranker.weights))) > least for _ in range(20))
    assert ranker.threshold == np.quantile(z @ ranker.weights, (~good).mean())


def test_repeated_ids_and_labels_are_bounded_and_learned_in_any_order(spark):
    data, labels = made(200)
    again = [*data, *data, *[(i, t + " more", *r) for i, t, *r in data]]
    a = Q.train(frame(spark, again), spark.createDataFrame([*labels, *labels], "doc_id long, quality int, toxic int"))
    b = Q.train(frame(spark, again[::-1]), spark.createDataFrame(labels[::-1], "doc_id long, quality int, toxic int"))
    assert np.array_equal(a.weights, b.weights) and a.threshold == b.threshold
    few = Q.train(frame(spark, again), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), most=20)
    assert len(few.weights) == len(Q.NAMES)


def made(n=800):
    rng = random.Random(3)
    out, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.2
        w = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) + (rng.choice(["!!", "%%"]) if bad and rng.random() < 0.5 else "")
            for _ in range(rng.randrange(20, 80))]
        out.append((i, " ".join(w), "en", "s", 1))
        labels.append((i, int(not bad), 0))
    return out, labels


def test_held_out_accuracy_and_threshold(spark):
    data, labels = made()
    docs = frame(spark, data, clashing=True)
    ranker = Q.train(docs, spark.createDataFrame([*labels, (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int"), 0.3)
    got = {r.doc_id: r for r in Q.scores(docs, ranker).collect()}
    truth = {i: q for i, q, _ in labels}
    held = [r for r in got.values() if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    left = Q.keep_good(docs, ranker)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {i for i, r in got.items() if r.predicted}


def test_held_out_labels_are_not_learned_from(spark):
    data, labels = made(300)
    docs = frame(spark, data)
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, 0) for i, q, _ in labels]
    a, b = (Q.train(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, turned))
    assert np.array_equal(a.weights, b.weights) and a.threshold == b.threshold


def test_defined_results(spark):
    none = Q.train(frame(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    got = Q.scores(frame(spark, clashing=True), none).collect()
    assert len(got) == len(rows()) and {r.score for r in got} == {0.5}
    assert Q.scores(frame(spark, []), none).count() == 0
