import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from auditweave.llm import near as N

from .helpers import frame, rows
from .test_simhash import brute_components


def test_one_of_each_group_stays(spark):
    rng = random.Random(6)
    words = [f"k{i}" for i in range(5000)]
    data = []
    for g in range(25):
        base = rng.choices(words, k=rng.choice([30, 120, 400]))
        for c in range(rng.randrange(1, 5)):
            own = list(base)
            for _ in range(rng.choice([0, 1, 2, 5, 40])):
                own[rng.randrange(len(own))] = rng.choice(words)
            data.append((10 * g + c, rng.choice([" ", "  "]).join(own).upper() if c % 2 else " ".join(own), "en", "s", 1))
    data += [(i, r[1], *r[2:]) for i, r in enumerate(rows(20), 1000)]

    def shingles(text):
        w = (text or "").encode().lower().split()
        return frozenset(b" ".join(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([b" ".join(w)] * bool(w))

    sets = {r[0]: shingles(r[1]) for r in data}
    want = brute_components(sorted(sets), lambda a, b: sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) > 0)
    docs = frame(spark, data, clashing=True)
    got = N.one_of_each_group(docs)
    assert got.columns == docs.columns
    kept = sorted(r.doc_id for r in got.collect())
    groups = sorted(set(want.values()))
    assert kept == groups  # the first of each group stays
    assert N.one_of_each_group(frame(spark, [])).count() == 0


def shingle_set(text, size=5):
    w = (text or "").encode().lower().split()
    return frozenset(b" ".join(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([b" ".join(w)] * bool(w))


def jaccard(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a | b)


def test_contiguous_edits_are_all_found(spark):
    """Truncated, extended and partly replaced copies from a similarity of 0.8 to 0.9: all are found, none below 0.8 is taken."""
    rng = random.Random(11)
    words = [f"k{i}" for i in range(20000)]
    data, want = [], set()
    for g in range(240):
        base = rng.choices(words, k=rng.choice([60, 100, 300, 500]))
        n = len(base)
        least = 0.79 + 0.11 * rng.random()
        if g % 3 == 0:
            own = base[: round(n * least) + 1]
        elif g % 3 == 1:
            own = base + rng.choices(words, k=round(n / least) - n)
        else:
            k = max(1, round(n * (1 - least) / (1 + least)) - 2)
            at = rng.randrange(n - k)
            own = [*base[:at], *rng.choices(words, k=k), *base[at + k :]]
        data += [(2 * g, " ".join(base), "en", "s", 1), (2 * g + 1, " ".join(own), "en", "s", 1)]
        want |= {2 * g} if jaccard(data[-2][1], data[-1][1]) >= 0.8 else {2 * g, 2 * g + 1}
    assert 300 > len(want) > 240
    assert {r.doc_id for r in N.one_of_each_group(frame(spark, data)).collect()} == want


def raw_of(texts):
    """The bytes of texts and their offsets."""
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def test_texts_of_equal_shingles_are_one_whatever_repeats(spark):
    rng = random.Random(12)
    words, data, want = [f"k{i}" for i in range(5000)], [], set()
    for g in range(30):
        head, passage = (" ".join(rng.choices(words, k=k)) for k in (100, 20))
        own = [" ".join([head, *[passage] * k]) for k in (2, 12, 40)]
        assert jaccard(own[0], own[1]) == jaccard(own[0], own[2]) == 1
        data += [(3 * g + i, t, "en", "s", 1) for i, t in enumerate(own)]
        want.add(3 * g)
    assert {r.doc_id for r in N.one_of_each_group(frame(spark, data)).collect()} == want
    nodes = N.node_of(N.shingle_hashes(*raw_of([r[1] for r in data]), 5))
    assert len(set(nodes.tolist())) == len(want)


def test_pairs_of_just_the_similarity_are_all_found(spark):
    """A sketch that estimates the similarity would lose some of these."""
    data = []
    for seed in range(500):
        rng = random.Random(seed)
        base = [f"k{rng.randrange(10**6)}" for _ in range(44)]
        texts = [" ".join(base), " ".join(base[:36])]  # 32 of 40 shingles
        assert jaccard(*texts) == 0.8
        data += [(2 * seed + i, t, "en", "s", 1) for i, t in enumerate(texts)]
    assert {r.doc_id for r in N.one_of_each_group(frame(spark, data)).collect()} == set(range(0, 1000, 2))


def test_thousands_of_pairs_of_every_edit(spark):
    """3000 pairs with a similarity of 0.76 to 0.84, of substitutions, insertions, moves and cuts: decisions equal brute force."""
    rng = random.Random(21)
    words = [f"k{i}" for i in range(50000)]
    data, want = [], set()
    for g in range(3000):
        base = rng.choices(words, k=rng.randrange(40, 160))
        own, share = list(base), 0.02 + 0.12 * rng.random()
        if g % 4 == 0:
            for at in rng.sample(range(len(own)), max(1, round(len(own) * share / 5))):
                own[at] = rng.choice(words)
        elif g % 4 == 1:
            for _ in range(max(1, round(len(own) * share / 5))):
                own.insert(rng.randrange(len(own)), rng.choice(words))
        elif g % 4 == 2:
            for _ in range(max(1, round(len(own) * share / 14))):
                at, to = sorted(rng.sample(range(len(own)), 2))
                own = own[:at] + own[to:] + own[at:to]
        else:
            own = own[round(len(own) * share) :]
        data += [(2 * g, " ".join(base), "en", "s", 1), (2 * g + 1, " ".join(own), "en", "s", 1)]
        want |= {2 * g} if jaccard(data[-2][1], data[-1][1]) >= 0.8 else {2 * g, 2 * g + 1}
    assert 3300 < len(want) < 5700
    assert {r.doc_id for r in N.one_of_each_group(frame(spark, data)).collect()} == want


def test_dense_groups_of_near_copies(spark):
    """1500 copies of three sources, some of them similar to another copy alone: as brute force says."""
    rng = random.Random(22)
    words = [f"k{i}" for i in range(3000)]
    base = [rng.choices(words, k=80) for _ in range(3)]
    texts = []
    for _ in range(1500):
        own = list(rng.choice(base if rng.random() < 0.7 or not texts else [t.split() for t in texts[-20:]]))
        for _ in range(rng.randrange(3)):
            own[rng.randrange(80)] = rng.choice(words)
        texts.append(" ".join(own))
    data = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    sets = [shingle_set(t) for t in texts]
    want = brute_components(range(len(sets)), lambda a, b: len(common := sets[a] & sets[b]) >= 0.8 * (len(sets[a]) + len(sets[b]) - len(common)))
    assert {r.doc_id for r in N.one_of_each_group(frame(spark, data)).collect()} == set(want.values())


def test_fingerprints_find_near_copies_by_themselves(spark, monkeypatch):
    """Long texts with one word changed: without the exact check of what is left, the fingerprints' links tie most of 80 copies."""
    rng = random.Random(23)
    words, data = [f"k{i}" for i in range(5000)], []
    for g in range(40):
        base = rng.choices(words, k=600)
        for c in range(3):
            data.append((3 * g + c, " ".join(base), "en", "s", 1))
            base[200 * c + 100] = "changed"
    monkeypatch.setattr(N, "_stars", lambda *_: spark.createDataFrame([], "a long, b long"))
    monkeypatch.setattr(N, "_mixed", lambda *_: (None, 0))
    kept = {r.doc_id for r in N.one_of_each_group(frame(spark, data)).collect()}
    assert kept >= set(range(0, 120, 3)) and len(kept) < 52  # some are six bits apart or more


def test_pairs_by_fingerprints_connect_what_all_near_ones_do(spark):
    rng = random.Random(24)
    base = [rng.getrandbits(64) for _ in range(30)]
    prints = [b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5))) & (1 << 64) - 1 for b in base for _ in range(10)]
    prints += prints[:40]  # other sets of the same fingerprint
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    pairs = N._by_fingerprints(spark.createDataFrame(list(enumerate(signed)), "node long, fp long").repartition(4)).collect()
    want = brute_components(range(len(prints)), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= N.DISTANCE)
    linked = {(r.a, r.b) for r in pairs}
    assert brute_components(range(len(prints)), lambda a, b: (min(a, b), max(a, b)) in linked) == want
    assert all((prints[a] ^ prints[b]).bit_count() <= N.DISTANCE for a, b in linked)


def test_repeated_rows_null_ids_and_clashing_names(spark):
    long = " ".join(f"w{i}" for i in range(50))
    data = [(7, long, "en", "s", 1)] * 3 + [(3, long + " end", "de", "t", 1), (None, "other text", None, None, None),
        (None, "other text", None, None, None), (9, "OTHER\n text", "en", "s", 1)]
    data += [(1, None, "en", "s", 1), (2, "", "en", "s", 1), (4, " ", "en", "s", 1), (5, "single", "en", "s", 1), (5, "single", "en", "s", 1)]
    for names in (("kept",), ("doc", "row", "place", "node", "Doc_", "text_")):
        docs = frame(spark, data).withColumns({n: F.lit(n) for n in names})
        got = N.one_of_each_group(docs)
        assert got.columns == docs.columns
        assert sorted(((r.doc_id, r.text) for r in got.collect()),
            key=repr) == sorted([(3, long + " end"), (None, "other text"), (1, None), (5, "single")], key=repr)


def test_long_texts_in_parts():
    rng = random.Random(13)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 9) for _ in range(n)) for n in (0, 1, 4, 5, 6, 40, 400, 3000)]
    batch = pa.record_batch([pa.array(texts)], names=["text"])
    whole = N.shingle_hashes(*raw_of(texts), 5)
    for most in (1, 60, 1000):
        got = [x for part in parts_sets(batch, most) for x in part]
        assert len(got) == len(whole) and all(np.array_equal(x, y) for x, y in zip(got, whole, strict=True))


def parts_sets(batch, most):
    return [own for _, own in N.shingle_sets(iter([batch]), 5, most)]


def test_parities_never_differ_more_than_sets():
    rng = np.random.default_rng(5)
    for n, k in ((10, 0), (300, 3), (300, 60), (5000, 900)):
        a = np.unique(rng.integers(-(2**63), 2**63, n + k))
        x, y = a[:n], a[k:]
        for bits, more in ((512, 512), (1024, 4096), (16384, 512)):
            apart = N.apart(N.parities(x, bits), N.parities(y, more))
            assert apart <= len(np.setxor1d(x, y)) and (k > 0) == (apart > 0)
