"""Searches that don't compare all pairs, against those that do."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditweave import model as M
from auditweave.operators import bands as B
from auditweave.operators import candidates as C
from auditweave.operators import findings as FD
from auditweave.operators import neighbours as N
from auditweave.operators.classes import Classes
from auditweave.operators.components import groups
from auditweave.storage import materialize


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def hashes(n, clusters, flips, seed=1):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(clusters)]
    out = []
    for _ in range(n):
        h = rng.choice(centres)
        for b in rng.sample(range(64), rng.randrange(flips + 1)):
            h ^= 1 << b
        out.append(h)
    return sorted(set(out))


@pytest.mark.parametrize("threshold", [0, 1, 3, 8, 16, 24])
def test_bands_find_all_pairs(spark, threshold):
    own = hashes(400, 25, 14)
    values = spark.createDataFrame([(signed(h),) for h in own], "h long")
    want = sorted((min(p), max(p), (a ^ b).bit_count()) for a,
        b in itertools.combinations(own, 2) if (a ^ b).bit_count() <= threshold for p in [(signed(a), signed(b))])
    assert sorted(map(tuple, C.value_pairs(values, threshold).collect())) == want


def test_distances_of_bands_add_up(spark):
    values = spark.createDataFrame([(signed(h),) for h in hashes(2000, 2000, 3)], "h long")
    for threshold in (1, 4, 8, 12, 16, 20, 24):
        chosen, _ = B.plan(values, threshold)
        assert sum(b.distance + 1 for b in chosen) == threshold + 1
        assert all(b.width <= B.WIDEST for b in chosen)


def test_few_candidates_are_met_where_the_distance_allows(spark):
    """Of random hashes: a small part of all pairs at 8, and the plan's figure is what is met."""
    own = hashes(4000, 4000, 0)
    values = spark.createDataFrame([(signed(h),) for h in own], "h long")
    every = len(own) ** 2 / 2
    chosen, cost = B.plan(values, 8)
    met = 0.0
    for b in chosen:
        seen = {}
        for h in own:
            seen.setdefault(h >> b.shift & (1 << b.width) - 1, []).append(h)
        met += sum(len(seen.get(v ^ m, ())) * len(hs) for v, hs in seen.items() for m in b.masks()) / 2
    balls = sum(1 + len(b.masks()) for b in chosen) * len(own)
    assert met + balls == pytest.approx(cost, rel=0.05) and met < 0.03 * every


def test_bands_shun_bits_that_all_hashes_share(spark):
    """The low 16 bits are the same everywhere: a band there would bring all pairs to each other."""
    values = spark.createDataFrame([(signed(h & ~0xFFFF),) for h in hashes(3000, 3000, 0)], "h long").distinct()
    chosen, cost = B.plan(values, 8)
    assert all(b.shift >= 16 or b.shift + b.width > 20 for b in chosen) and cost < 0.1 * 3000**2 / 2


@pytest.mark.parametrize("chunk", [1, 7, 1024])
def test_chunks_of_a_hot_band_value_meet_all(spark, monkeypatch, chunk):
    """All hashes share the low 32 bits, so a band has one value; groups of near copies beside them."""
    monkeypatch.setattr(B, "CHUNK", chunk)
    own = sorted({h & ~0xFFFFFFFF for h in hashes(300, 12, 9)})
    values = spark.createDataFrame([(signed(h),) for h in own], "h long")
    bands = [B.Band(shift, 16, 2) for shift in (0, 16, 48)]
    want = sorted((min(p), max(p), (a ^ b).bit_count()) for a, b in itertools.combinations(own, 2)
        if (a ^ b).bit_count() <= 8 for p in [(signed(a), signed(b))])
    assert sorted(map(tuple, B.pairs(values, bands, 8).collect())) == want


@pytest.mark.parametrize("threshold", [8, 16])
def test_enumerated_rows_are_never_broadcast(spark, threshold):
    """What Spark expects of an explode leaves out how many rows it makes: a small table of hashes became a broadcast of a thousand times its rows."""
    values = materialize(spark.createDataFrame([(signed(h),) for h in hashes(500, 500, 0)], "h long"), "hashes")
    tree = C.value_pairs(values, threshold)._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(line) - len(line.lstrip(" :+-")) for line in tree]
    for i, line in enumerate(tree):
        if "BroadcastExchange" in line:
            below = itertools.takewhile(lambda k: depth[k] > depth[i], range(i + 1, len(tree)))  # noqa: B023
            assert not any("Generate" in tree[k] for k in below)
    assert any("Generate" in line for line in tree)


def vectors(spark, rows):
    return spark.createDataFrame([(i, False, [float(x) for x in v]) for i, v in rows], "idx long, corrupt boolean, embedding array<float>").repartition(5)


def brute(rows, top_k, threshold):
    idx = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float32).astype(float)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    s = np.round(x @ x.T, 12)
    out = []
    for a in range(len(rows)):
        best = np.lexsort((idx, -s[a]))[: top_k + 1]
        out += [(int(idx[a]), int(idx[b]), round(float(s[a, b]), 6)) for b in best if b != a and s[a, b] >= threshold]
    return sorted(out)


@pytest.mark.parametrize("threshold,block_rows,per_pivot", [(0.5, 16, 20), (0.9, 4096, 256), (0.9, 16, 20), (-1.0, 16, 20)])
def test_neighbours_equal_all_comparisons(spark, monkeypatch, threshold, block_rows, per_pivot):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 24))
    rows = [(i, centres[i % 12] + rng.normal(0, 0.35, 24)) for i in range(300)]
    rows += [(1000 + i, rows[5][1]) for i in range(40)] + [(2000 + i, rows[7][1]) for i in range(3)]
    rows = [(i, np.round(v, 2)) for i, v in rows]
    monkeypatch.setattr(N.lists, "__defaults__", (*N.lists.__defaults__[:-1], per_pivot))
    got = C.neighbours(vectors(spark, rows), 6, threshold, block_rows=block_rows)
    assert sorted((r.a, r.b, round(r.similarity, 6)) for r in got.collect()) == brute(rows, 6, threshold)


def test_a_batch_of_queries_grows_with_the_vectors(spark):
    """Blocks are read for many queries at once: with 128 at a time each block of 20,000 vectors was read 160 times."""
    rng = np.random.default_rng(5)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(20_000, 8)))]
    visited = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    N.lists(vectors(spark, rows), 4, 0.35, visited).collect()
    assert visited[1].value <= 120 * (20_000 // 256 + 1)


def test_neighbours_that_single_precision_cannot_tell_apart():
    rng = np.random.default_rng(6)
    rows = rng.normal(size=8) + 1e-8 * rng.normal(size=(200, 8))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    queries = np.eye(8)[:3] + rows[:3]
    queries /= np.linalg.norm(queries, axis=1, keepdims=True)
    best = N.Lists(3, 5)
    for at in range(0, 200, 50):
        best.search(np.arange(3), queries, rows[at : at + 50], np.arange(at, at + 50), np.arange(51), 0.1)
    exact = np.round(queries @ rows.T, 12)
    want = [sorted(zip((-x).tolist(), range(200), strict=True))[:5] for x in exact]
    assert best.name.tolist() == [[i for _, i in w] for w in want]


def test_blocks_that_cannot_matter_are_not_read(spark):
    rng = np.random.default_rng(3)
    centres = np.eye(16)
    rows = [(i, centres[i % 16] + rng.normal(0, 0.02, 16)) for i in range(1600)]
    visited = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    got = N.lists(vectors(spark, rows), 4, 0.9, visited, per_pivot=25).collect()
    assert sorted((r.a, r.b) for r in got if r.a != r.b) == [(a, b) for a, b, _ in brute(rows, 3, 0.9)]
    assert 0 < visited[0].value < 0.4 * visited[1].value


def test_no_vectors(spark):
    assert C.neighbours(vectors(spark, []), 3, 0.9).collect() == []
    zero = vectors(spark, [(1, [0, 0]), (2, [0, 0]), (3, [1, 0])])
    assert C.neighbours(zero, 3, 0.9).collect() == []


def labelled(spark, seed=4, n=300):
    """Samples with groups of copies, near hashes, unlabelled ones, nulls and corrupt ones; equal content has equal hashes."""
    rng = random.Random(seed)
    contents = [(f"{i:064x}", h) for i, h in enumerate([signed(h) for h in hashes(40, 6, 5, seed)] + [None, None])]
    contents += [(f"{900 + i:064x}", contents[i][1]) for i in range(6)]  # other content, same hash
    rows = []
    for i in range(n):
        sha, h = rng.choice(contents[:3] + contents) if rng.random() < 0.95 else (rng.choice([None, ""]), rng.choice(contents)[1])
        rows.append((i, f"s{i}", rng.choice(M.SPLITS), rng.choice(["cat", "dog", M.UNLABELED]), sha, h, rng.random() < 0.05))
    return spark.createDataFrame(rows, "idx long, sample_id string, split string, label string, sha256 string, phash long, corrupt boolean").repartition(4)


@pytest.mark.parametrize("exact,near,threshold,strong", [(True, True, 8, 4), (True, True, 3, 0), (True, False, 8, 4), (False, True, 8, 4)])
def test_classes_count_what_pairs_do(spark, exact, near, threshold, strong):
    samples = labelled(spark)
    similar = spark.createDataFrame([(a, b, "embedding", 0.05, 0.95) for a in range(0, 290, 7) for b in (a + 1, a + 9)],
        "a long, b long, method string, distance double, similarity double")
    valid = samples.filter("not corrupt").select("idx")
    similar = similar.join(valid.withColumnRenamed("idx", "a"), "a").join(valid.withColumnRenamed("idx", "b"), "b").select("a", "b", "method", "distance",
        "similarity")
    found = [similar] + ([C.exact_pairs(samples)] if exact else []) + ([C.hamming_nested(samples, threshold)] if near else [])
    candidates = found[0]
    for more in found[1:]:
        candidates = candidates.unionByName(more)
    findings = FD.build(samples, candidates, strong, grouped=False)
    classes = Classes(samples, threshold, strong, similar, exact, near)
    want = sorted(map(tuple, findings.groupBy("kind", "severity").agg(F.count("*")).collect()))
    assert sorted(map(tuple, classes.counts().select("kind", "severity", "n").collect())) == want and len(want) >= 3
    assert sorted(map(tuple, classes.affected().collect())) == sorted(map(tuple, FD.affected(findings).collect()))
    assert sorted(map(tuple, groups(classes.edges()).select("node", "component").collect())) == sorted(
        map(tuple, groups(findings.select(F.col("a_idx").alias("a"), F.col("b_idx").alias("b"))).select("node", "component").collect()))
    if exact:
        assert classes.classes.count() < 60


def test_counts_of_partners_are_never_broadcast(spark):
    """They grow with the samples, and a caller's plan had sixteen broadcasts of them."""
    found = Classes(labelled(spark), 8, 4).affected()
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_pairs_by_rank(spark):
    samples = labelled(spark)
    classes = Classes(samples, 8, 4)
    every = sorted((r.a, r.b) for r in C.exact_pairs(samples).collect())
    assert sorted((r.a, r.b) for r in classes.export(chunk=7).collect()) == every
    total = classes.classes.agg(F.sum("t")).first()[0]
    pages = [classes.expand(at, 50).collect() for at in range(0, total, 50)]
    assert sorted((r.a, r.b) for p in pages for r in p) == every and [len(p) for p in pages[:-1]] == [50] * (len(pages) - 1)
    assert sorted(r.rank for p in pages for r in p) == list(range(total)) and classes.expand(total, 50).collect() == []


def test_a_large_class_is_one_row(spark):
    n = 100_000
    sample = F.col("id").alias("idx"), F.format_string("s%d", "id").alias("sample_id"), F.element_at(F.array(*map(F.lit, M.SPLITS)),
        (F.col("id") % 3 + 1).cast("int")).alias("split")
    samples = spark.range(n).select(*sample, F.when(F.col("id") % 10 == 0, "dog").otherwise("cat").alias("label"), F.lit("ab" * 32).alias("sha256"),
        F.lit(7).cast("long").alias("phash"), F.lit(False).alias("corrupt"))
    classes = Classes(samples, 8, 4)
    assert classes.classes.count() == 1 and classes.relation().count() == 1
    counts = {r.kind: r.n for r in classes.counts().collect()}
    assert sum(counts.values()) == n * (n - 1) // 2
    exact = {k: 0 for k in (M.CONFLICT, M.EXACT_CROSS, M.REDUNDANT)}
    own = {(r.split, r.label): r.n for r in classes.cells.collect()}
    for (a, na), (b, nb) in itertools.combinations_with_replacement(own.items(), 2):
        kind = M.CONFLICT if a[1] != b[1] else M.EXACT_CROSS if a[0] != b[0] else M.REDUNDANT
        exact[kind] += na * (na - 1) // 2 if a == b else na * nb
    assert counts == exact
    assert {r.kind: r.affected_samples for r in classes.affected().collect()} == {k: n for k in exact}
    top = counts and n * (n - 1) // 2 - 3
    assert [tuple(r)[1:] for r in classes.expand(top, 10).orderBy("rank").collect()] == [(n - 4, n - 1), (n - 3, n - 1), (n - 2, n - 1)]
