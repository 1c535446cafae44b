import datetime
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from auditweave import catalogue
from auditweave import model as M
from auditweave.functions import hashing as H
from auditweave.operators import candidates as C
from auditweave.operators import components as G
from auditweave.operators import evaluation as E
from auditweave.operators import findings as FD
from auditweave.operators import repair as R
from auditweave.operators import reviews as RV
from auditweave.plans.audit import Audit, capabilities
from auditweave.plans.findings_query import FindingsQuery, pages
from auditweave.sources import tables as T


def sample(i, split="train", label="cat", sha=None, phash=None, corrupt=False, embedding=None):
    return (i, f"s{i:07d}", split, label, f"{split}/{label}/{i}.png", sha, phash, 10, 10, 100, "PNG", corrupt, None, embedding)


def samples(spark, rows):
    return spark.createDataFrame(rows, M.SAMPLES)


def pairs(df):
    return sorted((r.a, r.b) for r in df.collect())


def signed(h):
    return int(h, 16) - (1 << 64) if int(h, 16) >> 63 else int(h, 16)


def test_exact_groups_skip_nulls_and_corrupt(spark):
    s = samples(spark, [sample(i, sha=h) for i, h in enumerate(["aa", "bb", "aa", None, "bb", "bb", ""])]
        + [sample(7, sha="aa", corrupt=True), sample(8, sha="")])
    assert pairs(C.exact_pairs(s)) == [(0, 2), (1, 4), (1, 5), (4, 5)]


def test_hamming_golden_case(spark):
    hashes = ["0" * 16, "01" + "0" * 14, "f" * 16, None]
    s = samples(spark, [sample(i, phash=None if h is None else signed(h)) for i, h in enumerate(hashes)])
    for find in (C.hamming_nested, C.hamming_banded, C.hamming_pairs):
        (row,) = find(s, 2).collect()
        assert (row.a, row.b, row.distance, row.similarity) == (0, 1, 1.0, round(63 / 64, 6))


@pytest.mark.parametrize("threshold", [0, 3, 8])
def test_bands_lose_nothing(spark, threshold):
    rng = random.Random(threshold)
    base = [rng.getrandbits(64) for _ in range(20)]
    prints = [b ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(9))}) for b in base for _ in range(8)] + [base[0]] * 4
    s = samples(spark, [sample(i, phash=signed(f"{h:016x}")) for i, h in enumerate(prints)])
    want = sorted((i, j) for i in range(len(prints)) for j in range(i + 1, len(prints)) if (prints[i] ^ prints[j]).bit_count() <= threshold)
    assert pairs(C.hamming_banded(s, threshold)) == pairs(C.hamming_nested(s, threshold)) == want


def test_neighbours_in_one_block_and_in_many(spark):
    rng = random.Random(2)
    vectors = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(60)] + [[0.0] * 6]
    s = samples(spark, [sample(i, embedding=v) for i, v in enumerate(vectors)])

    def rows(df):
        return sorted((r.a, r.b, r["rank"]) for r in df.collect())

    one = rows(C.neighbours(s, 4, 0.3))
    assert one == rows(C.neighbours(s, 4, 0.3, block_rows=7)) and one
    assert all(a != b for a, b, _ in one) and max(r for *_, r in one) <= 5
    assert C.neighbours(s.limit(0), 4, 0.3).count() == 0


@pytest.mark.parametrize("few", [0, 100_000])
def test_components_by_rounds_and_by_one_forest(spark, monkeypatch, few):
    monkeypatch.setattr(G, "FEW", few)
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(400 + i, 401 + i) for i in range(40)] + [(500, 500 + i) for i in range(1, 50)]
    want = G.forest(p for p in links if p[0] != p[1])
    got = {r.node: r.component for r in G.components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()}
    assert got == want
    assert G.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_and_groups(spark):
    links = spark.createDataFrame([(0, 1), (1, 2), (4, 5)], "a long, b long")
    assert sorted((r.node, r.component, r.group_id) for r in G.groups(links).collect()) == [(0, 0, "g0000"), (1, 0, "g0000"), (2, 0, "g0000"),
        (4, 4, "g0001"), (5, 4, "g0001")]


def classified(spark, method, distance, split_b="test", label_b="cat"):
    s = samples(spark, [sample(0), sample(1, split=split_b, label=label_b)])
    c = spark.createDataFrame([(0, 1, method, float(distance), 0.9)], "a long, b long, method string, distance double, similarity double")
    return FD.classify(FD.merge(c), s, 4).first()


@pytest.mark.parametrize(
    ("case", "kind", "severity", "confidence"),
    [
        (("sha256", 0), M.EXACT_CROSS, "critical", M.CONFIRMED), (("phash", 3), M.NEAR_CROSS, "high", M.LIKELY),
            (("phash", 7), M.NEAR_CROSS, "medium", M.NEEDS_REVIEW),
        (("embedding", 0.05), M.SEMANTIC, "medium", M.POSSIBLE), (("embedding", 0.05, "train"), M.SEMANTIC, "low", M.POSSIBLE),
            (("sha256", 0, "train"), M.REDUNDANT, "low", M.CONFIRMED),
        (("phash", 7, "train"), M.REDUNDANT, "low", M.NEEDS_REVIEW), (("sha256", 0, "train", "dog"), M.CONFLICT, "critical", M.CONFIRMED),
            (("phash", 4, "test", "dog"), M.CONFLICT, "high", M.LIKELY),
        (("phash", 5, "test", "dog"), M.NEAR_CROSS, "medium", M.NEEDS_REVIEW), (("sha256", 0, "test", M.UNLABELED), M.EXACT_CROSS, "critical", M.CONFIRMED),
    ],
)
def test_decision_table(spark, case, kind, severity, confidence):
    r = classified(spark, *case)
    assert (r.kind, r.severity, r.confidence_label) == (kind, severity, confidence)


def test_a_weak_pair_with_two_labels_still_says_so(spark):
    assert classified(spark, "phash", 7, "train", "dog").conflicting_label


def test_one_finding_for_a_pair_that_three_methods_see(spark):
    s = samples(spark, [sample(0), sample(1, split="test")])
    c = spark.createDataFrame([(0, 1, "embedding", 0.0, 1.0), (0, 1, "phash", 0.0, 1.0), (0, 1, "sha256", 0.0, 1.0)],
        "a long, b long, method string, distance double, similarity double")
    (r,) = FD.build(s, c, 4).collect()
    assert r.method == "sha256" and r.detail.methods == ["embedding", "phash",
        "sha256"] and r.detail.corroborated_by_multiple_methods and r.group_id == "g0000" and r.finding_id == "f_0_1"


def audit(spark):
    rows = [sample(0, sha="a"), sample(1, "test", sha="a"), sample(2, "val", "dog", sha="b"), sample(3, "train", "dog", sha="b"),
        sample(4, "test", "dog", sha="c"), sample(5, "test", "bird", sha="c"), sample(6, "train", "cat", phash=1), sample(7, "test", "cat", phash=3)]
    return Audit(samples(spark, rows), M.AuditConfig(enable_semantic=False))


def test_findings_query(spark):
    a = audit(spark)
    log = spark.createDataFrame([("f_0_1", "safe", None, datetime.datetime(2024, 1, 1)), ("f_2_3", "confirmed", "n", datetime.datetime(2024, 1, 1))], M.REVIEWS)

    def ids(**kw):
        return [r.finding_id for r in FindingsQuery(**kw).rows(a.findings, log).collect()]

    assert ids() == ["f_0_1", "f_2_3", "f_4_5", "f_6_7"]
    assert ids(split_pair="test-train") == ["f_0_1", "f_6_7"] and ids(label="bird") == ["f_4_5"] and ids(method="phash") == ["f_6_7"] and ids(kind=M.CONFLICT) == ["f_4_5"]
    assert ids(review="safe") == ["f_0_1"] and ids(review="unreviewed") == ["f_4_5", "f_6_7"] and ids(severity="high") == ["f_6_7"]
    assert ids(page_size=3, page=2) == ["f_6_7"] and FindingsQuery(page_size=3).total(a.findings, log) == 4
    page = FindingsQuery(page_size=2).with_samples(a.findings, log, a.samples.filter("idx <> 1")).collect()
    assert [(r.side_a.sample_id, r.side_b.split) for r in page] == [("s0000000", None), ("s0000002", "train")] and page[0].side_b.sample_id == "s0000001"
    assert (pages(0), pages(12), pages(13)) == (1, 1, 2)
    for bad in ({"sort": "x"}, {"split_pair": "train"}, {"page": 0}, {"page_size": 101}, {"review": "maybe"}):
        with pytest.raises(ValueError):
            FindingsQuery(**bad)


def last_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_decisions_are_never_broadcast(spark):
    """There can be as many as there are findings, and of files that compress well Spark takes them to be small."""
    a = audit(spark)
    log = spark.createDataFrame([("f_0_1", "safe", None, None), ("f_2_3", "confirmed", "n", None)], M.REVIEWS)
    repair = a.with_reviews(log).repair()
    for found in (RV.joined(a.findings, log), R.decided(a.findings, log), E.quarantine(a.findings, log), repair.warnings,
            a.score_components(log.select("finding_id"))):
        plan = last_plan(found)
        assert "SortMergeJoin [finding_id" in plan and "BroadcastHashJoin [finding_id" not in plan
    assert "BroadcastHashJoin" not in last_plan(R.group_members(a.samples, repair.tied))


def test_a_page_seeks_its_decisions_alone(spark, monkeypatch):
    """Neither all decisions nor the groups of all findings are met for it."""
    a = audit(spark)
    log = spark.createDataFrame([("f_0_1", "safe", None, None), ("f_2_3", "confirmed", "n", None)], M.REVIEWS)
    rows = FindingsQuery(page_size=2).rows(a.pairs, log)
    assert "SortMergeJoin" not in last_plan(rows)
    assert [(r.finding_id, r.review_decision, r.review_note) for r in rows.collect()] == [("f_0_1", "safe", None), ("f_2_3", "confirmed", "n")]
    monkeypatch.setattr(catalogue, "audit", lambda *_: a.with_reviews(log))
    assert catalogue.QUERIES["findings_page"](spark, "").collect() == [] and "findings" not in a.__dict__
    assert [r.finding_id for r in catalogue.QUERIES["findings_page_samples"](spark, "").collect()] == ["f_0_1", "f_2_3", "f_4_5", "f_6_7"]


def test_pairs_are_merged_by_hashes_of_numbers(spark):
    """Structs and sets by pair fall back to sorting beyond 128 pairs."""
    found = [(0, 1, "embedding", 0.2, 0.8), (0, 1, "phash", 0.03125, 0.96875), (0, 2, "phash", 0.0, 1.0), (0, 2, "sha256", 0.0, 1.0), (1, 2, "embedding", 0.1, 0.9)]
    merged = FD.merge(spark.createDataFrame(found, "a long, b long, method string, distance double, similarity double"))
    plan = last_plan(merged)
    assert "HashAggregate" in plan and "ObjectHashAggregate" not in plan and "SortAggregate" not in plan
    assert sorted(map(tuple, merged.collect())) == [(0, 1, "phash", 0.03125, 0.96875, ["embedding", "phash"]), (0, 2, "sha256", 0.0, 1.0, ["phash", "sha256"]),
        (1, 2, "embedding", 0.1, 0.9, ["embedding"])]


def test_texts_do_not_meet_vectors(spark, tmp_path, monkeypatch):
    """What is told of a text is told before the join, so the text is not shuffled."""
    spark.createDataFrame([(i, "Some words " * 9, "en", "s", 99) for i in range(3)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(T, "materialize", lambda df, name: df)
    found = T.document_samples(spark, str(tmp_path), embeddings=True)
    tree = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert next(i for i, x in enumerate(tree) if "Join" in x) < next(i for i, x in enumerate(tree) if "sha2(" in x)
    assert [(r.idx, r.embedding) for r in found.orderBy("idx").collect()] == [(0, None), (1, [1.0, 0.0]), (2, None)]


def test_majorities_of_many_tokens():
    rng = random.Random(5)
    lists = [{b"%d" % rng.randrange(10**6) for _ in range(n)} for n in (0, 1, 2, 254, 255, 256, 510, 511, 3000, 0)]
    halves = [[int.from_bytes(hashlib.md5(w).digest()[:8], "big") for w in t] for t in lists]
    want = [sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in t) > len(t)) for t in halves]
    assert H.majorities(lists) == [(w - (1 << 64) if w >> 63 else w) if t else None for w, t in zip(want, lists, strict=True)]


def test_a_page_reads_its_samples_by_a_broadcast_of_the_page(spark):
    a = audit(spark)
    log = spark.createDataFrame([], M.REVIEWS)
    plan = last_plan(FindingsQuery(page_size=2).with_samples(a.findings, log, a.samples))
    assert "LeftSemi, BuildRight" in plan and "RightOuter" not in plan


def test_reviews_latest_wins_and_unreviewed_takes_back(spark, tmp_path):
    a, log = audit(spark), str(tmp_path / "log")
    day = lambda n: datetime.datetime(2024, 1, n)
    RV.record(spark, log, a.findings, "f_0_1", "safe", at=day(1))
    RV.record(spark, log, a.findings, "f_0_1", "confirmed", "sure", at=day(2))
    RV.record(spark, log, a.findings, "f_2_3", "safe", at=day(1))
    RV.record(spark, log, a.findings, "f_2_3", "unreviewed", at=day(3))
    (row,) = RV.current(spark.read.parquet(log)).collect()
    assert (row.finding_id, row.decision, row.note) == ("f_0_1", "confirmed", "sure")
    assert RV.counts(RV.current(spark.read.parquet(log))).first().asDict() == {"confirmed": 1, "safe": 0, "uncertain": 0}
    with pytest.raises(KeyError):
        RV.record(spark, log, a.findings, "f_9_9", "safe")
    with pytest.raises(ValueError):
        RV.record(spark, log, a.findings, "f_0_1", "maybe")
    both = spark.createDataFrame([("safe", "safe"), ("safe", "confirmed"), (None, "safe")], "e string, c string")
    assert [r[0] for r in both.select(RV.toggled(F.col("e"), F.col("c"))).collect()] == ["unreviewed", "confirmed", "safe"]


def test_configuration():
    c = M.AuditConfig.resolve(phash_threshold=0, phash_strong_threshold=9, semantic_threshold=0.1, semantic_top_k=99)
    assert (c.phash_threshold, c.phash_strong_threshold, c.semantic_threshold, c.semantic_top_k) == (0, 0, 0.5, 50)
    assert M.AuditConfig.resolve(phash_threshold=None) == M.AuditConfig()
    with pytest.raises(ValueError):
        M.AuditConfig.resolve(nothing=1)
    assert capabilities()["defaults"]["phash_threshold"] == 8
