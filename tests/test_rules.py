import datetime
import json

import numpy as np
import pytest

from auditweave import model as M
from auditweave.operators import evaluation as E
from auditweave.operators import findings as F_
from auditweave.operators import inventory as I
from auditweave.operators import jobs as J
from auditweave.operators import repair as R
from auditweave.operators import score as S
from auditweave.plans import report as RP
from auditweave.plans.audit import Audit
from auditweave.sources import tables as T
from auditweave.streaming import status

from .test_findings import audit, sample, samples


def no_reviews(spark):
    return spark.createDataFrame([], M.REVIEWS)


def totals(spark, valid=100, corrupt=0, test=20, ratio=1.0, classes=2, fraction=0.2):
    return spark.createDataFrame([(valid + corrupt, valid, corrupt, test, classes, ratio, fraction)],
        "total long, valid long, corrupt long, test long, classes long, class_imbalance_ratio double, test_fraction double")


def found(spark, kinds):
    return spark.createDataFrame([(f"f_{a}_{b}", k, a, b) for k, a, b in kinds], "finding_id string, kind string, a_idx long, b_idx long")


def test_a_clean_inventory_scores_100(spark):
    r = S.integrity(S.components(found(spark, []), totals(spark))).first()
    assert (r.score, r.grade, r.total_penalty) == (100.0, "Low risk", 0.0)


def test_published_score_of_the_demo(spark):
    kinds = [(M.EXACT_CROSS, i, 50 + i) for i in range(3)] + [(M.CONFLICT, 10, 60)] + [(M.NEAR_CROSS, 20 + i, 70 + i)
        for i in range(7)] + [(M.SEMANTIC, 30, 80)]
    parts = S.components(found(spark, kinds), totals(spark, 115, 1, 38, 2.789, 3, 0.3304))
    r = S.integrity(parts).first()
    assert (r.score, r.grade, r.total_penalty) == (29.1, "Severe risk", 70.868)
    assert {p.category: p.penalty for p in parts.collect()}[M.CONFLICT] == 14.493


def test_exact_leaks_cost_more_than_overlaps_and_exclusions_count(spark):
    def penalty(kinds, excluded=None):
        return S.integrity(S.components(found(spark, kinds), totals(spark), excluded)).first().total_penalty

    exact, semantic = penalty([(M.EXACT_CROSS, 0, 1)]), penalty([(M.SEMANTIC, 0, 1)])
    assert exact > semantic > 0 and penalty([(M.EXACT_CROSS, 0, 1), (M.EXACT_CROSS, 2, 3)]) > exact
    assert penalty([(M.EXACT_CROSS, 0, 1)], spark.createDataFrame([("f_0_1",)], "finding_id string")) == 0


@pytest.mark.parametrize(("test", "fraction", "penalty"), [(0, 0.0, 3.0), (4, 0.04, 3.0), (7, 0.075, 1.5), (20, 0.2, 0.0), (55, 0.55, 1.5), (90, 0.9, 3.0)])
def test_split_imbalance(spark, test, fraction, penalty):
    parts = S.components(found(spark, []), totals(spark, test=test, fraction=fraction))
    assert {p.category: p.penalty for p in parts.collect()}[M.SPLIT_IMBALANCE] == pytest.approx(penalty)


def test_inventory_and_issues(spark):
    rows = [sample(i, "train", "a") for i in range(6)] + [sample(6, "test", "b"), sample(7, "train", "b", corrupt=True)]
    s = samples(spark, rows)
    t = I.totals(s).first()
    assert (t.total, t.valid, t.corrupt, t.class_imbalance_ratio, t.test_fraction) == (8, 7, 1, 6.0, 0.1429)
    assert sorted((r.split, r.label) for r in I.missing_classes(s).collect()) == [("test", "a"), ("train", "b")]
    got = {r.issue_id: (r.severity, r.title) for r in I.issues(s).collect()}
    assert got == {"issue_corrupt": ("medium", "1 corrupt or unreadable image(s)"),
        "issue_class_imbalance": ("medium", "Class imbalance ratio 6.0x (largest class / smallest class)"),
        "issue_missing_classes": ("low", "2 class/split combination(s) empty")}
    assert {r.issue_id for r in I.issues(s.filter("split = 'train'")).collect()} == {"issue_corrupt", "issue_no_test_split"}
    empty = I.totals(s.limit(0)).first()
    assert (empty.total, empty.class_imbalance_ratio, empty.test_fraction) == (0, None, 0.0)


def test_percentiles_leave_out_zeros(spark):
    rows = [(*sample(i)[:7], w, 10, 100, "PNG", False, None, None) for i, w in enumerate([0, 10, 20, 30, 40])]
    got = {r.measure: tuple(r)[1:] for r in I.percentiles(samples(spark, rows)).collect()}
    assert got["width"] == (10.0, 17.5, 25.0, 32.5, 40.0) and got["aspect_ratio"] == (1.0, 1.75, 2.5, 3.25, 4.0)


def test_fingerprint_does_not_depend_on_order(spark):
    rows = [sample(i, sha=h) for i, h in enumerate(["x", "y", "x"])]
    a, b = I.fingerprint(samples(spark, rows)).first()[0], I.fingerprint(samples(spark, rows[::-1]).repartition(3)).first()[0]
    assert a == b != I.fingerprint(samples(spark, rows[:2])).first()[0]


def plan(spark, splits, kind=M.EXACT_CROSS, decision=None, include=False, corrupt=()):
    s = samples(spark, [sample(i, x, corrupt=i in corrupt) for i, x in enumerate(splits)] + [sample(99)])
    f = found(spark, [(kind, i, i + 1) for i in range(len(splits) - 1)])
    r = spark.createDataFrame([(f"f_{i}_{i + 1}", decision, None, None) for i in range(len(splits) - 1)] if decision else [], M.REVIEWS)
    tied = R.members(f, r, include)
    return {e.idx: (e.proposed_split, e.action) for e in R.manifest(s, tied, R.plan_groups(s, f, r, tied)).collect()}


def test_repair_rules(spark):
    assert plan(spark, ["train", "test", "test"]) == {0: ("test", "move"), 1: ("test", "keep"), 2: ("test", "keep"), 99: ("train", "keep")}
    assert plan(spark, ["train", "test"])[1] == ("train", "move")
    assert plan(spark, ["test", "val"])[1] == ("test", "move")
    assert plan(spark, ["val", "test"])[1] == ("val", "move")
    assert plan(spark, ["val", "val"])[0] == ("val", "keep")
    assert plan(spark, ["train", "test"], kind=M.CONFLICT)[0] == ("excluded", "exclude")
    assert plan(spark, ["train", "test"], decision="safe")[1] == ("test", "keep")
    assert plan(spark, ["train", "test"], kind=M.SEMANTIC)[1] == ("test", "keep")
    assert plan(spark, ["train", "test"], kind=M.SEMANTIC, include=True)[1] == ("train", "move")
    assert plan(spark, ["train", "test"], kind=M.SEMANTIC, decision="confirmed")[1] == ("train", "move")
    assert plan(spark, ["train", "test"], corrupt={1})[1] == ("excluded", "exclude")
    assert len(plan(spark, ["train", "test", "val"])) == 4


def test_warnings(spark):
    a = audit(spark)
    repair = a.repair()
    assert sorted(r.warning for r in repair.warnings.collect()) == []
    s = samples(spark, [sample(i, "train") for i in range(3)] + [sample(3 + i, "test") for i in range(3)])
    f = found(spark, [(M.EXACT_CROSS, i, 3 + i) for i in range(3)])
    tied = R.members(f, no_reviews(spark))
    entries = R.manifest(s, tied, R.plan_groups(s, f, no_reviews(spark), tied))
    (w,) = R.warnings(s, f, no_reviews(spark), entries).collect()
    assert w.warning.startswith("Class 'cat' would lose 3 of 3 test samples")
    assert {r.split: (r.before, r.after, r.delta) for r in R.split_delta(s, entries).collect()} == {"train": (3, 6, 3), "test": (3, 0, -3)}


@pytest.mark.parametrize(
    ("rows", "start"),
    [
        ([("test", "a", 20)], "No training split"), ([("train", "a", 20)], "No test split"),
            ([("train", M.UNLABELED, 20), ("test", M.UNLABELED, 20)], "The dataset has no class labels"),
        ([("train", "a", 20), ("test", "a", 20)], "Need at least 2 classes present in both train and test; found 1."),
            ([("train", "a", 20), ("train", "b", 4), ("test", "a", 20), ("test", "b", 9)], "Classes with fewer than 5 training samples: b."),
        ([("train", "a", 20), ("train", "b", 20), ("test", "a", 5), ("test", "b", 4)], "Test split has 9 samples"),
            ([("train", "a", 20), ("train", "b", 20), ("test", "a", 5), ("test", "b", 5)], "Dataset is eligible"),
    ],
)
def test_eligibility(spark, rows, start):
    out = [sample(i, split, label) for i, (split, label) in enumerate((s, c) for s, c, n in rows for _ in range(n))]
    r = E.eligibility(samples(spark, out), M.AuditConfig()).first()
    assert r.reason.startswith(start) and r.eligible == start.startswith("Dataset")


def separable(spark, copies=6):
    rows, f = [], []
    for i in range(60):
        label, split = "ab"[i % 2], "train" if i < 40 else "test"
        rows.append(sample(i, split, label, embedding=[1.0 - 0.3 * (i % 2), 0.2 + 0.7 * (i % 2) + i / 500]))
    for c in range(copies):
        rows.append(sample(60 + c, "test", "ab"[c % 2], embedding=rows[c][13]))
        f.append((c, 60 + c))
    s = samples(spark, rows)
    found = spark.createDataFrame([(f"f_{a}_{b}", M.EXACT_CROSS, "critical", "sha256", a, b, "train", "test", 1.0, True) for a, b in f],
        "finding_id string, kind string, severity string, method string, a_idx long, b_idx long, split_a string, split_b string, similarity double, cross_split boolean")
    return s, found


def test_evaluation_gap(spark):
    s, f = separable(spark)
    r = E.gap(s, f, no_reviews(spark), M.AuditConfig()).first()
    assert r.eligible and r.quarantined == 6 and r.clean_samples == 20 and r.gap >= 0 and r.accuracy == 1.0 and (r.low, r.high) == (1.0, 1.0)
    again = E.gap(s, f, no_reviews(spark), M.AuditConfig()).first()
    assert again == r
    safe = spark.createDataFrame([(f"f_{i}_{60 + i}", "safe", None, None) for i in range(6)], M.REVIEWS)
    r = E.gap(s, f, safe, M.AuditConfig()).first()
    assert r.quarantined == 0 and r.gap is None and r.note.startswith("No test samples")


def test_accuracy_and_macro_f1(spark):
    p = spark.createDataFrame([(0, 0.0, 0.0), (1, 0.0, 1.0), (2, 1.0, 1.0), (3, 1.0, 1.0), (4, 2.0, 1.0)], "idx long, label double, prediction double")
    r = E.accuracy(p).first()
    assert r.test_samples == 5 and r.accuracy == pytest.approx(3 / 5) and r.macro_f1 == pytest.approx((2 / 3 + 4 / 6 + 0) / 3)


def test_bootstraps_agree(spark):
    p = spark.createDataFrame([(i, 1.0, float(i % 4 > 0)) for i in range(400)], "idx long, label double, prediction double")
    one = E.bootstrap(p, M.AuditConfig(bootstrap="sequence"), 5).first()
    right, rng = np.array([int(i % 4 > 0) for i in range(400)]) == 1, np.random.RandomState(5)
    stats = [right[rng.randint(0, 400, size=400)].mean() for _ in range(1000)]
    assert (one.low, one.high) == tuple(round(float(x), 4) for x in np.percentile(stats, [2.5, 97.5]))
    other = E.bootstrap(p, M.AuditConfig(), 5).first()
    assert tuple(other) == tuple(E.bootstrap(p.repartition(5), M.AuditConfig(), 5).first())
    with pytest.raises(ValueError, match="bootstrap"):
        M.AuditConfig.resolve(bootstrap="poisson")
    assert abs(one.low - other.low) < 0.02 and abs(one.high - other.high) < 0.02
    assert E.bootstrap(p.limit(5), M.AuditConfig(), 5).count() == 0


def test_jobs_are_written_and_guarded(spark, tmp_path):
    path = str(tmp_path / "log")
    job = J.create(spark, path)
    with pytest.raises(ValueError, match="not complete .status: queued"):
        J.found(J.log(spark, path), job, complete=True)
    J.advance(spark, path, job, "indexing")
    assert J.found(J.log(spark, path), job).status == "running"
    J.advance(spark, path, job, "complete")
    assert J.found(J.log(spark, path), job, complete=True).n_events == 3
    with pytest.raises(ValueError, match="unknown stage"):
        J.advance(spark, path, job, "resting")
    J.advance(spark, path, job, "deleted")
    for missing in (job, "nobody"):
        with pytest.raises(KeyError, match="not found"):
            J.found(J.log(spark, path), missing)
        with pytest.raises(KeyError, match="not found"):
            J.advance(spark, path, missing, "scoring")


def test_job_lifecycle(spark):
    t = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    log = spark.createDataFrame([(1, 7, "queued", t(0)), (2, 7, "indexing", t(1)), (3, 8, "complete", t(30))],
        "event_id long, job_id long, stage string, ts timestamp_ntz")
    state = J.latest_state(log)
    assert {r.job_id: r.stage for r in state.collect()} == {7: "indexing", 8: "complete"}
    from pyspark.sql import functions as F

    gone = J.expired(state, F.lit("2024-01-02 12:00:00").cast("timestamp_ntz"))
    assert [r.job_id for r in gone.collect()] == [7] and [r.event_id for r in J.without(log, gone).collect()] == [3]
    jobs = spark.createDataFrame([(1, "indexing", "running"), (2, "complete", "complete")], "job_id long, stage string, status string")
    states = {(r.job_id, r.key): r.state for r in J.stage_progress(jobs).collect()}
    assert states[1, "validating"] == "pending" and states[1, "indexing"] == "active" and states[1, "scoring"] == "complete" and states[2,
        "scoring"] == "complete"


def test_exports(spark, tmp_path):
    a = audit(spark)
    table = RP.findings_table(a.findings, a.decisions)
    assert table.columns == RP.FINDING_COLUMNS and [r.review_decision for r in table.collect()] == ["unreviewed"] * 4
    RP.write_csv(table, str(tmp_path / "f"))
    assert spark.read.option("header", True).csv(str(tmp_path / "f")).count() == 4
    entries = RP.repair_table(a.repair().entries)
    assert entries.columns == RP.REPAIR_COLUMNS and entries.count() == 8
    parts = RP.report(a, "<demo>", "2024-01-01", evaluation=True)
    assert json.loads(RP.to_json(parts))["findings_total"] == 4 and parts["evaluation"]["eligible"] is False
    page = RP.to_html(parts)
    assert "&lt;demo&gt;" in page and "<demo>" not in page and parts["generated_at"] and parts["findings"][0]["review"] == {"decision": "unreviewed",
        "note": None}


def test_report_has_all_findings(spark, tmp_path):
    """401 pairs of equal samples: the JSON has all, the page the first 400 and the number of all."""
    rows = [(i, f"s{i:07d}", "train" if i % 2 else "test", "c", f"{i}", f"{i // 2}", None, 1, 1, 1, "png", False, None, None) for i in range(802)]
    a = Audit(spark.createDataFrame(rows, M.SAMPLES), M.AuditConfig(enable_perceptual=False, enable_semantic=False))
    parts = RP.report(a, "many", "2024-01-01", evaluation=False, job_id="j1")
    assert len(json.loads(RP.to_json(parts))["findings"]) == 401 == parts["findings_total"] and parts["audit"]["job_id"] == "j1"
    page = RP.to_html(parts)
    assert "first 400 of 401" in page
    written = RP.report(a, "many", "2024-01-01", evaluation=False, findings_path=str(tmp_path / "f"))
    assert spark.read.json(written["findings_path"]).count() == 401 and [f["id"] for f in written["findings"]] == [f["id"] for f in parts["findings"][:400]]


def test_stored_tables_replace_one_job(spark, tmp_path):
    root = str(tmp_path)
    for job, n in (("a", 3), ("b", 2), ("a", 1)):
        T.store(spark.range(n), root, "issues", job)
    assert T.stored(spark, root, "issues", "a").count() == 1 and T.stored(spark, root, "issues", "b").count() == 2
    with pytest.raises(ValueError):
        T.store(spark.range(1), root, "nothing", "a")
    T.store(T.result_row(spark, "a", summary={"score": 3}), root, "results", "a")
    (r,) = T.stored(spark, root, "results", "a").collect()
    assert json.loads(r.body) == {"score": 3}
    assert T.drop(spark, root, "a") == 2 and T.stored(spark, root, "issues", "a").count() == 0 and T.stored(spark, root, "issues", "b").count() == 2


def test_json_text(spark):
    from pyspark.sql import functions as F

    from pyspark.sql.types import StructType as T_

    from auditweave.functions import blobs

    rows = spark.createDataFrame([('{"a": 1, "b": {"c": "x"}}',), ("{broken",), (None,), ("{}",)], "t string")
    got = [r[0] for r in rows.select(blobs.load(F.col("t"), T_.fromDDL("a int, b struct<c:string>"))).collect()]
    assert got[0].a == 1 and got[0].b.c == "x" and got[1] is None and got[2] is None and got[3].a is None
    assert [r[0] for r in rows.select(F.from_json(blobs.dump(F.struct("t")), "t string")["t"]).collect()] == [r.t for r in rows.collect()]


def test_reviews_change_the_plan_but_not_the_evidence(spark):
    a = audit(spark)
    ids = [r.finding_id for r in a.findings.collect()]
    b = a.with_reviews(spark.createDataFrame([(i, "safe", None, None) for i in ids], M.REVIEWS))
    assert b.findings is a.findings and b.repair().counts.first().moves == 0 and a.repair().counts.first().moves > 0
    assert Audit(a.samples, M.AuditConfig(enable_exact=False, enable_perceptual=False, enable_semantic=False)).findings.count() == 0


def test_a_plan_ties_samples_once_and_reads_no_group_ids(spark, monkeypatch):
    """Groups of all findings are no part of a plan: they were sought for it, and joined at each read of the findings and of the reviews made of them."""
    sought, tie = [], R.groups
    for module in (R, F_):
        monkeypatch.setattr(module, "groups", lambda links: sought.append(1) or tie(links))
    a = audit(spark)
    b = a.with_reviews(T.made_reviews(a.pairs))  # as the queries have them
    plan, score = b.repair(), b.score().first()
    assert len(sought) == 1 and "findings" not in b.__dict__ and "group_id" not in b.pairs.columns
    assert all("Join" not in x._jdf.queryExecution().executedPlan().toString() for x in (b.pairs, b.verdicts, plan.tied, plan.groups, plan.entries))
    c = a.with_reviews(b.decisions)
    assert c.findings.count() == c.pairs.count() == b.verdicts.count() + b.decisions.filter("decision = 'safe'").count() and c.score().first() == score
    tied = R.members(c.findings, c.decisions)
    entries = R.manifest(c.samples, tied, R.plan_groups(c.samples, c.findings, c.decisions, tied))
    assert sorted(entries.collect(), key=lambda e: e.idx) == sorted(plan.entries.collect(), key=lambda e: e.idx)


def test_stream_of_states(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    rows = [(i, i % 3, ["queued", "indexing", "complete"][i // 3], t + datetime.timedelta(minutes=i)) for i in range(9)]
    spark.createDataFrame(rows, status.EVENTS).repartition(3).write.parquet(str(tmp_path / "in"))
    events = status.read_events(spark, str(tmp_path / "in"), 1)
    status.write(status.latest_states(events), "states", str(tmp_path / "c1")).awaitTermination()
    assert {r.job_id: (r.stage, r.n_events) for r in spark.table("states").collect()} == {0: ("complete", 3), 1: ("complete", 3), 2: ("complete", 3)}
    status.write(status.stage_counts(events), "counts", str(tmp_path / "c2")).awaitTermination()
    assert sum(r.n for r in spark.table("counts").collect()) == 9


def test_stream_of_a_job_log(spark, tmp_path):
    path = str(tmp_path / "log")
    jobs = [J.create(spark, path) for _ in range(3)]
    for job in jobs[:2]:
        J.advance(spark, path, job, "indexing")
    J.advance(spark, path, jobs[0], "complete")
    status.write(status.latest_states(status.read_log(spark, path, 1)), "log_states", str(tmp_path / "c")).awaitTermination()
    assert {r.job_id: (r.stage, r.n_events) for r in spark.table("log_states").collect()} == {jobs[0]: ("complete", 3), jobs[1]: ("indexing", 2), jobs[2]: ("queued", 1)}


def test_numbers_beside_columns_of_any_name(spark):
    from pyspark.sql import functions as F

    from auditweave.operators.order import numbered

    rows = spark.range(50).select((F.col("id") * 3).alias("key"), F.lit("a").alias("part"), F.lit("b").alias("PLACE"), F.lit("c").alias("before")).repartition(4)
    got = numbered(rows, "key", "n")
    assert got.columns == ["key", "part", "PLACE", "before", "n"] and sorted((r.key, r.n) for r in got.collect()) == [(3 * i, i) for i in range(50)]
