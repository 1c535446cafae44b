import hashlib

import pytest
from pyspark.sql import functions as F

from auditweave.llm import exact_dedup as E
from auditweave.llm.common import fresh_path, settings
from auditweave.llm.exact_dedup import DigestIndex, exact_dedup, first_rows

from .helpers import frame, rows


def brute(data):
    groups = {}
    for doc_id, text, *_ in data:
        groups.setdefault((text or ""), []).append(doc_id)
    out = []
    for doc_id, text, *_ in data:
        ids = groups[text or ""]
        keep = max((i for i in ids if i is not None), default=None)
        out.append((doc_id, keep, len(ids), keep is None or doc_id == keep, hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("clashing", [False, True])
def test_matches_brute_force(spark, clashing):
    got = exact_dedup(frame(spark, clashing=clashing))
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.kept, bytes(r.digest).hex()) for r in got.collect()], key=repr) == brute(rows())


def test_empty(spark):
    assert exact_dedup(frame(spark, [])).count() == 0


def test_second_batch_is_joined_against_the_index(spark):
    index = DigestIndex(spark, fresh_path(spark, "index"), 4)
    data = rows()
    index.deduplicate(frame(spark, data[:30]))
    more = [(1000 + i, r[1], *r[2:]) for i, r in enumerate(data[20:])]
    got = {(r.doc_id, bytes(r.digest)): r for r in index.deduplicate(frame(spark, more)).collect()}
    before = {r[1] or "" for r in data[:30]}
    for r in more:
        found = got[r[0], hashlib.sha256((r[1] or "").encode()).digest()]
        if (r[1] or "") in before:
            assert not found.kept and found.keep_id < 30
    assert index.rows().count() == len({r[1] or "" for r in data})


def test_hot_group(spark):
    got = exact_dedup(frame(spark, [(i, "same", "en", "s", 4) for i in range(5000)])).collect()
    assert len(got) == 5000 and {r.group_size for r in got} == {5000} and [r.doc_id for r in got if r.kept] == [4999]


def test_first_rows_keeps_one_of_each_text(spark):
    docs = frame(spark, clashing=True)
    got = first_rows(docs)
    assert got.columns == docs.columns
    texts = [r.text or "" for r in got.collect()]
    assert sorted(texts) == sorted({r[1] or "" for r in rows()})
    named = docs.withColumns({c: F.lit(1) for c in ("doc", "place", "Digest_", "a.b", "c`d")})
    assert first_rows(named).columns == named.columns and first_rows(named).count() == len(texts)


def batch(spark, *texts):
    return frame(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)])


def test_index_takes_batch_after_batch(spark, tmp_path):
    index = DigestIndex(spark, str(tmp_path / "digest-index"), buckets=4)
    first = [(1, "a", None, None, 1), (2, "b", None, None, 1)]
    second = [(3, "b", None, None, 1), (4, "c", None, None, 1), (5, "c", None, None, 1), (2, "b", None, None, 1)]
    assert {r.doc_id: r.kept for r in exact_dedup(frame(spark, first), index).collect()} == {1: True, 2: True}
    got = {(r.doc_id, r.keep_id, r.kept) for r in exact_dedup(frame(spark, second), index).collect()}
    assert got == {(3, 2, False), (4, 5, False), (5, 5, True), (2, 2, True)}
    assert index.rows().count() == 3
    assert exact_dedup(frame(spark, []), index).count() == 0


def index_side(plan):
    """The join's second child, which reads the index."""
    lines = plan.strip().split("\n")
    at = next(i for i, x in enumerate(lines) if x.startswith("+- "))
    assert "digest_index" in lines[-1]
    return lines[at:]


def test_anti_join_takes_the_index_as_it_lies(spark, tmp_path):
    index = DigestIndex(spark, str(tmp_path / "index"), buckets=4)
    index.deduplicate(batch(spark, "a", "b", "c"))
    groups = spark.createDataFrame([(b"x", 1, 1)], E.SCHEMA)
    with settings(spark, spark__sql__legacy__bucketedTableScan__outputOrdering="true", spark__sql__adaptive__enabled="false"):
        plan = index.missing(groups)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "LeftAnti" in plan
        assert not any("Exchange" in x or "Sort" in x for x in index_side(plan))  # one file in each bucket
        index.deduplicate(batch(spark, "c", "d", "e", "f", "g"))
        plan = index.missing(groups)._jdf.queryExecution().executedPlan().toString()
        assert not any("Exchange" in x for x in index_side(plan))
        index.compact()
        plan = index.missing(groups)._jdf.queryExecution().executedPlan().toString()
        assert not any("Exchange" in x or "Sort" in x for x in index_side(plan))
    assert index.rows().count() == 7


def test_indexes_with_one_last_folder_are_two(spark, tmp_path):
    one, two = (DigestIndex(spark, str(tmp_path / x / "index"), buckets=2) for x in "ab")
    one.deduplicate(batch(spark, "a"))
    assert two.rows().count() == 0
    assert [r.kept for r in exact_dedup(batch(spark, "a"), two).collect()] == [True]


def test_index_is_found_again_and_compacted(spark, tmp_path):
    path = str(tmp_path / "index")
    for i in range(E.MOST_APPENDS + 2):
        index = DigestIndex(spark.newSession() if i % 2 else spark, path, buckets=3 + i)  # the number of the first holds
        kept = {r.doc_id: r.kept for r in exact_dedup(batch(spark if i % 2 == 0 else index.spark, f"new {i}", "old"), index).collect()}
        assert kept == {0: True, 1: True}  # the id that was kept with the first batch comes again
        spark.sql(f"DROP TABLE {index.name}")  # as in another application: only the files are left
    index = DigestIndex(spark, path + "/")
    assert index.buckets == 3 and index.state["appends"] == 2 and index.rows().count() == E.MOST_APPENDS + 3


def test_null_ids_over_batches_and_a_batch_given_twice(spark, tmp_path):
    index = DigestIndex(spark, str(tmp_path / "index"), buckets=2)

    def kept(*rows):
        return sorted(((r.doc_id, r.keep_id, r.kept) for r in exact_dedup(frame(spark, [(i, t, "en", "s", 1) for i, t in rows]), index).collect()), key=repr)

    assert kept((None, "x"), (1, "y")) == [(1, 1, True), (None, None, True)]
    assert kept((5, "x"), (None, "x")) == [(5, None, False), (None, None, False)]  # x is in the index, under no id
    assert kept((1, "y"), (2, "y"), (None, "y")) == [(1, 1, True), (2, 1, False), (None, 1, False)]
    twice = [(7, "z"), (8, "z"), (None, "q")]
    assert kept(*twice) == [(7, 8, False), (8, 8, True), (None, None, True)]
    assert kept(*twice) == [(7, 8, False), (8, 8, True), (None, None, False)]


def test_two_writers(spark, tmp_path):
    one, two = (DigestIndex(spark, str(tmp_path / "index"), buckets=2) for _ in range(2))
    with one._locked(), pytest.raises(E.IndexBusy):
        two.deduplicate(batch(spark, "a"))
    assert one.rows().count() == 0
    assert [r.kept for r in two.deduplicate(batch(spark, "a")).collect()] == [True]
    assert [r.kept for r in one.deduplicate(frame(spark, [(9, "a", "en", "s", 1)])).collect()] == [False]  # sees what two has added
    with one._locked():
        two.unlock()
        assert [r.kept for r in two.deduplicate(batch(spark, "b")).collect()] == [True]
