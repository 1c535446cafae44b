import zlib

import numpy as np
import pytest

from auditweave.llm import queries
from auditweave.llm.sharding import jump_hash, shard, stable_keys, write_shards

from .helpers import frame, rows, table


def reference_jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_is_the_published_one():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 500).astype(np.uint64) * np.uint64(2)
    for n in (1, 2, 40, 41):
        assert jump_hash(keys, n).tolist() == [reference_jump(int(k), n) for k in keys]


def test_growth_moves_rows_only_into_the_new_shard_and_evenly():
    keys = stable_keys(np.arange(200_000))
    a, b = jump_hash(keys, 40), jump_hash(keys, 41)
    assert set(b[a != b].tolist()) == {40}
    assert abs((a != b).mean() - 1 / 41) < 0.003
    assert np.bincount(a).max() / np.bincount(a).mean() < 1.05


def test_rows_and_slots(spark):
    got = shard(frame(spark, clashing=True), 5, ranges=4).collect()
    want = sorted((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows() if r[0] is not None)
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got if r.doc_id is not None) == want and len(got) == len(rows())
    for s in range(5):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert all(r.grown_shard in (r.shard, 5) for r in got)
    by_id = {}
    assert all(by_id.setdefault(r.doc_id, r.shard) == r.shard for r in got)


def brute(data, shards):
    """Shards by the published loop on a plain mix of the id, slots by sorting each shard."""
    def key(i):
        x = ((i if i is not None else -(1 << 63)) + 0x9E3779B97F4A7C15) % (1 << 64)
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % (1 << 64)
        x = (x ^ x >> 27) * 0x94D049BB133111EB % (1 << 64)
        return x ^ x >> 31

    out, rows_of = [], {}
    for i, t, *_ in data:
        raw = (t or "").encode()
        rows_of.setdefault(reference_jump(key(i), shards), []).append((i, len(raw) + 16, zlib.crc32(raw), reference_jump(key(i), shards + 1)))
    for s, own in rows_of.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))
        out += [(i, size, crc, "key", s, slot, grown) for slot, (i, size, crc, grown) in enumerate(own)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("ranges", [1, 3, 16])
def test_equals_brute_force(spark, ranges):
    data = [*rows(), *[(None, "again and again", None, None, None)] * 300, *[(77, "hot", "en", "s", 1)] * 200]
    assert table(shard(frame(spark, data, clashing=True), 7, ranges)) == brute(data, 7)


def test_query(spark, tmp_path):
    data = rows()
    frame(spark, data).write.parquet(str(tmp_path / "documents.parquet"))
    assert table(queries.op4_jump_sharding(spark, str(tmp_path))) == brute(data, 40)


def test_empty(spark):
    assert shard(frame(spark, []), 5).count() == 0


def test_written_shards_hold_all_rows(spark, tmp_path):
    for clashing, name in ((False, "shard"), (True, "shard_")):
        docs = frame(spark, clashing=clashing)
        write_shards(docs, 3, str(tmp_path / name), 2)
        got = spark.read.parquet(str(tmp_path / name))
        assert table(got.select(*docs.columns)) == table(docs) and got.columns == [*docs.columns, name]
        want = {(r[0], r[4]) for r in brute(rows(), 3)}
        assert {(r.doc_id, r[name]) for r in got.collect()} == want
