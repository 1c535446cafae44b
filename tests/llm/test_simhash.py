import random

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from auditweave.llm import simhash as S
from auditweave.operators.components import components

from .helpers import frame, rows


def brute_print(text, size):
    w = text.encode().lower().split()
    shingles = [b" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else [b" ".join(w)] * bool(w)
    hs = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute_components(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@settings(deadline=None, max_examples=60)
@given(st.text(alphabet="aB é\t\n\x1f", max_size=80), st.sampled_from([1, 4, 5]))
def test_fingerprint(text, size):
    assert int.from_bytes(S.simhash(text.encode(), size), "big") == brute_print(text, size)


def test_fingerprint_of_more_shingles_than_a_lane_counts():
    rng = random.Random(2)
    text = " ".join(rng.choice("abcdefgh") for _ in range(1500))
    assert int.from_bytes(S.simhash(text.encode(), 4), "big") == brute_print(text, 4)


def test_radii_cover_the_distance():
    for n in (10, 10**5, 10**7, 10**10):
        for d in (0, 1, 4, 8):
            plan = S.segments(d, n)
            assert sum(r + 1 for *_, r in plan) == d + 1 and max(s + w for s, w, _ in plan) == 64


def test_all_links_of_clustered_fingerprints(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(12)]
    prints = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(6))) & (2**64 - 1) for b in base for _ in range(15)} | {0, 15, 2**64 - 1})
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    nodes = spark.createDataFrame([(x, x) for x in signed], "node long, fp long")
    for d, sizes in ((4, (100, 10**6, 10**9)), (0, (10**6,)), (7, (10**3, 10**5)), (10, (10**5,))):
        want = {(min(a, b), max(a, b)) for a in signed for b in signed if a != b and ((a ^ b) & (2**64 - 1)).bit_count() <= d}
        for n in sizes:
            got = [tuple(r) for r in S.links(nodes, d, n).collect()]
            assert len(got) == len(set(got)) and set(got) == want


def test_long_texts_in_parts(spark):
    rng = random.Random(9)
    data = [(i, " ".join(rng.choice("abcdefgh") * rng.randrange(1, 9) for _ in range(n)), "en", "s", 1) for i, n in enumerate((0, 1, 3, 4, 5, 40, 400, 3000))]
    for most in (1, 50, 1000):
        got = {r.doc_id: r.fp for r in S.fingerprints(frame(spark, data), 4, most).collect()}
        assert got == {r[0]: (x := brute_print(r[1], 4)) - (x >> 63 << 64) for r in data}


def test_thousands_of_near_copies(spark):
    """5000 fingerprints within a few bits of three sources and of each other, chains that only two steps connect, and chance ones."""
    rng = random.Random(10)
    flip = lambda x, k: x ^ sum(1 << b for b in rng.sample(range(64), k))
    base = [rng.getrandbits(64) for _ in range(3)]
    prints = {flip(rng.choice(base), rng.randrange(1, 5)) for _ in range(5000)} | {rng.getrandbits(64) for _ in range(300)}
    chain = flip(base[0], 4)
    for _ in range(40):
        chain = flip(chain, 4)
        prints.add(chain)
    signed = sorted(x - (x >> 63 << 64) for x in prints)
    nodes = spark.createDataFrame([(x, x) for x in signed], "node long, fp long")
    ties, groups, main = S.stars(nodes, 4, len(signed), dense=64)
    assert ties.count() < 10 * len(signed) and not main.isEmpty()
    more = S.links(nodes, 4, len(signed), (groups, main)).count()
    array = np.array(signed, np.int64)
    near = [np.flatnonzero(np.bitwise_count((array ^ x).view(np.uint64)) <= 4) for x in array]
    assert sum(map(len, near)) > 8 * more, (sum(map(len, near)), more)  # of half a million links few are looked up
    want, seen = {}, set()
    for i in range(len(signed)):
        if i not in seen:
            todo, own = [i], {i}
            while todo:
                for j in near[todo.pop()].tolist():
                    if j not in own:
                        own.add(j)
                        todo.append(j)
            seen |= own
            want |= {signed[j]: signed[min(own)] for j in own}
    got = {r.node: r.component for r in S.connected(nodes, 4, len(signed), dense=64).collect()}
    assert {x: got.get(x, x) for x in signed} == want


def test_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(400 + i, 401 + i) for i in range(40)] + [(500, 500 + i) for i in range(1, 50)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long").repartition(7)).collect()}
    ids = {x for a, b in pairs if a != b for x in (a, b)}
    links = {(min(p), max(p)) for p in pairs}
    assert got == brute_components(sorted(ids), lambda a, b: (a, b) in links)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_documents(spark):
    data = [r for r in rows() if r[0] is not None]
    got = S.near_duplicates(frame(spark, clashing=True)).collect()
    assert len(got) == len(rows())
    prints = {r[0]: brute_print(r[1] or "", 4) for r in data}
    want = brute_components(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    for r in got:
        if r.doc_id is not None:
            assert (r.fingerprint, r.component_id) == (f"{prints[r.doc_id]:016x}", want[r.doc_id])
    assert S.near_duplicates(frame(spark, [])).count() == 0
