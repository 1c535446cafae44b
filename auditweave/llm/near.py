"""Near duplicates by SimHash and word shingles: one document of each group stays.

Each set of shingles has a fingerprint of 64 bits, set where most of its shingles' hashes are. Multi-index hashing (`simhash`) finds all
fingerprints within DISTANCE bits, and pairs of their sets that whole shingle sets confirm are tied: these are most near copies. Fingerprints
of a few bits lose pairs whose similarity is just enough (see the README), so an exact check follows that finds what they can't tell.
All sets stand in one order of shingles; two sets with a Jaccard similarity of 0.8 have one in
common among their first n - ceil(0.8 n) + 1, so an equi-join on these finds every pair. What can't be alike leaves by bounds that
never err: sizes, the place of the first common shingle, and parities (a bit for each of some values of a hash: the number of the
set's shingles there, modulo 2), which never differ in more bits than the sets do in shingles.

1. Fingerprints within DISTANCE bits are linked; of the links of a task those that connect something new go on to be verified and tied.
2. While buckets (the nodes with a shingle) hold many pairs of different groups, nodes are compared with one member of each, each tie verified. The
   first turn takes the member whose buckets are largest, as copies with few edits share them with their source.
3. Then all pairs of different groups are searched. In each bucket the largest group's members meet the others only.
4. Candidates of all steps that the bounds leave are verified on their texts' whole shingle sets.

Defined results: texts with equal shingle sets are one node, whatever their case and white space and however often a passage repeats;
a text of fewer words than a shingle is one shingle of all its words, null and empty texts are equal to each other and to nothing
else; of a group the row with the smallest doc_id stays (a null id counts as the smallest), of equal ids that with the smallest
hash of its text, of rows that repeat one; an empty table gives no rows; other columns stay as they are, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import HELD, components
from .common import KEY, PART_BYTES, arrow_limits, chunks, id_and_text, mark, materialize, only_rows, parts, release, signed, with_key, without_rows
from .simhash import bit_counts, links, majority, stars
from .wordhash import BLANK_SEPARATED, LOWER, mix, run_hash, run_sums, word_hashes, words

#: Bits that the fingerprints of near copies differ in at most. More need balls that are several times as large; the pairs beyond are found all the same.
DISTANCE = 5
#: Bits of the parities that go with a bucket's entries; a node's own have twice as many bits as it has shingles or more.
PARITY_BITS = 512
PARITY = [f"s{i}" for i in range(PARITY_BITS // 64)]


def parities(shingles: np.ndarray, bits: int) -> np.ndarray:
    """The parities of a set of shingle hashes in `bits` bits, a power of two, as longs. Halves xor to the parities in bits / 2."""
    counts = np.bincount((mix(shingles.view(np.uint64)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def folded(longs: np.ndarray, n: int) -> np.ndarray:
    """Parities in 64 * n bits."""
    while len(longs) > n:
        longs = longs[: len(longs) // 2] ^ longs[len(longs) // 2 :]
    return longs


def apart(x: np.ndarray, y: np.ndarray) -> int:
    """In how many shingles two sets differ at least, by their parities."""
    n = min(len(x), len(y))
    return int(np.bitwise_count((folded(x, n) ^ folded(y, n)).view(np.uint64)).sum())


def shingle_hashes(raw: np.ndarray, offs: np.ndarray, size: int) -> list[np.ndarray]:
    """The distinct hashes of each text's shingles in order."""
    raw = LOWER[raw]
    starts, ends, first = words(raw, offs, BLANK_SEPARATED)
    sums = run_sums(word_hashes(raw, starts, ends), 1)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        at = np.arange(a, max(b - size, a) + 1) if b > a else np.zeros(0, np.int64)
        out.append(np.unique(signed(run_hash(sums, at, np.minimum(at + size, b), 1))))
    return out


def shingle_sets(batches: Iterator[pa.RecordBatch], size: int, most: int = PART_BYTES) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """(rows, the distinct hashes of each row's shingles in order); a long text is worked on in parts."""
    held: list[np.ndarray] = []
    for rows, raw, offs, _, last in parts(batches, size, most):
        own = shingle_hashes(raw, offs, size)
        if not last:
            held += own
        else:
            if held:  # the last part has shingles of its own unless it is just the overlap
                if len(words(raw, offs, BLANK_SEPARATED)[0]) < size:
                    own = []
                own, held = [np.unique(np.concatenate([*held, *own]))], []
            yield rows, own


def fingerprint(shingles: np.ndarray) -> bytes:
    """The SimHash of a set of shingle hashes."""
    return majority(bit_counts(mix(shingles.view(np.uint64)).tobytes()), len(shingles))


def node_of(shingles: list[np.ndarray]) -> np.ndarray:
    """A hash of each set."""
    return signed(np.array([xxhash.xxh64_intdigest(x.tobytes(), 42) for x in shingles], np.uint64))


#: Shingles that stand OFTEN times or more in one of SAMPLE texts come last in the order of shingles, by their counts; MOST_FREQUENT of
#: them at most. Any order finds all pairs: this one only keeps lines that many texts share from making candidates.
SAMPLE, OFTEN, MOST_FREQUENT = 32, 3, 1 << 16


def _frequent(texts: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The frequent shingles' hashes in order, and their counts."""

    def run(batches):
        for _, shingles in shingle_sets(batches, size):
            yield pa.record_batch([pa.array(np.concatenate(shingles))], names=["shingle"])

    sample = texts.filter(F.pmod("row", F.lit(SAMPLE)) == 0).select("text").mapInArrow(run, "shingle long")
    counts = sample.groupBy("shingle").agg(F.count("*").alias("n")).filter(F.col("n") >= OFTEN)
    found = sorted((r.shingle, r.n) for r in counts.orderBy(F.desc("n"), "shingle").limit(MOST_FREQUENT).collect())
    return np.array([x for x, _ in found], np.int64), np.array([n for _, n in found], np.int64)


def prefix(shingles: np.ndarray, counts: np.ndarray, least: float) -> np.ndarray:
    """The first of a set's hashes by (count, hash): so many that a set with a Jaccard similarity of `least` has one of them among its own first."""
    n = len(shingles)
    if counts.any():
        shingles = shingles[np.lexsort((shingles, counts))]
    return shingles[: n - math.ceil(least * n - 1e-6) + 1] if n else shingles


def _prints(texts: DataFrame, size: int, least: float) -> DataFrame:
    """(doc, row, node, fp, n, tokens, bits, s0, s1 ...): the fingerprint and number of a text's shingles, their prefix and parities."""
    frequent = texts.sparkSession.sparkContext.broadcast(_frequent(texts, size))

    def run(batches):
        known, often = frequent.value
        for rows, shingles in shingle_sets(batches, size):
            n = np.array([len(x) for x in shingles], np.int64)
            counts = np.zeros(n.sum(), np.int64)
            if len(known):
                flat = np.concatenate(shingles)
                at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
                counts = np.where(known[at] == flat, often[at], 0)
            tokens = [prefix(x, c, least) for x, c in zip(shingles, np.split(counts, np.cumsum(n)[:-1]), strict=True)]
            own = [parities(x, max(PARITY_BITS, 1 << (2 * len(x)).bit_length())) for x in shingles]
            short = np.array([folded(x, len(PARITY)) for x in own]).reshape(len(own), -1)
            columns = [
                *[rows.column(c) for c in KEY], pa.array(node_of(shingles)),
                pa.array(np.frombuffer(b"".join(map(fingerprint, shingles)), ">i8").astype(np.int64)), pa.array(n, pa.int32()),
                pa.array(tokens, pa.list_(pa.int64())),
                pa.array([x.tobytes() for x in own], pa.binary()), *[pa.array(short[:, i]) for i in range(len(PARITY))],
            ]
            yield pa.record_batch(columns, names=[*KEY, "node", "fp", "n", "tokens", "bits", *PARITY])

    return texts.mapInArrow(run, "doc long, row long, node long, fp long, n int, tokens array<long>, bits binary, " + ", ".join(f"{c} long" for c in PARITY))


def connecting(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) without those whose ends others of the same task connect: as many as a task has nodes at most."""

    def run(batches):
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.setdefault(x, x)) != x:
                root[x] = x = root[up]
            return x

        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            new = []
            for x, y in zip(a, b, strict=True):
                x, y = find(x), find(y)
                root[max(x, y)] = min(x, y)
                new.append(x != y)
            yield batch.filter(pa.array(new, pa.bool_()))
            if len(root) > HELD:
                root.clear()

    return pairs.mapInArrow(run, "a long, b long")


def _by_fingerprints(prints: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes by multi-index hashing: nodes of one fingerprint, with the first of them, and the first ones of fingerprints within
    DISTANCE bits. Pairs connect what all such pairs do."""
    nodes = prints.select("node", "fp").distinct()
    first = materialize(nodes.groupBy("fp").agg(F.min("node").alias("first")), "fingerprints")
    n, values = first.count(), first.select(F.col("fp").alias("node"), "fp")
    ties = stars(values, DISTANCE, n)
    found = links(values, DISTANCE, n, ties and ties[1:])
    found = materialize(connecting(found if ties is None else found.unionByName(ties[0])), "links").distinct()
    of = lambda x: first.select(F.col("fp").alias(x), F.col("first").alias(f"{x}_first")).hint("merge")
    pairs = found.join(of("a"), "a").join(of("b"), "b").select(F.col("a_first").alias("a"), F.col("b_first").alias("b"))
    equal = nodes.join(first.hint("merge"), "fp").filter("node != first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    return pairs.unionByName(equal).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _may_be(x: str, y: str, least: float) -> F.Column:
    """Whether rows x and y of a token can be of sets with a similarity of `least`, if the token is their first common one: none
    before it is common, so of n shingles n - at are left at most."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    return F.least(n - F.col(f"{x}.at"), m - F.col(f"{y}.at")) >= (n + m) * (least / (1 + least)) - 1e-6


def _near_bits(x: str, y: str, least: float) -> F.Column:
    """Whether by their parities the sets of rows x and y can have a similarity of `least`."""
    differ = sum((F.bit_count(F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}"))) for c in PARITY), F.lit(0))
    return differ <= (F.col(f"{x}.n") + F.col(f"{y}.n")) * ((1 - least) / (1 + least)) + 1e-6


def _placed(tokens: DataFrame, least: float) -> DataFrame:
    """The entries that may have a similar one of another node with the same token: a semi-join, which stops at the first one it meets."""
    x, y = tokens.alias("x"), tokens.alias("y")
    return x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.node") != F.col("y.node")) & _may_be("x", "y", least), "left_semi")


def _pair() -> list[F.Column]:
    return [F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")]


def _stars(entries: DataFrame, groups: DataFrame, turn: int, least: float) -> DataFrame:
    """Pairs (a, b) of each node and one of every bucket it is in, if they are of different groups: another one in each turn."""
    e = entries.join(groups, "node")
    rank = F.col("weight") if turn == 0 else F.xxhash64("node", F.lit(turn))
    one = F.max_by(F.struct("node", "n", "at", "group"), F.struct(rank, "node"))
    picked = e.groupBy("token").agg(F.min("group").alias("least"), F.max("group").alias("most"), one.alias("one"))
    picked = materialize(picked.filter("least != most").select("token", "one.*"), "picked")
    x, y = e.alias("x"), picked.alias("y")
    met = x.join(y.hint("merge"), (F.col("x.token") == F.col("y.token")) & (F.col("x.group") != F.col("y.group")) & _may_be("x", "y", least))
    return met.select(*_pair()).distinct()


def _mixed(entries: DataFrame, groups: DataFrame) -> tuple[DataFrame, int]:
    """Tokens with nodes of several groups: (token, main), the largest group; and the number of pairs that the search looks at."""
    sizes = entries.join(groups.select("node", "group"), "node").groupBy("token", "group").agg(F.count("*").alias("n"))
    main = F.max_by("group", F.struct("n", "group")).alias("main")
    found = sizes.groupBy("token").agg(main, F.max("n").alias("most"), F.sum("n").alias("all"), F.count("*").alias("groups"))
    found = materialize(found.filter("groups > 1").select("token", "main", "most", "all"), "mixed")
    return found.select("token", "main"), found.agg(F.sum((F.col("all") - F.col("most")) * F.col("all"))).first()[0] or 0


def _pairs(entries: DataFrame, groups: DataFrame, mixed: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """All pairs (a, b) of nodes of different groups with a common token that can be similar by sizes, places and parities."""
    own = groups.select("node", "group").join(nodes.select("node", *PARITY), "node")
    e = materialize(entries.join(mixed.hint("merge"), "token").join(own, "node"), "sought")
    x, y = e.filter("group != main").alias("x"), e.alias("y")
    once = (F.col("y.group") == F.col("y.main")) | (F.col("x.node") < F.col("y.node"))
    own = (F.col("x.token") == F.col("y.token")) & (F.col("x.group") != F.col("y.group")) & once
    return x.join(y.hint("merge"), own & _may_be("x", "y", least) & _near_bits("x", "y", least)).select(*_pair()).distinct()


def _by_parities(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The pairs that by their nodes' own parities can be similar."""

    def run(batches):
        for rows in batches:
            sizes = np.asarray(rows.column("n")) + np.asarray(rows.column("m"))
            most = sizes * ((1 - least) / (1 + least)) + 1e-6
            bits = [[np.frombuffer(v.as_buffer(), np.int64) for v in rows.column(c)] for c in ("x", "y")]
            good = pa.array([apart(x, y) <= m for x, y, m in zip(*bits, most.tolist(), strict=True)], pa.bool_())
            yield pa.record_batch([rows.column("a").filter(good), rows.column("b").filter(good)], names=["a", "b"])

    x, y = (nodes.select(F.col("node").alias(a), F.col("n").alias(n), F.col("bits").alias(x)) for a, n, x in (("a", "n", "x"), ("b", "m", "y")))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "n", "m", "x", "y").mapInArrow(run, "a long, b long")


def _by_texts(pairs: DataFrame, size: int, least: float) -> DataFrame:
    """The pairs (a, b) of the texts x, y whose shingle sets have a Jaccard similarity of `least` or more."""

    def run(batches):
        for batch in batches:
            for rows, _, _ in chunks([batch], "x"):
                own, good = [], []
                for c in ("x", "y"):
                    texts = pa.record_batch([rows.column(c)], names=["text"])
                    own.append([x for _, found in shingle_sets(iter([texts]), size) for x in found])
                for x, y in zip(*own, strict=True):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(common >= least * (len(x) + len(y) - common))
                keep = pa.array(good, pa.bool_())
                yield pa.record_batch([rows.column("a").filter(keep), rows.column("b").filter(keep)], names=["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def _merged(groups: DataFrame, found: DataFrame) -> DataFrame:
    """groups (node, weight, group) after the pairs (a, b) in `found` are tied."""
    of = lambda x: groups.select(F.col("node").alias(x), F.col("group").alias(f"g{x}"))
    tied = found.join(of("a"), "a").join(of("b"), "b").select(F.col("ga").alias("a"), F.col("gb").alias("b"))
    to = materialize(components(tied), "tied").select(F.col("node").alias("group"), "component")
    return materialize(groups.join(to, "group", "left").select("node", "weight", F.coalesce("component", "group").alias("group")), "groups")


#: Turns of stars go on while the search would look at so many pairs for each entry, and one in FEW_TIED pairs of the last turn was tied.
#: Both bear on the work alone.
WORK, FEW_TIED = 32, 100


def one_of_each_group(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs less near duplicates: of every group one row stays.

    Groups are connected by all pairs whose sets of `size`-word shingles have a Jaccard similarity of `similarity` or more.
    """
    since = mark()
    arrow_limits(docs.sparkSession)
    texts = with_key(id_and_text(docs)).select(*KEY, "text")
    prints = materialize(_prints(texts, size, similarity), "prints")
    reps = materialize(prints.groupBy("node").agg(F.min(F.struct(*KEY)).alias("rep")), "reps")
    tokens = prints.select("node", "n", F.posexplode("tokens").alias("at", "token"))
    shared = tokens.groupBy("token").agg(F.min("node").alias("x"), F.max("node").alias("y")).filter("x != y").select("token")
    tokens = materialize(tokens.join(materialize(shared, "shared"), "token", "left_semi").distinct(), "tokens")
    entries = materialize(_placed(tokens, similarity), "entries")
    sizes = entries.groupBy("token").agg(F.count("*").alias("nodes"))
    near = materialize(entries.select("token", "node").join(sizes, "token").groupBy("node").agg(F.sum("nodes").alias("weight")), "near")
    nodes = materialize(prints.select("node", "n", "bits", *PARITY).join(near.select("node"), "node", "left_semi").dropDuplicates(["node"]), "nodes")

    def alike(pairs: DataFrame) -> tuple[DataFrame, int]:
        pairs = materialize(_by_parities(pairs, nodes, similarity), "plausible")
        used = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        used = materialize(reps.join(used, "node").select("node", "rep.*"), "used")
        own = materialize(texts.join(used.hint("merge"), KEY).select("node", "text").dropDuplicates(["node"]), "texts")
        x, y = (own.select(F.col("node").alias(n), F.col("text").alias(s)) for n, s in (("a", "x"), ("b", "y")))
        found = materialize(_by_texts(pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y"), size, similarity), "similar")
        return found, found.count()

    groups, n = near.select("node", "weight", F.col("node").alias("group")), entries.count()
    if n:
        found, tied = alike(materialize(_by_fingerprints(prints), "near-fingerprints"))
        if tied:
            groups = _merged(groups, found)
        mixed, work = _mixed(entries, groups)
    turn = 0
    while n and work > WORK * n:
        pairs = materialize(_stars(entries, groups, turn, similarity), "stars")
        found, tied = alike(pairs)
        if tied:
            groups = _merged(groups, found)
            mixed, work = _mixed(entries, groups)
        turn += 1
        if tied * FEW_TIED < pairs.count():
            break
    if n and work:
        found, tied = alike(materialize(_pairs(entries, groups, mixed, nodes, similarity), "pairs"))
        if tied:
            groups = _merged(groups, found)
    named = reps.join(groups.select("node", "group"), "node", "left")
    stays = named.groupBy(F.coalesce("group", "node").alias("group")).agg(F.min("rep").alias("rep")).select("rep.*")
    rows = prints.groupBy(*KEY).agg(F.count("*").alias("times"))
    fate = materialize(rows.join(stays.withColumn("stays", F.lit(True)), KEY, "left").select(*KEY, "times", F.col("stays").isNotNull().alias("stays")), "fate")
    gone = materialize(fate.filter("not stays or times > 1").select(*KEY), "gone")
    twice = materialize(fate.filter("stays and times > 1").select(*KEY), "twice")
    release(docs.sparkSession, since, keep=2)
    out = without_rows(docs, gone)
    return out if twice.isEmpty() else out.unionByName(only_rows(docs, twice))
