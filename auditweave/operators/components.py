"""Connected components of a link table by alternating large-star and small-star rounds.

Links stay distributed: each round groups by node with map-side minima and writes its links to the
shared folder. Before the first round every partition replaces its links by a spanning forest; if few
links are left after that, one more forest settles them. Both ways give the same components.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import mark, materialize, release
from .order import numbered


def forest(pairs: Iterator[tuple[int, int]]) -> dict[int, int]:
    """The smallest node that each node of the links reaches."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while root.setdefault(top, top) != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


#: Links up to which one task finishes what the forests of the partitions have left.
FEW = 100_000
#: Links that a worker holds at once while it builds a forest.
HELD = 1_000_000


def local_forests(links: DataFrame) -> DataFrame:
    def stars(roots: dict[int, int]):
        pairs = [(v, u) for v, u in roots.items() if u != v]
        return pa.record_batch([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])

    def run(batches):
        roots: dict[int, int] = {}
        for batch in batches:
            roots = forest([*roots.items(), *zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)])
            if len(roots) > HELD:
                yield stars(roots)
                roots = {}
        yield stars(roots)

    return links.mapInArrow(run, "a long, b long")


def _star(links: DataFrame, small: bool) -> DataFrame:
    """One round. Large: larger neighbours of a node are tied to its smallest one; small: the others."""
    ways = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    if not small:
        ways = ways.unionByName(ways.select(F.col("b").alias("a"), F.col("a").alias("b")))
    ways = materialize(ways, "ways")
    least = materialize(ways.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
    # both sides are plain exchanges, so a hot node's links can be split; told so, as the minima's files are a fraction of what a broadcast would take
    joined = ways.join(least.hint("merge"), "a")
    if small:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    else:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return materialize(out.filter("a <> b").distinct(), "links")


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, component): for each node of links (a, b), the smallest node it reaches."""
    spark, since = links.sparkSession, mark()
    links = materialize(local_forests(links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b")), "links")
    before = _mark(links)
    if before[0] <= FEW:
        links, max_rounds = materialize(local_forests(links.coalesce(1)), "links"), 0
    for _ in range(max_rounds if before[0] else 0):
        links = _star(_star(links, small=False), small=True)
        release(spark, since)
        if (now := _mark(links)) == before:
            break
        before = now
    else:
        if before[0] and max_rounds:
            raise RuntimeError("links didn't settle")
    release(spark, since)
    return links.select(F.col("a").alias("node"), F.col("b")
        .alias("component")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component"))).groupBy("node").agg(F.min("component")
        .alias("component"))


def groups(links: DataFrame) -> DataFrame:
    """(node, component, group_id): components of two nodes at least, numbered by their smallest node."""
    found = materialize(components(links), "components")
    numbers = numbered(found.select("component").distinct(), "component", "number")
    return found.join(numbers.hint("merge"), "component").select("node", "component", F.format_string("g%04d", "number").alias("group_id"))
