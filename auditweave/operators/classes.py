"""Findings as a factorised relation: classes of equal content stand for all their pairs.

Samples of one digest are a class; classes of one perceptual hash are a value. All pairs of a class are exact, all pairs of two
values within the threshold are near (but for those of one class), so a row per class and per pair of values says what m * n rows would. How many
findings there are of a kind, which samples they touch, the score and the groups follow from counts by class, split and label; pairs are made only for
the ranks that are asked for. Embedding pairs depend on ranks among neighbours and stay pairs, top_k for each sample at most.

What is counted for a set of pairs: all (t), those across splits (x), those with two labels (c), and those with both (xc). Equal content has equal
hashes; samples without a
digest are classes of their own, a sample without a hash has no near pairs. Samples that are corrupt are in no class. An empty table has no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .. import model as M
from ..functions.hashing import similarity
from ..storage import materialize
from .candidates import value_pairs

KINDS = {"exact": "sha256", "near": "phash"}


def members(samples: DataFrame) -> DataFrame:
    """idx, cls (the smallest idx of its digest), h (its hash), split, label of valid samples; written once."""
    own = samples.filter("not corrupt").select("idx", F.nullif("sha256", F.lit("")).alias("sha256"), F.col("phash").alias("h"), "split", "label")
    first = own.filter("sha256 is not null").groupBy("sha256").agg(F.min("idx").alias("cls"), F.min("h").alias("value"))
    first = materialize(first.withColumnRenamed("sha256", "key"), "digests")  # two plain exchanges meet then, of which a hot digest's can be split
    known = own.withColumn("key", F.coalesce("sha256", F.concat(F.lit("#"), "idx"))).join(first.hint("merge"), "key", "left")
    return materialize(known.select("idx", F.coalesce("cls", "idx").alias("cls"), F.coalesce("value", "h").alias("h"), "split", "label"), "members")


def labelled(n: str = "n") -> Column:
    return F.when(F.col("label") != M.UNLABELED, F.col(n)).otherwise(0)


@dataclass
class Counts:
    """Samples by one key: all and labelled (key), by split, by label (labelled), by both (labelled)."""

    whole: DataFrame
    splits: DataFrame
    labels: DataFrame
    both: DataFrame

    @classmethod
    def of(cls, cells: DataFrame, key: str) -> Counts:
        cell = cells.groupBy(key, "split", "label").agg(F.sum("n").alias("n"))
        splits = cell.groupBy(key, "split").agg(F.sum("n").alias("n_s"), F.sum(labelled()).alias("l_s"))
        named = cell.filter(F.col("label") != M.UNLABELED)
        whole = splits.groupBy(key).agg(F.sum("n_s").alias("n_all"), F.sum("l_s").alias("l_all"))
        return cls(whole, splits, named.groupBy(key, "label").agg(F.sum("n").alias("n_l")), named.select(key, "split", "label", F.col("n").alias("n_sl")))

    def within(self, key: str) -> DataFrame:
        """t, x, c, xc of the pairs within each key, from sums of squares."""
        parts = [self.whole.select(key, F.col("n_all").alias("n"), F.col("l_all").alias("l"))]
        parts.append(self.splits.groupBy(key).agg(F.sum(F.col("n_s") * F.col("n_s")).alias("ss"), F.sum(F.col("l_s") * F.col("l_s")).alias("ls")))
        parts.append(self.labels.groupBy(key).agg(F.sum(F.col("n_l") * F.col("n_l")).alias("ll")))
        parts.append(self.both.groupBy(key).agg(F.sum(F.col("n_sl") * F.col("n_sl")).alias("sl")))
        one = parts[0]
        for more in parts[1:]:
            one = one.join(more, key, "left")
        one = one.na.fill(0)
        two = F.col("l") * F.col("l") - F.col("ll")
        halves = {"t": F.col("n") * (F.col("n") - 1), "x": F.col("n") * F.col("n") - F.col("ss"), "c": two, "xc": two - F.col("ls") + F.col("sl")}
        return one.select(key, *[(v / 2).cast("long").alias(k) for k, v in halves.items()])

    def between(self, pairs: DataFrame, key: str) -> DataFrame:
        """t, x, c, xc of pairs (u, v, d) of different keys, each standing for all its pairs of samples."""
        side = lambda rows, name, *more: rows.select(F.col(key).alias(name), *more)

        def products(rows: DataFrame, on: list[str], **sums: str) -> DataFrame:
            mine = side(rows, "u", *on, *[F.col(c).alias(f"u_{c}") for c in sums.values()])
            other = side(rows, "v", *on, *[F.col(c).alias(f"v_{c}") for c in sums.values()])
            met = pairs.select("u", "v").join(mine, "u").join(other, ["v", *on])
            return met.groupBy("u", "v").agg(*[F.sum(F.col(f"u_{c}") * F.col(f"v_{c}")).alias(name) for name, c in sums.items()])

        one = pairs
        for rows, on, sums in (
            (self.whole, [], {"t": "n_all", "ll": "l_all"}), (self.splits, ["split"], {"same": "n_s", "same_l": "l_s"}),
            (self.labels, ["label"], {"equal": "n_l"}), (self.both, ["split", "label"], {"both": "n_sl"}),
        ):
            one = one.join(products(rows, on, **sums), ["u", "v"], "left")
        one = one.na.fill(0, ["t", "ll", "same", "same_l", "equal", "both"])
        two = F.col("ll") - F.col("equal")
        return one.select("u", "v", "d", "t", (F.col("t") - F.col("same")).alias("x"), two.alias("c"), (two - F.col("same_l") + F.col("both")).alias("xc"))


def by_kind(rows: DataFrame, method: str, strong: Column) -> DataFrame:
    """kind, severity, n of rows with t, x, c, xc."""
    t, x, c, clean = F.col("t"), F.col("x"), F.col("c"), F.col("x") - F.col("xc")
    exact = method == "sha256"
    made = F.array(
        F.struct(F.lit(M.CONFLICT).alias("kind"), F.lit("critical" if exact else "high").alias("severity"), F.when(strong, c).otherwise(0).alias("n")),
        F.struct(F.lit(M.EXACT_CROSS if exact else M.NEAR_CROSS).alias("kind"),
            (F.lit("critical") if exact else F.when(strong, "high").otherwise("medium")).alias("severity"), F.when(strong, clean).otherwise(x).alias("n")),
        F.struct(F.lit(M.REDUNDANT).alias("kind"), F.lit("low").alias("severity"), (t - F.when(strong, c + clean).otherwise(x)).alias("n")),
    )
    return rows.select(F.inline(made)).filter("n > 0").groupBy("kind", "severity").agg(F.sum("n").alias("n"))


@dataclass
class Classes:
    """The factorised findings of samples. threshold, strong: distances of near and of strong pairs; similar: embedding pairs a, b, if any are searched."""

    samples: DataFrame
    threshold: int
    strong: int
    similar: DataFrame | None = None
    exact: bool = True
    near: bool = True

    @cached_property
    def members(self) -> DataFrame:
        return members(self.samples)

    @cached_property
    def cells(self) -> DataFrame:
        """cls, h, split, label, n: the number of rows that all else is counted from."""
        return materialize(self.members.groupBy("cls", "h", "split", "label").agg(F.count("*").alias("n")), "cells")

    @cached_property
    def classes(self) -> DataFrame:
        """cls, h, n, t, x, c, xc: a row for each class of more than one sample, whose pairs are exact."""
        inside = Counts.of(self.cells, "cls").within("cls").filter("t > 0")
        sizes = self.cells.groupBy("cls", "h").agg(F.sum("n").alias("n")).filter("n > 1")
        return materialize(sizes.join(inside, "cls"), "classes")

    @cached_property
    def values(self) -> DataFrame:
        """u, v, d, t, x, c, xc: a row for each pair of hashes within the threshold, and for each hash of several classes (u = v), whose pairs of
        samples of different classes are near."""
        hashed = self.cells.filter("h is not null")
        own = Counts.of(hashed, "h")
        less = self.classes if self.exact else self.classes.limit(0)
        less = less.filter("h is not null").groupBy("h").agg(*[F.sum(k).alias(f"{k}_own") for k in ("t", "x", "c", "xc")])
        same = own.within("h").join(less, "h", "left").na.fill(0)
        same = same.select(F.col("h").alias("u"), F.col("h").alias("v"), F.lit(0).alias("d"),
            *[(F.col(k) - F.col(f"{k}_own")).alias(k) for k in ("t", "x", "c", "xc")]).filter("t > 0")
        pairs = materialize(value_pairs(hashed.select("h").distinct(), self.threshold).select(F.col("h").alias("u"), F.col("k").alias("v"), "d"), "value-pairs")
        return materialize(same.unionByName(own.between(pairs, "h")), "values")

    @cached_property
    def left(self) -> DataFrame:
        """Embedding pairs that no class and no pair of values stands for: a, b, split_a, split_b."""
        if self.similar is None:
            return self.samples.sparkSession.createDataFrame([], "a long, b long, split_a string, split_b string")
        side = lambda x: self.members.select(F.col("idx").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("cls", "h", "split")])
        met = self.similar.select("a", "b").join(side("a"), "a").join(side("b"), "b")
        met = met.filter(F.col("cls_a") != F.col("cls_b")) if self.exact else met
        if self.near:
            met = met.withColumns({"u": F.least("h_a", "h_b"), "v": F.greatest("h_a", "h_b")})
            both = F.col("h_a").isNotNull() & F.col("h_b").isNotNull()
            keys = ["u", "v"]
            met = met.filter(both).join(self.values.select(*keys), keys, "left_anti").unionByName(met.filter(~both))
        return materialize(met.select("a", "b", "split_a", "split_b"), "similar-left")

    def counts(self) -> DataFrame:
        """kind, severity, n: findings, as many as there are pairs."""
        parts = [self.left.select(F.lit(M.SEMANTIC).alias("kind"),
            F.when(F.col("split_a") != F.col("split_b"), "medium").otherwise("low").alias("severity")).groupBy("kind", "severity").agg(F.count("*").alias("n"))]
        parts += [by_kind(self.classes, "sha256", F.lit(True))] if self.exact else []
        parts += [by_kind(self.values, "phash", F.col("d") <= self.strong)] if self.near else []
        out = parts[0]
        for more in parts[1:]:
            out = out.unionByName(more)
        return out.groupBy("kind", "severity").agg(F.sum("n").alias("n"))

    def affected(self) -> DataFrame:
        """kind, affected_samples: a cell of a class is touched or not as a whole, so samples are counted by cells."""
        touched = self._touched_exact() if self.exact else None
        if self.near:
            near = self._touched_near()
            touched = near if touched is None else touched.unionByName(near)
        ends = self.left.select(F.explode(F.array("a", "b")).alias("idx")).distinct().agg(F.count("*").alias("affected_samples")).filter("affected_samples > 0")
        semantic = ends.select(F.lit(M.SEMANTIC).alias("kind"), "affected_samples")
        if touched is None:
            return semantic
        found = touched.distinct().groupBy("kind").agg(F.sum("n").alias("affected_samples"))
        return found.unionByName(semantic)

    def _partners(self, met: DataFrame, counts: Counts, key: str, of: str) -> DataFrame:
        """met (with split, label and the column `of`) and how many samples of that key there are: n_all, l_all, n_s, l_s, n_l, n_sl.

        Merges, as the counts grow with the samples: up to some size of their shuffles a caller's plan would broadcast them, a dozen at once."""
        for rows, on in ((counts.whole, []), (counts.splits, ["split"]), (counts.labels, ["label"]), (counts.both, ["split", "label"])):
            met = met.join(rows.withColumnRenamed(key, of).hint("merge"), [of, *on], "left")
        return met.na.fill(0, ["n_all", "l_all", "n_s", "l_s", "n_l", "n_sl"])

    @staticmethod
    def _kinds(met: DataFrame, exact: bool, strong: Column) -> DataFrame:
        """cls, h, split, label, n, kind for cells with the partners n_all ... n_sl."""
        named = F.col("label") != M.UNLABELED
        free, free_s = F.col("n_all") - F.col("l_all"), F.col("n_s") - F.col("l_s")
        conflict = named & strong & (F.col("l_all") > F.col("n_l"))
        apart = F.when(named & strong, F.col("n_l") - F.col("n_sl") + free - free_s).otherwise(F.col("n_all") - F.col("n_s")) > 0
        together = F.when(named & strong, F.col("n_sl") + free_s).otherwise(F.col("n_s")) > 0
        kinds = F.filter(F.array(F.when(conflict, M.CONFLICT), F.when(apart, M.EXACT_CROSS if exact else M.NEAR_CROSS), F.when(together, M.REDUNDANT)),
            lambda k: k.isNotNull())
        return met.select("cls", "h", "split", "label", "n", F.explode(kinds).alias("kind"))

    def _touched_exact(self) -> DataFrame:
        own = Counts.of(self.cells, "cls")
        met = self._partners(self.cells.join(self.classes.select("cls").hint("merge"), "cls", "left_semi"), own, "cls", "cls")
        one, named = F.lit(1), (F.col("label") != M.UNLABELED).cast("int")  # a sample is no partner of its own
        met = met.withColumns({"n_all": F.col("n_all") - one, "n_s": F.col("n_s") - one, "l_all": F.col("l_all") - named, "l_s": F.col("l_s") - named,
            "n_l": F.col("n_l") - named, "n_sl": F.col("n_sl") - named})
        return self._kinds(met, True, F.lit(True))

    def _touched_near(self) -> DataFrame:
        hashed = self.cells.filter("h is not null")
        own, inner = Counts.of(hashed, "h"), Counts.of(hashed, "cls")
        off = self.values.filter("u <> v").select("u", "v", "d")
        ways = off.unionByName(off.select(F.col("v").alias("u"), F.col("u").alias("v"), "d"))
        met = self._partners(hashed.withColumn("u", F.col("h")).join(ways.hint("merge"), "u"), own, "h", "v")
        out = self._kinds(met, False, F.col("d") <= self.strong)
        names = ["n_all", "l_all", "n_s", "l_s", "n_l", "n_sl"]
        same = self._partners(hashed.join(self.values.filter("u = v").select(F.col("u").alias("h")).hint("merge"), "h", "left_semi"), own, "h", "h")
        if self.exact:  # without those of its own class
            same = self._partners(same.withColumnsRenamed({c: f"h_{c}" for c in names}), inner, "cls",
                "cls").withColumns({c: F.col(f"h_{c}") - F.col(c) for c in names})
        else:
            one, named = F.lit(1), (F.col("label") != M.UNLABELED).cast("int")
            same = same.withColumns({c: F.col(c) - (one if c in ("n_all", "n_s") else named) for c in names})
        return out.unionByName(self._kinds(same, False, F.lit(0) <= self.strong))

    def edges(self) -> DataFrame:
        """a, b: links with the components of all pairs, one for each sample, each pair of values and each embedding pair that is left."""
        out = self.left.select("a", "b")
        if self.exact:
            out = out.unionByName(self.members.filter("idx <> cls").select(F.col("cls").alias("a"), F.col("idx").alias("b")))
        if self.near:
            first = self.members.filter("h is not null").groupBy("h").agg(F.min("idx").alias("first"))
            reps = self.values.filter("u <> v").join(first.select(F.col("h").alias("u"), F.col("first").alias("i")),
                "u").join(first.select(F.col("h").alias("v"), F.col("first").alias("j")), "v")
            star = self.members.join(first, "h").filter("idx <> first").select(F.col("first").alias("a"), F.col("idx").alias("b"))
            out = out.unionByName(reps.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"))).unionByName(star)
        return out

    def expand(self, first: int, n: int) -> DataFrame:
        """rank, a, b: the exact pairs of ranks first to first + n - 1, classes in order and in each the pairs (i, j), i < j, by j, then i. Only those
        pairs are made."""
        numbered = F.sum("t").over(Window.orderBy("cls").rowsBetween(Window.unboundedPreceding, -1))
        ranked = self._offsets() if self.classes.count() > MOST_LISTED else self.classes.select("cls", "n", "t", F.coalesce(numbered, F.lit(0)).alias("before"))
        hit = ranked.filter((F.col("before") < first + n) & (F.col("before") + F.col("t") > first))
        low, high = F.greatest(F.col("before"), F.lit(first)), F.least(F.col("before") + F.col("t"), F.lit(first + n)) - 1
        ranks = hit.select("cls", "before", F.explode(F.sequence(low, high)).alias("rank"))
        return self._unranked(ranks)

    def _offsets(self) -> DataFrame:
        """cls, n, t and the pairs of the classes before, in ranges."""
        dealt = materialize(self.classes.select("cls", "n", "t").repartitionByRange("cls").withColumn("part", F.spark_partition_id()), "ranges")
        sums = dealt.groupBy("part").agg(F.sum("t").alias("s"))
        outer = sums.select("part", F.coalesce(F.sum("s").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("outer"))
        inner = F.coalesce(F.sum("t").over(Window.partitionBy("part").orderBy("cls").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return dealt.withColumn("inner", inner).join(F.broadcast(outer), "part").select("cls", "n", "t", (F.col("inner") + F.col("outer")).alias("before"))

    @cached_property
    def _numbered(self) -> DataFrame:
        """cls, number, idx: the members of classes in order, numbered in ranges, so that a class of any size is no task's alone."""
        rows = self.members.join(self.classes.select("cls"), "cls", "left_semi").select("cls", "idx")
        dealt = materialize(rows.repartitionByRange("cls", "idx").withColumn("part", F.spark_partition_id()), "member-ranges")
        counts = dealt.groupBy("cls", "part").agg(F.count("*").alias("n"))
        before = counts.select("cls", "part", F.coalesce(F.sum("n")
            .over(Window.partitionBy("cls").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
        own = F.row_number().over(Window.partitionBy("cls", "part").orderBy("idx")) - 1
        return materialize(dealt.withColumn("own", own).join(before, ["cls", "part"])
            .select("cls", (F.col("own") + F.col("before")).alias("number"), "idx"), "numbered-members")

    def _unranked(self, ranks: DataFrame) -> DataFrame:
        """Pairs of members by rank r = j (j - 1) / 2 + i."""
        r = F.col("rank") - F.col("before")
        guess = F.floor((1 + F.sqrt(1 + 8 * r.cast("double"))) / 2)
        j = F.when(guess * (guess - 1) / 2 > r, guess - 1).when(guess * (guess + 1) / 2 <= r, guess + 1).otherwise(guess).cast("long")
        at = ranks.withColumn("j", j).withColumn("i", (r - F.floor(F.col("j") * (F.col("j") - 1) / 2)).cast("long"))
        own = self._numbered
        left = at.join(own.select("cls", F.col("number").alias("i"), F.col("idx").alias("a")), ["cls", "i"])
        return left.join(own.select("cls", F.col("number").alias("j"), F.col("idx").alias("b")), ["cls", "j"]).select("rank", "a", "b")

    def export(self, chunk: int = 1 << 16) -> DataFrame:
        """a, b, method, distance, similarity of all exact pairs, for a write: ranks are dealt in chunks, so that no class is one task's."""
        chunks = self.classes.select("cls", "t", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("t") - 1) / chunk))).alias("nth"))
        dealt = chunks.repartition("cls", "nth").select("cls", F.lit(0).cast("long").alias("before"),
            F.explode(F.sequence(F.col("nth") * chunk, F.least((F.col("nth") + 1) * chunk, "t") - 1)).alias("rank"))
        return self._unranked(dealt).select("a", "b", F.lit("sha256").alias("method"), F.lit(0.0).alias("distance"), F.lit(1.0).alias("similarity"))

    def relation(self) -> DataFrame:
        """method, u, v, distance, similarity, t, x, c, xc: all rows that stand for pairs, classes by their smallest idx and values by hash."""
        d = F.col("d").cast("double")
        exact = self.classes.select(F.lit("sha256").alias("method"), F.col("cls").alias("u"), F.col("cls").alias("v"), F.lit(0.0).alias("distance"),
            F.lit(1.0).alias("similarity"), "t", "x", "c", "xc")
        near = self.values.select(F.lit("phash").alias("method"), "u", "v", d.alias("distance"), F.round(similarity(F.col("d")), 6).alias("similarity"),
            "t", "x", "c", "xc")
        return exact.unionByName(near)


#: Classes that one task puts in order; beyond it ranges do.
MOST_LISTED = 100_000
