"""Dataset inventory, issues and fingerprint."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .. import model as M
from ..sources.zips import place
from ..storage import fresh_path, materialize

#: Lines that the reader of a fingerprint's files holds.
AT_ONCE = 4096

# Titles of issues.
CORRUPT_TITLE = " corrupt or unreadable image(s)"
IMBALANCE_TITLE = "Class imbalance ratio %.1fx (largest class / smallest class)"
NO_TEST_TITLE = "No test split detected"
TEST_TITLE = "Test split is %.1f%% of the dataset"
MISSING_TITLE = " class/split combination(s) empty"


def split_class(samples: DataFrame) -> DataFrame:
    """Valid samples by split, by label and by both in one pass; null stands for all."""
    valid = samples.filter("not corrupt")
    return valid.groupingSets([["split"], ["label"], ["split", "label"]], "split", "label").agg(F.count("*").alias("n"))


def totals(samples: DataFrame) -> DataFrame:
    """One row: total, valid, corrupt, test, splits, classes, class_imbalance_ratio, test_fraction."""
    own = samples.agg(F.count("*").alias("total"), F.count_if(F.expr("not corrupt")).alias("valid"), F.count_if("corrupt").alias("corrupt"),
        F.count_if(F.expr("not corrupt and split = 'test'")).alias("test"))
    classes = samples.filter("not corrupt").groupBy("label").agg(F.count("*").alias("n")).agg(F.count("*").alias("classes"),
        F.round(F.max("n") / F.min("n"), 3).alias("class_imbalance_ratio"))
    both = own.crossJoin(F.broadcast(classes))  # one row each
    return both.withColumn("test_fraction", F.round(F.coalesce(F.try_divide("test", "valid"), F.lit(0.0)), 4))


def class_balance(samples: DataFrame) -> DataFrame:
    return totals(samples).select("classes", "class_imbalance_ratio", "test_fraction")


def missing_classes(samples: DataFrame) -> DataFrame:
    """Pairs of a split and a class that are present, but not together."""
    valid = samples.filter("not corrupt")
    splits, classes = valid.select("split").distinct(), valid.select("label").distinct()
    return classes.crossJoin(F.broadcast(splits)).join(valid.select("split", "label").distinct(), ["split", "label"], "left_anti").select("split", "label")


MEASURES = {"width": "width", "height": "height", "aspect_ratio": "aspect_ratio", "file_size_bytes": "bytes"}


def aspect_ratio() -> F.Column:
    return F.round(F.try_divide(F.col("width").cast("double"), F.nullif(F.col("height"), F.lit(0)).cast("double")), 4)


PERCENTILES = {"p25": 0.25, "median": 0.5, "p75": 0.75}


def percentiles(samples: DataFrame) -> DataFrame:
    """measure, min, p25, median, p75, max over valid samples with a value other than zero; exact, linear between ranks.

    By selection: values are counted, put in order by ranges, and what precedes a range is the sum of the counts before it; then only the two values
    about each rank are taken. No task holds a measure's values."""
    valid = samples.filter("not corrupt").withColumn("aspect_ratio", F.when((F.col("width") != 0) & (F.col("height") != 0), aspect_ratio()))
    long = valid.select(F.inline(F.array(*[F.struct(F.lit(name).alias("measure"), F.nullif(F.col(c).cast("double"), F.lit(0.0)).alias("v")) for name,
        c in MEASURES.items()]))).filter("v is not null")
    counted = long.groupBy("measure", "v").agg(F.count("*").alias("n"))
    dealt = materialize(counted.repartitionByRange("measure", "v").withColumn("part", F.spark_partition_id()), "measures")
    sizes = dealt.groupBy("measure", "part").agg(F.sum("n").alias("own"))
    whole = Window.partitionBy("measure")
    before = F.coalesce(F.sum("own").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("measure", "part", before.alias("before"), F.sum("own").over(whole).alias("total"))  # a row for each measure and range
    upto = F.sum("n").over(Window.partitionBy("measure", "part").orderBy("v"))
    ranked = dealt.withColumn("upto", upto).join(F.broadcast(offsets), ["measure", "part"]).withColumn("last",
        F.col("before") + F.col("upto") - 1).withColumn("first", F.col("last") - F.col("n") + 1)
    at = {name: (F.col("total") - 1) * p for name, p in PERCENTILES.items()}
    covers = lambda rank: (F.col("first") <= rank) & (rank <= F.col("last"))
    low = {name: F.max(F.when(covers(F.floor(x)), F.col("v"))) for name, x in at.items()}
    high = {name: F.max(F.when(covers(F.ceil(x)), F.col("v"))) for name, x in at.items()}
    found = ranked.groupBy("measure").agg(F.min("v").alias("min"), F.max("v").alias("max"), F.max("total").alias("total"),
        *[c.alias(f"low_{n}") for n, c in low.items()], *[c.alias(f"high_{n}") for n, c in high.items()])
    between = {name: F.col(f"low_{name}") + (F.col(f"high_{name}") - F.col(f"low_{name}")) * (x - F.floor(x)) for name, x in at.items()}
    return found.select("measure", F.round("min", 4).alias("min"), *[F.round(c, 4).alias(n) for n, c in between.items()], F.round("max", 4).alias("max"))


def formats(samples: DataFrame) -> DataFrame:
    return samples.filter("not corrupt and img_format is not null and img_format <> ''").groupBy("img_format").agg(F.count("*").alias("n"))


def corrupt_samples(samples: DataFrame) -> DataFrame:
    return samples.filter("corrupt").select("idx", "sample_id", "split", "label", "error")


def lines(samples: DataFrame) -> DataFrame:
    """line (split/label/digest) and how often it occurs."""
    return samples.select(F.concat_ws("/", "split", "label", F.coalesce("sha256", F.lit(""))).alias("line")).groupBy("line").agg(F.count("*").alias("n"))


def fingerprint(samples: DataFrame) -> DataFrame:
    """SHA-256 over the sorted lines split/label/digest, each with a newline; equal lines count as often as they occur.

    Lines are counted and sorted by ranges, in as many tasks as there are, to files whose names are in order. The digest is sequential by definition:
    one task reads
    those files one after another, a batch at a time, and sorts nothing. merkle_root() is an identity without that task."""
    spark, path = samples.sparkSession, fresh_path(samples.sparkSession, "lines")
    lines(samples).repartitionByRange("line").sortWithinPartitions("line").write.parquet(path)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for folder in b.column("path").to_pylist():
                h, (store, top) = hashlib.sha256(), place(folder)
                files = sorted(f.path for f in store.get_file_info(fs.FileSelector(top)) if f.base_name.startswith("part-"))
                for file in files:
                    with store.open_input_file(file) as f:
                        for part in pq.ParquetFile(f).iter_batches(AT_ONCE, columns=["line", "n"]):
                            for line, n in zip(part.column("line").to_pylist(), part.column("n").to_pylist(), strict=True):
                                for at in range(0, n, AT_ONCE):  # a line may occur any number of times
                                    h.update(f"{line}\n".encode() * min(AT_ONCE, n - at))
                yield pa.record_batch([pa.array([h.hexdigest()])], names=["fingerprint"])

    return materialize(spark.createDataFrame([(path,)], "path string").coalesce(1).mapInArrow(digest, "fingerprint string"), "fingerprint")


#: Leaves of the Merkle tree, by the first hex digits of a line's digest.
LEAF_DIGITS = 3


def merkle_leaves(samples: DataFrame) -> DataFrame:
    """leaf, digest: SHA-256 over the sorted lines whose own digest begins with the leaf's digits, each as `count line` and a newline. A leaf is a
    task's, whatever the partitions."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaf, h = None, None
        for b in batches:
            done = []
            for own, line, n in zip(*[b.column(c).to_pylist() for c in ("leaf", "line", "n")], strict=True):
                if own != leaf:
                    done += [(leaf, h.hexdigest())] if h else []
                    leaf, h = own, hashlib.sha256()
                h.update(f"{n} {line}\n".encode())
            yield pa.record_batch([pa.array([d[i] for d in done], pa.string()) for i in range(2)], names=["leaf", "digest"])
        if h:
            yield pa.record_batch([pa.array([leaf]), pa.array([h.hexdigest()])], names=["leaf", "digest"])

    dealt = lines(samples).withColumn("leaf", F.substring(F.sha2("line", 256), 1, LEAF_DIGITS)).repartition("leaf").sortWithinPartitions("leaf", "line")
    return dealt.select("leaf", "line", "n").mapInArrow(digest, "leaf string, digest string")


def merkle_root(samples: DataFrame) -> DataFrame:
    """merkle_root, leaves: SHA-256 over the leaves in order, `leaf digest` and a newline each; 16 ** LEAF_DIGITS rows at most."""
    told = F.array_sort(F.collect_list(F.concat_ws(" ", "leaf", "digest")))
    text = F.array_join(F.transform(told, lambda x: F.concat(x, F.lit("\n"))), "")
    return merkle_leaves(samples).agg(F.sha2(text, 256).alias("merkle_root"), F.count("*").alias("leaves"))


def issues(samples: DataFrame) -> DataFrame:
    """Findings that aren't pairs: issue_id, kind, severity, title."""
    missing = missing_classes(samples).agg(F.count("*").alias("missing"))
    t = totals(samples).crossJoin(F.broadcast(missing))  # one row each
    ratio, fraction = F.col("class_imbalance_ratio"), F.col("test_fraction")
    rows = [
        (F.col("corrupt") > 0, "issue_corrupt", M.CORRUPT, F.lit("medium"), F.concat(F.col("corrupt").cast("string"), F.lit(CORRUPT_TITLE))),
        (ratio > M.IMBALANCE_OK, "issue_class_imbalance", M.CLASS_IMBALANCE, F.when(ratio >= 5, "medium").otherwise("low"),
            F.format_string(IMBALANCE_TITLE, ratio)),
        (F.col("test") == 0, "issue_no_test_split", M.SPLIT_IMBALANCE, F.lit("medium"), F.lit(NO_TEST_TITLE)),
        ((F.col("test") > 0) & ((fraction < M.TEST_MIN) | (fraction > M.TEST_HIGH)), "issue_split_imbalance", M.SPLIT_IMBALANCE, F.lit("low"),
            F.format_string(TEST_TITLE, fraction * 100)),
        (F.col("missing") > 0, "issue_missing_classes", M.CLASS_IMBALANCE, F.lit("low"), F.concat(F.col("missing").cast("string"), F.lit(MISSING_TITLE))),
    ]
    made = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(i).alias("issue_id"), F.lit(k).alias("kind"), s.alias("severity"),
        t_.alias("title"))) for c, i, k, s, t_ in rows])
    return t.select(F.inline(F.filter(made, lambda x: x.isNotNull())))


def split_class_chart(samples: DataFrame) -> DataFrame:
    """A row for each class, a column for each split."""
    return samples.filter("not corrupt").groupBy("label").pivot("split", list(M.SPLITS)).agg(F.count(F.lit(1))).na.fill(0, list(M.SPLITS))
