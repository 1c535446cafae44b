"""Shared storage: where intermediate tables go, and lineage cuts that survive lost executors."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Spark's settings that free shuffle files when a query ends, and that say up to which size a side of a join is broadcast.
CLEANUP, BROADCAST = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.autoBroadcastJoinThreshold"
#: Bytes that a side may have by its files or shuffles to be broadcast while a table is written, if the session allows as many. What the driver
#: holds for it can be several times as much (78 MB were seen for 10), and a plan may have a dozen of them.
MOST_BROADCAST = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one only in local mode where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="auditweave-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/auditweave/{name}-{uuid.uuid4().hex}"


#: Paths of the tables that this thread has written and not released, in order.
_own = threading.local()


def _written() -> list[str]:
    if not hasattr(_own, "paths"):
        _own.paths = []
    return _own.paths


def mark() -> int:
    """What release() takes to leave alone all that this thread wrote before."""
    return len(_written())


def release(spark: SparkSession, since: int, keep: int = 1) -> None:
    """Deletes the tables written since mark(), but for the last `keep`: call it when only those are still read."""
    paths = _written()
    gone = paths[since : len(paths) - keep]
    del paths[since : len(paths) - keep]
    for path in gone:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


def size_in_bytes(setting: str) -> int:
    """A size as Spark's settings have it: -1, 10485760b, 256k, 10MB."""
    number, unit = re.fullmatch(r"\s*(-?\d+)\s*([kmgtp]?)i?b?\s*", setting.lower()).groups()
    return int(number) << (10 * " kmgtp".index(unit or " "))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df once to the shared folder and reads it back: lineage ends there, and lost
    executors cost no more than the tasks they ran. The shuffle files behind the write are freed.

    Only small sides of joins are broadcast for it (MOST_BROADCAST), but for those that the plan names."""
    spark = df.sparkSession
    path, before = fresh_path(spark, name), {k: spark.conf.get(k, None) for k in (CLEANUP, BROADCAST)}
    spark.conf.set(CLEANUP, "true")
    if size_in_bytes(spark.conf.get(BROADCAST)) > MOST_BROADCAST:
        spark.conf.set(BROADCAST, str(MOST_BROADCAST))
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    _written().append(path)
    return spark.read.schema(nullable(df.schema)).parquet(path)
