"""Numbers in order without one task that sees every row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..storage import materialize


def numbered(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Adds `name`, 0, 1, 2 ... in the order of `column`, whose values should be distinct.

    Ranges of the column are sorted and numbered each on its own; what precedes a range is the sum of the sizes before
    it, a row for each partition."""
    part, place, before = (_unused(rows, c) for c in ("part", "place", "before"))
    dealt = materialize(rows.repartitionByRange(column).sortWithinPartitions(column).withColumn(part, F.spark_partition_id()), "ordered")
    sizes = dealt.groupBy(part).agg(F.count("*").alias("n"))
    offsets = sizes.select(part, F.coalesce(F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before))
    own = dealt.withColumn(place, F.row_number().over(Window.partitionBy(part).orderBy(column)))
    return own.join(F.broadcast(offsets), part).withColumn(name, (F.col(before) + F.col(place) - 1).cast("bigint")).drop(part, before, place)


def _unused(rows: DataFrame, name: str) -> str:
    """The name, longer by underscores where rows has such a column."""
    taken = {c.lower() for c in rows.columns}
    while name.lower() in taken:
        name += "_"
    return name
