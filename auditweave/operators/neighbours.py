"""Nearest rows by cosine, exact, over block files: what the triangle inequality rules out is not read.

Vectors of unit norm lie at the distance sqrt(2 - 2 cosine). Each goes to the nearest of some pivots, and blocks of one pivot's vectors are
files in the shared folder. A task with some query vectors knows its distances to all pivots; a block whose vectors lie between r and R from
their pivot holds none nearer than max(d - R, r - d). Blocks are visited in the order of these bounds, until they exceed what the threshold
and the k-th best so far allow. No vector goes through the driver, only the pivots (MOST_PIVOTS at most) and a row for each block.

Equal vectors are one: they have one list of neighbours, in which of equal ones only the first k + 1 by idx can stand; so a group of copies is
asked once and stored k + 1 times at most."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..sources.zips import place
from ..storage import fresh_path, materialize

#: Vectors of a block, query vectors that meet it at once (a 64th of all, if that's fewer), vectors for each pivot, pivots at most.
BLOCK_ROWS, QUERIES, PER_PIVOT, MOST_PIVOTS = 4096, 2048, 256, 1024
#: Distances from the pivot that a larger group is cut at, by quantiles.
RINGS = 16
#: What a bound may be off by rounding.
SLACK = 1e-6
LISTS = "a long, b long, similarity double"


def unit_rows(vectors: pa.Array) -> np.ndarray:
    """A list column as rows of unit norm; zero rows stay."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    rows = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms > 0, norms, 1)


def distances(cosines: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * cosines, 0))


class Lists:
    """The k best of each query so far: similarity, then the smaller name."""

    def __init__(self, queries: int, k: int):
        self.k, self.similarity, self.name = k, np.full((queries, k), -np.inf), np.full((queries, k), np.iinfo(np.int64).max)

    def floor(self, threshold: float) -> np.ndarray:
        """What a similarity must reach to matter."""
        return np.maximum(self.similarity[:, -1], threshold)

    def search(self, asked: np.ndarray, queries: np.ndarray, rows: np.ndarray, names: np.ndarray, first: np.ndarray, threshold: float) -> None:
        """The queries `asked` meet the vectors in rows; vector v has the names names[first[v] : first[v + 1]], k at most.

        Products of single precision tell, with what they may be off, which pairs can matter; only these are measured in double."""
        off = 2e-7 * (rows.shape[1] + 8)
        coarse = queries[asked].astype(np.float32) @ rows.astype(np.float32).T
        floor = (self.floor(threshold)[asked] - off).astype(np.float32)
        q, v = np.divmod(np.flatnonzero(coarse >= np.nextafter(floor, np.float32(-np.inf))[:, None]), coarse.shape[1])
        if not len(q):
            return
        many = np.flatnonzero(np.bincount(q, minlength=len(asked)) > 4 * self.k)  # the k best of the block are a bound, too
        if len(many):
            least = np.full(len(asked), -np.inf, np.float32)
            least[many] = np.partition(coarse[many], rows.shape[0] - self.k, axis=1)[:, rows.shape[0] - self.k] - np.float32(2 * off)
            can = coarse[q, v] >= least[q]
            q, v = q[can], v[can]
        q = asked[q]
        similarity = np.round(np.einsum("ij,ij->i", queries[q], rows[v]), 12)
        times = first[v + 1] - first[v]
        name = names[np.repeat(first[v] - (np.cumsum(times) - times), times) + np.arange(times.sum())]
        own = np.unique(q)
        row = np.concatenate([np.repeat(own, self.k), np.repeat(q, times)])
        similarity = np.concatenate([self.similarity[own].ravel(), np.repeat(similarity, times)])
        name = np.concatenate([self.name[own].ravel(), name])
        order = np.lexsort((name, -similarity, row))
        row = row[order]
        start = np.searchsorted(row, own)
        best = order[start[:, None] + np.arange(self.k)]  # each has k entries at least
        self.similarity[own], self.name[own] = similarity[best], name[best]


def read_block(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The vectors of a block, the idx that stand for them, and where each vector's begin and the last one's end."""
    store, folder = place(path)
    files = sorted(f.path for f in store.get_file_info(fs.FileSelector(folder)) if f.path.endswith(".parquet"))
    # file by file: a dataset's discovery takes longer than the block
    table = pa.concat_tables([pq.ParquetFile(store.open_input_file(f)).read(["embedding", "names"], use_threads=False) for f in files])
    names = table.column("names").combine_chunks()
    return unit_rows(table.column("embedding")), names.flatten().to_numpy(), names.offsets.to_numpy() - names.offsets[0].as_py()


def lists(samples: DataFrame, k: int, threshold: float, visited: tuple[Accumulator, Accumulator] | None = None, block_rows: int = BLOCK_ROWS,
    per_pivot: int = PER_PIVOT) -> DataFrame:
    """a, b, similarity: for each sample the k nearest by (similarity, smaller idx), itself among them, that reach the threshold. visited counts the
    blocks that were read for some
    queries, and those that there were."""
    spark = samples.sparkSession
    own = samples.filter(~F.col("corrupt") & F.col("embedding").isNotNull()).select("idx", "embedding")
    if threshold > 0:  # a zero vector is at 0 from all
        own = own.filter(F.exists("embedding", lambda x: x != 0))
    own = materialize(own.withColumn("key", F.xxhash64("embedding")), "vectors")
    rank = F.row_number().over(Window.partitionBy("key", "embedding").orderBy("idx"))
    first = own.withColumn("nth", rank).filter(F.col("nth") <= k)  # of each map task k go on at most
    groups = first.groupBy("key", "embedding").agg(F.min("idx").alias("vec"), F.array_sort(F.collect_list("idx")).alias("names"))
    groups = materialize(groups, "distinct-vectors")
    n = groups.count()
    if not n:
        return spark.createDataFrame([], LISTS)
    drawn = groups.orderBy(F.xxhash64("vec"), "vec").limit(min(MOST_PIVOTS, -(-n // per_pivot))).select("embedding").toArrow()
    pivots = spark.sparkContext.broadcast(unit_rows(drawn.column("embedding")))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cosine = unit_rows(b.column("embedding")) @ pivots.value.T
            near = cosine.argmax(axis=1)
            yield pa.record_batch([*b.columns, pa.array(near.astype(np.int32)), pa.array(distances(cosine[np.arange(len(near)), near]))],
                names=[*b.schema.names, "pivot", "distance"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in groups.schema.fields)
    assigned = materialize(groups.mapInArrow(assign, f"{fields}, pivot int, distance double"), "assigned")
    quantiles = [i / RINGS for i in range(1, RINGS)]
    sizes = assigned.groupBy("pivot").agg(F.count("*").alias("n"), F.percentile_approx("distance", quantiles, 1000).alias("edges"))  # a row for each pivot
    rings = F.least(F.lit(RINGS), F.ceil(F.col("n") / block_rows))
    ring = F.floor(F.size(F.filter("edges", lambda e: e < F.col("distance"))) * rings / RINGS)
    again = F.pmod(F.xxhash64("vec"), F.ceil(F.col("n") / (RINGS * block_rows)))
    block = F.concat_ws("-", *[c.cast("string") for c in (F.col("pivot"), ring, again)])
    path = fresh_path(spark, "blocks")
    assigned.join(F.broadcast(sizes), "pivot").withColumn("block", block).drop("edges", "n").repartition("block").write.partitionBy("block").parquet(path)
    stored = spark.read.parquet(path)
    told = stored.groupBy("block", "pivot").agg(F.min("distance").alias("near"), F.max("distance").alias("far")).orderBy("block").toArrow()
    blocks = (told.column("block").to_pylist(), told.column("pivot").to_numpy(), told.column("near").to_numpy(), told.column("far").to_numpy())
    reach = float(distances(np.array(threshold))) if threshold > 0 else np.inf

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, pivot, near, far = blocks
        for b in batches:
            together = max(128, min(QUERIES, n // 64, (1 << 22) // len(names)))
            for at in range(0, b.num_rows, together):
                part = b.slice(at, together)
                queries = unit_rows(part.column("embedding"))
                to_pivot = distances(queries @ pivots.value.T)[:, pivot]
                bound = np.maximum(np.maximum(to_pivot - far, near - to_pivot), 0) - SLACK
                if visited is not None:
                    visited[1].add(len(names))
                best, order = Lists(len(queries), k), np.lexsort((to_pivot.min(axis=0), bound.min(axis=0)))
                for block in order:
                    limit = np.minimum(reach, np.where(np.isfinite(best.similarity[:, -1]),
                        distances(np.where(np.isfinite(best.similarity[:, -1]), best.similarity[:, -1], 0)), np.inf))
                    asked = np.flatnonzero(bound[:, block] <= limit + SLACK)
                    if not len(asked):
                        continue
                    rows, idx, first = read_block(f"{path}/block={names[block]}")
                    if visited is not None:
                        visited[0].add(1)
                    best.search(asked, queries, rows, idx, first, threshold)
                row, place_ = np.nonzero(best.similarity >= threshold)
                vec = part.column("vec").to_numpy()
                yield pa.record_batch([pa.array(vec[row]), pa.array(best.name[row, place_]), pa.array(best.similarity[row, place_])],
                    names=["vec", "b", "similarity"])

    asked = stored.select("vec", "embedding", "block").repartition("block").sortWithinPartitions("block").select("vec", "embedding")  # neighbours ask together
    found = materialize(asked.mapInArrow(search, "vec long, b long, similarity double"), "lists")
    members = own.select("idx", "key", "embedding").join(groups.select("key", "embedding", "vec"), ["key", "embedding"]).select(F.col("idx").alias("a"), "vec")
    return members.join(found, "vec").select("a", "b", "similarity")
