"""A stored dense index, searched exactly.

Points are in clusters around centroids, by angle. A cluster's radius bounds how near to a query any of its points can be,
so a search reads clusters from the best bound on, and stops when no other can have one of the k best.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.operators import retrieval
from corpusmill.sources import publish

#: Clusters at most (the centroids are in every task), how many vectors choose them, and passes that improve them.
MOST_CLUSTERS, CHOOSING, PASSES = 2048, 20_000, 4
#: Tasks that write a cluster's folder, as one may hold much of the index.
SPREAD = 8


def units(vectors: list[np.ndarray]) -> np.ndarray:
    """Vectors of one length each as rows of length 1."""
    rows = np.array(vectors, np.float64)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def centroids(sample: np.ndarray, n: int) -> np.ndarray:
    """n directions of a sample of unit vectors: spherical k-means from every few of them."""
    found = sample[np.linspace(0, len(sample) - 1, n).astype(int)]
    for _ in range(PASSES):
        nearest = np.argmax(sample @ found.T, axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, nearest, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        found = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), found)
    return found


def assigned(batches: Iterator[pa.RecordBatch], held) -> Iterator[pa.RecordBatch]:
    """Points with the cluster that is nearest by angle, and that angle."""
    found = held.value
    for batch in batches:
        at = batch.schema.get_field_index("dense")
        flat = batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        near = units(flat) @ found.T
        cluster = np.argmax(near, axis=1)
        angle = np.arccos(np.clip(near[np.arange(len(near)), cluster], -1, 1))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cluster, pa.int32()), pa.array(angle)], [*batch.schema.names, "cluster", "angle"])


@dataclass(frozen=True)
class Clusters:
    """A stored index of points with dense vectors of one length."""

    path: str

    @classmethod
    def build(cls, points: DataFrame, path: str, clusters: int | None = None) -> Clusters:
        """Stores points (id, dense, technique if there is one) in a folder for each cluster, and of each its centroid, radius
        and number of points. Vectors that are null or zero, or hold null or non-finite numbers, are near to nothing and
        are left out. Centroids are chosen on CHOOSING vectors at most; every vector is in the index."""
        spark = points.sparkSession
        sound = F.col("dense").isNotNull() & F.forall("dense", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("dense", lambda x: x != 0)
        rows = points.where(sound).select("id", *[c for c in ("technique",) if c in points.columns], F.col("dense").cast("array<double>").alias("dense"))
        total = rows.count()
        share = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(min(1.0, CHOOSING / max(total, 1)) * (1 << 20))
        sample = [r["dense"] for r in rows.where(share).orderBy(F.xxhash64("id"), "id").limit(CHOOSING).collect()]
        sample = sample or [r["dense"] for r in rows.limit(1).collect()]
        n = min(MOST_CLUSTERS, len(sample), clusters or max(1, math.isqrt(total)))
        found = centroids(units(sample), n) if sample else np.zeros((0, 1))
        held = spark.sparkContext.broadcast(found)
        shape = T.StructType([*rows.schema.fields]).add("cluster", T.IntegerType()).add("angle", T.DoubleType())

        def write(to: str) -> None:
            rows.limit(0).select("id").write.parquet(f"{to}/shape")
            if not sample:
                return
            placed = rows.mapInArrow(lambda batches: assigned(batches, held), shape)
            spread = F.pmod(F.xxhash64("id"), F.lit(SPREAD))
            order = ["cluster", *[c for c in ("technique",) if c in rows.columns], "id"]
            placed.repartition("cluster", spread).sortWithinPartitions(*order).write.partitionBy("cluster").parquet(f"{to}/points")
            read = spark.read.schema(shape).parquet(f"{to}/points")
            radii = read.groupBy(F.col("cluster").alias("range")).agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n"))
            centers = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(found)], "range int, center array<double>")
            radii.join(centers, "range").write.parquet(f"{to}/clusters")

        publish.replace(spark, path, write)
        return cls(path)

    def top(self, spark: SparkSession, query: list[float], k: int = retrieval.DEPTH, technique: str | None = None) -> DataFrame:
        """id and cosine of the k nearest points (of a technique, if given)."""
        return self.search(spark, query, k, technique)[0]

    def search(self, spark: SparkSession, query: list[float], k: int = retrieval.DEPTH, technique: str | None = None) -> tuple[DataFrame, dict[str, int]]:
        """The same, with the number of clusters and of those that were read. The technique is a filter of the scan."""
        shape = retrieval.stored_shape(spark, self.path)
        if not any(query) or not publish.exists(spark, f"{self.path}/clusters"):
            return spark.createDataFrame([], shape), {"clusters": 0, "read": 0}
        clusters, points = spark.read.parquet(f"{self.path}/clusters"), spark.read.parquet(f"{self.path}/points")
        points = points if technique is None else points.where(F.col("technique") == technique)
        center = retrieval.cosine(F.col("center"), F.array(*[F.lit(float(x)) for x in query]))
        # No point is nearer to the query than the centroid by more than the radius.
        gap = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), center))) - F.col("radius")
        bounds = clusters.select("range", F.cos(F.greatest(F.lit(0.0), gap)).alias("bound"))

        # At most MOST_CLUSTERS numbers, fewer than best_first() holds, which choose folders.
        best, n, read = retrieval.best_first(spark, bounds, lambda some: retrieval.dense(points.where(F.col("cluster").isin(some)), query, k), k, shape)
        return best, {"clusters": n, "read": read}
