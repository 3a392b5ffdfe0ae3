"""Exact nearest neighbours that leave out what cannot be near: vectors in cells around pivots, bounded by their radii."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .search import comparable, nearest_of
from .storage import new_path

#: Pivots of an index at most, and queries that are searched together.
PIVOTS, BLOCK = 256, 10_000


@dataclass(frozen=True)
class Found:
    """``rows`` of the search, and the share of all distances between queries and vectors that were computed."""

    rows: DataFrame
    share: float


class PivotIndex:
    """Vectors of ``chunks(chunk_id, vector, ...)`` by cell: each is in the cell of the nearest of at most ``PIVOTS`` pivots.

    A vector's distance to a query is at least the query's distance to the pivot less that of the vector, and the
    other way round. The cells nearest to a query that hold enough vectors give it a bound; of the others only those
    are searched whose inner and outer radius let them hold a nearer one. So results are those of a full scan; how
    much is left out depends on how the vectors lie, and is returned.
    """

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark, self.path = spark, path or new_path(spark, "pivots")

    def build(self, chunks: DataFrame, pivots: int | None = None, seed: int = 0) -> PivotIndex:
        """Index the chunks whose vectors have the dimension of the pivots, which are some that a hash of their ids picks; null vectors and those beyond numbers take no part."""
        count = chunks.count()
        n = min(PIVOTS, max(1, int(count**0.5))) if pivots is None else min(PIVOTS, pivots)
        first = chunks.where("vector IS NOT NULL").select(F.size("vector").alias("n")).groupBy("n").count().orderBy(F.desc("count"), "n").limit(1).collect()
        dims = first[0].n if first else 0
        good = comparable(chunks, "vector", dims)
        picked = good.select("vector").orderBy(F.xxhash64(F.lit(seed), "chunk_id"), "chunk_id").limit(n).collect()
        points = np.array([r.vector for r in picked], np.float64).reshape(len(picked), dims)
        shared = self.spark.sparkContext.broadcast(points)
        schema = T.StructType([*good.schema.fields, T.StructField("radius", T.DoubleType()), T.StructField("cell", T.IntegerType())])

        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    flat = np.asarray(batch.column("vector").flatten(), np.float64).reshape(batch.num_rows, dims)
                    _, cell, distance = nearest_of(shared.value, np.arange(len(shared.value)), flat, 1)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.sqrt(distance)), pa.array(cell.astype(np.int32))], [f.name for f in schema])

        placed = good.mapInArrow(dealt, schema) if len(points) else good.withColumns({"radius": F.lit(0.0), "cell": F.lit(0)}).limit(0)
        # a large cell's rows go to as many files as it needs
        placed.repartition("cell", F.pmod(F.xxhash64("chunk_id"), F.lit(8))).write.mode("overwrite").partitionBy("cell").parquet(f"{self.path}/cells")
        stored = self.spark.read.schema(schema).parquet(f"{self.path}/cells")
        stats = {r.cell: r for r in stored.groupBy("cell").agg(F.count("*").alias("n"), F.min("radius").alias("inner"), F.max("radius").alias("outer")).collect()}
        self.schema, self.points = schema, points
        self.n = np.array([stats[c].n if c in stats else 0 for c in range(len(points))])
        self.inner = np.array([stats[c].inner if c in stats else np.inf for c in range(len(points))])
        self.outer = np.array([stats[c].outer if c in stats else -np.inf for c in range(len(points))])
        return self

    def _scanned(self, ids: list, vectors: np.ndarray, wanted: np.ndarray, k: int, kind: T.DataType, exclude_self: str | None) -> DataFrame:
        """Of each query the nearest vectors of each batch of its cells; ``wanted`` is queries by cells."""
        rest = [f for f in self.schema.fields if f.name not in ("vector", "radius", "cell")]
        schema = T.StructType([T.StructField("query", T.IntegerType()), T.StructField("query_id", kind), T.StructField("distance", T.DoubleType()), *rest])
        names, width = [f.name for f in rest], self.points.shape[1]
        shared = self.spark.sparkContext.broadcast((ids, vectors, wanted))
        cells = np.flatnonzero(wanted.any(0)).tolist()
        rows = self.spark.read.schema(self.schema).parquet(f"{self.path}/cells").where(F.col("cell").isin(cells))

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, vectors, wanted = shared.value
            for batch in batches:
                of_cell = batch.column("cell").to_numpy()
                for cell in np.unique(of_cell):
                    part = batch.filter(pa.array(of_cell == cell))
                    asked = np.flatnonzero(wanted[:, cell])
                    flat = np.asarray(part.column("vector").flatten(), np.float64).reshape(part.num_rows, width)
                    _, order = np.unique(np.asarray(part.column("chunk_id")), return_inverse=True)
                    barred = None
                    if exclude_self:
                        place: dict = {}
                        for i, q in enumerate(asked):
                            place.setdefault(ids[q], []).append(i)
                        own = [(i, at) for at, x in enumerate(part.column(exclude_self).to_pylist()) for i in place.get(x, ())]
                        barred = tuple(np.array(own, np.int64).reshape(-1, 2).T)
                    a, b, distance = nearest_of(flat, order, vectors[asked], k, barred)
                    if len(a):
                        query = asked[a]
                        yield pa.RecordBatch.from_arrays([pa.array(query.astype(np.int32)), pa.array([ids[i] for i in query]), pa.array(distance), *part.select(names).take(pa.array(b)).columns], [f.name for f in schema])

        found = rows.select(*names, "vector", "cell").mapInArrow(look, schema)
        place = F.row_number().over(W.partitionBy("query").orderBy("distance", "chunk_id"))
        return found.withColumn("rank", place).where(F.col("rank") <= k)

    def _block(self, asked: list, k: int, kind: T.DataType, exclude_self: str | None) -> tuple[DataFrame, int]:
        ids, vectors = [r.query_id for r in asked], np.array([r.q for r in asked], np.float64).reshape(len(asked), -1)
        if vectors.shape[1] != self.points.shape[1]:
            raise ValueError(f"queries of {vectors.shape[1]} dimensions, vectors of {self.points.shape[1]}")
        to_pivot = np.sqrt(np.maximum(0, np.square(vectors[:, None, :] - self.points[None, :, :]).sum(2))) if len(vectors) * self.points.size < 1 << 26 else np.stack([np.sqrt(np.square(v - self.points).sum(1)) for v in vectors])
        least = np.maximum(np.maximum(to_pivot - self.outer, self.inner - to_pivot), 0)
        # the cells that may hold the nearest come first, until they hold enough, one's own row left out
        order = np.argsort(np.where(self.n > 0, to_pivot, np.inf), axis=1, kind="stable")
        held = np.cumsum(self.n[order], axis=1)
        first = np.zeros(to_pivot.shape, bool)
        np.put_along_axis(first, order, held - self.n[order] < k + bool(exclude_self), axis=1)
        first &= self.n > 0
        near = self._scanned(ids, vectors, first, k, kind, exclude_self)
        bounds = np.full(len(ids), np.inf)
        for r in near.where(F.col("rank") == k).select("query", "distance").collect():
            bounds[r.query] = np.sqrt(r.distance)
        # bounds are a little wider than rounding can make them wrong
        more = (least <= bounds[:, None] * (1 + 1e-9) + 1e-12) & ~first & (self.n > 0)
        both = self._scanned(ids, vectors, first | more, k, kind, exclude_self) if more.any() else near
        return both.drop("query"), int(((first | more) * self.n).sum())

    def search(self, queries: DataFrame, k: int, exclude_self: str | None = None) -> Found:
        """Each query's ``k`` nearest chunks, ties by ``chunk_id``: ``query_id, distance, rank`` and the chunks' columns, as a full scan has them.

        ``queries(query_id, query_vector)`` go in blocks of ``BLOCK``; of each block its bounds reach the driver.
        """
        kind = queries.schema["query_id"].dataType
        asked = queries.withColumn("vector", F.transform("query_vector", lambda x: x.cast("double")))
        whole = comparable(asked, "vector", self.points.shape[1]).select("query_id", F.col("vector").alias("q"))
        rows, block, computed, total = whole.toLocalIterator(), [], 0, 0
        out = None
        while True:
            block = [r for _, r in zip(range(BLOCK), rows, strict=False)]
            if not block and out is not None:
                break
            found, n = self._block(block, k, kind, exclude_self) if block and len(self.points) else (self._none(kind), 0)
            out, computed, total = found if out is None else out.unionByName(found), computed + n, total + len(block) * int(self.n.sum())
            if not block:
                break
        return Found(out, computed / total if total else 0.0)

    def _none(self, kind: T.DataType) -> DataFrame:
        rest = [f for f in self.schema.fields if f.name not in ("vector", "radius", "cell")]
        return self.spark.createDataFrame([], T.StructType([T.StructField("query_id", kind), T.StructField("distance", T.DoubleType()), *rest, T.StructField("rank", T.IntegerType())]))
