"""Nearest vectors through an inverted multi-index.

Each half of the vectors has a codebook of its own; a vector lies in the cell named by the nearest
centroid of either half. Cells of a query come from a heap in order of the summed squared distances
of their two centroids, until the cells taken hold enough vectors; those are ranked by exact
distance in double precision.

* Codebooks are fitted on at most ``SAMPLE`` vectors (those with the smallest hashes). Every vector
  is indexed. ``K * K`` cell counts are all that is sent to every task.
* A query looks at cells until they hold ``share`` of all different vectors, and ``least`` at least.
* Equal vectors are indexed once, with their ``k + 1`` smallest ids: no result can hold more of them.
* Cells are searched in blocks: (first centroid, salt), with as many salts as keep a block near
  ``BLOCK`` vectors. A block sees the queries that want one of its cells and sends each query's best
  ``k``, so rows between stages grow with queries times blocks, not with pairs.

Vectors that are null, empty, all zero, or hold null or non-finite components take no part, as
queries or as candidates. Vectors of different lengths never meet. Repeated ids are candidates each
(a query passes over every row of its own id). Fewer than ``k`` candidates give fewer rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meteoqc.llm.common import staged, table

K, SAMPLE, ROUNDS, BLOCK = 96, 8192, 12, 8192
BEST, SHARE, LEAST = 10, 0.45, 2000
FOUND = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector) of the vectors that take part."""
    v = F.col("vector")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").alias("vector")).where(
        F.col("vec_id").isNotNull() & v.isNotNull() & fine & F.exists(v, lambda x: x != 0))


def different(vectors: DataFrame, k: int) -> DataFrame:
    """Each different vector once, with its ``k + 1`` smallest ids."""
    place = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    return vectors.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("vector").agg(
        F.array_sort(F.collect_list("vec_id")).alias("ids"))


def nearest_centroids(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centroids."""
    return (x * x).sum(1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(1)[None]


def codebook(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Lloyd's rounds from evenly chosen different rows; empty cells keep their centroid."""
    x = np.unique(x, axis=0)
    c = x[np.random.default_rng(1).permutation(len(x))[:k]]
    for _ in range(rounds):
        near = nearest_centroids(x, c).argmin(1)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("<f8")
    return flat.reshape(len(column), -1)


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = (x.shape[1] + 1) // 2
    return x[:, :cut], x[:, cut:] if x.shape[1] > 1 else np.zeros((len(x), 1))


def _placing(books, salts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def place(batches):
        a, b = books.value
        for batch in batches:
            if batch.num_rows:
                left, right = halves(matrix(batch.column(0)))
                i, j = nearest_centroids(left, a).argmin(1), nearest_centroids(right, b).argmin(1)
                first = np.array([x[0] for x in batch.column(1).to_pylist()], "<i8")
                block = i * salts + np.abs(first) % salts
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(i * len(b) + j), pa.array(block)],
                                                 names=["vector", "ids", "cell", "block"])

    return place


def best_cells(near: np.ndarray, far: np.ndarray, counts: np.ndarray, wanted: int) -> list[int]:
    """Cells in order of summed distance until they hold ``wanted`` vectors; ``counts`` is K by K."""
    order_a, order_b = np.argsort(near, kind="stable"), np.argsort(far, kind="stable")
    heap, seen, out, held = [(near[order_a[0]] + far[order_b[0]], 0, 0)], {(0, 0)}, [], 0
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        a, b = order_a[i], order_b[j]
        if counts[a, b]:
            out.append(int(a * len(far) + b))
            held += int(counts[a, b])
        for p, q in ((i + 1, j), (i, j + 1)):
            if p < len(near) and q < len(far) and (p, q) not in seen:
                seen.add((p, q))
                heapq.heappush(heap, (near[order_a[p]] + far[order_b[q]], p, q))
    return out


def _wanting(books, counts, wanted: int, salts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row for each query and block, with the cells it wants there."""
    def want(batches):
        a, b = books.value
        held = counts.value
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = halves(matrix(batch.column(1)))
            near, far = nearest_centroids(left, a), nearest_centroids(right, b)
            ids, vectors, rows = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for q in range(batch.num_rows):
                by_first: dict[int, list[int]] = {}
                for cell in best_cells(near[q], far[q], held, wanted):
                    by_first.setdefault(cell // len(b), []).append(cell)
                rows += [(ids[q], vectors[q], cells, i * salts + s) for i, cells in by_first.items() for s in range(salts)]
            for at in range(0, len(rows), 2048):
                q, v, c, k = zip(*rows[at:at + 2048])
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.list_(pa.float64())), pa.array(c, pa.list_(pa.int64())),
                                                  pa.array(k, pa.int64())], names=["query_id", "vector", "cells", "block"])

    return want


def best_of(query_id: int, distances: np.ndarray, ids: list[list[int]], k: int) -> list[tuple[int, float]]:
    """The ``k`` nearest ids among classes of equal vectors, ties to smaller ids."""
    order = np.argsort(distances, kind="stable")
    limit = distances[order[min(k, len(order) - 1)]]  # one more than k: the query's own class may be among them
    near = order[:np.searchsorted(distances[order], limit, side="right")]
    pairs = sorted((float(distances[i]), v) for i in near for v in ids[i] if v != query_id)
    return [(v, d) for d, v in pairs[:k]]


def _searching(k: int) -> Callable:
    def search(_, index: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        if index.num_rows and queries.num_rows:
            x = matrix(index["vector"].combine_chunks())
            ids, cell = index["ids"].to_pylist(), index["cell"].to_numpy()
            order = np.argsort(cell, kind="stable")
            sorted_cells = cell[order]
            for q in queries.to_pylist():
                cells = np.array(q["cells"])
                low, high = np.searchsorted(sorted_cells, cells), np.searchsorted(sorted_cells, cells, side="right")
                at = order[np.concatenate([np.arange(a, b) for a, b in zip(low, high)])] if len(cells) else []
                if len(at):
                    d = np.sqrt(((x[at] - np.array(q["vector"])) ** 2).sum(1))
                    out += [(q["query_id"], v, s) for v, s in best_of(q["query_id"], d, [ids[i] for i in at], k)]
        q, v, s = zip(*out) if out else ((), (), ())
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, pa.float64())})

    return search


def _search_one_length(vectors: DataFrame, queries: DataFrame, k: int, share: float, least: int, codes: int) -> DataFrame:
    spark = vectors.sparkSession
    classes = staged(different(vectors, k))
    total = classes.count()
    sample = classes.orderBy(F.xxhash64("vector"), F.element_at("ids", 1)).limit(SAMPLE).select("vector").toArrow()
    x = matrix(sample["vector"].combine_chunks())
    books = spark.sparkContext.broadcast(tuple(codebook(h, codes) for h in halves(x)))
    n_a, n_b = (len(b) for b in books.value)
    salts = max(1, -(-total // (n_a * BLOCK)))
    placed = staged(classes.mapInArrow(_placing(books, salts), "vector array<double>, ids array<long>, cell long, block long"))
    counts = np.zeros((n_a, n_b), np.int64)
    for r in placed.groupBy("cell").count().collect():  # K * K numbers at most
        counts[divmod(r["cell"], n_b)] = r["count"]
    wanted = max(least, int(share * total))
    asked = queries.mapInArrow(_wanting(books, spark.sparkContext.broadcast(counts), wanted, salts),
                               "query_id long, vector array<double>, cells array<long>, block long")
    return placed.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(_searching(k), FOUND)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = BEST, share: float = SHARE, least: int = LEAST, codes: int = K) -> DataFrame:
    """The ``k`` nearest found of every query: both tables are (vec_id, embedding)."""
    spark = vectors.sparkSession
    own = usable(vectors).withColumn("vector", F.col("vector").cast("array<double>"))
    asked = usable(queries).withColumn("vector", F.col("vector").cast("array<double>"))
    lengths = [r["n"] for r in own.groupBy(F.size("vector").alias("n")).count().collect()]
    parts = [_search_one_length(own.where(F.size("vector") == n), asked.where(F.size("vector") == n), k, share, least, codes) for n in lengths]
    found = spark.createDataFrame([], FOUND)
    for p in parts:
        found = found.unionByName(p)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0))
