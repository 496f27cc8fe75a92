"""Nearest neighbours by cosine as a block matrix join.

Queries and candidates are dealt into blocks; each pair of a query block and a candidate block is one tile. In a
tile, int8 vectors are multiplied as a matrix product, the quantisation errors bound every cosine from both
sides, pairs whose upper bound stays below a query's k-th lower bound are dropped, and the rest are computed
again in double precision. Each tile keeps k rows a query in a heap; the heaps of all tiles are merged by rank.
The bounds are exact, so nothing is lost to quantisation.
"""
from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RESULT = "query_id long, vec_id long, score double"
QUERY_BLOCK, BLOCK, STRIP = 4096, 32768, 2048


def matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if column.num_chunks else pa.array([], pa.float64())
    return np.asarray(flat, np.float64).reshape(-1, dim)


class Quantised:
    """Unit vectors as int8 levels times a step, with the length of the rest: unit = step * level + error."""

    def __init__(self, vectors: np.ndarray) -> None:
        # scaling by the largest component first keeps squares of very large or small components in range
        scaled = vectors / np.abs(vectors).max(1, keepdims=True)
        self.scaled = scaled
        self.length = np.sqrt((scaled * scaled).sum(1))
        unit = scaled / self.length[:, None]
        self.step = np.abs(unit).max(1) / 127
        self.levels = np.rint(unit / self.step[:, None]).astype(np.int8)
        near = self.levels * self.step[:, None]
        self.error = np.sqrt(((unit - near) ** 2).sum(1))
        self.near_length = np.sqrt((near * near).sum(1))


def tile(queries: Quantised, query_ids: np.ndarray, rows: Quantised, ids: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    heaps: list[list[tuple[float, int]]] = [[] for _ in query_ids]
    floor = np.full(len(query_ids), -np.inf)  # k-th best exact score so far
    exact_type = np.float32 if queries.levels.shape[1] * 127 * 127 < 1 << 24 else np.float64  # integers that the product holds exactly
    left = queries.levels.astype(exact_type)
    slack = 1e-9
    for at in range(0, len(ids), STRIP):
        strip = slice(at, at + STRIP)
        product = (left @ rows.levels[strip].astype(exact_type).T).astype(np.float64) * queries.step[:, None] * rows.step[strip]
        bound = queries.error[:, None] + queries.near_length[:, None] * rows.error[strip] + slack
        other = ids[strip] != query_ids[:, None]
        low = np.where(other, product - bound, -np.inf)
        kth = np.partition(low, -k, 1)[:, -k] if low.shape[1] >= k else np.full(len(query_ids), -np.inf)
        wanted = other & (product + bound >= np.maximum(kth, floor)[:, None])
        for q in np.flatnonzero(wanted.any(1)):
            close = np.flatnonzero(wanted[q]) + at
            scores = (rows.scaled[close] * queries.scaled[q]).sum(1) / (rows.length[close] * queries.length[q])
            heap = heaps[q]
            for score, x in zip(scores.tolist(), ids[close].tolist()):
                if len(heap) < k:
                    heapq.heappush(heap, (score, -x))
                elif (score, -x) > heap[0]:
                    heapq.heapreplace(heap, (score, -x))
            if len(heap) == k:
                floor[q] = heap[0][0]
    return [(int(q), -x, score) for q, heap in zip(query_ids, heaps) for score, x in heap]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank int from 1, vec_id, score double): for each query the k rows of largest cosine, ties to the smaller vec_id.

    Rows of both tables whose id or vector is null, or whose vector is empty, zero or holds a null, NaN or infinity
    take no part. A query never finds rows with its own id, and finds only rows of its own number of components;
    with fewer than k such rows it finds all. Of equal vectors only the k + 1 smallest ids can be found, so more
    are not compared. Other columns are left out. The queries must be a stated set: work grows with queries x rows.
    """
    spark = vectors.sparkSession

    def usable(df: DataFrame) -> DataFrame:
        v = F.col("v")
        df = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
        finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return df.where(F.col("id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)).withColumn("dim", F.size("v"))

    first = Window.partitionBy("v").orderBy("id")
    rows = usable(vectors).dropDuplicates(["id", "v"]).withColumn("copy", F.row_number().over(first)).where(F.col("copy") <= k + 1).drop("copy")
    asked = usable(queries).dropDuplicates(["id", "v"])
    n_asked, n_rows = usable(queries).count(), usable(vectors).count()
    query_blocks, blocks = max(1, -(-n_asked // QUERY_BLOCK)), max(1, -(-n_rows // BLOCK), min(spark.sparkContext.defaultParallelism, -(-n_rows // STRIP)))
    left = (asked.withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(query_blocks)).cast("int"))
            .withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).groupBy("dim", "qb", "cb"))
    right = (rows.withColumn("cb", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(blocks)).cast("int"))
             .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))).groupBy("dim", "qb", "cb"))

    def run(key: tuple, q: pa.Table, c: pa.Table) -> pa.Table:
        found: list = []
        if q.num_rows and c.num_rows:
            dim = key[0].as_py()
            found = tile(Quantised(matrix(q.column("v"), dim)), q.column("id").to_numpy(), Quantised(matrix(c.column("v"), dim)), c.column("id").to_numpy(), k)
        return pa.table({n: pa.array([x[i] for x in found], t) for i, (n, t) in enumerate((("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())))})

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    merged = left.cogroup(right).applyInArrow(run, RESULT)
    return merged.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
