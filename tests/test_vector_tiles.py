"""What the vector search sends and returns grows with tiles of cells, not with cells."""
import numpy as np
from pyspark.sql import functions as F

from trailweave.functions import vectors


def test_a_query_comes_back_with_one_list_a_tile(spark):
    """Vectors without clusters, where nearly every cell has to be met: one list of ten a query, and brute force's."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(2000, 16))
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "poi_id long, vec array<double>")
    index = vectors.deal(items, True, 40)
    tiles = vectors.tiles_of(index, 5000)
    assert tiles.size.tolist() == [2000]
    asked = items.where("poi_id < 50").select(F.col("poi_id").alias("case_id"), F.col("vec"), F.lit(10).cast("long").alias("want"), F.lit(float("-inf")).alias("floor"))
    every = vectors.chosen_cells(asked.withColumn("floor", F.lit(-9.0)), index, tiles, True)
    assert vectors.multiplied(every, index, tiles, 5000, None).groupBy("case_id").count().agg(F.max("count")).first()[0] == 10
    best = vectors.top_items(asked.select("case_id", "vec"), items, 10)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {(r.case_id, r["rank"]): r.poi_id for r in best.collect()}
    for i in range(50):
        assert [got[i, k + 1] for k in range(10)] == np.argsort(-np.round(unit[i] @ unit.T, 9), kind="stable")[:10].tolist()


def test_tiles_hold_neighbouring_cells_and_large_cells_are_cut():
    index = vectors.Cells(None, np.array([[5.0], [1.0], [4.0], [2.0], [30.0]]), np.zeros(5), np.array([40, 40, 40, 40, 250]))
    tiles = vectors.tiles_of(index, 100)
    groups = {tuple(np.flatnonzero(tiles.of_cell == t)) for t in range(len(tiles.size))}
    assert groups == {(1, 3), (0, 2), (4,)} and sorted(tiles.parts) == [1, 1, 3]


def test_means_by_sums(spark):
    rows = spark.createDataFrame([(1, [3.0, 4.0], 1), (1, [0.0, 2.0], 3), (2, [1.0, 0.0], 2), (2, None, 5)], "k long, vec array<double>, n long")
    got = {r.k: r.vec for r in vectors.mean_vectors(rows, "k", vectors.width(rows), "n").collect()}
    assert np.allclose(got[1], [0.75, 2.5]) and np.allclose(got[2], [1, 0])
    got = {r.k: r.vec for r in vectors.mean_vectors(rows, "k", 2, unit=True).collect()}
    assert np.allclose(got[1], [0.3, 0.9])
    assert vectors.mean_vectors(rows.where("false"), "k", vectors.width(rows.where("false"))).count() == 0
