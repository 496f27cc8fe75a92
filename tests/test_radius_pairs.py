"""Pairs within a radius: those of the plain distance, as the work of many tasks however small the files are."""
import random

import pytest
from pyspark.sql import functions as F

from trailweave.functions import geo


def frames(spark, n, spread, seed):
    rng = random.Random(seed)
    at = lambda: (34.6 + spread * rng.random(), 135.4 + spread * rng.random())
    anchors = [(i, *at(), rng.choice([0.0, 0.5, 1.5, 3.0])) for i in range(n)] + [(-1, None, 135.0, 1.0), (-2, 34.6, 135.4, None), (-3, float("nan"), 135.4, 1.0)]
    pois = [(i, *at()) for i in range(n)] + [(-1, 34.6, None), (-2, anchors[0][1], anchors[0][2]), (-3, float("nan"), 135.4)]
    return (spark.createDataFrame(anchors, "case_id long, a_lat double, a_lon double, reach double").coalesce(1), spark.createDataFrame(pois, "poi_id long, lat double, lon double").coalesce(1))


@pytest.mark.parametrize("spread, radius", [(0.1, 1.5), (0.1, "reach"), (0.00002, 0.001), (40.0, 900.0), (0.1, 0.0)])
def test_pairs_and_distances_are_those_of_every_pair(spark, spread, radius):
    anchors, pois = frames(spark, 150, spread, 4)
    got = geo.radius_join(anchors, pois, radius, cell_deg=0.03 if isinstance(radius, str) else None).select("case_id", "poi_id", "distance_km")
    km = geo.haversine_km(F.col("a_lat"), F.col("a_lon"), F.col("lat"), F.col("lon"))
    want = anchors.crossJoin(pois).withColumn("distance_km", km).where(F.col("distance_km") <= (F.col(radius) if isinstance(radius, str) else radius))
    got, want = ({(r[0], r[1]): r[2] for r in df.collect()} for df in (got, want.select("case_id", "poi_id", "distance_km")))
    assert got == want and want  # the same numbers, bit by bit


def test_points_at_the_very_edge(spark):
    """Radii that are exactly a distance, and the next smaller and larger numbers."""
    import math

    anchors, pois = frames(spark, 30, 0.1, 5)
    km = geo.haversine_km(F.col("a_lat"), F.col("a_lon"), F.col("lat"), F.col("lon"))
    pairs = anchors.drop("reach").crossJoin(pois).withColumn("km", km).where("km > 0 AND km < 100").collect()
    asked = [(i * 3 + d, r.a_lat, r.a_lon, (math.nextafter(r.km, 0), r.km, math.nextafter(r.km, 99))[d], r.poi_id) for i, r in enumerate(pairs[::13]) for d in range(3)]
    edge = spark.createDataFrame(asked, "case_id long, a_lat double, a_lon double, reach double, own long").coalesce(1)
    found = {r.case_id for r in geo.radius_join(edge, pois, "reach", cell_deg=0.05).where("own = poi_id").collect()}
    assert found == {c[0] for c in asked if c[0] % 3}


def test_small_files_are_the_work_of_many_tasks(spark):
    """One file a side, crowded into a few cells: the pairs come of many tasks of like size."""
    anchors, pois = frames(spark, 3000, 0.05, 6)
    met = geo.radius_join(anchors, pois, 1.5, cell_deg=None)
    rows = [r["n"] for r in met.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert len(rows) > 4 and max(rows) < sum(rows) / 3


def test_a_cell_with_many_pairs_is_split(spark):
    from trailweave.functions.numeric import balanced_join

    left = spark.range(400).selectExpr("id AS a", "id div 390 AS k")
    right = spark.range(300).selectExpr("id AS b", "id div 290 AS k")
    met = balanced_join(left, right, ["k"], ["a"], ["b"], most_pairs=2000)
    assert met.count() == met.distinct().count() == 390 * 290 + 10 * 10
    assert max(r["n"] for r in met.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()) < 390 * 290 / 4
