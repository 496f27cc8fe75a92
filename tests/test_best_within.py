"""The best POI within a radius, without rows for the pairs."""
import random

from pyspark.sql import functions as F

from trailweave.functions import geo


def test_best_within_equals_all_pairs(spark):
    """Few ratings, so that nearness and ids decide; half of all at one place, cells split; against the ranked rows of the radius join."""
    rng = random.Random(4)
    pts = [(i, 34.7 if i % 2 else rng.uniform(34.69, 34.71), 135.5 if i % 2 else rng.uniform(135.49, 135.51), float(rng.randint(0, 2)), rng.randint(0, 1)) for i in range(1500)]
    pois = spark.createDataFrame([*pts, (5000, None, 135.5, 9.0, 1)], "poi_id long, lat double, lon double, rating double, _v int")
    anchors = spark.createDataFrame([(i, la + 0.0003, lo) for i, la, lo, _, _ in pts[:300]] + [(900, 10.0, 10.0), (901, None, None)], "case_id long, a_lat double, a_lon double")
    near = geo.radius_join(anchors, pois, 0.3)
    want = near.groupBy("case_id").agg(F.max_by("poi_id", F.struct("_v", "rating", -F.round("distance_km", 9), -F.col("poi_id"))).alias("poi_id"))
    want = {r.case_id: r.poi_id for r in want.collect()}
    for most in (200_000, 40):
        got = [(r.case_id, r.poi_id) for r in geo.best_within(anchors, pois, 0.3, ["_v", "rating"], most).collect()]
        assert len(got) == len(want) >= 300 and dict(got) == want


def test_a_cell_gives_one_row_an_anchor():
    import pandas as pd

    anchors = pd.DataFrame({"case_id": [1, 2], "a_lat": [0.0, 0.001], "a_lon": [0.0, 0.0]})
    pois = pd.DataFrame({"poi_id": range(2000), "lat": 0.0, "lon": [(1999 - i) * 1e-6 for i in range(2000)], "rating": 1.0})
    got = geo.best_of_cell(anchors, pois, 5.0, ["rating"])
    assert got["case_id"].tolist() == [1, 2] and got["poi_id"].tolist()[0] == 1999
    assert geo.best_of_cell(anchors, pois.iloc[:0], 5.0, ["rating"]).empty
