"""Geodesic column expressions and grid-cell helpers."""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from trailweave.functions.numeric import MOST_ROWS, balanced_join, r9, top_per_group

# Earth radius (km) and the Web-Mercator half circumference (m).
EARTH_RADIUS_KM = 6371.0
MERCATOR_HALF_M = 20037508.34

KM_PER_DEGREE = 111.0
# Straight lines, on a globe of radius one, that rounding may put on either side of a radius differ from it by less.
EDGE = 1e-12
# Distances are ranked after rounding to nine digits, so those this close may be ties.
TIE_KM = 2e-9


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance, arcsine form, argument clamped to 1; null where a coordinate is."""
    half_dlat = F.radians(lat2 - lat1) / 2
    half_dlon = F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(half_dlat), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_dlon), F.lit(2.0))
    return F.when(a.isNotNull(), F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(a))))


def haversine_km_atan2(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """The same distance in arctangent form."""
    half_dlat = F.radians(lat2 - lat1) / 2
    half_dlon = F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(half_dlat), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_dlon), F.lit(2.0))
    return F.lit(2 * EARTH_RADIUS_KM) * F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(0.0), 1 - a)))


def mercator_x(lon: Column) -> Column:
    return lon * F.lit(MERCATOR_HALF_M) / 180


def mercator_y(lat: Column) -> Column:
    from math import pi

    return F.log(F.tan((90 + lat) * F.lit(pi) / 360)) / F.lit(pi / 180) * F.lit(MERCATOR_HALF_M) / 180


def valid_latlon(lat: Column, lon: Column) -> Column:
    la, lo = lat.try_cast("double"), lon.try_cast("double")
    return F.coalesce(la.between(-90, 90) & lo.between(-180, 180), F.lit(False))


def radius_join(
    anchors: DataFrame, pois: DataFrame, radius_km: float | str, out: str = "distance_km",
    cell_deg: float | None = None, most: int = MOST_ROWS,
) -> DataFrame:
    """Pairs (anchor, POI) within a radius, by an equi-join on grid cells and a distance check.

    ``radius_km`` is a number, or the name of an anchor column holding it (then ``cell_deg``
    is required). ``anchors`` has ``a_lat``/``a_lon``; ``pois`` has ``lat``/``lon``. Each anchor
    is expanded to the cells its radius touches, so no anchor meets a POI outside them.
    Anchors across the 180th meridian or at the poles are widened to all longitudes. A cell with more than ``most``
    anchors or POIs is split into parts, so that a crowded place is the work of several tasks.
    """
    wide, located = in_cells(anchors, pois, radius_km, cell_deg)
    distance = haversine_km(F.col("a_lat"), F.col("a_lon"), F.col("lat"), F.col("lon"))
    radius = F.col(radius_km) if isinstance(radius_km, str) else F.lit(float(radius_km))
    # the straight line through the globe tells all but pairs at the very edge without a sine for each pair
    line = 2 * F.sin(F.least(radius / (2 * EARTH_RADIUS_KM), F.lit(math.pi / 2)))
    wide = wide.withColumns({**_on_globe("_a", "a_lat", "a_lon"), "_far": (line + EDGE) * (line + EDGE), "_near": F.when(line > EDGE, (line - EDGE) * (line - EDGE)).otherwise(F.lit(-1.0))})
    met = balanced_join(wide, located.withColumns(_on_globe("_p", "lat", "lon")), ["_cy", "_cx"], anchors.columns, pois.columns, most)
    apart = sum((F.col(f"_a{i}") - F.col(f"_p{i}")) * (F.col(f"_a{i}") - F.col(f"_p{i}")) for i in "xyz")
    within = met.where((apart <= F.col("_far")) & ((apart <= F.col("_near")) | (distance <= radius)))
    return within.withColumn(out, distance).drop("_cy", "_cx", "_far", "_near", *[f"_{side}{i}" for side in "ap" for i in "xyz"])


def _on_globe(name: str, lat: str, lon: str) -> dict[str, Column]:
    """Place on a globe of radius one as three columns."""
    la, lo = F.radians(lat), F.radians(lon)
    return {f"{name}x": F.cos(la) * F.cos(lo), f"{name}y": F.cos(la) * F.sin(lo), f"{name}z": F.sin(la)}


def in_cells(anchors: DataFrame, pois: DataFrame, radius_km: float | str, cell_deg: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Anchors once for each grid cell (_cy, _cx) that their radius touches, and POIs with the cell they are in; rows without coordinates are left out."""
    radius = F.col(radius_km) if isinstance(radius_km, str) else F.lit(float(radius_km))
    cell = cell_deg or max(float(radius_km) / KM_PER_DEGREE, 1e-4)
    dlat = radius / KM_PER_DEGREE
    cosine = F.greatest(F.cos(F.radians(F.least(F.lit(89.9), F.abs(F.col("a_lat")) + dlat))), F.lit(1e-3))
    dlon = F.least(F.lit(180.0), radius / (KM_PER_DEGREE * cosine))
    n_lon = int(360.0 / cell) + 1

    def span(center, delta):
        return F.sequence(F.floor((center - delta) / cell).cast("long"), F.floor((center + delta) / cell).cast("long"))

    shifted = F.col("a_lon") + 180.0
    wide = anchors.where(F.col("a_lat").isNotNull() & F.col("a_lon").isNotNull() & radius.isNotNull() & (radius >= 0))
    wide = wide.withColumn("_cy", F.explode(span(F.col("a_lat"), dlat)))
    # cells are numbered eastwards from -180; both ends of the seam cell belong to either side
    wrapped = F.array_distinct(F.flatten(F.transform(
        span(shifted, dlon),
        lambda x: F.when(x < 0, F.array(x + n_lon, x + n_lon - 1)).when(x >= n_lon - 1, F.array(x, F.pmod(x - n_lon + 1, F.lit(n_lon)), F.pmod(x - n_lon, F.lit(n_lon))))
        .otherwise(F.array(x)))))
    wide = wide.withColumn("_cx", F.explode(wrapped))
    located = pois.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).withColumns({
        "_cy": F.floor(F.col("lat") / cell).cast("long"),
        "_cx": F.floor((F.col("lon") + 180.0) / cell).cast("long"),
    })
    return wide, located


def km_between(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    """``haversine_km`` of arrays."""
    a = np.sin((np.radians(lat2) - np.radians(lat1)) / 2) ** 2 + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * np.sin((np.radians(lon2) - np.radians(lon1)) / 2) ** 2
    return 2 * EARTH_RADIUS_KM * np.arcsin(np.minimum(1.0, np.sqrt(a)))


def best_of_cell(anchors: pd.DataFrame, pois: pd.DataFrame, radius_km: float, order: list[str], step: int = 256) -> pd.DataFrame:
    """Each anchor's best POI of one cell, with those as near but for rounding. POIs are met from the best down, an anchor is done after the rank in which it found one."""
    pois = pois.sort_values([*order, "poi_id"], ascending=[*[False] * len(order), True], kind="stable")
    lat, lon = (pois[c].to_numpy() for c in ("lat", "lon"))
    values = pois[order].to_numpy(float)
    rank = np.cumsum(np.concatenate([[0], (values[1:] != values[:-1]).any(axis=1)])) if len(pois) else np.zeros(0, int)
    a_lat, a_lon = anchors["a_lat"].to_numpy(), anchors["a_lon"].to_numpy()
    best, near, tied = np.full(len(anchors), -1), np.full(len(anchors), np.inf), []
    for at in range(0, len(pois), step):
        left = np.flatnonzero((best < 0) | (best == rank[at]))
        if not len(left):
            break
        for few in np.array_split(left, -(-len(left) // 4096)):
            km = km_between(a_lat[few, None], a_lon[few, None], lat[None, at:at + step], lon[None, at:at + step])
            place = np.where(km <= radius_km, rank[at:at + step], len(rank))
            top = place.min(axis=1)
            few, km, place, top = (v[top < len(rank)] for v in (few, km, place, top))
            few, km, place, top = (v[(best[few] < 0) | (best[few] == top)] for v in (few, km, place, top))
            km = np.where(place == top[:, None], km, np.inf)
            best[few], near[few] = top, np.minimum(near[few], km.min(axis=1, initial=np.inf))
            x, y = np.nonzero(km <= near[few, None] + TIE_KM)
            tied.append((few[x], at + y, km[x, y]))
    a, p, km = (np.concatenate(v) for v in zip(*tied)) if tied else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    a, p = (v[km <= near[a] + TIE_KM] for v in (a, p))
    return pd.concat([anchors.iloc[a][["case_id", "a_lat", "a_lon"]].reset_index(drop=True), pois.iloc[p][["poi_id", "lat", "lon", *order]].reset_index(drop=True)], axis=1)


def best_within(anchors: DataFrame, pois: DataFrame, radius_km: float, order: list[str], most: int = MOST_ROWS) -> DataFrame:
    """(case_id, poi_id): of the POIs within the radius the one with the largest ``order`` columns, then the nearest, then the smallest id.

    No pair of anchor and POI leaves the task that meets them: a cell gives each anchor its best and what ties with it. Cells with more than ``most`` anchors or POIs are split.
    """
    wide, located = in_cells(anchors.select("case_id", "a_lat", "a_lon"), pois.select("poi_id", "lat", "lon", *order), radius_km)
    keys = ["_cy", "_cx"]

    def counts(df: DataFrame, out: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.ceil(F.count("*") / most).cast("int").alias(out)).where(F.col(out) > 1)

    hot = F.broadcast(counts(wide, "_a").join(counts(located, "_p"), keys, "full").fillna(1))
    part = lambda df, own, ids: F.pmod(F.xxhash64(*ids), F.coalesce(own, F.lit(1))).cast("int")
    copy = lambda other: F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))
    a = wide.join(hot, keys, "left").withColumn("_ap", part(wide, F.col("_a"), ["case_id", "a_lat", "a_lon"])).withColumn("_pp", copy(F.col("_p"))).drop("_a", "_p")
    p = located.join(hot, keys, "left").withColumn("_pp", part(located, F.col("_p"), ["poi_id"])).withColumn("_ap", copy(F.col("_a"))).drop("_a", "_p")
    keys = [*keys, "_ap", "_pp"]
    schema = "case_id long, a_lat double, a_lon double, poi_id long, lat double, lon double, " + ", ".join(f"{c} double" for c in order)
    cells = a.groupBy(*keys).cogroup(p.groupBy(*keys)).applyInPandas(lambda x, y: best_of_cell(x, y, radius_km, order), schema)
    near = cells.withColumn("_km", r9(haversine_km(F.col("a_lat"), F.col("a_lon"), F.col("lat"), F.col("lon"))))
    return top_per_group(near, ["case_id"], [*[F.col(c).desc() for c in order], F.col("_km"), F.col("poi_id")], 1).select("case_id", "poi_id")
