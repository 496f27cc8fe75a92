"""Multi-variant requests: signals, variant weights, local routes, coverage and surprise."""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from trailweave.functions.geo import haversine_km, radius_join
from trailweave.functions.numeric import attach, draw, r9, top_per_group
from trailweave.operators.fusion import minmax_norm
from trailweave.operators.rerank import exp_decay, gauss
from trailweave.operators.routes import _stack, gather, km_from

VARIANTS = ["history", "inputs", "location", "full"]
# Preference order of the variant shown first.
VARIANT_ORDER = ["full", "history", "inputs", "location"]

# Fixed values per city: (start, largest, step) search radius in km; leg cap and target distance
# to the anchor in km, each (proximity first, normal). None is any other city.
RADIUS_PROFILES = {"Q35765": (1.8, 4.0, 0.40), "Q406": (1.8, 4.0, 0.40), "Q864965": (2.8, 6.0, 0.50), None: (2.0, 4.5, 0.40)}
LEG_CAPS = {"Q35765": (2.2, 3.0), "Q406": (2.2, 3.0), "Q864965": (3.2, 4.2), None: (2.6, 3.6)}
ANCHOR_TARGETS = {"Q35765": (1.0, 1.6), "Q406": (1.0, 1.6), "Q864965": (1.6, 2.4), None: (1.2, 1.9)}
PROXIMITY_RADIUS_FACTOR = 0.85
SIGMA = (0.85, 1.20)
BETA = (1.05, 0.80)


@dataclass(frozen=True)
class SurpriseParams:
    """Gate, filters, seed and the bounds of the short list."""

    rate: float = 0.03
    min_score_ratio: float = 0.35
    max_km: float = 3.0
    seed: int = 42
    shortest: int = 10
    longest: int = 40


def quality_prior(rows: DataFrame, keys: list[str]) -> DataFrame:
    """quality = 0.7 * rating share + 0.3 * share of rating counts within the group."""
    r, t = F.coalesce("rating", F.lit(0.0)), F.coalesce("total_ratings", F.lit(0)).cast("double")
    out = attach(rows, keys, F.max(r).alias("_r"), F.max(t).alias("_t"))
    share = lambda x, m: F.when(F.col(m) > 0, x / F.col(m)).otherwise(F.lit(0.0))
    return out.withColumn("quality", 0.7 * share(r, "_r") + 0.3 * share(t, "_t")).drop("_r", "_t")


def signals(requests: DataFrame, visits: DataFrame, prefs_table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests with history, inputs, location flags, requests without any signal)."""
    users = visits.select("user_id").distinct().withColumn("_u", F.lit(True))
    p = prefs_table.select("req_id", ((F.size("categories") > 0) | F.col("free_only").isNotNull() | F.col("max_price_tier").isNotNull()).alias("inputs"))
    rows = requests.join(users, "user_id", "left").join(p, "req_id", "left").select(
        *requests.columns, F.coalesce("_u", F.lit(False)).alias("history"), F.coalesce("inputs", F.lit(False)).alias("inputs"),
        (F.col("lat").isNotNull() & F.col("lon").isNotNull()).alias("location"))
    any_signal = F.col("history") | F.col("inputs") | F.col("location")
    return rows.where(any_signal), rows.where(~any_signal).select("req_id", F.lit("missing_input").alias("error"))


def _per_city(table: dict, city: Column, pick) -> Column:
    out = F.lit(pick(table[None]))
    for k, v in table.items():
        if k is not None:
            out = F.when(F.upper(F.trim(city)) == k, F.lit(pick(v))).otherwise(out)
    return out


def radius_profile(requests: DataFrame, city: str = "city_id") -> DataFrame:
    """Adds start_km, max_km, step_km, leg_cap_km, target_km, sigma and beta."""
    c, near = F.col(city), F.coalesce("proximity", F.lit(False))
    factor = F.when(near, PROXIMITY_RADIUS_FACTOR).otherwise(1.0)
    two = lambda t: F.when(near, _per_city(t, c, lambda v: v[0])).otherwise(_per_city(t, c, lambda v: v[1]))
    return requests.withColumns({
        "start_km": _per_city(RADIUS_PROFILES, c, lambda v: v[0]) * factor, "max_km": _per_city(RADIUS_PROFILES, c, lambda v: v[1]) * factor,
        "step_km": _per_city(RADIUS_PROFILES, c, lambda v: v[2]), "leg_cap_km": two(LEG_CAPS), "target_km": two(ANCHOR_TARGETS),
        "sigma": F.when(near, SIGMA[0]).otherwise(SIGMA[1]), "beta": F.when(near, BETA[0]).otherwise(BETA[1])})


def radius_expand(near: DataFrame, requests: DataFrame, target: Column) -> DataFrame:
    """(req_id, radius_km): first radius start, start + step, ..., max holding ``target`` POIs, else max.

    ``near`` is (req_id, distance_km) up to the largest radius; its rows are counted per ring first.
    """
    r = requests.select("req_id", "start_km", "max_km", "step_km", target.cast("long").alias("_target"))
    steps = F.ceil((F.col("max_km") - F.col("start_km")) / F.col("step_km") - 1e-9).cast("int")
    at = lambda i: F.least(F.col("max_km"), F.col("start_km") + i * F.col("step_km"))
    ring = F.when(F.col("distance_km") <= F.col("start_km"), 0).otherwise(F.ceil((F.col("distance_km") - F.col("start_km")) / F.col("step_km") - 1e-12)).cast("int")
    counts = near.select("req_id", "distance_km").join(r, "req_id").where(F.col("distance_km") <= F.col("max_km")).groupBy("req_id", ring.alias("i")).agg(F.count("*").alias("_n"))
    rings = r.select("req_id", F.explode(F.sequence(F.lit(0), steps)).alias("i"), "_target", "start_km", "max_km", "step_km")
    w = W.partitionBy("req_id").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    cum = rings.join(counts, ["req_id", "i"], "left").withColumn("_c", F.sum(F.coalesce("_n", F.lit(0))).over(w)).withColumn("_r", at(F.col("i")))
    return cum.groupBy("req_id").agg(F.coalesce(F.min(F.when(F.col("_c") >= F.col("_target"), F.col("_r"))), F.max("_r")).alias("radius_km"))


def gated_pois(requests: DataFrame, pois: DataFrame, target: Column, widest_km: float = 6.0) -> DataFrame:
    """POIs within the expanded radius of each located request, with the request's profile columns.

    ``requests`` carries the columns of ``radius_profile``; ``widest_km`` is the largest radius of any profile.
    """
    anchors = requests.withColumnsRenamed({"lat": "a_lat", "lon": "a_lon"})
    usable = pois.dropna(subset=["name", "primary_category", "lat", "lon"]).select("poi_id", "lat", "lon", "primary_category", "rating", "total_ratings")
    near = radius_join(anchors, usable, "max_km", "distance_km", cell_deg=widest_km / 111.0 / 2)
    radius = radius_expand(near, requests, target)
    return near.join(radius, "req_id").where(F.col("distance_km") <= F.col("radius_km"))


def local_scores(gated: DataFrame, model: DataFrame) -> DataFrame:
    """Adds geo, model, quality and local = 0.40 geo + 0.45 model + 0.15 quality.

    ``model`` is (req_id, poi_id, score), min-max scaled per request here; POIs outside it get 0.
    """
    scaled = minmax_norm(model, ["req_id"], "score", "model").select("req_id", "poi_id", "model")
    rows = quality_prior(gated.join(scaled, ["req_id", "poi_id"], "left").fillna(0.0, ["model"]), ["req_id"])
    rows = rows.withColumn("geo", gauss(F.col("distance_km"), F.col("target_km"), F.col("sigma")))
    return rows.withColumn("local", r9(0.40 * F.col("geo") + 0.45 * F.col("model") + 0.15 * F.col("quality")))


def _walk(rows: DataFrame, columns: list[str], once: list[str], pick) -> DataFrame:
    """(req_id, pick, poi_id) of a step-by-step choice per request, over rows sorted by id."""
    packed = gather(rows, ["req_id"], "poi_id", [c for c in columns if c != "poi_id"], once)
    ids = rows.groupBy("req_id").agg(F.array_sort(F.collect_list("poi_id")).alias("poi_id"))

    def choose(batches):
        for pdf in batches:
            parts = []
            for row in pdf.itertuples(index=False):
                a = {c: np.asarray(getattr(row, c)) for c in columns}
                chosen = pick(a, row)
                parts.append({"req_id": [row.req_id] * len(chosen), "pick": range(1, len(chosen) + 1), "poi_id": a["poi_id"][chosen]})
            yield _stack(parts, ["req_id", "pick", "poi_id"])

    return packed.join(ids, "req_id").mapInPandas(choose, "req_id long, pick long, poi_id long")


def _local_pick(a, row) -> list[int]:
    lat, lon = a["lat"].astype(float), a["lon"].astype(float)
    cat = np.char.lower(np.char.strip(a["primary_category"].astype(str)))
    base = 0.35 * a["geo"].astype(float) + 0.45 * a["model"].astype(float)
    free = np.ones(len(lat), dtype=bool)
    chosen = [int(np.argmax(a["local"].astype(float)))]
    free[chosen[0]] = False
    while len(chosen) < int(row.k):
        last = chosen[-1]
        leg = km_from(lat[last], lon[last], lat, lon)
        ok = free & (leg <= row.leg_cap_km)
        if not ok.any():
            break
        total = np.round(base + 0.20 * np.exp(-row.beta * leg) + np.where(cat != cat[last], 0.05, 0.0), 9)
        nxt = int(np.argmax(np.where(ok, total, -np.inf)))
        chosen.append(nxt)
        free[nxt] = False
    return chosen


def variant_location(scored: DataFrame) -> DataFrame:
    """(req_id, rank, poi_id, score, distance_km): greedy local route, filled by local score, sorted by it.

    ``scored`` comes from ``local_scores``; the candidates of a request are those in its radius.
    """
    cols = ["poi_id", "lat", "lon", "primary_category", "geo", "model", "local"]
    picks = _walk(scored.select("req_id", *cols, "k", "leg_cap_km", "beta"), cols, ["k", "leg_cap_km", "beta"], _local_pick)
    rows = scored.join(picks, ["req_id", "poi_id"], "left")
    first = [F.col("pick").isNull(), F.col("pick"), F.col("local").desc(), r9("distance_km"), F.col("poi_id")]
    kept = top_per_group(rows.select("req_id", "poi_id", "local", "distance_km", "pick", "k"), ["req_id"], first, "k", "_o")
    final = [F.col("local").desc(), r9("distance_km"), F.col("poi_id")]
    return top_per_group(kept, ["req_id"], final, "k").select("req_id", "rank", "poi_id", F.col("local").alias("score"), "distance_km")


# Fixed values of the older, nearest-first local route.
NEAREST = {"decay": 3.2, "anchor_scale": 1.4, "leg_target": 1.4, "leg_sigma": 0.95, "edge": 0.85, "edge_factor": 0.70, "hop_km": 1.2, "hop_factor": 0.20}


def _nearest_pick(a, row) -> list[int]:
    lat, lon, d = a["lat"].astype(float), a["lon"].astype(float), a["distance_km"].astype(float)
    cat = np.char.lower(np.char.strip(a["primary_category"].astype(str)))
    m, n = a["score"].astype(float), NEAREST
    near = 1.0 / (1.0 + d / n["anchor_scale"])
    free = np.ones(len(lat), dtype=bool)
    chosen = [int(np.argmax(np.round(0.05 * m + 0.95 * near, 9)))]
    free[chosen[0]] = False
    while len(chosen) < int(row.k) and free.any():
        last = chosen[-1]
        leg = km_from(lat[last], lon[last], lat, lon)
        fit = np.exp(-((leg - n["leg_target"]) ** 2) / (2 * n["leg_sigma"] ** 2))
        fit = fit * np.where(leg < 0.25, 0.15, np.where(leg < 0.45, 0.55, 1.0)) * np.where(leg > 5.5, 0.5, 1.0)
        total = 0.05 * m + 0.85 * near + 0.10 * fit + np.where((cat != "") & (cat != cat[last]), 0.05, 0.0)
        total = total * np.where(d > n["edge"] * row.radius_km, n["edge_factor"], 1.0) * np.where(leg > n["hop_km"], n["hop_factor"], 1.0)
        nxt = int(np.argmax(np.where(free, np.round(total, 9), -np.inf)))
        chosen.append(nxt)
        free[nxt] = False
    return chosen


def trim_location_nearest(gated: DataFrame, model: DataFrame) -> DataFrame:
    """(req_id, rank, poi_id, score, distance_km): the older local route, nearest stops first.

    ``gated`` holds the candidates within the radius reached with target k; the score is the
    scaled model score faded by distance.
    """
    rows = minmax_norm(gated.join(model.select("req_id", "poi_id", F.col("score").alias("_m")), ["req_id", "poi_id"]), ["req_id"], "_m", "_n")
    rows = rows.withColumn("score", F.col("_n") * exp_decay(F.col("distance_km"), F.lit(NEAREST["decay"])))
    cols = ["poi_id", "lat", "lon", "primary_category", "distance_km", "score"]
    picks = _walk(rows.select("req_id", *cols, "k", "radius_km"), cols, ["k", "radius_km"], _nearest_pick)
    kept = rows.join(picks, ["req_id", "poi_id"])
    return top_per_group(kept, ["req_id"], [r9("distance_km"), r9("score").desc(), F.col("poi_id")], "k").select("req_id", "rank", "poi_id", r9("score").alias("score"), "distance_km")


def trim_coverage(rows: DataFrame, wanted: DataFrame, poi_intent: DataFrame) -> DataFrame:
    """(req_id, rank, poi_id, score): best POI per requested intent first, then by score, k in all.

    ``rows`` is (req_id, poi_id, score, strict, k) after removing duplicates, ``wanted`` is
    (req_id, word, pos, is_intent): requested intents, or the lower-case tokens of requests whose
    tokens have no intent. Requests asking for more than k words keep their given order.
    """
    words = wanted.groupBy("req_id").agg(F.count("*").alias("_w"))
    base = rows.join(words, "req_id", "left").fillna(0, ["_w"])
    plain = F.col("_w").between(1, F.col("k"))
    order = [F.col("score").desc(), F.col("poi_id")]
    named = base.where(plain).join(poi_intent, "poi_id")
    hits = named.join(wanted, "req_id").where(
        F.when(F.col("is_intent"), F.col("intent") == F.col("word")).otherwise(F.contains(F.lower("primary_category"), F.col("word"))))
    # the i-th word needs at most i rows to find one that earlier words have not taken
    best = top_per_group(hits.select("req_id", "pos", "poi_id", "score", "_w"), ["req_id", "pos"], order, "_w", "_r")
    lists = best.groupBy("req_id", "pos").agg(F.array_sort(F.collect_list(F.struct("_r", "poi_id"))).alias("_c"))
    per_req = lists.groupBy("req_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("_c.poi_id").alias("ids")))).alias("_l"))
    chosen = F.aggregate("_l", F.array().cast("array<bigint>"), lambda acc, x: F.concat(acc, F.slice(F.array_except(x["ids"], acc), 1, 1)))
    picked = per_req.select("req_id", F.posexplode(chosen).alias("_pick", "poi_id"))
    ranked = base.join(picked, ["req_id", "poi_id"], "left")
    first = F.when(plain, F.coalesce("_pick", F.lit(1 << 20))).otherwise(F.when(F.col("strict"), 0).otherwise(1))
    final = top_per_group(ranked.withColumn("_f", first), ["req_id"], [F.col("_f"), *order], "k")
    return final.select("req_id", "rank", "poi_id", "score")


def variant_weights(sig: DataFrame) -> DataFrame:
    """(req_id, variant, weight) for the blend, by the signals present."""
    h, i, l = F.col("history"), F.col("inputs"), F.col("location")
    near = F.coalesce("proximity", F.lit(False))
    hist = F.when(i & l, 0.45).otherwise(0.65) * F.when(near & l, 0.85).otherwise(1.0)
    inp = F.when(h & l, 0.35).otherwise(0.55) * F.when(near & l, 0.9).otherwise(1.0)
    loc = F.when(h & i, 0.10).otherwise(0.20) * F.when(near, 1.20).otherwise(1.0)
    cells = F.array(*[F.struct(F.lit(n).alias("variant"), F.when(s, w).alias("weight")) for n, s, w in (("history", h, hist), ("inputs", i, inp), ("location", l, loc))])
    return sig.select("req_id", F.explode(cells).alias("x")).select("req_id", "x.variant", "x.weight").where("weight IS NOT NULL")


def full_pool_size(k: Column) -> Column:
    return F.greatest(k, F.least(F.lit(400), F.greatest(k * 8, k + 80))).cast("int")


def soft_surprise(route: DataFrame, pool: DataFrame, requests: DataFrame, wanted: DataFrame, poi_intent: DataFrame, p: SurpriseParams | None = None) -> DataFrame:
    """(req_id, rank, poi_id, score, is_surprise): route with, at a seeded chance, a near pool POI as last stop.

    ``route`` and ``pool`` are (req_id, poi_id, score, [rank]) with lat/lon; ``wanted`` is
    (req_id, intent) from preferences, else the intents of the route are the target.
    """
    p = p or SurpriseParams()
    gate = requests.where(draw(p.seed, F.lit("surprise"), F.col("req_id")) < F.lit(int(p.rate * (1 << 32)))).select("req_id", F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"))
    center = route.groupBy("req_id").agg(F.avg("lat").alias("_clat"), F.avg("lon").alias("_clon"), F.max("rank").alias("_last"))
    gate = gate.join(center, "req_id").select("req_id", F.coalesce("a_lat", "_clat").alias("r_lat"), F.coalesce("a_lon", "_clon").alias("r_lon"), "_last")
    rows = pool.where("lat IS NOT NULL AND lon IS NOT NULL").join(route.select("req_id", "poi_id"), ["req_id", "poi_id"], "left_anti").join(gate, "req_id")
    rows = attach(rows.withColumn("score", F.coalesce("score", F.lit(0.0))), ["req_id"], F.max("score").alias("_smax"))
    rows = rows.where((F.col("_smax") <= 0) | (F.col("score") >= p.min_score_ratio * F.col("_smax")))
    rows = rows.withColumn("_d", F.coalesce(haversine_km(F.col("r_lat"), F.col("r_lon"), F.col("lat"), F.col("lon")), F.lit(0.0))).where(F.col("_d") <= p.max_km)
    asked = wanted.select("req_id", "intent").distinct()
    own = route.join(poi_intent, "poi_id").where("intent <> 'inconclusive'").select("req_id", "intent").distinct().join(asked.select("req_id").distinct(), "req_id", "left_anti")
    target = asked.unionByName(own).withColumn("_m", F.lit(1.0))
    rows = rows.join(poi_intent, "poi_id").join(target, ["req_id", "intent"], "left")
    rows = attach(rows, ["req_id"], F.min("score").alias("_lo"), F.max("score").alias("_hi"), F.max("_d").alias("_dmax"), F.count("*").alias("_n"))
    s = F.when(F.col("_hi") - F.col("_lo") <= 1e-12, 0.0).otherwise((F.col("score") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    near = F.when(F.col("_dmax") <= 1e-12, 1.0).otherwise(1.0 - F.col("_d") / F.col("_dmax"))
    rows = rows.withColumn("_soft", r9(0.55 * s + 0.30 * near + 0.15 * F.coalesce("_m", F.lit(0.0))))
    short = F.least("_n", F.greatest(F.lit(p.shortest), F.least(F.lit(p.longest), F.col("_n"))))
    ranked = top_per_group(rows.withColumn("_short", short), ["req_id"], [F.col("_soft").desc(), F.col("poi_id")], "_short", "_r")
    chosen = ranked.where(F.col("_r") == F.pmod(draw(p.seed, F.lit("pick"), F.col("req_id")), F.col("_short")) + 1)
    swap = chosen.select("req_id", F.col("_last").alias("rank"), F.col("poi_id").alias("_new"), F.col("score").alias("_new_score"))
    out = route.select("req_id", "rank", "poi_id", "score").join(swap, ["req_id", "rank"], "left")
    return out.select("req_id", "rank", F.coalesce("_new", "poi_id").alias("poi_id"), F.coalesce("_new_score", "score").alias("score"), F.col("_new").isNotNull().alias("is_surprise"))


def omitted_variants(sig: DataFrame, routes: DataFrame) -> DataFrame:
    """(req_id, variant, reason) for variants without a route."""
    have = routes.select("req_id", "variant").distinct().withColumn("_ok", F.lit(True))
    present = {"history": F.col("history"), "inputs": F.col("inputs"), "location": F.col("location"), "full": F.lit(True)}
    reason = {"history": "user_without_history", "inputs": "missing_inputs", "location": "missing_location", "full": "empty_result"}
    cells = F.array(*[F.struct(F.lit(v).alias("variant"), present[v].alias("present"), F.lit(reason[v]).alias("why")) for v in VARIANTS])
    rows = sig.select("req_id", F.explode(cells).alias("x")).select("req_id", "x.variant", "x.present", "x.why").join(have, ["req_id", "variant"], "left")
    return rows.where("_ok IS NULL").select("req_id", "variant", F.when(F.col("present"), "empty_result").otherwise(F.col("why")).alias("reason"))


def route_warnings(sig: DataFrame, routes: DataFrame) -> DataFrame:
    """(req_id, warning)."""
    surprised = routes.where("is_surprise").select("req_id").distinct().select("req_id", F.lit("soft_surprise_injected:full").alias("warning"))
    none = sig.select("req_id").join(routes.select("req_id").distinct(), "req_id", "left_anti").select("req_id", F.lit("no_routes_generated").alias("warning"))
    return surprised.unionByName(none)


def primary_variant(routes: DataFrame, sig: DataFrame) -> DataFrame:
    """(req_id, variant): location when proximity is preferred and present, else by fixed order."""
    place = F.array_position(F.array(*[F.lit(v) for v in VARIANT_ORDER]), F.col("variant"))
    rows = routes.select("req_id", "variant").distinct().join(sig.select("req_id", F.coalesce("proximity", F.lit(False)).alias("_p")), "req_id")
    rank = F.when(F.col("_p") & (F.col("variant") == "location"), 0).otherwise(place)
    return rows.groupBy("req_id").agg(F.min_by("variant", rank).alias("variant"))
