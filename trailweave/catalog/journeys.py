"""Queries: route selection, ordering and metrics, and multi-variant requests."""
from __future__ import annotations

from pyspark.sql import functions as F

from trailweave.catalog.oracle_views import add_view
from trailweave.catalog.registry import query
from trailweave.functions.numeric import r6
from trailweave.operators import features, routes
from trailweave.operators import transitions as tr

P = routes.PlannerParams()


def hav(alat, alon, blat, blon):
    return f"CASE WHEN {alat} + {alon} + {blat} + {blon} IS NOT NULL THEN 2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians({blat} - {alat}) / 2), 2) + cos(radians({alat})) * cos(radians({blat})) * pow(sin(radians({blon} - {alon}) / 2), 2)))) END"


def greedy_sql(pool, anchored, k="k", p=P):
    """Check SQL of the greedy planner: a recursive query whose state holds the remaining candidates as a list.

    ``pool`` yields case_id, k, a_lat, a_lon, poi_id, score, lat, lon, cat, rk.
    """
    w, m = p.effective(anchored)
    d = hav("r.la", "r.lo", "s.lat", "s.lon")
    graded = f"""list_transform(r.rest, lambda s: {{'bad': CASE WHEN s.n >= {p.max_per_category} THEN 9 WHEN s.d >= {p.pair_min_km} AND s.d >= {p.min_leg_km} AND s.d <= {m} THEN 0
      WHEN {'r.step = 0 OR ' if anchored else ''}s.d >= {p.pair_min_km} THEN 1 ELSE 9 END, 'nu': -round(s.score - {w} * s.d + CASE WHEN s.n = 0 THEN {p.diversity_bonus} ELSE 0 END, 9), 'rk': s.rk}})"""
    measured = f"list_transform(r.rest0, lambda s: {{'poi_id': s.poi_id, 'score': s.score, 'lat': s.lat, 'lon': s.lon, 'cat': s.cat, 'rk': s.rk, 'd': {d}, 'n': len(list_filter(r.cats, lambda c: c = s.cat))}})"
    start = ("SELECT case_id, any_value(k) AS k, 0 AS step, CAST(NULL AS BIGINT) AS poi_id, CAST(NULL AS DOUBLE) AS leg, any_value(a_lat) AS la, any_value(a_lon) AS lo, CAST([] AS VARCHAR[]) AS cats, "
             "list({'poi_id': poi_id, 'score': score, 'lat': lat, 'lon': lon, 'cat': cat, 'rk': rk} ORDER BY rk) AS rest0 FROM pool GROUP BY case_id") if anchored else (
        "SELECT case_id, any_value(k) AS k, 1 AS step, arg_min(poi_id, rk) AS poi_id, CAST(NULL AS DOUBLE) AS leg, arg_min(lat, rk) AS la, arg_min(lon, rk) AS lo, [CAST(arg_min(cat, rk) AS VARCHAR)] AS cats, "
        "COALESCE(list({'poi_id': poi_id, 'score': score, 'lat': lat, 'lon': lon, 'cat': cat, 'rk': rk} ORDER BY rk) FILTER (WHERE rk > 1), []) AS rest0 FROM pool GROUP BY case_id")
    return f"""
WITH RECURSIVE pool AS ({pool}), walk AS ({start}
 UNION ALL SELECT case_id, k, step + 1, hit.poi_id, hit.d, hit.lat, hit.lon, list_append(cats, hit.cat), list_filter(rest0, lambda s: s.rk <> hit.rk)
 FROM (SELECT r.*, list_filter(r.rest, lambda s: s.rk = r.best.rk)[1] AS hit FROM (SELECT r.*, list_sort({graded})[1] AS best FROM (SELECT r.*, {measured} AS rest FROM walk r WHERE r.step < r.k AND len(r.rest0) > 0) r) r WHERE r.best.bad < 9) x)
SELECT case_id, CAST(step AS BIGINT) AS step, poi_id, round(leg, 6) AS leg_km FROM walk WHERE poi_id IS NOT NULL"""


add_view("v_pool_near", """
SELECT n.case_id, r.k, r.lat AS a_lat, r.lon AS a_lon, n.poi_id, n.score / 10.0 AS score, p.lat, p.lon, p.primary_category AS cat, row_number() OVER (PARTITION BY n.case_id ORDER BY n.score DESC, n.poi_id) AS rk
FROM v_near_req n JOIN v_requests r ON r.req_id = n.case_id JOIN v_pois p ON p.poi_id = n.poi_id""")
add_view("v_pool_user", """
SELECT u.user_id AS case_id, 6 AS k, NULL AS a_lat, NULL AS a_lon, u.poi_id, CAST(u.n AS DOUBLE) + p.rating / 10.0 AS score, p.lat, p.lon, p.primary_category AS cat, row_number() OVER (PARTITION BY u.user_id ORDER BY CAST(u.n AS DOUBLE) + p.rating / 10.0 DESC, u.poi_id) AS rk
FROM (SELECT user_id, poi_id, count(*) AS n FROM v_visits GROUP BY 1, 2) u JOIN v_pois p ON p.poi_id = u.poi_id WHERE p.lat IS NOT NULL AND p.rating IS NOT NULL""")


def near_plans(t):
    """Routes of all requests with a place, over the POIs within 2 km scored by rating."""
    reqs = t.requests.select(F.col("req_id").alias("case_id"), "k", F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"))
    score = F.coalesce("rating", F.lit(0.0)) / 10.0
    return routes.plan_near(reqs, t.pois.select("poi_id", "lat", "lon", "primary_category", score.alias("score")), 2.0, P)


def user_pool(t):
    rows = features.interactions(t.visits).join(t.pois.where("lat IS NOT NULL AND rating IS NOT NULL"), "poi_id")
    return rows.select(F.col("user_id").alias("case_id"), "poi_id", (F.col("n").cast("double") + F.col("rating") / 10.0).alias("score"), "lat", "lon", "primary_category", F.lit(6).alias("k"))


@query("plan_route", greedy_sql("SELECT * FROM v_pool_near", True))
def plan_route(t):
    return near_plans(t).select("case_id", "step", "poi_id", r6("leg_km").alias("leg_km"))


@query("plan_route_no_anchor", greedy_sql("SELECT * FROM v_pool_user", False))
def plan_route_no_anchor(t):
    return routes.plan_route(user_pool(t), P).select("case_id", "step", "poi_id", r6("leg_km").alias("leg_km"))


def stops(t):
    return tr.trail_positions(tr.located_visits(t.visits, t.pois), "step").select("trail_id", "user_id", "step", "poi_id", "lat", "lon")


_NN = f"""
WITH RECURSIVE walk AS (SELECT trail_id, 1 AS step, arg_min(poi_id, step) AS poi_id, CAST(0 AS DOUBLE) AS leg, arg_min(lat, step) AS la, arg_min(lon, step) AS lo,
  COALESCE(list({{'i': step, 'poi_id': poi_id, 'lat': lat, 'lon': lon}} ORDER BY step) FILTER (WHERE step > 1), []) AS rest FROM v_located GROUP BY trail_id
 UNION ALL SELECT trail_id, step + 1, hit.poi_id, hit.d, hit.lat, hit.lon, list_filter(rest, lambda s: s.i <> hit.i) FROM
  (SELECT r.*, list_sort(list_transform(r.rest, lambda s: {{'rd': round({hav('r.la', 'r.lo', 's.lat', 's.lon')}, 9), 'i': s.i, 'poi_id': s.poi_id, 'lat': s.lat, 'lon': s.lon, 'd': {hav('r.la', 'r.lo', 's.lat', 's.lon')}}}))[1] AS hit FROM walk r WHERE len(r.rest) > 0))
SELECT trail_id, CAST(step AS BIGINT) AS step, poi_id, round(sum(leg) OVER (PARTITION BY trail_id), 6) AS total_km FROM walk"""


@query("nn_order", _NN)
def nn_order(t):
    return routes.nn_order(stops(t), ["trail_id"]).withColumn("total_km", r6("total_km"))


def two_opt_sql(paths, key, first):
    """Check SQL of open-path 2-opt: a recursive query that reverses the first stretch of each path that shortens it, until none does.

    ``paths`` yields the key and ``path``, a list of {poi_id, lat, lon}; ``first`` is 1 where the path's start is fixed.
    """
    at = lambda x: f"w.path[{x} + 1]"
    d = lambda a, b: hav(f"{at(a)}.lat", f"{at(a)}.lon", f"{at(b)}.lat", f"{at(b)}.lon")
    shorter = f"""(CASE WHEN x.i > 0 THEN {d('x.i - 1', 'x.j')} ELSE 0 END) + {d('x.i', 'x.j + 1')} + 1e-9 < (CASE WHEN x.i > 0 THEN {d('x.i - 1', 'x.i')} ELSE 0 END) + {d('x.j', 'x.j + 1')}"""
    return f"""
w AS (SELECT {key}, 0 AS pass, path FROM ({paths}) UNION ALL SELECT {key}, pass + 1, list_concat(list_concat(path[1:hit.i], list_reverse(path[hit.i + 1:hit.j + 1])), path[hit.j + 2:]) FROM
 (SELECT w.*, list_filter(list_transform(range(0, len(w.path) * len(w.path)), lambda q: {{'i': q // len(w.path), 'j': q % len(w.path)}}),
   lambda x: x.i >= {first} AND x.j > x.i AND x.i <= len(w.path) - 3 AND x.j <= len(w.path) - 2 AND {shorter})[1] AS hit FROM w WHERE pass < 80 AND len(path) >= 4) w WHERE hit IS NOT NULL),
done AS (SELECT {key}, arg_max(path, pass) AS path FROM w GROUP BY 1),
spread AS (SELECT {key}, unnest(range(1, len(path) + 1)) AS step, unnest(path) AS s FROM done),
legs AS (SELECT {key}, step, s.poi_id AS poi_id, {hav('lag(s.lat) OVER o', 'lag(s.lon) OVER o', 's.lat', 's.lon')} AS leg, step = 1 AS starts FROM spread WINDOW o AS (PARTITION BY {key} ORDER BY step))"""


@query("two_opt", f"""
WITH RECURSIVE {two_opt_sql("SELECT trail_id, list({'poi_id': poi_id, 'lat': lat, 'lon': lon} ORDER BY step) AS path FROM v_located GROUP BY 1", "trail_id", 0)}
SELECT trail_id, CAST(step AS BIGINT) AS step, poi_id, round(sum(CASE WHEN starts THEN 0 ELSE leg END) OVER (PARTITION BY trail_id), 6) AS total_km FROM legs""")
def two_opt(t):
    return routes.two_opt(stops(t), ["trail_id"]).withColumn("total_km", r6("total_km"))


add_view("v_near_planned", greedy_sql("SELECT * FROM v_pool_near", True))
add_view("v_near_stops", "SELECT r.case_id, r.step, r.poi_id, p.lat, p.lon, q.lat AS a_lat, q.lon AS a_lon FROM v_near_planned r JOIN v_pois p USING (poi_id) JOIN v_requests q ON q.req_id = r.case_id")
_NEXT = hav("r.path[len(r.path)].lat", "r.path[len(r.path)].lon", "s.lat", "s.lon")


@query("build_route", f"""
WITH RECURSIVE nn AS (SELECT case_id, [{{'poi_id': CAST(NULL AS BIGINT), 'lat': any_value(a_lat), 'lon': any_value(a_lon)}}] AS path, list({{'i': step, 'poi_id': poi_id, 'lat': lat, 'lon': lon}} ORDER BY step) AS rest FROM v_near_stops GROUP BY 1
 UNION ALL SELECT case_id, list_append(path, {{'poi_id': hit.poi_id, 'lat': hit.lat, 'lon': hit.lon}}), list_filter(rest, lambda s: s.i <> hit.i) FROM
 (SELECT r.*, list_sort(list_transform(r.rest, lambda s: {{'d': round({_NEXT}, 9), 'i': s.i, 'poi_id': s.poi_id, 'lat': s.lat, 'lon': s.lon}}))[1] AS hit FROM nn r WHERE len(r.rest) > 0)),
{two_opt_sql("SELECT case_id, path FROM nn WHERE len(rest) = 0", "case_id", 1)}
SELECT case_id, CAST(step - 1 AS BIGINT) AS step, poi_id, total_km FROM (SELECT *, round(sum(CASE WHEN starts THEN 0 ELSE leg END) OVER (PARTITION BY case_id), 6) AS total_km FROM legs) WHERE NOT starts""")
def build_route(t):
    planned = near_plans(t)
    start = t.requests.select(F.col("req_id").alias("case_id"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"))
    return routes.build_route(planned.join(start, "case_id"), ["case_id"]).withColumn("total_km", r6("total_km"))


@query("path_length", f"""
SELECT trail_id, round(COALESCE(sum({hav('plat', 'plon', 'lat', 'lon')}), 0), 6) AS total_km FROM (SELECT *, lag(lat) OVER (PARTITION BY trail_id ORDER BY step) AS plat, lag(lon) OVER (PARTITION BY trail_id ORDER BY step) AS plon FROM v_located) GROUP BY trail_id""")
def path_length(t):
    return routes.path_length(stops(t), ["trail_id"]).withColumn("total_km", r6("total_km"))


add_view("v_anchor_stops", f"""
SELECT *, {hav('plat', 'plon', 'lat', 'lon')} AS leg FROM (SELECT l.trail_id, l.user_id, l.step, l.poi_id, l.lat, l.lon, COALESCE(lag(l.lat) OVER (PARTITION BY l.trail_id ORDER BY l.step), r.lat) AS plat, COALESCE(lag(l.lon) OVER (PARTITION BY l.trail_id ORDER BY l.step), r.lon) AS plon FROM v_located l LEFT JOIN v_requests r ON r.req_id = l.user_id)""")


def anchored(t):
    start = t.requests.select(F.col("req_id").alias("user_id"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"))
    return routes.anchored_legs(stops(t).join(start, "user_id", "left"), ["trail_id"])


@query("leg_distances", "SELECT trail_id, step, poi_id, round(leg, 6) AS leg_km FROM v_anchor_stops")
def leg_distances(t):
    return anchored(t).select("trail_id", "step", "poi_id", r6("leg_km").alias("leg_km"))


add_view("v_topcats", """
SELECT case_id, category, rank FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY n DESC, category) AS rank FROM (SELECT h.case_id, p.primary_category AS category, CAST(sum(h.n) AS BIGINT) AS n FROM v_uhist h JOIN v_pois p USING (poi_id) GROUP BY 1, 2)) WHERE rank <= 5""")


def _hist(t):
    return features.interactions(t.visits).withColumnRenamed("user_id", "case_id")


@query("user_top_categories", "SELECT case_id, category, rank FROM v_topcats")
def user_top_categories(t):
    return routes.user_top_categories(_hist(t), t.pois, t.poi_categories)


@query("anchor_from_poi", "SELECT c.case_id, p.lat AS a_lat, p.lon AS a_lon FROM v_ucase c LEFT JOIN v_pois p ON p.poi_id = c.current_poi")
def anchor_from_poi(t):
    from trailweave.catalog.engines import ucases

    return routes.anchor_from_poi(ucases(t)[0], t.pois).select("case_id", "a_lat", "a_lon")


@query("shannon_entropy", """
SELECT trail_id, round(-sum(n / t * log2(n / t + 1e-12)), 6) AS entropy FROM (SELECT trail_id, primary_category, count(*) AS n, sum(count(*)) OVER (PARTITION BY trail_id) AS t FROM v_visits JOIN v_pois USING (poi_id) GROUP BY 1, 2) GROUP BY trail_id""")
def shannon_entropy(t):
    rows = t.visits.join(t.pois.select("poi_id", "primary_category"), "poi_id")
    return routes.shannon_entropy(rows, ["trail_id"], "primary_category").withColumn("entropy", r6("entropy"))


@query("route_metrics", f"""
WITH s AS (SELECT a.*, lower(p.primary_category) AS cat, CASE WHEN c.category IS NULL THEN 0 ELSE 1 END AS m FROM v_anchor_stops a JOIN v_pois p ON p.poi_id = a.poi_id LEFT JOIN v_topcats c ON c.case_id = a.user_id AND lower(c.category) = lower(p.primary_category)),
e AS (SELECT trail_id, -sum(n / t * log2(n / t + 1e-12)) AS e FROM (SELECT trail_id, cat, count(*) AS n, sum(count(*)) OVER (PARTITION BY trail_id) AS t FROM s GROUP BY 1, 2) GROUP BY 1)
SELECT trail_id, CAST(count(*) AS DOUBLE) AS n_pois, round(COALESCE(sum(leg), 0), 6) AS total_km, round(COALESCE(avg(leg), 0), 6) AS avg_leg_km, round(COALESCE(min(leg), 0), 6) AS min_leg_km, round(COALESCE(max(leg), 0), 6) AS max_leg_km,
 round(count(*) FILTER (WHERE leg < 0.35) / greatest(count(leg), 1), 6) AS pct_legs_too_close, round(count(*) FILTER (WHERE leg > 5.0) / greatest(count(leg), 1), 6) AS pct_legs_too_far, round(count(DISTINCT cat) / count(*), 6) AS unique_cat_ratio,
 round(any_value(e.e), 6) AS cat_entropy, round(sum(m) / count(*), 6) AS cat_match_ratio FROM s JOIN e USING (trail_id) GROUP BY trail_id""")
def route_metrics(t):
    rows = anchored(t).join(t.pois.select("poi_id", "primary_category"), "poi_id").withColumnRenamed("user_id", "case_id")
    top = routes.user_top_categories(_hist(t), t.pois, t.poi_categories)
    out = routes.route_metrics(rows, ["trail_id"], top)
    return out.select("trail_id", *[r6(m).alias(m) for m in routes.ROUTE_METRICS])
