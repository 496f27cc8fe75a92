"""Queries: multi-variant requests."""
from __future__ import annotations

import re

from pyspark.sql import functions as F

from trailweave.catalog.journeys import hav
from trailweave.catalog.oracle_views import VIEWS, add_view
from trailweave.catalog.ranking import built
from trailweave.catalog.registry import query, shared
from trailweave.functions.numeric import r6
from trailweave.operators import engines as eng
from trailweave.operators import intents, prefs, variants
from trailweave.plans import multi_route as mr

add_view("v_sig_req", """
SELECT r.*, r.user_id IN (SELECT user_id FROM v_visits) AND r.user_id IS NOT NULL AS history, (COALESCE(q.categories, '') <> '' OR q.free_only IS NOT NULL OR q.max_price_tier IS NOT NULL) AS inputs, r.lat IS NOT NULL AND r.lon IS NOT NULL AS location
FROM v_requests r JOIN v_prefs q USING (req_id)""")


@query("signals", "SELECT req_id, history, inputs, location, CASE WHEN history OR inputs OR location THEN NULL ELSE 'missing_input' END AS error FROM v_sig_req")
def signals(t):
    good, bad = variants.signals(t.requests, t.visits, prefs.prefs_table(t.requests))
    rejected = bad.select("req_id", F.lit(False).alias("history"), F.lit(False).alias("inputs"), F.lit(False).alias("location"), "error")
    return good.select("req_id", "history", "inputs", "location", F.lit(None).cast("string").alias("error")).unionByName(rejected)


def _city(t):
    m = F.col("req_id") % 4
    return t.requests.withColumn("city_id", F.when(m == 0, "Q35765").when(m == 1, "Q406").when(m == 2, "q864965 "))


add_view("v_profile", """
SELECT *, CASE WHEN c IN ('A', 'B') THEN 1.8 WHEN c = 'C' THEN 2.8 ELSE 2.0 END * CAST(CASE WHEN proximity THEN 0.85 ELSE 1.0 END AS DOUBLE) AS start_km, CASE WHEN c IN ('A', 'B') THEN 4.0 WHEN c = 'C' THEN 6.0 ELSE 4.5 END * CAST(CASE WHEN proximity THEN 0.85 ELSE 1.0 END AS DOUBLE) AS max_km,
 CAST(CASE WHEN c = 'C' THEN 0.5 ELSE 0.4 END AS DOUBLE) AS step_km, CAST(CASE WHEN c IN ('A', 'B') THEN CASE WHEN proximity THEN 2.2 ELSE 3.0 END WHEN c = 'C' THEN CASE WHEN proximity THEN 3.2 ELSE 4.2 END ELSE CASE WHEN proximity THEN 2.6 ELSE 3.6 END END AS DOUBLE) AS leg_cap_km,
 CAST(CASE WHEN c IN ('A', 'B') THEN CASE WHEN proximity THEN 1.0 ELSE 1.6 END WHEN c = 'C' THEN CASE WHEN proximity THEN 1.6 ELSE 2.4 END ELSE CASE WHEN proximity THEN 1.2 ELSE 1.9 END END AS DOUBLE) AS target_km,
 CAST(CASE WHEN proximity THEN 0.85 ELSE 1.2 END AS DOUBLE) AS sigma, CAST(CASE WHEN proximity THEN 1.05 ELSE 0.8 END AS DOUBLE) AS beta FROM (SELECT *, CASE req_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' END AS c FROM v_requests)""")
_PROFILE = ["start_km", "max_km", "step_km", "leg_cap_km", "target_km", "sigma", "beta"]


@query("radius_profile", "SELECT req_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in _PROFILE) + " FROM v_profile")
def radius_profile(t):
    return variants.radius_profile(_city(t)).select("req_id", *[r6(c).alias(c) for c in _PROFILE])


_D = hav("r.lat", "r.lon", "p.lat", "p.lon")
add_view("v_wide", f"SELECT r.*, p.poi_id, p.lat AS plat, p.lon AS plon, p.primary_category, p.rating, p.total_ratings, {_D} AS d FROM v_profile r JOIN v_pois p ON r.lat IS NOT NULL AND p.lat IS NOT NULL WHERE {_D} <= r.max_km")
_EXPAND = """
WITH r AS (SELECT req_id, max_km, start_km, step_km, {target} AS target, unnest(range(0, CAST(ceil((max_km - start_km) / step_km - 1e-9) AS INT) + 1)) AS i FROM v_profile WHERE lat IS NOT NULL),
c AS (SELECT r.req_id, least(r.max_km, r.start_km + r.i * r.step_km) AS rad, any_value(r.target) AS target, count(w.poi_id) AS n FROM r LEFT JOIN v_wide w ON w.req_id = r.req_id AND w.d <= least(r.max_km, r.start_km + r.i * r.step_km) GROUP BY 1, 2)
SELECT req_id, COALESCE(min(CASE WHEN n >= target THEN rad END), max(rad)) AS radius_km FROM c GROUP BY req_id"""
add_view("v_radius", _EXPAND.format(target="greatest(k * 6, 80)"))
add_view("v_radius_k", _EXPAND.format(target="k"))


def _gated(t, target):
    located = variants.radius_profile(_city(t).where("lat IS NOT NULL AND lon IS NOT NULL"))
    return variants.gated_pois(located, t.pois, target)


@query("radius_expand", "SELECT g.req_id, round(any_value(g.radius_km), 6) AS radius_km, count(*) AS n FROM v_radius g JOIN v_wide w ON w.req_id = g.req_id AND w.d <= g.radius_km GROUP BY 1")
def radius_expand(t):
    rows = _gated(t, F.greatest(F.col("k") * 6, F.lit(80)))
    return rows.groupBy("req_id").agg(r6(F.max("radius_km")).alias("radius_km"), F.count("*").alias("n"))


def _model(t, gated):
    q = eng.quality_scores(t.pois.withColumn("scope", F.lit("ALL")))
    return gated.select("req_id", "poi_id").where(F.col("poi_id") % 3 != 0).join(q.select("poi_id", "score"), "poi_id")


def _walk_sql(view, first, total, where, cols, k="k"):
    """Recursive check query for the local walks: the state holds the remaining candidates as a list."""
    item = "{" + ", ".join(f"'{c}': {c}" for c in cols) + "}"
    leg = hav("r.la", "r.lo", "s.plat", "s.plon")
    return f"""
walk AS (SELECT req_id, any_value({k}) AS k, any_value(leg_cap_km) AS leg_cap_km, any_value(beta) AS beta, any_value(radius_km) AS radius_km, 1 AS pick, any_value(f.poi_id) AS poi_id, any_value(f.plat) AS la, any_value(f.plon) AS lo, any_value(f.primary_category) AS cat, COALESCE(list(i ORDER BY i.poi_id) FILTER (WHERE i.poi_id <> f.poi_id), []) AS rest0
  FROM (SELECT *, {item} AS i, first_value({item}) OVER (PARTITION BY req_id ORDER BY {first} DESC, poi_id) AS f FROM {view}) GROUP BY req_id
 UNION ALL SELECT req_id, k, leg_cap_km, beta, radius_km, pick + 1, hit.poi_id, hit.plat, hit.plon, hit.primary_category, list_filter(rest0, lambda s: s.poi_id <> hit.poi_id) FROM
 (SELECT r.*, list_filter(r.rest0, lambda s: s.poi_id = r.best.poi_id)[1] AS hit FROM (SELECT r.*, list_sort(list_transform(list_filter(r.rest, lambda s: {where}), lambda s: {{'nt': -round({total}, 9), 'poi_id': s.poi_id}}))[1] AS best FROM
  (SELECT r.*, list_transform(r.rest0, lambda s: {{{", ".join(f"'{c}': s.{c}" for c in cols)}, 'leg': {leg}}}) AS rest FROM walk r WHERE r.pick < r.k AND len(r.rest0) > 0) r) r WHERE r.best IS NOT NULL) x)"""


add_view("v_local", """
WITH g AS (SELECT w.*, r.radius_km, q.score AS ms FROM v_wide w JOIN v_radius r ON r.req_id = w.req_id AND w.d <= r.radius_km LEFT JOIN v_quality q ON q.poi_id = w.poi_id AND w.poi_id % 3 <> 0),
m AS (SELECT *, COALESCE((ms - min(ms) OVER p) / NULLIF(max(ms) OVER p - min(ms) OVER p, 0), 0) AS model, exp(-pow(d - target_km, 2) / (2 * sigma * sigma)) AS geo,
 0.7 * COALESCE(COALESCE(rating, 0) / NULLIF(max(COALESCE(rating, 0)) OVER p, 0), 0) + 0.3 * COALESCE(total_ratings / NULLIF(max(total_ratings) OVER p, 0), 0) AS quality FROM g WINDOW p AS (PARTITION BY req_id))
SELECT *, round(0.40 * geo + 0.45 * model + 0.15 * quality, 9) AS lscore FROM m""")


@query("variant_location", "WITH RECURSIVE " + _walk_sql(
    "v_local", "lscore", "0.35 * s.geo + 0.20 * exp(-r.beta * s.leg) + 0.45 * s.model + CASE WHEN s.primary_category <> r.cat THEN 0.05 ELSE 0 END", "s.leg <= r.leg_cap_km",
    ["poi_id", "plat", "plon", "primary_category", "geo", "model"]) + """,
 kept AS (SELECT l.req_id, l.poi_id, l.lscore, l.d, l.k, row_number() OVER (PARTITION BY l.req_id ORDER BY w.pick IS NULL, w.pick, l.lscore DESC, round(l.d, 9), l.poi_id) AS o FROM v_local l LEFT JOIN walk w ON w.req_id = l.req_id AND w.poi_id = l.poi_id)
SELECT req_id, row_number() OVER (PARTITION BY req_id ORDER BY lscore DESC, round(d, 9), poi_id) AS rank, poi_id, lscore AS score, round(d, 6) AS distance_km FROM kept WHERE o <= k""")
def variant_location(t):
    gated = _gated(t, F.greatest(F.col("k") * 6, F.lit(80)))
    out = variants.variant_location(variants.local_scores(gated, _model(t, gated)))
    return out.withColumn("distance_km", r6("distance_km"))


add_view("v_nearest", """
WITH g AS (SELECT w.*, r.radius_km, q.score AS ms FROM v_wide w JOIN v_radius_k r ON r.req_id = w.req_id AND w.d <= r.radius_km JOIN v_quality q ON q.poi_id = w.poi_id AND w.poi_id % 3 <> 0)
SELECT *, CASE WHEN max(ms) OVER p - min(ms) OVER p <= 1e-12 THEN 0 ELSE (ms - min(ms) OVER p) / (max(ms) OVER p - min(ms) OVER p) END * exp(-3.2 * d) AS sc FROM g WINDOW p AS (PARTITION BY req_id)""")


@query("trim_location_nearest", "WITH RECURSIVE " + _walk_sql(
    "v_nearest", "round(0.05 * sc + 0.95 / (1 + d / 1.4), 9)",
    "(0.05 * s.sc + 0.85 / (1 + s.d / 1.4) + 0.10 * exp(-pow(s.leg - 1.4, 2) / (2 * 0.95 * 0.95)) * CASE WHEN s.leg < 0.25 THEN 0.15 WHEN s.leg < 0.45 THEN 0.55 ELSE 1 END * CASE WHEN s.leg > 5.5 THEN 0.5 ELSE 1 END + CASE WHEN s.primary_category <> r.cat THEN 0.05 ELSE 0 END) * CASE WHEN s.d > 0.85 * r.radius_km THEN 0.7 ELSE 1 END * CASE WHEN s.leg > 1.2 THEN 0.2 ELSE 1 END",
    "true", ["poi_id", "plat", "plon", "primary_category", "d", "sc"]) + """
SELECT w.req_id, row_number() OVER (PARTITION BY w.req_id ORDER BY round(n.d, 9), round(n.sc, 9) DESC, w.poi_id) AS rank, w.poi_id, round(n.sc, 9) AS score, round(n.d, 6) AS distance_km FROM walk w JOIN v_nearest n ON n.req_id = w.req_id AND n.poi_id = w.poi_id""")
def trim_location_nearest(t):
    gated = _gated(t, F.col("k"))
    return variants.trim_location_nearest(gated, _model(t, gated)).withColumn("distance_km", r6("distance_km"))


# without a user the content pass has no profile, so both passes are the popularity list
add_view("v_inputs_pool", """
SELECT s.req_id, s.k, q.poi_id, q.score, q.rk <= greatest(s.k * 12, 400) AND h.req_id IS NOT NULL AS strict FROM v_sig_req s LEFT JOIN v_hasp h USING (req_id) CROSS JOIN (SELECT *, row_number() OVER (ORDER BY score DESC, poi_id) AS rk FROM v_quality) q
WHERE s.inputs AND q.rk <= CASE WHEN h.req_id IS NOT NULL THEN greatest(s.k * 12, 400) ELSE greatest(s.k * 6, least(300, s.k + 60)) END""")
add_view("v_inputs", """
WITH a AS (SELECT req_id, intent, min(pos) AS pos FROM (SELECT c.req_id, c.pos, COALESCE(al.intent, i.intent) AS intent FROM v_pref_cats c JOIN v_intents i ON i.name = c.token AND i.t = c.l LEFT JOIN v_aliases al ON al.w = c.l) WHERE intent <> 'inconclusive' GROUP BY 1, 2),
n AS (SELECT req_id, count(*) AS w FROM a GROUP BY 1),
b AS (SELECT p.req_id, p.poi_id, a.pos FROM (SELECT p.*, i.intent, row_number() OVER (PARTITION BY p.req_id, i.intent ORDER BY p.score DESC, p.poi_id) AS r FROM v_inputs_pool p JOIN v_poi_intent i USING (poi_id)) p JOIN a ON a.req_id = p.req_id AND a.intent = p.intent WHERE p.r = 1)
SELECT req_id, rank, poi_id, score FROM (SELECT p.req_id, p.k, p.poi_id, p.score, row_number() OVER (PARTITION BY p.req_id ORDER BY CASE WHEN COALESCE(n.w, 0) BETWEEN 1 AND p.k THEN COALESCE(b.pos, 1000000) ELSE CASE WHEN p.strict THEN 0 ELSE 1 END END, p.score DESC, p.poi_id) AS rank
 FROM v_inputs_pool p LEFT JOIN n ON n.req_id = p.req_id LEFT JOIN b ON b.req_id = p.req_id AND b.poi_id = p.poi_id) WHERE rank <= k""")


@shared
def multi(t):
    p = mr.MultiRouteParams(surprise=variants.SurpriseParams(rate=0.25))
    return mr.build_multi_routes(t.requests, built(t), p)


@query("variant_inputs", "SELECT * FROM v_inputs")
def variant_inputs(t):
    return multi(t).routes.where("variant = 'inputs'").select("req_id", "rank", "poi_id", "score")


@query("trim_coverage", "SELECT * FROM v_inputs")
def trim_coverage(t):
    reqs = variants.signals(t.requests, t.visits, prefs.prefs_table(t.requests))[0].where("inputs")
    table = prefs.prefs_table(t.requests).select("req_id", (F.size("categories") > 0).alias("named"))
    k = F.col("k")
    size = F.when(F.col("named"), F.greatest(k * 12, F.lit(400))).otherwise(F.greatest(k * 6, F.least(F.lit(300), k + 60)))
    asked = reqs.join(table, "req_id").select(F.col("req_id").alias("case_id"), F.lit("ALL").alias("scope"), "k", "named", size.alias("upto"))
    pois = t.pois.withColumn("scope", F.lit("ALL"))
    rows = eng.popularity_fallback(asked, pois, F.col("upto")).join(asked.select("case_id", "k", "named"), "case_id").select(
        F.col("case_id").alias("req_id"), "poi_id", "score", F.col("named").alias("strict"), "k")
    uni = prefs.normalize_categories(prefs.pref_tokens(t.requests))
    words = intents.intent_user(uni, ["req_id"], "token", "pos").select("req_id", F.col("intent").alias("word"), "pos", F.lit(True).alias("is_intent"))
    named = intents.poi_intents(t.pois).join(t.pois.select("poi_id", "primary_category"), "poi_id")
    return variants.trim_coverage(rows, words, named)


# the history variant is a recommendation from the user alone: the same views over requests without place and preferences
_ALONE = {"v_requests": "v_h_requests", "v_prefs": "v_h_prefs", "v_hasp": "v_h_hasp", "v_snap": "v_h_snap", "v_recommend": "v_h_recommend"}
add_view("v_h_requests", "SELECT req_id, user_id, CAST(NULL AS BIGINT) AS current_poi, CAST(NULL AS DOUBLE) AS lat, CAST(NULL AS DOUBLE) AS lon, k, 'soft' AS category_mode FROM v_sig_req WHERE history")
add_view("v_h_prefs", "SELECT req_id, CAST(NULL AS BOOLEAN) AS free_only, CAST(NULL AS INT) AS max_price_tier FROM v_h_requests")
add_view("v_h_hasp", "SELECT req_id FROM v_h_requests WHERE false")
add_view("v_h_snap", "SELECT req_id, poi_id FROM v_snap WHERE false")
for _name, _sql in [(n, q) for n, q in VIEWS.items() if n.startswith("v_r_") or n == "v_recommend"]:
    _alone = lambda text: re.sub(r"\bv_\w+", lambda m: _ALONE.get(m[0], re.sub("^v_r_", "v_h_", m[0])), text)
    add_view(_alone(_name), _alone(_sql))


@query("variant_history", "SELECT case_id AS req_id, rank, poi_id, score FROM v_h_recommend")
def variant_history(t):
    return multi(t).routes.where("variant = 'history'").select("req_id", "rank", "poi_id", "score")


@query("variant_full")
def variant_full(t):
    return multi(t).routes.where("variant = 'full'").select("req_id", "rank", "poi_id", "score", "is_surprise")


@query("variant_routes")
def variant_routes(t):
    return multi(t).routes


@query("omitted_warnings", """
SELECT req_id, variant, reason FROM (SELECT req_id, 'history' AS variant, 'user_without_history' AS reason FROM v_sig_req WHERE (inputs OR location) AND NOT history
 UNION ALL SELECT req_id, 'inputs', 'missing_inputs' FROM v_sig_req WHERE (history OR location) AND NOT inputs UNION ALL SELECT req_id, 'location', 'missing_location' FROM v_sig_req WHERE (history OR inputs) AND NOT location)""")
def omitted_warnings(t):
    return multi(t).omitted


@query("primary_variant", "SELECT req_id, CASE WHEN proximity AND location THEN 'location' ELSE 'full' END AS variant FROM v_sig_req WHERE history OR inputs OR location")
def primary_variant(t):
    m = multi(t)
    return variants.primary_variant(m.routes, m.signals)


# routes of the surprise check: the ten best rated POIs within reach, the pool all within reach
add_view("v_sp_pool", "SELECT req_id, poi_id, plat AS lat, plon AS lon, lscore AS score, row_number() OVER (PARTITION BY req_id ORDER BY lscore DESC, poi_id) AS rank FROM v_local")
add_view("v_sp_route", "SELECT * FROM v_sp_pool WHERE rank <= 10")


def _u32(tag, key):
    return f"CAST(('0x' || substr(md5(concat_ws(':', '42', '{tag}', CAST({key} AS VARCHAR))), 1, 8)) AS BIGINT)"


@query("soft_surprise", f"""
WITH gate AS (SELECT r.req_id, r.lat, r.lon, (SELECT max(rank) FROM v_sp_route x WHERE x.req_id = r.req_id) AS last FROM v_requests r WHERE r.req_id IN (SELECT req_id FROM v_sp_route) AND {_u32('surprise', 'r.req_id')} < {int(0.5 * (1 << 32))}),
a AS (SELECT p.*, g.last, {hav('g.lat', 'g.lon', 'p.lat', 'p.lon')} AS d, max(p.score) OVER (PARTITION BY p.req_id) AS smax FROM v_sp_pool p JOIN gate g ON g.req_id = p.req_id WHERE p.rank > 10),
t AS (SELECT req_id, intent FROM v_uintents UNION SELECT r.req_id, i.intent FROM v_sp_route r JOIN v_poi_intent i USING (poi_id) WHERE i.intent <> 'inconclusive' AND r.req_id NOT IN (SELECT req_id FROM v_uintents)),
b AS (SELECT a.*, CASE WHEN t.intent IS NULL THEN 0 ELSE 1 END AS m FROM a JOIN v_poi_intent i USING (poi_id) LEFT JOIN t ON t.req_id = a.req_id AND t.intent = i.intent WHERE (a.smax <= 0 OR a.score >= 0.35 * a.smax) AND a.d <= 3.0),
c AS (SELECT *, round(0.55 * CASE WHEN max(score) OVER w - min(score) OVER w <= 1e-12 THEN 0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END + 0.30 * CASE WHEN max(d) OVER w <= 1e-12 THEN 1 ELSE 1 - d / max(d) OVER w END + 0.15 * m, 9) AS soft, count(*) OVER w AS n FROM b WINDOW w AS (PARTITION BY req_id)),
e AS (SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY soft DESC, poi_id) AS r, least(n, greatest(10, least(40, n))) AS short FROM c),
h AS (SELECT req_id, last, poi_id, score FROM e WHERE r = {_u32('pick', 'req_id')} % short + 1)
SELECT s.req_id, s.rank, COALESCE(h.poi_id, s.poi_id) AS poi_id, COALESCE(h.score, s.score) AS score, h.poi_id IS NOT NULL AS is_surprise FROM v_sp_route s LEFT JOIN h ON h.req_id = s.req_id AND h.last = s.rank""")
def soft_surprise(t):
    from trailweave.functions.numeric import by_score, top_per_group
    from trailweave.session import materialize

    gated = _gated(t, F.greatest(F.col("k") * 6, F.lit(80)))
    scored = materialize(variants.local_scores(gated, _model(t, gated)).select("req_id", "poi_id", "lat", "lon", F.col("local").alias("score")))
    route = top_per_group(scored, ["req_id"], by_score(), 10)
    wanted = intents.intent_user(prefs.pref_tokens(t.requests).where("kind = 'category'"), ["req_id"], "token", "pos")
    return variants.soft_surprise(route, scored, t.requests, wanted, intents.poi_intents(t.pois), variants.SurpriseParams(rate=0.5))


@query("recommend_then_plan")
def recommend_then_plan(t):
    return mr.recommend_then_plan(t.requests, built(t), multi(t))
