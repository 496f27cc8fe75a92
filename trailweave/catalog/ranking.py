"""Queries: candidate filters, re-ranking and whole recommendations."""
from __future__ import annotations

from pyspark.sql import functions as F

from trailweave.catalog.engines import content_views, context_view
from trailweave.catalog.oracle_views import add_view
from trailweave.catalog.registry import query, shared
from trailweave.functions.numeric import r6, r9
from trailweave.functions.geo import radius_join
from trailweave.operators import features, intents, prefs, rerank
from trailweave.plans import recommend as rec

_HAV = "CASE WHEN p.lat + p.lon + r.lat + r.lon IS NOT NULL THEN 2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(p.lat - r.lat) / 2), 2) + cos(radians(r.lat)) * cos(radians(p.lat)) * pow(sin(radians(p.lon - r.lon) / 2), 2)))) END"

# candidates of the filter queries: POIs co-visited with a POI the request names or its user visited most
add_view("v_seed", """
SELECT req_id, COALESCE(current_poi, fav) AS a, current_poi FROM v_requests r LEFT JOIN (SELECT user_id, arg_max(poi_id, {'n': n, 'p': -poi_id}) AS fav FROM (SELECT user_id, poi_id, count(*) AS n FROM v_visits GROUP BY 1, 2) GROUP BY 1) f USING (user_id) WHERE COALESCE(current_poi, fav) IS NOT NULL""")
add_view("v_cand", "SELECT s.req_id AS case_id, s.current_poi, c.b AS poi_id, CAST(c.n AS DOUBLE) AS score FROM v_seed s JOIN v_cooc c ON c.a = s.a UNION ALL SELECT req_id, current_poi, a, CAST(1 AS DOUBLE) FROM v_seed")


def cand(t):
    counts = features.interactions(t.visits)
    fav = counts.groupBy("user_id").agg(F.max_by("poi_id", F.struct("n", -F.col("poi_id"))).alias("fav"))
    seed = t.requests.select("req_id", "user_id", "current_poi").join(fav, "user_id", "left").select("req_id", "current_poi", F.coalesce("current_poi", "fav").alias("a")).where("a IS NOT NULL")
    co = seed.join(features.cooccurrence(t.visits), "a").select(F.col("req_id").alias("case_id"), "current_poi", F.col("b").alias("poi_id"), F.col("n").cast("double").alias("score"))
    return co.unionByName(seed.select(F.col("req_id").alias("case_id"), "current_poi", F.col("a").alias("poi_id"), F.lit(1.0).alias("score")))


@query("f_not_current", "SELECT case_id, poi_id FROM v_cand WHERE current_poi IS NULL OR poi_id <> current_poi")
def f_not_current(t):
    return rerank.not_current(cand(t)).select("case_id", "poi_id")


@query("f_metadata", "SELECT case_id, poi_id FROM v_cand JOIN v_pois USING (poi_id) WHERE lat IS NOT NULL AND lon IS NOT NULL")
def f_metadata(t):
    return cand(t).join(rerank.has_metadata(t.pois), "poi_id").select("case_id", "poi_id")


@query("f_exclude_category", "SELECT case_id, poi_id FROM v_cand JOIN v_pois USING (poi_id) WHERE primary_category NOT IN ('Intersection', 'State', 'Home (private)')")
def f_exclude_category(t):
    return rerank.exclude_category(cand(t).join(t.pois, "poi_id")).select("case_id", "poi_id")


@query("f_price_free", """
SELECT c.case_id, c.poi_id FROM v_cand c JOIN v_pois p USING (poi_id) JOIN v_prefs f ON f.req_id = c.case_id WHERE (f.free_only IS NULL OR p.is_free = f.free_only) AND (f.max_price_tier IS NULL OR p.price_tier IS NULL OR p.price_tier <= f.max_price_tier)""")
def f_price_free(t):
    table = prefs.prefs_table(t.requests).select(F.col("req_id").alias("case_id"), "free_only", "max_price_tier")
    return cand(t).join(t.pois, "poi_id").join(table, "case_id").where(rerank.price_free_filter()).select("case_id", "poi_id")


add_view("v_pnames", "SELECT DISTINCT poi_id, name FROM (SELECT poi_id, category_name AS name FROM v_poi_categories UNION ALL SELECT poi_id, primary_category FROM v_pois)")
add_view("v_pfacts", "SELECT n.poi_id, bool_and(i.intent = 'inconclusive') AS oi, max(i.confidence) AS mc FROM v_pnames n JOIN v_intents i ON i.name = n.name GROUP BY 1")
add_view("v_uintents", """
SELECT DISTINCT req_id, intent FROM (SELECT p.req_id, COALESCE(a.intent, i.intent) AS intent FROM v_pref_tokens p JOIN v_intents i ON i.name = p.token AND i.t = lower(p.token) LEFT JOIN v_aliases a ON a.w = lower(p.token) WHERE p.kind = 'category') WHERE intent <> 'inconclusive'""")
add_view("v_pmatch", "SELECT DISTINCT c.req_id, n.poi_id FROM v_pref_cats c JOIN v_pnames n ON lower(n.name) = c.l")
add_view("v_imatch", "SELECT DISTINCT u.req_id, n.poi_id FROM v_uintents u JOIN v_intents i ON i.intent = u.intent JOIN v_pnames n ON n.name = i.name")
add_view("v_hasp", "SELECT DISTINCT req_id FROM v_pref_cats")


def _pref_rows(t):
    """Candidates with label, boosts not yet applied."""
    f_labels, poi_label = labels(t)
    tok = prefs.pref_tokens(t.requests).where("kind = 'category'").select(F.col("req_id").alias("case_id"), "pos", "token")
    wanted = intents.intent_user(tok, ["case_id"], "token", "pos")
    matches = rerank.preference_matches(f_labels, tok, wanted)
    has = tok.select("case_id").distinct().withColumn("has_prefs", F.lit(True))
    mode = t.requests.select(F.col("req_id").alias("case_id"), "category_mode")
    rows = cand(t).join(poi_label, "poi_id").join(mode, "case_id").join(has, "case_id", "left").fillna(False, ["has_prefs"])
    return rows, rerank.label_facts(f_labels), matches


def labels(t):
    sig = features.signatures(t.poi_categories)
    poi_label = t.pois.join(sig, "poi_id", "left").select("poi_id", F.concat_ws("\u0001", "sig", "primary_category").alias("label"), "sig", "primary_category")
    names = poi_label.select("label", F.explode(F.array_distinct(F.array_append(F.split("sig", r"\|"), F.col("primary_category")))).alias("name")).distinct()
    classified = intents.intent_classify(names.select("name").distinct(), "name").select("name", "intent", "confidence")
    return names.join(classified, "name"), poi_label.select("poi_id", "label")


_BOOST = """
SELECT c.case_id, c.poi_id, c.score, h.req_id IS NOT NULL AS hp, r.category_mode = 'strict' AS strict, m.poi_id IS NOT NULL AS pm, i.poi_id IS NOT NULL AS im, COALESCE(f.oi, false) AS oi, COALESCE(f.mc, 0) AS mc
FROM v_cand c JOIN v_requests r ON r.req_id = c.case_id LEFT JOIN v_hasp h ON h.req_id = c.case_id LEFT JOIN v_pmatch m ON m.req_id = c.case_id AND m.poi_id = c.poi_id LEFT JOIN v_imatch i ON i.req_id = c.case_id AND i.poi_id = c.poi_id LEFT JOIN v_pfacts f ON f.poi_id = c.poi_id"""


@query("boost_category", f"SELECT case_id, poi_id, pm AS pref_match FROM ({_BOOST}) WHERE pm")
def boost_category(t):
    rows, _, matches = _pref_rows(t)
    return rows.join(matches.where("pref_match"), ["case_id", "label"]).select("case_id", "poi_id", "pref_match")


@query("boost_intent_soft", f"""
SELECT case_id, poi_id, round(score * CASE WHEN hp AND pm THEN 1.2 ELSE 1.0 END * CASE WHEN hp AND im THEN 1.3 ELSE 1.0 END * CASE WHEN hp AND oi THEN 0.8 ELSE 1.0 END, 9) AS score FROM ({_BOOST}) WHERE NOT strict""")
def boost_intent_soft(t):
    rows, facts, matches = _pref_rows(t)
    return rerank.apply_preferences(rows.where("category_mode <> 'strict'"), facts, matches).select("case_id", "poi_id", r9("score").alias("score"))


@query("filter_strict", f"""
SELECT case_id, poi_id, pm AS by_name FROM (SELECT x.* FROM ({_BOOST.replace("r.category_mode = 'strict'", "true")}) x) WHERE hp AND (pm OR (im AND mc >= 0.35))""")
def filter_strict(t):
    rows, facts, matches = _pref_rows(t)
    strict = rows.where("has_prefs").withColumn("category_mode", F.lit("strict"))
    kept = rerank.apply_preferences(strict, facts, matches).select("case_id", "poi_id", "label")
    return kept.join(matches.select("case_id", "label", "pref_match"), ["case_id", "label"]).select("case_id", "poi_id", F.col("pref_match").alias("by_name"))


add_view("v_near_req", f"SELECT r.req_id AS case_id, p.poi_id, COALESCE(p.rating, 0) AS score, {_HAV} AS d FROM v_requests r JOIN v_pois p ON r.lat IS NOT NULL AND p.lat IS NOT NULL WHERE {_HAV} <= 2.0")


def near_requests(t):
    anchors = t.requests.select(F.col("req_id").alias("case_id"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"))
    rows = radius_join(anchors, t.pois.select("poi_id", "lat", "lon", "rating"), 2.0)
    return rows.select("case_id", "poi_id", F.coalesce("rating", F.lit(0.0)).alias("score"), "distance_km")


@query("rerank_distance", "SELECT case_id, poi_id, round(CASE WHEN max(d) OVER g > 0 THEN score * (1 - 0.3 * d / (max(d) OVER g + 1e-8)) ELSE score END, 9) AS score FROM v_near_req WINDOW g AS (PARTITION BY case_id)")
def rerank_distance(t):
    return rerank.rerank_distance(near_requests(t), F.lit(0.3)).select("case_id", "poi_id", r9("score").alias("score"))


@query("quality_prior", """
SELECT n.case_id, n.poi_id, round(0.7 * CASE WHEN max(n.score) OVER g > 0 THEN n.score / max(n.score) OVER g ELSE 0 END + 0.3 * CASE WHEN max(p.total_ratings) OVER g > 0 THEN p.total_ratings / max(p.total_ratings) OVER g ELSE 0 END, 9) AS quality
FROM v_near_req n JOIN v_pois p USING (poi_id) WINDOW g AS (PARTITION BY n.case_id)""")
def quality_prior(t):
    from trailweave.operators.variants import quality_prior as prior

    rows = near_requests(t).join(t.pois.select("poi_id", "rating", "total_ratings"), "poi_id")
    return prior(rows, ["case_id"]).select("case_id", "poi_id", r9("quality").alias("quality"))


# ---------------------------------------------------------------- whole recommendations

add_view("v_r_case", """
SELECT r.req_id AS case_id, r.user_id, COALESCE(r.current_poi, s.poi_id) AS current_poi, CASE WHEN l.l1 = COALESCE(r.current_poi, s.poi_id) AND l.n >= 2 THEN l.l2 ELSE l.l1 END AS prev_poi
FROM v_requests r LEFT JOIN v_snap s ON r.current_poi IS NULL AND s.req_id = r.req_id LEFT JOIN (SELECT case_id, current_poi AS l1, prev_poi AS l2, CASE WHEN prev_poi IS NULL THEN 1 ELSE 2 END AS n FROM v_ucase) l ON l.case_id = r.user_id""")
add_view("v_r_hist", "SELECT r.req_id AS case_id, v.poi_id, count(*) AS n FROM v_requests r JOIN v_visits v ON v.user_id = r.user_id GROUP BY 1, 2")
add_view("v_r_seen", "SELECT case_id, poi_id FROM v_r_hist UNION SELECT req_id, current_poi FROM v_requests WHERE current_poi IS NOT NULL")
content_views("v_r", "v_r_case", "v_r_hist", "v_r_seen")
add_view("v_r_mk", """
WITH s AS (SELECT c.case_id, t.b AS poi_id, 0.3 * t.p AS s FROM v_r_case c JOIN v_tr1 t ON t.a = c.current_poi UNION ALL SELECT c.case_id, t.b, 0.7 * t.p2 FROM v_r_case c JOIN v_tr2 t ON t.a = c.current_poi AND t.p = c.prev_poi),
m AS (SELECT case_id, poi_id, round(sum(s), 9) AS score FROM s GROUP BY 1, 2),
e AS (SELECT c.case_id, p.primary_category AS cat FROM v_r_case c JOIN v_pois p ON p.poi_id = c.current_poi WHERE c.case_id NOT IN (SELECT case_id FROM m)),
f AS (SELECT e.case_id, p.poi_id, t.p, COALESCE(p.rating, 0) AS r, max(COALESCE(p.rating, 0)) OVER (PARTITION BY e.case_id) AS m FROM e JOIN v_trc t ON t.cat_a = e.cat JOIN v_pois p ON p.primary_category = t.cat_b)
SELECT case_id, poi_id, score FROM m UNION ALL SELECT case_id, poi_id, round(p * (0.7 + 0.3 * r / CASE WHEN m > 0 THEN m ELSE 1 END), 9) FROM f""")
# embeddings: the last three of history and given POI; else the given POI; else sums over the neighbours of the history
add_view("v_r_ctx", """
SELECT case_id, poi_id FROM (SELECT case_id, poi_id, row_number() OVER (PARTITION BY case_id ORDER BY pos DESC) AS back FROM
 (SELECT q.req_id AS case_id, r.poi_id, r.pos FROM v_requests q JOIN v_urecent r ON r.case_id = q.user_id WHERE q.current_poi IS NULL OR r.poi_id <> q.current_poi
  UNION ALL SELECT req_id, current_poi, 9000000000 FROM v_requests WHERE current_poi IS NOT NULL)) WHERE back <= 3""")
add_view("v_r_ctx2", "SELECT * FROM v_r_ctx WHERE case_id IN (SELECT case_id FROM v_r_ctx GROUP BY case_id HAVING count(*) >= 2)")
add_view("v_r_at", "SELECT req_id AS case_id, current_poi AS poi_id FROM v_requests WHERE current_poi IN (SELECT poi_id FROM v_unit) AND req_id NOT IN (SELECT case_id FROM v_r_ctx2)")
context_view("v_r_emb_ctx", "v_r_ctx2", 2000)
context_view("v_r_emb_at", "v_r_at", 2000)
add_view("v_r_embed", """
SELECT case_id, poi_id, score FROM v_r_emb_ctx UNION ALL SELECT case_id, poi_id, score FROM v_r_emb_at
UNION ALL SELECT q.req_id, n.b, round(sum(n.score), 9) FROM v_requests q JOIN v_uhist h ON h.case_id = q.user_id JOIN v_near_all n ON n.a = h.poi_id
 WHERE q.current_poi IS NULL AND q.req_id NOT IN (SELECT case_id FROM v_r_ctx2) AND NOT EXISTS (SELECT 1 FROM v_uhist x WHERE x.case_id = q.user_id AND x.poi_id = n.b) GROUP BY 1, 2""")
# factors: the user's own, else the mean of the visited items' weighted by visits; the 500 best unvisited items
add_view("v_r_als_user", """
SELECT r.req_id AS case_id, v.vec FROM v_requests r JOIN v_user_vectors v USING (user_id)
UNION ALL SELECT case_id, list(m ORDER BY d) FROM (SELECT case_id, d, sum(n * x) / sum(n) AS m FROM (SELECT h.case_id, h.n, unnest(v.vec) AS x, unnest(range(1, len(v.vec) + 1)) AS d FROM v_r_hist h JOIN v_item_vectors v USING (poi_id)
 WHERE h.case_id NOT IN (SELECT r.req_id FROM v_requests r JOIN v_user_vectors u USING (user_id))) GROUP BY 1, 2) GROUP BY 1""")
add_view("v_r_als", """
SELECT case_id, poi_id, score FROM (SELECT s.*, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, poi_id) AS rn FROM (SELECT u.case_id, i.poi_id, round(list_dot_product(u.vec, i.vec), 9) AS score FROM v_r_als_user u CROSS JOIN v_item_vectors i) s
 WHERE NOT EXISTS (SELECT 1 FROM v_r_hist h WHERE h.case_id = s.case_id AND h.poi_id = s.poi_id)) WHERE rn <= 500""")
add_view("v_r_sparse", """
WITH i AS (SELECT h.case_id, c.b AS poi_id, CAST(sum(c.n) AS DOUBLE) AS score FROM v_r_hist h JOIN v_cooc c ON c.a = h.poi_id WHERE NOT EXISTS (SELECT 1 FROM v_r_hist x WHERE x.case_id = h.case_id AND x.poi_id = c.b) GROUP BY 1, 2),
m AS (SELECT k.case_id, k.poi_id, k.score / sqrt(COALESCE(c.n_visits, 1)) AS score FROM v_r_mk k LEFT JOIN v_counts c USING (poi_id)),
e AS (SELECT 'item' AS engine, * FROM i UNION ALL SELECT 'markov', * FROM m UNION ALL SELECT 'embed', * FROM v_r_embed UNION ALL SELECT 'als', * FROM v_r_als),
n AS (SELECT *, max(score) OVER (PARTITION BY engine, case_id) AS top FROM e)
SELECT case_id, engine, poi_id, score / top AS score FROM n WHERE top > 0 AND poi_id IN (SELECT poi_id FROM v_pois)""")
# weights by what is known of the request: content, item, markov, embed, als
add_view("v_r_fused", """
SELECT l.case_id, l.poi_id, sum(l.score * CASE w.kind WHEN 'both' THEN CASE l.engine WHEN 'content' THEN 0.10 WHEN 'item' THEN 0.15 WHEN 'markov' THEN 0.15 WHEN 'embed' THEN 0.05 ELSE 0.55 END
 WHEN 'user' THEN CASE l.engine WHEN 'content' THEN 0.10 WHEN 'item' THEN 0.20 WHEN 'markov' THEN 0.10 WHEN 'embed' THEN 0.05 ELSE 0.55 END
 WHEN 'place' THEN CASE l.engine WHEN 'content' THEN 0.10 WHEN 'item' THEN 0.15 WHEN 'markov' THEN 0.35 WHEN 'embed' THEN 0.05 ELSE 0.35 END
 WHEN 'model' THEN CASE l.engine WHEN 'content' THEN 0.15 WHEN 'item' THEN 0.15 WHEN 'markov' THEN 0.10 WHEN 'embed' THEN 0.15 ELSE 0.45 END
 ELSE CASE l.engine WHEN 'content' THEN 0.60 WHEN 'item' THEN 0.20 WHEN 'markov' THEN 0.20 ELSE 0.0 END END) AS score
FROM (SELECT case_id, engine, poi_id, score FROM v_r_sparse UNION ALL SELECT case_id, 'content', poi_id, norm FROM v_r_content) l
JOIN (SELECT c.case_id, CASE WHEN h.case_id IS NOT NULL AND c.current_poi IS NOT NULL THEN 'both' WHEN h.case_id IS NOT NULL THEN 'user' WHEN c.current_poi IS NOT NULL THEN 'place' WHEN k.case_id IS NOT NULL THEN 'model' ELSE 'none' END AS kind
 FROM v_r_case c LEFT JOIN (SELECT DISTINCT case_id FROM v_r_hist) h USING (case_id) LEFT JOIN (SELECT DISTINCT case_id FROM v_r_sparse WHERE engine IN ('embed', 'als')) k USING (case_id)) w ON w.case_id = l.case_id GROUP BY 1, 2""")
add_view("v_r_screened", """
SELECT x.case_id, x.poi_id, p.primary_category, r.k, CASE WHEN h.req_id IS NULL THEN x.score ELSE x.score * CASE WHEN m.poi_id IS NOT NULL THEN 1.2 ELSE 1.0 END * CASE WHEN r.category_mode = 'strict' THEN 1.0 ELSE CASE WHEN i.poi_id IS NOT NULL THEN 1.3 ELSE 1.0 END * CASE WHEN f.oi THEN 0.8 ELSE 1.0 END END END AS score,
 """ + _HAV + """ AS d
FROM v_r_fused x JOIN v_requests r ON r.req_id = x.case_id JOIN v_pois p ON p.poi_id = x.poi_id JOIN v_prefs q ON q.req_id = x.case_id LEFT JOIN v_hasp h ON h.req_id = x.case_id LEFT JOIN v_pmatch m ON m.req_id = x.case_id AND m.poi_id = x.poi_id
LEFT JOIN v_imatch i ON i.req_id = x.case_id AND i.poi_id = x.poi_id LEFT JOIN v_pfacts f ON f.poi_id = x.poi_id
WHERE p.lat IS NOT NULL AND p.primary_category NOT IN ('Intersection', 'State', 'Home (private)') AND (q.free_only IS NULL OR p.is_free = q.free_only) AND (q.max_price_tier IS NULL OR p.price_tier IS NULL OR p.price_tier <= q.max_price_tier)
 AND NOT EXISTS (SELECT 1 FROM v_r_seen s WHERE s.case_id = x.case_id AND s.poi_id = x.poi_id) AND (h.req_id IS NULL OR r.category_mode <> 'strict' OR m.poi_id IS NOT NULL OR (i.poi_id IS NOT NULL AND f.mc >= 0.35))""")
# every POI that passes the filters counts for the largest distance, however its score
add_view("v_r_final", """
SELECT case_id, poi_id, primary_category, k, round(CASE WHEN max(d) OVER g > 0 THEN score * (1 - 0.3 * d / (max(d) OVER g + 1e-8)) ELSE score END, 9) AS score, d FROM v_r_screened WINDOW g AS (PARTITION BY case_id)""")
add_view("v_recommend", """
SELECT case_id, poi_id, rank, score, round(d, 6) AS distance_km, 'engines' AS source FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, poi_id) AS rank FROM
 (SELECT *, row_number() OVER (PARTITION BY case_id, primary_category ORDER BY score DESC, poi_id) AS cr FROM v_r_final) WHERE cr <= 2) WHERE rank <= k
UNION ALL SELECT case_id, poi_id, rank, score, NULL, 'popularity' FROM (SELECT r.req_id AS case_id, r.k, q.poi_id, q.score, row_number() OVER (PARTITION BY r.req_id ORDER BY q.score DESC, q.poi_id) AS rank FROM v_requests r CROSS JOIN (SELECT * FROM v_quality ORDER BY score DESC, poi_id LIMIT 50) q
 WHERE r.req_id NOT IN (SELECT case_id FROM v_r_fused)) WHERE rank <= k""")


@shared
def built(t):
    return rec.build_features(t.visits, t.pois, t.poi_categories, item_vectors=t.item_vectors, factors=(t.user_vectors, t.item_vectors))


@query("recommend", "SELECT case_id, poi_id, rank, score, distance_km, source FROM v_recommend")
def recommend(t):
    reqs, tokens = rec.parse_requests(t.requests)
    out = rec.recommend(reqs, tokens, built(t))
    return out.withColumn("distance_km", r6("distance_km")).withColumn("score", r9("score"))


