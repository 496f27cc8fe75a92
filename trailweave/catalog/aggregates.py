"""Queries: dataset statistics, intents and preferences."""
from __future__ import annotations

from pyspark.sql import functions as F

from trailweave.catalog.oracle_views import add_view
from trailweave.catalog.registry import query
from trailweave.functions.numeric import r6
from trailweave.operators import features, intents, prefs, stats, transitions

# ---------------------------------------------------------------- intents


def _values(rows):
    return ", ".join("(" + ", ".join(f"{x}" if isinstance(x, int) else "'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows)


_KW = [(i, intent, w) for i, (intent, words) in enumerate(intents.KEYWORDS.items()) for w in words]
_OV = sorted({(w.replace("é", "e").replace("Ã", "a").lower(), intent) for w, intent in intents.OVERRIDES.items()})
add_view("v_keywords", f"SELECT * FROM (VALUES {_values(_KW)}) AS t(o, intent, w)")
add_view("v_overrides", f"SELECT * FROM (VALUES {_values(_OV)}) AS t(w, intent)")
add_view("v_aliases", f"SELECT * FROM (VALUES {_values(intents.IntentTables().aliases)}) AS t(intent, w)")
add_view("v_names", "SELECT DISTINCT category_name AS name, lower(trim(category_name)) AS t FROM v_poi_categories UNION SELECT DISTINCT token, lower(token) FROM v_pref_tokens WHERE kind = 'category'")
add_view("v_kw", """
SELECT name, t, COALESCE(intent, 'inconclusive') AS intent, CASE WHEN n IS NULL THEN CAST(0 AS DOUBLE) ELSE least(1.0, CAST(0.35 AS DOUBLE) + CAST(0.15 AS DOUBLE) * n) END AS conf FROM v_names LEFT JOIN
 (SELECT name, t, intent, n, row_number() OVER (PARTITION BY name, t ORDER BY n DESC, o) AS rn FROM
   (SELECT name, t, o, intent, count(*) AS n FROM v_names JOIN v_keywords k ON contains(t, k.w) GROUP BY name, t, o, intent)) USING (name, t) WHERE rn = 1 OR rn IS NULL""")
add_view("v_intents", """
SELECT k.name, k.t, COALESCE(o.intent, k.intent) AS intent, CASE WHEN o.intent IS NOT NULL THEN CAST(1 AS DOUBLE) ELSE k.conf END AS confidence,
 CASE WHEN o.intent IS NOT NULL THEN 'override' WHEN k.intent <> 'inconclusive' THEN 'keyword' ELSE 'inconclusive' END AS source FROM v_kw k LEFT JOIN v_overrides o ON o.w = k.t""")
add_view("v_pref_tokens", r"""
SELECT req_id, pos, token, CASE WHEN free IS NOT NULL THEN 'free' WHEN tier IS NOT NULL THEN 'price' ELSE 'category' END AS kind, free, tier FROM
(SELECT *, CASE WHEN l IN ('free', 'gratis') THEN true WHEN l IN ('paid', 'pago') THEN false END AS free,
  CASE WHEN l IN ('cheap', 'budget', 'barato') THEN 1 WHEN l IN ('mid', 'medio') THEN 2 WHEN l IN ('expensive', 'caro') THEN 3
       WHEN regexp_matches(l, '^(price|max_price|max-price|price_tier|price-tier):') THEN TRY_CAST(trim(regexp_extract(token, '^[^:]*:(.*)$', 1)) AS INT) END AS tier
 FROM (SELECT req_id, pos, trim(raw) AS token, lower(trim(raw)) AS l FROM (SELECT req_id, unnest(string_split(prefs, ',')) AS raw, unnest(range(0, len(string_split(prefs, ',')))) AS pos FROM v_requests WHERE prefs IS NOT NULL)) WHERE token <> '')""")
add_view("v_poi_intent", "SELECT p.poi_id, i.intent FROM v_pois p JOIN (SELECT DISTINCT name, intent FROM v_intents) i ON i.name = p.primary_category")


@query("intent_keyword", "SELECT DISTINCT name, intent AS kw_intent, round(conf, 6) AS kw_conf FROM v_kw WHERE name IN (SELECT category_name FROM v_poi_categories)")
def intent_keyword(t):
    names = t.poi_categories.select(F.col("category_name").alias("name")).distinct()
    return intents.intent_keyword(names, "name").withColumn("kw_conf", r6("kw_conf"))


@query("intent_classify", "SELECT DISTINCT name AS category_name, intent, round(confidence, 6) AS confidence, source FROM v_intents WHERE name IN (SELECT category_name FROM v_poi_categories)")
def intent_classify(t):
    return intents.category_intents(t.poi_categories).withColumn("confidence", r6("confidence"))


@query("intent_user", """
SELECT req_id, intent, min(CAST(pos AS BIGINT)) AS pos FROM (SELECT p.req_id, p.pos, COALESCE(a.intent, i.intent) AS intent FROM v_pref_tokens p JOIN v_intents i ON i.name = p.token AND i.t = lower(p.token) LEFT JOIN v_aliases a ON a.w = lower(p.token) WHERE p.kind = 'category')
WHERE intent <> 'inconclusive' GROUP BY req_id, intent""")
def intent_user(t):
    tok = prefs.pref_tokens(t.requests).where("kind = 'category'")
    return intents.intent_user(tok, ["req_id"], "token", "pos").withColumn("pos", F.col("pos").cast("long"))


@query("intent_set", """
SELECT c.poi_id, string_agg(DISTINCT i.intent, '|' ORDER BY i.intent) AS intents FROM v_poi_categories c JOIN (SELECT DISTINCT name, intent FROM v_intents) i ON i.name = c.category_name GROUP BY c.poi_id""")
def intent_set(t):
    return intents.intent_set(t.poi_categories, "poi_id").select("poi_id", F.array_join("intents", "|").alias("intents"))


@query("intent_catalog_report", """
WITH c AS (SELECT category_name AS name, count(*) AS n FROM v_poi_categories GROUP BY 1)
SELECT i.intent, count(*) AS n_categories, CAST(sum(c.n) AS BIGINT) AS n_weighted FROM c JOIN (SELECT DISTINCT name, intent FROM v_intents) i USING (name) GROUP BY i.intent""")
def intent_catalog_report(t):
    catalog = t.poi_categories.groupBy(F.col("category_name").alias("name")).agg(F.count("*").alias("n"))
    return intents.intent_catalog_report(catalog, "name", "n")[1]


add_view("v_prefs", """
SELECT r.req_id, r.category_mode, g.categories, g.free_only, g.max_price_tier FROM v_requests r LEFT JOIN
 (SELECT req_id, string_agg(token, '|' ORDER BY pos) FILTER (WHERE kind = 'category') AS categories, arg_max(free, pos) FILTER (WHERE kind = 'free') AS free_only,
   arg_max(tier, pos) FILTER (WHERE kind = 'price') AS max_price_tier FROM v_pref_tokens GROUP BY req_id) g USING (req_id)""")


@query("prefs_table", "SELECT req_id, category_mode, COALESCE(categories, '') AS categories, free_only, max_price_tier FROM v_prefs")
def prefs_table(t):
    return prefs.prefs_table(t.requests).withColumn("categories", F.array_join("categories", "|"))


add_view("v_pref_cats", "SELECT req_id, lower(token) AS l, min(CAST(pos AS BIGINT)) AS pos, arg_min(token, pos) AS token FROM v_pref_tokens WHERE kind = 'category' GROUP BY req_id, lower(token)")


@query("normalize_categories", "SELECT req_id, pos, token FROM v_pref_cats")
def normalize_categories(t):
    return prefs.normalize_categories(prefs.pref_tokens(t.requests)).withColumn("pos", F.col("pos").cast("long"))


# ---------------------------------------------------------------- aggregations

@query("item_counts", "SELECT poi_id, count(*) AS n_visits FROM v_visits GROUP BY poi_id")
def item_counts(t):
    return features.item_counts(t.visits)


@query("interactions", "SELECT user_id, poi_id, count(*) AS n FROM v_visits GROUP BY user_id, poi_id")
def interactions(t):
    return features.interactions(t.visits)


@query("user_history", "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, trail_id, seq, poi_id, tie) AS pos, poi_id FROM v_visits")
def user_history(t):
    return transitions.user_history(t.visits)


@query("trail_sequences", """
SELECT trail_id, string_agg(CAST(poi_id AS VARCHAR), '>' ORDER BY ts, seq, poi_id, tie) AS venues FROM v_visits GROUP BY trail_id HAVING count(*) >= 2""")
def trail_sequences(t):
    return transitions.trail_sequences(t.visits).select("trail_id", F.array_join(F.col("venues").cast("array<string>"), ">").alias("venues"))


_CITY_STATS = """
SELECT p.city_id, COALESCE(v.n_visits, 0) AS n_visits, COALESCE(v.n_users, 0) AS n_users, COALESCE(v.n_trails, 0) AS n_trails, p.n_pois, COALESCE(v.n_visits / v.n_trails, 0) AS avg_trail,
 1.0 - COALESCE(v.n_visits, 0) / greatest(COALESCE(v.n_users, 0) * p.n_pois, 1) AS sparsity
FROM (SELECT city_id, count(*) AS n_pois FROM v_pois GROUP BY city_id) p LEFT JOIN (SELECT venue_city, count(*) AS n_visits, count(DISTINCT user_id) AS n_users, count(DISTINCT trail_id) AS n_trails FROM v_visits GROUP BY venue_city) v ON v.venue_city = p.city_id"""


@query("city_stats", f"SELECT city_id, n_visits, n_users, n_trails, n_pois, round(avg_trail, 6) AS avg_trail, round(sparsity, 6) AS sparsity FROM ({_CITY_STATS})")
def city_stats(t):
    return stats.city_stats(t.visits, t.pois).withColumns({"avg_trail": r6("avg_trail"), "sparsity": r6("sparsity")})


_STAT_COLS = ["n_visits", "n_users", "n_trails", "n_pois", "avg_trail", "sparsity"]
_MM = ", ".join(f"round(CAST(({c} - min({c}) OVER ()) / CASE WHEN max({c}) OVER () - min({c}) OVER () > 0 THEN max({c}) OVER () - min({c}) OVER () ELSE 1.0 END AS DOUBLE), 6) AS {c}" for c in _STAT_COLS)


@query("city_stats_norm", f"SELECT city_id, {_MM} FROM ({_CITY_STATS})")
def city_stats_norm(t):
    out = stats.minmax_columns(stats.city_stats(t.visits, t.pois), "city_id", _STAT_COLS)
    return out.withColumns({c: r6(c) for c in _STAT_COLS})


@query("category_distribution", """
SELECT v.venue_city AS city_id, i.intent, count(*) AS n_visits FROM v_visits v JOIN v_poi_intent i USING (poi_id) GROUP BY 1, 2""")
def category_distribution(t):
    return stats.visits_per_label(t.visits, intents.poi_intents(t.pois), "intent").withColumnRenamed("venue_city", "city_id")


@query("category_supply_demand", """
SELECT intent, count(*) AS n_pois, CAST(COALESCE(sum(n), 0) AS BIGINT) AS n_visits FROM v_poi_intent i LEFT JOIN (SELECT poi_id, count(*) AS n FROM v_visits GROUP BY poi_id) c USING (poi_id) GROUP BY intent""")
def category_supply_demand(t):
    return stats.label_supply_demand(t.visits, intents.poi_intents(t.pois), "intent")


@query("top_categories", "SELECT category_name, count(*) AS cnt FROM v_poi_categories GROUP BY 1 ORDER BY cnt DESC, category_name LIMIT 15")
def top_categories(t):
    return stats.top_categories(t.poi_categories, 15)


@query("top_primary_categories", """
SELECT city_id, category_name, cnt, rank FROM (SELECT *, row_number() OVER (PARTITION BY city_id ORDER BY cnt DESC, category_name) AS rank FROM
 (SELECT p.city_id, c.category_name, count(*) AS cnt FROM v_poi_categories c JOIN v_pois p USING (poi_id) WHERE c.ord = 0 AND p.city_id <> 'C3' GROUP BY 1, 2
  UNION ALL SELECT city_id, COALESCE(primary_category, 'Unknown'), count(*) FROM v_pois WHERE city_id = 'C3' GROUP BY 1, 2)) WHERE rank <= 5""")
def top_primary_categories(t):
    listed = t.poi_categories.join(t.pois.where("city_id <> 'C3'"), "poi_id", "left_semi")
    return stats.top_primary(t.pois, listed)


@query("table_counts", """
SELECT 'visits' AS what, '' AS city_id, count(*) AS n FROM v_visits UNION ALL SELECT 'pois', '', count(*) FROM v_pois UNION ALL SELECT 'poi_categories', '', count(*) FROM v_poi_categories
UNION ALL SELECT 'pois_by_city', city_id, count(*) FROM v_pois GROUP BY city_id UNION ALL SELECT 'visits_by_city', venue_city, count(*) FROM v_visits GROUP BY venue_city""")
def table_counts(t):
    return stats.table_counts(t.visits, t.pois, t.poi_categories)


_NULLABLE = ["name", "rating", "price_tier", "lat", "lon", "primary_category"]


@query("null_profile", " UNION ALL ".join(
    f"SELECT city_id, '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL OR trim(CAST({c} AS VARCHAR)) = '') AS n_null, count(*) AS n_rows, round(100.0 * count(*) FILTER (WHERE {c} IS NULL OR trim(CAST({c} AS VARCHAR)) = '') / count(*), 6) AS pct_null FROM v_pois GROUP BY city_id"
    for c in _NULLABLE))
def null_profile(t):
    return stats.null_profile(t.pois, _NULLABLE, "city_id").withColumn("pct_null", r6("pct_null"))


@query("duplicate_ids", "SELECT venue_city, count(*) AS n_rows, count(DISTINCT poi_id) AS n_ids, count(*) - count(DISTINCT poi_id) AS n_duplicates FROM v_visits GROUP BY venue_city")
def duplicate_ids(t):
    return stats.duplicate_ids(t.visits, "poi_id", "venue_city")


_COVERAGE = """
SELECT c AS venue_city, count(*) AS n_ids, count(p.poi_id) AS matched, count(*) - count(p.poi_id) AS missing, 100.0 * count(p.poi_id) / count(*) AS pct FROM
 (SELECT DISTINCT venue_city AS c, poi_id FROM v_visits UNION ALL SELECT DISTINCT 'ALL', poi_id FROM v_visits) i LEFT JOIN (SELECT poi_id FROM v_pois WHERE rating IS NOT NULL) p USING (poi_id) GROUP BY c"""


@query("coverage", f"SELECT venue_city, n_ids, matched, missing, round(pct, 6) AS coverage_pct FROM ({_COVERAGE})")
def coverage(t):
    return stats.coverage(t.visits, t.pois.where("rating IS NOT NULL")).withColumn("coverage_pct", r6("coverage_pct"))


@query("city_summary", f"""
WITH s AS ({_CITY_STATS}), top AS (SELECT city_id, string_agg(category_name || ' (' || CAST(cnt AS VARCHAR) || ')', '; ' ORDER BY rn) AS top5_primary_categories FROM
 (SELECT *, row_number() OVER (PARTITION BY city_id ORDER BY cnt DESC, category_name) AS rn FROM (SELECT p.city_id, c.category_name, count(*) AS cnt FROM v_poi_categories c JOIN v_pois p USING (poi_id) WHERE c.ord = 0 GROUP BY 1, 2)) WHERE rn <= 5 GROUP BY city_id),
n AS (SELECT city_id, {", ".join(f"round(100.0 * count(*) FILTER (WHERE {c} IS NULL) / count(*), 2) AS null_{c}_pct" for c in ["lat", "lon", "name", "rating", "price_tier", "total_ratings"])} FROM v_pois GROUP BY city_id)
SELECT s.city_id, s.n_visits, s.n_users, s.n_trails, u.n AS n_unique_visit_pois, CAST(100 AS DOUBLE) AS poi_coverage_pct, n.* EXCLUDE (city_id), top.top5_primary_categories
FROM s JOIN n USING (city_id) JOIN top USING (city_id) JOIN (SELECT venue_city AS city_id, count(DISTINCT poi_id) AS n FROM v_visits GROUP BY 1) u USING (city_id)""")
def city_summary(t):
    return stats.city_summary(t.visits, t.pois, t.poi_categories)


@query("visits_profile", """
SELECT count(*) AS n_rows, count(DISTINCT user_id) AS n_users, count(DISTINCT trail_id) AS n_trails, count(DISTINCT poi_id) AS n_venues, min(ts) AS ts_min, max(ts) AS ts_max FROM v_visits""")
def visits_profile(t):
    return stats.visits_profile(t.visits)


@query("visit_counts", """
SELECT 'city' AS dimension, venue_city AS id, count(*) AS n FROM v_visits GROUP BY 2 UNION ALL SELECT 'user', CAST(user_id AS VARCHAR), count(*) FROM v_visits GROUP BY 2
UNION ALL SELECT 'trail', CAST(trail_id AS VARCHAR), count(*) FROM v_visits GROUP BY 2""")
def visit_counts(t):
    return stats.visit_counts(t.visits)


@query("category_catalog", """
SELECT p.city_id, c.category_id, c.category_name, count(*) AS n FROM v_poi_categories c JOIN v_pois p USING (poi_id) GROUP BY GROUPING SETS ((p.city_id, c.category_id, c.category_name), (c.category_id, c.category_name))""")
def category_catalog(t):
    return stats.category_catalog(t.poi_categories, t.pois)


@query("category_inconsistencies", """
SELECT category_id, count(DISTINCT n) AS n_names, min(n) AS first_name, max(n) AS last_name FROM (SELECT category_id, CASE WHEN poi_id % 9 = 0 THEN lower(category_name) ELSE category_name END AS n FROM v_poi_categories) GROUP BY 1 HAVING count(DISTINCT n) > 1""")
def category_inconsistencies(t):
    odd = t.poi_categories.withColumn("category_name", F.when(F.col("poi_id") % 9 == 0, F.lower("category_name")).otherwise(F.col("category_name")))
    return stats.inconsistent_categories(odd)


@query("hour_dow_pivot", """
SELECT CAST(h AS INT) AS hour, """ + ", ".join(f"count(*) FILTER (WHERE isodow(ts) = {d + 1}) AS d{d}" for d in range(7)) + """ FROM range(0, 24) r(h) LEFT JOIN events ON hour(ts) = h GROUP BY h""")
def hour_dow_pivot(t):
    return stats.hour_dow(t.raw("events"))


@query("trail_length_hist", """
WITH l AS (SELECT trail_id, count(DISTINCT poi_id) AS n_pois FROM v_visits GROUP BY trail_id)
SELECT n_pois, count(*) AS n_trails, round((SELECT avg(n_pois) FROM l), 6) AS mean, (SELECT median(n_pois) FROM l) AS median FROM l GROUP BY n_pois""")
def trail_length_hist(t):
    return stats.trail_length_hist(t.visits).withColumn("mean", r6("mean"))


@query("lorenz_curve", """
WITH u AS (SELECT user_id, count(*) AS n FROM v_visits GROUP BY user_id),
c AS (SELECT n, sum(n) OVER (ORDER BY n, user_id ROWS UNBOUNDED PRECEDING) / (SELECT sum(n) FROM u) AS vs, row_number() OVER (ORDER BY n, user_id) / (SELECT count(*) FROM u) AS us FROM u)
SELECT n, count(*) AS n_users, round(max(us), 6) AS user_share, round(max(vs), 6) AS visit_share FROM c GROUP BY n""")
def lorenz_curve(t):
    return stats.lorenz_curve(t.visits).withColumns({"user_share": r6("user_share"), "visit_share": r6("visit_share")})


@query("activity_histogram", """
WITH u AS (SELECT user_id, count(*) AS n FROM v_visits GROUP BY user_id), e AS (SELECT min(n) AS lo, max(n) AS hi FROM u)
SELECT CAST(least(49, floor((n - lo) / (greatest(hi - lo, 1) / 50.0))) AS BIGINT) AS bin, count(*) AS n_users FROM u, e GROUP BY 1""")
def activity_histogram(t):
    return stats.activity_histogram(t.visits)


_TOP = """tu AS (SELECT user_id FROM v_visits GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 50), tp AS (SELECT poi_id FROM v_visits GROUP BY poi_id ORDER BY count(*) DESC, poi_id LIMIT 50),
cells AS (SELECT user_id, poi_id, count(*) AS n FROM v_visits WHERE user_id IN (SELECT user_id FROM tu) AND poi_id IN (SELECT poi_id FROM tp) GROUP BY 1, 2)"""


@query("top_matrix", f"WITH {_TOP} SELECT count(*) AS filled, round(1.0 - count(*) / ((SELECT count(*) FROM tu) * (SELECT count(*) FROM tp)), 6) AS sparsity FROM cells")
def top_matrix(t):
    return stats.top_matrix(t.visits)[1].withColumn("sparsity", r6("sparsity"))


@query("top_matrix_cells", f"WITH {_TOP} SELECT * FROM cells")
def top_matrix_cells(t):
    return stats.top_matrix(t.visits)[0]


add_view("v_xy", "SELECT *, lon * 20037508.34 / 180 AS x, ln(tan((90 + lat) * pi() / 360)) / (pi() / 180) * 20037508.34 / 180 AS y FROM v_pois WHERE lat IS NOT NULL")


def _cell(v, cells, pad):
    return f"CAST(floor(({v} - ({v}0 - {pad} * ({v}1 - {v}0))) / (({v}1 - {v}0) * {1 + 2 * pad} / {cells})) AS BIGINT)"


@query("spatial_bin_mean", f"""
WITH e AS (SELECT quantile_cont(x, 0.01) AS x0, quantile_cont(x, 0.99) AS x1, quantile_cont(y, 0.01) AS y0, quantile_cont(y, 0.99) AS y1 FROM v_xy)
SELECT {_cell('x', 95, 0.16)} AS cx, {_cell('y', 95, 0.16)} AS cy, count(*) AS n, round(avg(COALESCE(rating, 0)), 6) AS rating FROM v_xy, e GROUP BY 1, 2 HAVING count(*) >= 2""")
def spatial_bin_mean(t):
    return stats.spatial_bin_mean(t.pois).withColumn("rating", r6("rating"))


@query("checkin_density", f"""
WITH v AS (SELECT x, y FROM v_visits JOIN v_xy USING (poi_id)),
e AS (SELECT quantile_cont(x, 0.01) AS x0, quantile_cont(x, 0.99) AS x1, quantile_cont(y, 0.01) AS y0, quantile_cont(y, 0.99) AS y1 FROM v)
SELECT {_cell('x', 60, 0.07)} AS cx, {_cell('y', 60, 0.07)} AS cy, count(*) AS n_visits FROM v, e GROUP BY 1, 2""")
def checkin_density(t):
    return stats.checkin_density(t.visits, t.pois)


@query("mercator_xy", "SELECT poi_id, round(x, 3) AS x, round(y, 3) AS y FROM v_xy")
def mercator_xy(t):
    return stats.located_xy(t.pois).select("poi_id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query("poi_map_table", """
SELECT p.poi_id, p.lat, p.lon, i.intent, round(COALESCE(p.rating, (SELECT median(rating) FROM v_pois WHERE lat IS NOT NULL)), 6) AS rating FROM v_pois p JOIN v_poi_intent i USING (poi_id) WHERE p.lat IS NOT NULL""")
def poi_map_table(t):
    return stats.poi_map_table(t.pois, intents.poi_intents(t.pois)).withColumn("rating", r6("rating"))


