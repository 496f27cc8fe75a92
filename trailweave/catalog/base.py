"""Queries: scans, sinks, joins, set operations, top-k and scalar functions."""
from __future__ import annotations

from pyspark.sql import functions as F

from trailweave.catalog.registry import query
from trailweave.functions import geo, numeric, text
from trailweave.functions.numeric import r6
from trailweave.operators import features, transitions
from trailweave.session import scratch_dir
from trailweave.sources import scans

CITY = "C1"

# ---------------------------------------------------------------- scans and sinks


@query("scan_visits_csv", """
SELECT trail_id, user_id, venue_id, venue_city, "timestamp" AS ts_text FROM v_raw_checkins""")
def scan_visits_csv(t):
    path = scratch_dir(t.spark) + "/checkins"
    t.raw_checkins.drop("seq", "tie").write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    df = scans.read_checkins_csv(t.spark, path, ["trail_id", "user_id", "venue_id", "venue_city", "timestamp"])
    return df.withColumnRenamed("timestamp", "ts_text")


@query("scan_poi_json", """
SELECT CASE WHEN poi_id % 3 <> 0 THEN 'foursquare:' || CAST(poi_id AS VARCHAR) END AS fsq_id,
  CASE WHEN poi_id % 3 = 0 THEN 'foursquare:' || CAST(poi_id AS VARCHAR) END AS fsq_place_id,
  CASE WHEN poi_id % 2 = 0 THEN round(lat, 6) END AS latitude, round(CASE WHEN poi_id % 2 = 1 THEN lat END, 6) AS main_latitude,
  CAST(1 AS BIGINT) AS n_categories
FROM v_pois""")
def scan_poi_json(t):
    path = scratch_dir(t.spark) + "/pois"
    listed = F.col("poi_id") % 2 == 0
    line = F.when(listed, F.concat(F.lit("["), F.col("doc"), F.lit("]"))).otherwise(F.col("doc"))
    t.raw_pois.select(line.alias("value")).unionByName(t.raw_pois.select(F.lit("42").alias("value"))).write.text(path)
    return scans.read_poi_json(t.spark, path).select(
        "fsq_id", "fsq_place_id", r6("latitude").alias("latitude"),
        r6("geocodes.main.latitude").alias("main_latitude"), F.size("categories").cast("long").alias("n_categories"))


@query("scan_visits", """
SELECT trail_id, user_id, poi_id, venue_city, ts, seq FROM v_visits WHERE venue_city = 'C1'""")
def scan_visits(t):
    return scans.load_visits(t.visits, CITY)


@query("scan_pois", """
SELECT poi_id, name, lat, lon, city_id, rating, price_tier, total_ratings, primary_category, is_free
FROM v_pois WHERE city_id ILIKE 'c1' AND city_id = 'C1'""")
def scan_pois(t):
    pois = t.pois.withColumn("city", F.col("city_id"))
    return scans.load_pois(pois, "c1", CITY, t.pois.columns)


@query("scan_poi_categories", """
SELECT * FROM v_poi_categories WHERE poi_id IN (SELECT poi_id FROM v_pois WHERE rating >= 6)""")
def scan_poi_categories(t):
    return scans.load_poi_categories(t.poi_categories, t.pois.where("rating >= 6"))


@query("scan_pois_stats", """
SELECT CAST(poi_id AS VARCHAR) AS poi_id, COALESCE(CAST(total_ratings AS BIGINT), 0) AS total_ratings, primary_category, lat, lon
FROM v_pois WHERE city_id = 'C2'""")
def scan_pois_stats(t):
    return scans.pois_stats(t.pois, city_id="C2")


@query("load_all", """
SELECT 'visits' AS part, poi_id, count(*) AS n FROM v_visits WHERE venue_city = 'C1' GROUP BY poi_id
UNION ALL SELECT 'pois', poi_id, count(*) FROM v_pois WHERE city_id = 'C1' GROUP BY poi_id
UNION ALL SELECT 'categories', poi_id, count(*) FROM v_poi_categories WHERE poi_id IN (SELECT poi_id FROM v_pois WHERE city_id = 'C1') GROUP BY poi_id""")
def load_all(t):
    v, p, c = scans.load_all(t.visits, t.pois, t.poi_categories, CITY)
    parts = [df.groupBy("poi_id").agg(F.count("*").alias("n")).select(F.lit(n).alias("part"), "poi_id", "n")
             for n, df in (("visits", v), ("pois", p), ("categories", c))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("scan_poi_files_fallback", """
WITH s AS (
 SELECT city_id, 1 AS source_rank, poi_id AS row_rank, poi_id, name FROM v_pois WHERE city_id = 'C1' AND is_free
 UNION ALL SELECT city_id, 2, poi_id, poi_id, upper(name) FROM v_pois WHERE city_id <> 'C3'
 UNION ALL SELECT city_id, 3, -poi_id, poi_id, name FROM v_pois
 UNION ALL SELECT city_id, 3, poi_id, poi_id, lower(name) FROM v_pois WHERE poi_id % 4 = 0),
b AS (SELECT s.* FROM s JOIN (SELECT city_id, min(source_rank) AS m FROM s GROUP BY city_id) x ON s.city_id = x.city_id AND s.source_rank = x.m)
SELECT city_id, source_rank, poi_id, name FROM (SELECT *, row_number() OVER (PARTITION BY poi_id ORDER BY city_id, row_rank) AS rn FROM b) WHERE rn = 1""")
def scan_poi_files_fallback(t):
    p = t.pois

    def source(df, rank, row, name):
        return df.select("city_id", F.lit(rank).alias("source_rank"), row.alias("row_rank"), "poi_id", name.alias("name"))

    rows = (
        source(p.where((F.col("city_id") == "C1") & F.col("is_free")), 1, F.col("poi_id"), F.col("name"))
        .unionByName(source(p.where(F.col("city_id") != "C3"), 2, F.col("poi_id"), F.upper("name")))
        .unionByName(source(p, 3, -F.col("poi_id"), F.col("name")))
        .unionByName(source(p.where(F.col("poi_id") % 4 == 0), 3, F.col("poi_id"), F.lower("name")))
    )
    return scans.first_nonempty_source(rows).drop("row_rank")


@query("sink_csv_json", """
SELECT 'csv' AS format, poi_id, name, price_tier FROM v_pois UNION ALL SELECT 'json', poi_id, name, price_tier FROM v_pois
UNION ALL SELECT 'parquet', poi_id, name, price_tier FROM v_pois""")
def sink_csv_json(t):
    base = scratch_dir(t.spark)
    src = t.pois.select("poi_id", "name", "price_tier")
    src.write.option("header", True).csv(base + "/csv")
    src.write.json(base + "/json")
    src.write.parquet(base + "/parquet")
    schema = "poi_id long, name string, price_tier int"
    back = {
        "csv": t.spark.read.schema(schema).option("header", True).csv(base + "/csv"),
        "json": t.spark.read.schema(schema).json(base + "/json"),
        "parquet": t.spark.read.schema(schema).parquet(base + "/parquet"),
    }
    out = [df.select(F.lit(k).alias("format"), "*") for k, df in back.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("bulk_load_visits", """
SELECT venue_city, count(*) AS n, count(DISTINCT trail_id) AS n_trails FROM v_visits GROUP BY venue_city""")
def bulk_load_visits(t):
    path = scratch_dir(t.spark) + "/visits"
    late = F.col("seq") > 3
    scans.append(t.visits.where(~late), path)
    scans.append(t.visits.where(late), path)
    return t.spark.read.parquet(path).groupBy("venue_city").agg(F.count("*").alias("n"), F.countDistinct("trail_id").alias("n_trails"))


@query("upsert_pois", """
SELECT poi_id, CASE WHEN poi_id % 4 = 0 THEN upper(name) ELSE name END AS name, CASE WHEN poi_id % 4 = 0 THEN 'C9' ELSE city_id END AS city_id,
  CASE WHEN poi_id % 4 = 0 THEN NULL ELSE rating END AS rating FROM v_pois""")
def upsert_pois(t):
    cur = t.pois.select("poi_id", "name", "city_id", "rating")
    new = cur.where(F.col("poi_id") % 4 == 0).select("poi_id", F.upper("name").alias("name"), F.lit("C9").alias("city_id"), F.lit(None).cast("double").alias("rating"))
    loads = new.withColumn("name", F.lower("name")).withColumn("load_seq", F.lit(1).cast("long")).unionByName(new.withColumn("load_seq", F.lit(2).cast("long")))
    return scans.upsert(cur, loads, "poi_id", "load_seq")


@query("insert_categories_ignore", """
SELECT poi_id, category_id, category_name FROM v_poi_categories WHERE ord = 0
UNION ALL
SELECT poi_id, category_id, upper(category_name) FROM v_poi_categories a WHERE ord = 1
  AND NOT EXISTS (SELECT 1 FROM v_poi_categories b WHERE b.ord = 0 AND b.poi_id = a.poi_id AND b.category_id = a.category_id)""")
def insert_categories_ignore(t):
    c = t.poi_categories
    incoming = c.withColumn("category_name", F.upper("category_name")).unionByName(
        c.select("poi_id", (F.col("ord") + 5).alias("ord"), "category_id", F.lower("category_name").alias("category_name"))
    ).unionByName(c.select("poi_id", "ord", F.lit("").alias("category_id"), "category_name"))
    return scans.insert_categories_ignore(c.where("ord = 0"), incoming)


@query("incremental_merge", """
SELECT poi_id, CASE WHEN poi_id % 3 = 0 THEN 'new2' ELSE 'old1' END AS payload, CASE WHEN poi_id % 3 = 0 THEN CAST(2 AS BIGINT) ELSE CAST(1 AS BIGINT) END AS row_seq
FROM v_pois""")
def incremental_merge(t):
    ids = t.pois.select("poi_id")

    def rows(df, tag, n):
        return df.select("poi_id", F.lit(f"{tag}{n}").alias("payload"), F.lit(n).cast("long").alias("row_seq"))

    old = rows(ids, "old", 1).unionByName(rows(ids, "old", 2))
    third = ids.where(F.col("poi_id") % 3 == 0)
    new = rows(third, "new", 1).unionByName(rows(third, "new", 2))
    return scans.incremental_merge(old, new, "poi_id", "row_seq")


@query("pending_ids", """
SELECT DISTINCT v.poi_id FROM v_visits v WHERE NOT EXISTS (SELECT 1 FROM v_pois p WHERE p.poi_id = v.poi_id AND p.rating IS NOT NULL)
ORDER BY poi_id LIMIT 250""")
def pending_ids(t):
    wanted = t.visits.select("poi_id").distinct()
    return scans.pending_ids(wanted, t.pois.where("rating IS NOT NULL").select("poi_id"), "poi_id", 250, "poi_id")


def _saved_routes(t):
    return t.raw("orders").select(
        F.col("o_orderkey").alias("route_id"), F.col("o_custkey").alias("user_id"),
        F.concat(F.lit("C"), (F.col("o_custkey") % 3 + 1).cast("string")).alias("city_id"),
        F.lower("o_orderstatus").alias("route_type"), F.col("o_orderdate").alias("created_at"))


_SAVED = "SELECT o_orderkey AS route_id, o_custkey AS user_id, 'C' || CAST(o_custkey % 3 + 1 AS VARCHAR) AS city_id, lower(o_orderstatus) AS route_type, o_orderdate AS created_at FROM orders"


@query("saved_routes_append", f"""
SELECT user_id, city_id, route_type, payload, count(*) AS n_rows, count(*) AS n_ids FROM
 (SELECT user_id, city_id, route_type, '{{"route_id":' || CAST(route_id AS VARCHAR) || ',"route_type":"' || route_type || '"}}' AS payload FROM ({_SAVED})) GROUP BY ALL""")
def saved_routes_append(t):
    """Ids and times are generated, so the rows are counted by what was given, with their distinct ids and those that have a time."""
    path = scratch_dir(t.spark) + "/saved"
    rows = _saved_routes(t).select("user_id", "city_id", "route_type", F.to_json(F.struct("route_id", "route_type")).alias("payload"))
    scans.append(scans.new_saved_routes(rows), path)
    return t.spark.read.parquet(path).where("created_at is not null").groupBy("user_id", "city_id", "route_type", "payload").agg(
        F.count("*").alias("n_rows"), F.count_distinct("route_id").alias("n_ids"))


@query("saved_routes_list", f"""
SELECT * FROM ({_SAVED}) WHERE city_id = 'C2' ORDER BY created_at DESC, route_id DESC LIMIT 1000""")
def saved_routes_list(t):
    return scans.list_saved_routes(_saved_routes(t), 5000, city_id="C2")


@query("saved_routes_delete", f"""
WITH s AS ({_SAVED}) SELECT 'kept' AS part, city_id, count(*) AS n FROM s WHERE city_id <> 'C1' GROUP BY city_id
UNION ALL SELECT 'deleted', 'C1', count(*) FROM s WHERE city_id = 'C1'""")
def saved_routes_delete(t):
    kept, gone = scans.delete_saved_routes(_saved_routes(t), city_id="C1")
    return kept.groupBy("city_id").agg(F.count("*").alias("n")).select(F.lit("kept").alias("part"), "city_id", "n").unionByName(
        gone.select(F.lit("deleted").alias("part"), F.lit("C1").alias("city_id"), F.col("deleted").alias("n")))


@query("geojson_export", """
WITH s AS (SELECT v.trail_id, v.poi_id, p.name, p.primary_category, p.rating, p.price_tier, p.lat, p.lon,
  row_number() OVER (PARTITION BY v.trail_id ORDER BY v.ts, v.seq, v.poi_id, v.tie) AS step
  FROM v_visits v JOIN v_pois p ON p.poi_id = v.poi_id WHERE p.lat IS NOT NULL)
SELECT trail_id, json_array_length(g, '$.features') = count(*) AS whole, CAST(count(*) AS BIGINT) AS n_features,
  json_extract_string(any_value(g), '$.features[0].properties.name') AS first_name, CAST(json_extract_string(any_value(g), '$.features[0].properties.order') AS BIGINT) AS first_order,
  json_extract_string(any_value(g), '$.type') AS kind, json_extract_string(any_value(g), '$.features[0].geometry.type') AS shape
FROM (SELECT s.*, (SELECT to_json({'type': 'FeatureCollection', 'features': list({'type': 'Feature', 'geometry': {'type': 'Point', 'coordinates': [lon, lat]},
   'properties': {'fsq_id': poi_id, 'name': name, 'primary_category': primary_category, 'rating': rating, 'price_tier': price_tier, 'order': step}} ORDER BY step)}) FROM s s2 WHERE s2.trail_id = s.trail_id) AS g FROM s)
GROUP BY trail_id, g""")
def geojson_export(t):
    stops = transitions.trail_positions(t.visits.join(t.pois.where("lat IS NOT NULL"), "poi_id"), "step")
    docs = scans.to_geojson(stops, "trail_id")
    sizes = stops.groupBy("trail_id").agg(F.count("*").alias("n_features"))
    g = lambda p: F.get_json_object("geojson", p)
    return docs.join(sizes, "trail_id").select(
        "trail_id", (F.json_array_length(g("$.features")) == F.col("n_features")).alias("whole"), "n_features",
        g("$.features[0].properties.name").alias("first_name"),
        g("$.features[0].properties.order").cast("long").alias("first_order"),
        g("$.type").alias("kind"), g("$.features[0].geometry.type").alias("shape"))


@query("records_export", """
SELECT poi_id, json_extract_string(j, '$.name') AS name, CAST(json_extract_string(j, '$.rating') AS DOUBLE) AS rating, json_exists(j, '$.rating') AS has_rating_key
FROM (SELECT poi_id, to_json({'poi_id': poi_id, 'name': name, 'rating': rating}) AS j FROM v_pois)""")
def records_export(t):
    rows = t.pois.select("poi_id", "name", F.coalesce("rating", F.lit(float("nan"))).alias("rating"))
    g = lambda p: F.get_json_object("record", p)
    return scans.to_records(rows).select(
        g("$.poi_id").cast("long").alias("poi_id"), g("$.name").alias("name"), g("$.rating").try_cast("double").alias("rating"),
        F.contains("record", F.lit('"rating":')).alias("has_rating_key"))


# ---------------------------------------------------------------- joins and set operations

@query("join_left_poi", """
SELECT c.poi_id, c.n AS score, p.name, p.city_id, p.primary_category, p.rating FROM (SELECT poi_id, count(*) AS n FROM v_visits GROUP BY poi_id) c LEFT JOIN v_pois p ON p.poi_id = c.poi_id""")
def join_left_poi(t):
    scores = features.item_counts(t.visits).withColumnRenamed("n_visits", "score")
    return scores.join(t.pois, "poi_id", "left").select("poi_id", "score", "name", "city_id", "primary_category", "rating")


@query("join_inner_visits_pois", """
SELECT v.trail_id, v.poi_id, v.seq, p.primary_category FROM v_visits v JOIN v_pois p ON p.poi_id = v.poi_id""")
def join_inner_visits_pois(t):
    return t.visits.join(t.pois, "poi_id").select("trail_id", "poi_id", "seq", "primary_category")


@query("join_left_visits_pois", """
SELECT v.trail_id, v.poi_id, v.seq, p.rating FROM v_visits v LEFT JOIN v_pois p ON p.poi_id = v.poi_id WHERE p.rating IS NOT NULL""")
def join_left_visits_pois(t):
    return t.visits.join(t.pois, "poi_id", "left").dropna(subset=["rating"]).select("trail_id", "poi_id", "seq", "rating")


@query("semi_join", """
SELECT trail_id, poi_id, seq FROM v_visits WHERE poi_id IN (SELECT poi_id FROM v_pois WHERE lat IS NOT NULL)""")
def semi_join(t):
    return t.visits.join(t.pois.where("lat IS NOT NULL"), "poi_id", "left_semi").select("trail_id", "poi_id", "seq")


@query("anti_join_seen", """
SELECT c.req_id, c.poi_id FROM (SELECT r.req_id, r.user_id, s.b AS poi_id FROM v_requests r JOIN (SELECT DISTINCT v1.poi_id AS a, v2.poi_id AS b FROM v_visits v1 JOIN v_visits v2 ON v1.trail_id = v2.trail_id AND v1.poi_id <> v2.poi_id) s ON s.a = r.current_poi) c
WHERE NOT EXISTS (SELECT 1 FROM v_visits v WHERE v.user_id = c.user_id AND v.poi_id = c.poi_id)""")
def anti_join_seen(t):
    pairs = features.cooccurrence(t.visits).select(F.col("a").alias("current_poi"), F.col("b").alias("poi_id"))
    cands = t.requests.select("req_id", "user_id", "current_poi").join(pairs, "current_poi").select("req_id", "user_id", "poi_id")
    seen = t.visits.select("user_id", "poi_id").distinct()
    return cands.join(seen, ["user_id", "poi_id"], "left_anti").select("req_id", "poi_id")


@query("self_join_trail", """
WITH d AS (SELECT DISTINCT trail_id, poi_id FROM v_visits)
SELECT a.trail_id, a.poi_id AS a, b.poi_id AS b FROM d a JOIN d b ON a.trail_id = b.trail_id AND a.poi_id < b.poi_id""")
def self_join_trail(t):
    return features.trail_pairs(t.visits)


@query("range_join_radius", """
SELECT r.req_id, p.poi_id, round(2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(p.lat - r.lat) / 2), 2) + cos(radians(r.lat)) * cos(radians(p.lat)) * pow(sin(radians(p.lon - r.lon) / 2), 2)))), 6) AS distance_km
FROM v_requests r, v_pois p WHERE r.lat IS NOT NULL AND p.lat IS NOT NULL
  AND 2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(p.lat - r.lat) / 2), 2) + cos(radians(r.lat)) * cos(radians(p.lat)) * pow(sin(radians(p.lon - r.lon) / 2), 2)))) <= 1.5""")
def range_join_radius(t):
    anchors = t.requests.select("req_id", F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"))
    return geo.radius_join(anchors, t.pois.select("poi_id", "lat", "lon"), 1.5).select("req_id", "poi_id", r6("distance_km").alias("distance_km"))


@query("union_ids", """
SELECT poi_id, count(*) AS n_sources FROM (SELECT DISTINCT poi_id FROM v_visits UNION ALL SELECT poi_id FROM v_pois WHERE rating IS NOT NULL UNION ALL SELECT poi_id FROM v_item_vectors) GROUP BY poi_id""")
def union_ids(t):
    ids = t.visits.select("poi_id").distinct().unionByName(t.pois.where("rating IS NOT NULL").select("poi_id")).unionByName(t.item_vectors.select("poi_id"))
    return ids.groupBy("poi_id").agg(F.count("*").alias("n_sources"))


@query("intersect_ids", "SELECT poi_id FROM v_visits INTERSECT SELECT poi_id FROM v_pois WHERE rating IS NOT NULL")
def intersect_ids(t):
    return t.visits.select("poi_id").intersect(t.pois.where("rating IS NOT NULL").select("poi_id"))


@query("except_ids", "SELECT poi_id FROM v_visits EXCEPT SELECT poi_id FROM v_pois WHERE rating IS NOT NULL")
def except_ids(t):
    return t.visits.select("poi_id").subtract(t.pois.where("rating IS NOT NULL").select("poi_id"))


@query("union_concat_dedup", """
SELECT poi_id, CASE WHEN price_tier = 1 THEN 'strict' ELSE 'soft' END AS source FROM v_pois WHERE price_tier = 1 OR rating > 6""")
def union_concat_dedup(t):
    strict = t.pois.where("price_tier = 1").select("poi_id", F.lit("strict").alias("source"))
    soft = t.pois.where("rating > 6").select("poi_id", F.lit("soft").alias("source"))
    rows = strict.withColumn("p", F.lit(0)).unionByName(soft.withColumn("p", F.lit(1)))
    return rows.groupBy("poi_id").agg(F.min_by("source", "p").alias("source"))


# ---------------------------------------------------------------- sort, limit, top-k

@query("topk_global", """
SELECT poi_id, count(*) AS n_visits FROM v_visits GROUP BY poi_id ORDER BY n_visits DESC, poi_id LIMIT 25""")
def topk_global(t):
    return features.item_counts(t.visits).orderBy(F.col("n_visits").desc(), "poi_id").limit(25)


_USER_COUNTS = "SELECT user_id, poi_id, count(*) AS n FROM v_visits GROUP BY user_id, poi_id"


@query("topk_per_case", f"""
SELECT user_id, poi_id, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, poi_id) AS rank FROM ({_USER_COUNTS})) WHERE rank <= 5""")
def topk_per_case(t):
    return numeric.top_per_group(features.interactions(t.visits), ["user_id"], numeric.by_score("n"), 5)


@query("topn_engine", f"""
SELECT user_id, poi_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, poi_id) AS rank FROM ({_USER_COUNTS})) WHERE rank <= 30""")
def topn_engine(t):
    return numeric.top_per_group(features.interactions(t.visits), ["user_id"], numeric.by_score("n"), 30).drop("n")


@query("candidate_pool", f"""
SELECT user_id, c.poi_id, rank FROM (SELECT u.*, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, u.poi_id) AS rank FROM ({_USER_COUNTS}) u JOIN v_pois p ON p.poi_id = u.poi_id WHERE p.lat IS NOT NULL) c WHERE rank <= 20""")
def candidate_pool(t):
    located = t.pois.where("lat IS NOT NULL").select("poi_id")
    rows = features.interactions(t.visits).join(located, "poi_id", "left_semi")
    return numeric.top_per_group(rows, ["user_id"], numeric.by_score("n"), 20).select("user_id", "poi_id", "rank")


@query("topk_diverse", f"""
WITH c AS (SELECT u.user_id, u.poi_id, u.n, p.primary_category AS category FROM ({_USER_COUNTS}) u JOIN v_pois p ON p.poi_id = u.poi_id),
d AS (SELECT *, row_number() OVER (PARTITION BY user_id, category ORDER BY n DESC, poi_id) AS cr FROM c)
SELECT user_id, poi_id, category, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, poi_id) AS rank FROM d WHERE cr <= 2) WHERE rank <= 10""")
def topk_diverse(t):
    from trailweave.operators.rerank import diverse_top_k

    rows = features.interactions(t.visits).join(t.pois.select("poi_id", F.col("primary_category").alias("category")), "poi_id")
    return diverse_top_k(rows, ["user_id"], "n", "category", 10, 2).select("user_id", "poi_id", "category", "rank")


@query("case_sample", """
SELECT user_id, md5(concat_ws(':', '42', CAST(user_id AS VARCHAR))) AS draw FROM (SELECT DISTINCT user_id FROM v_visits) ORDER BY draw, user_id LIMIT 300""")
def case_sample(t):
    from trailweave.operators.splits import sample_cases

    return sample_cases(t.visits.select("user_id").distinct(), "user_id", 42, 300)


# ---------------------------------------------------------------- scalar functions

_HAV = "CASE WHEN {a}.lat + {a}.lon + {b}.lat + {b}.lon IS NOT NULL THEN 2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2)))) END"


@query("haversine_km", f"""
SELECT r.req_id, round({_HAV.format(a='r', b='p')}, 6) AS km, round({_HAV.format(a='r', b='p')}, 6) AS km_atan2
FROM v_requests r JOIN v_pois p ON p.poi_id = r.req_id WHERE r.lat IS NOT NULL AND p.lat IS NOT NULL""")
def haversine_km(t):
    pair = t.requests.select("req_id", F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon")).join(t.pois, F.col("req_id") == F.col("poi_id"))
    args = (F.col("r_lat"), F.col("r_lon"), F.col("lat"), F.col("lon"))
    return pair.where("r_lat IS NOT NULL AND lat IS NOT NULL").select(
        "req_id", r6(geo.haversine_km(*args)).alias("km"), r6(geo.haversine_km_atan2(*args)).alias("km_atan2"))


@query("norm_text", r"""
SELECT doc_id, regexp_replace(regexp_replace(strip_accents(lower(trim(text, ' '))), '[\x{0300}-\x{036F}]', '', 'g'), '[ \t\n\x{0B}\f\r]+', ' ', 'g') AS norm FROM documents""")
def norm_text(t):
    return t.raw("documents").select("doc_id", text.norm_text(F.col("text")).alias("norm"))


@query("null_like", """
SELECT p_partkey AS poi_id, CASE WHEN lower(trim(v)) IN ('', 'nan', 'none', 'null') THEN NULL ELSE trim(v) END AS v
FROM (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN ' NaN ' WHEN 1 THEN 'None' WHEN 2 THEN 'null' WHEN 3 THEN '  ' WHEN 4 THEN NULL ELSE ' ' || p_brand || ' ' END AS v FROM part)""")
def null_like(t):
    m = F.col("p_partkey") % 6
    v = F.when(m == 0, " NaN ").when(m == 1, "None").when(m == 2, "null").when(m == 3, "  ").when(m == 5, F.concat(F.lit(" "), "p_brand", F.lit(" ")))
    return t.raw("part").select(F.col("p_partkey").alias("poi_id"), text.null_like(v).alias("v"))


@query("decay", """
SELECT poi_id, round(exp(-pow(d - 1.2, 2) / (2 * 0.85 * 0.85)), 6) AS gauss, round(exp(-0.8 * d), 6) AS fade FROM (SELECT poi_id, total_ratings / 100.0 AS d FROM v_pois)""")
def decay(t):
    from trailweave.operators.rerank import exp_decay, gauss

    d = F.col("total_ratings") / 100.0
    return t.pois.select("poi_id", r6(gauss(d, F.lit(1.2), F.lit(0.85))).alias("gauss"), r6(exp_decay(d, F.lit(0.8))).alias("fade"))


@query("log_norm", """
SELECT poi_id, round(ln(1 + total_ratings) / (ln(1 + max(total_ratings) OVER ()) + 1e-8), 6) AS x FROM v_pois""")
def log_norm(t):
    biggest = t.pois.agg(F.max("total_ratings").alias("m"))
    rows = t.pois.select("poi_id", "total_ratings").join(F.broadcast(biggest), F.lit(True))
    return rows.select("poi_id", r6(numeric.log_norm(F.col("total_ratings"), F.col("m"))).alias("x"))


@query("budget_to_tier", """
SELECT c_custkey AS user_id, CASE WHEN b = 'low' THEN 1 WHEN b = 'medium' THEN 2 ELSE 3 END AS tier FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE c_mktsegment END AS b FROM customer)""")
def budget_to_tier(t):
    from trailweave.operators.prefs import budget_to_tier as tier

    m = F.col("c_custkey") % 3
    budget = F.when(m == 0, "low").when(m == 1, "medium").otherwise(F.col("c_mktsegment"))
    return t.raw("customer").select(F.col("c_custkey").alias("user_id"), tier(budget).alias("tier"))


@query("timestamp_functions", """
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, CAST(hour(ts) AS INT) AS hour, CAST((isodow(ts) - 1) AS INT) AS dow FROM events""")
def timestamp_functions(t):
    parsed = F.try_to_timestamp(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("yyyy-MM-dd HH:mm:ss"))
    return t.raw("events").select(
        "event_id", F.date_format(parsed, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"), F.hour(parsed).alias("hour"), F.weekday(parsed).alias("dow"))


@query("string_functions", """
SELECT poi_id, starts_with(name, 'part') AS starts, replace(name, ' ', '') AS packed, lower(name) AS lowered, CAST(len(string_split(name, ' ')) AS BIGINT) AS words,
  contains(lower(primary_category), 'port') AS has_port, trim(name) AS trimmed FROM v_pois""")
def string_functions(t):
    return t.pois.select(
        "poi_id", F.startswith("name", F.lit("part")).alias("starts"), F.replace("name", F.lit(" "), F.lit("")).alias("packed"),
        F.lower("name").alias("lowered"), F.size(F.split("name", " ")).cast("long").alias("words"),
        F.contains(F.lower("primary_category"), F.lit("port")).alias("has_port"), F.trim("name").alias("trimmed"))


@query("array_json_functions", """
SELECT poi_id, CAST(array_to_string(list_reverse(l), '|') AS VARCHAR) AS reversed, array_to_string(list_slice(list_append(l, 'x'), -2, -1), '|') AS tail,
  list_contains(l, 'Park') AS has_park, CAST(to_json({'a': l[1], 'n': len(l)}) AS VARCHAR) AS doc
FROM (SELECT poi_id, list(category_name ORDER BY ord) AS l FROM v_poi_categories GROUP BY poi_id)""")
def array_json_functions(t):
    lists = t.poi_categories.groupBy("poi_id").agg(F.array_sort(F.collect_list(F.struct("ord", "category_name"))).alias("s"))
    arr = F.transform("s", lambda x: x["category_name"])
    tail = F.array_append(arr, F.lit("x"))
    return lists.select(
        "poi_id", F.array_join(F.reverse(arr), "|").alias("reversed"), F.array_join(F.slice(tail, -2, 2), "|").alias("tail"),
        F.array_contains(arr, "Park").alias("has_park"), F.to_json(F.struct(arr[0].alias("a"), F.size(arr).alias("n"))).alias("doc"))


@query("hash_seed", """
SELECT user_id, CAST(('0x' || substr(md5(concat_ws(':', '42', 'user', CAST(user_id AS VARCHAR))), 1, 8)) AS BIGINT) AS seed FROM (SELECT DISTINCT user_id FROM v_visits)""")
def hash_seed(t):
    return t.visits.select("user_id").distinct().select("user_id", numeric.draw(42, F.lit("user"), F.col("user_id")).alias("seed"))
