"""Queries: cleaning, enrichment and imputation."""
from __future__ import annotations

from pyspark.sql import functions as F

from trailweave.catalog.oracle_views import add_view
from trailweave.catalog.registry import query
from trailweave.functions import geo, numeric, text
from trailweave.functions.numeric import r6
from trailweave.operators import cleaning, labels
from trailweave.session import scratch_dir
from trailweave.sources import scans

VALID = ["wd:C1", "wd:C2"]

add_view("v_clean_visits", """
SELECT trail_id, user_id, replace(trim(venue_id), 'foursquare:', '') AS venue_id, replace(venue_category, 'schema:', '') AS venue_category,
  replace(venue_schema, 'schema:', '') AS venue_schema, replace(venue_city, 'wd:', '') AS venue_city, replace(venue_country, 'wd:', '') AS venue_country,
  strftime(TRY_CAST("timestamp" AS TIMESTAMP), '%Y-%m-%dT%H:%M:%SZ') AS "timestamp", TRY_CAST("timestamp" AS TIMESTAMP) AS ts, seq, tie
FROM v_raw_checkins WHERE venue_city IN ('wd:C1', 'wd:C2') AND venue_id IS NOT NULL AND "timestamp" IS NOT NULL AND TRY_CAST("timestamp" AS TIMESTAMP) IS NOT NULL""")


@query("strip_prefix", r"""
SELECT CAST(trail_id AS BIGINT) AS trail_id, seq, regexp_replace(trim(venue_id), '^foursquare:', '') AS venue_id, regexp_replace(venue_category, '^schema:', '') AS venue_category,
  regexp_replace(venue_city, '^wd:', '') AS venue_city FROM v_raw_checkins""")
def strip_prefix(t):
    return t.raw_checkins.select(
        F.col("trail_id").cast("long").alias("trail_id"), "seq", text.clean_id(F.col("venue_id")).alias("venue_id"),
        text.normalize_field(F.col("venue_category")).alias("venue_category"), text.clean_id(F.col("venue_city"), "wd:").alias("venue_city"))


@query("clean_visits", "SELECT trail_id, user_id, venue_id, venue_category, venue_schema, venue_city, venue_country, \"timestamp\" AS ts_text, seq FROM v_clean_visits")
def clean_visits(t):
    out = cleaning.clean_visits(t.raw_checkins, VALID)
    return out.select("trail_id", "user_id", *cleaning.TEXT_COLUMNS, F.col("timestamp").alias("ts_text"), "seq")


@query("dense_reindex", """
WITH f AS (SELECT CAST(user_id AS BIGINT) AS user_id, min(CAST(trail_id AS BIGINT) * 100 + seq) AS f FROM v_clean_visits GROUP BY 1)
SELECT user_id, row_number() OVER (ORDER BY f, user_id) AS new_id FROM f""")
def dense_reindex(t):
    rows = cleaning.clean_visits(t.raw_checkins, VALID).select(
        F.col("user_id").cast("long").alias("user_id"), (F.col("trail_id").cast("long") * 100 + F.col("seq")).alias("row_seq"))
    return cleaning.dense_reindex(rows, "user_id", "row_seq", "new_id")


@query("extract_city_ids", """
SELECT replace(trim(venue_id), 'foursquare:', '') AS venue_id, min(CAST(trail_id AS BIGINT) * 100 + seq) AS first_seen FROM v_raw_checkins
WHERE venue_city = 'wd:C2' AND venue_id IS NOT NULL GROUP BY 1""")
def extract_city_ids(t):
    rows = t.raw_checkins.withColumn("row_seq", F.col("trail_id").cast("long") * 100 + F.col("seq"))
    return cleaning.extract_city_ids(rows, "wd:C2", "row_seq")


add_view("v_norm_pois", """
SELECT 'foursquare:' || CAST(poi_id AS VARCHAR) AS fsq_id,
  CASE WHEN poi_id % 4 = 1 THEN 'n' || CAST(poi_id AS VARCHAR) WHEN poi_id % 11 <> 0 THEN primary_category ELSE 'POI-foursquare:' || CAST(poi_id AS VARCHAR) END AS name,
  lat, lon, CASE WHEN poi_id % 6 = 1 THEN city_id END AS city, CASE WHEN poi_id % 6 = 1 THEN 'JP' END AS country,
  CASE WHEN poi_id % 5 IN (1, 2) THEN CAST(total_ratings AS DOUBLE) END AS total_ratings,
  CASE WHEN poi_id % 4 IN (0, 2) THEN CAST(poi_id % 5 AS DOUBLE) END AS price,
  CASE WHEN poi_id % 11 <> 0 THEN primary_category END AS primary_category, CASE WHEN poi_id % 11 <> 0 THEN 1 ELSE 0 END AS n_categories
FROM v_pois""")


def _norm(t):
    docs = t.raw_pois.select(F.from_json("doc", scans.RAW_POI_SCHEMA).alias("d")).select("d.*")
    return cleaning.normalize_pois(docs)


@query("normalize_poi", """
SELECT fsq_id, name, round(lat, 6) AS lat, round(lon, 6) AS lon, city, country, total_ratings, price, primary_category, n_categories FROM v_norm_pois""")
def normalize_poi(t):
    return _norm(t).select("fsq_id", "name", r6("lat").alias("lat"), r6("lon").alias("lon"), "city", "country", "total_ratings", "price",
                           "primary_category", F.size("categories").alias("n_categories"))


_MERGED = """
SELECT COALESCE(a.fsq_id, b.fsq_id) AS fsq_id, CASE WHEN a.fsq_id IS NULL THEN b.name ELSE COALESCE(NULLIF(b.name, ''), a.name) END AS name,
  CASE WHEN a.fsq_id IS NULL THEN b.city ELSE COALESCE(NULLIF(b.city, ''), a.city) END AS city, COALESCE(b.price, a.price) AS price,
  CASE WHEN a.fsq_id IS NULL THEN b.n ELSE CASE WHEN b.n > 0 THEN b.n ELSE a.n END END AS n_categories
FROM (SELECT fsq_id, name, city, price, n_categories AS n FROM v_norm_pois WHERE price IS NULL OR price < 4) a
FULL OUTER JOIN (SELECT fsq_id, CASE WHEN n_categories = 0 THEN '' ELSE upper(name) END AS name, COALESCE(city, '') AS city, price + 1 AS price, CASE WHEN city IS NULL THEN n_categories ELSE 0 END AS n
  FROM v_norm_pois WHERE price IS NOT NULL) b ON a.fsq_id = b.fsq_id"""


def _merge(t):
    n = _norm(t).select("fsq_id", "name", "city", "price", "categories")
    first = n.where("price IS NULL OR price < 4")
    second = n.where("price IS NOT NULL").select(
        "fsq_id", F.when(F.size("categories") == 0, "").otherwise(F.upper("name")).alias("name"), F.coalesce("city", F.lit("")).alias("city"),
        (F.col("price") + 1).alias("price"), F.when(F.col("city").isNull(), F.col("categories")).otherwise(F.slice("categories", 1, 0)).alias("categories"))
    return cleaning.merge_poi_sources(first, second)


@query("merge_poi_sources", _MERGED)
def merge_poi_sources(t):
    return _merge(t).select("fsq_id", "name", "city", "price", F.size("categories").alias("n_categories"))


@query("join_full_outer_merge", f"SELECT fsq_id, name, n_categories FROM ({_MERGED})")
def join_full_outer_merge(t):
    return _merge(t).select("fsq_id", "name", F.size("categories").alias("n_categories"))


@query("valid_latlon", """
SELECT poi_id, COALESCE(TRY_CAST(la AS DOUBLE) BETWEEN -90 AND 90 AND TRY_CAST(lo AS DOUBLE) BETWEEN -180 AND 180, false) AS ok
FROM (SELECT poi_id, CASE poi_id % 5 WHEN 0 THEN 'x' WHEN 1 THEN '95.5' WHEN 2 THEN NULL ELSE '34.5' END AS la, CASE poi_id % 3 WHEN 0 THEN '181' ELSE '-179.9' END AS lo FROM v_pois)""")
def valid_latlon(t):
    m = F.col("poi_id") % 5
    la = F.when(m == 0, "x").when(m == 1, "95.5").when(m >= 3, "34.5")
    lo = F.when(F.col("poi_id") % 3 == 0, "181").otherwise("-179.9")
    return t.pois.select("poi_id", la.alias("la"), lo.alias("lo")).select("poi_id", geo.valid_latlon(F.col("la"), F.col("lo")).alias("ok"))


@query("safe_int", """
SELECT p_partkey AS poi_id, CAST(round_even(TRY_CAST(v AS DOUBLE), 0) AS BIGINT) AS n
FROM (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_brand ELSE CAST(p_size / 2.0 AS VARCHAR) END AS v FROM part)""")
def safe_int(t):
    v = F.when(F.col("p_partkey") % 4 == 0, F.col("p_brand")).otherwise((F.col("p_size") / 2.0).cast("string"))
    return t.raw("part").select(F.col("p_partkey").alias("poi_id"), v.alias("v")).select("poi_id", numeric.safe_int(F.col("v")).alias("n"))


@query("keep_valid_pois", """
SELECT fsq_id, COALESCE(NULLIF(trim(city), ''), 'Osaka') AS city, COALESCE(country, 'Japan') AS country FROM v_norm_pois WHERE n_categories > 0 AND lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180""")
def keep_valid_pois(t):
    return cleaning.keep_valid_pois(_norm(t), "Osaka", "Japan").select("fsq_id", "city", "country")


@query("prune_visits", """
SELECT trail_id, seq, poi_id FROM v_visits v WHERE venue_city <> 'C1' OR EXISTS (SELECT 1 FROM v_pois p WHERE p.poi_id = v.poi_id AND p.rating IS NOT NULL)""")
def prune_visits(t):
    return cleaning.prune_visits(t.visits, t.pois.where("rating IS NOT NULL"), "C1").select("trail_id", "seq", "poi_id")


def _alias_input(t):
    m = F.col("c_custkey") % 6
    alias = (F.when(m == 0, " Osaka ").when(m == 1, "ISTANBUL").when(m == 2, "Petaling Jaya").when(m == 3, "petaling  jaya")
             .when(m == 4, "Estambul").otherwise(F.col("c_mktsegment")))
    return t.raw("customer").select(F.col("c_custkey").alias("user_id"), alias.alias("city_text"))


@query("city_alias", """
WITH i AS (SELECT c_custkey AS user_id, CASE c_custkey % 6 WHEN 0 THEN ' Osaka ' WHEN 1 THEN 'ISTANBUL' WHEN 2 THEN 'Petaling Jaya' WHEN 3 THEN 'petaling  jaya' WHEN 4 THEN 'Estambul' ELSE c_mktsegment END AS city_text FROM customer),
a AS (SELECT * FROM (VALUES ('osaka', 'Q35765', 'Osaka', 'Japan'), ('istanbul', 'Q406', 'Istanbul', 'Turkey'), ('estambul', 'Q406', 'Istanbul', 'Turkey'), ('petalingjaya', 'Q864965', 'Petaling Jaya', 'Malaysia'), ('petaling jaya', 'Q864965', 'Petaling Jaya', 'Malaysia')) AS t(k, q, n, c))
SELECT i.user_id, i.city_text, COALESCE(a1.q, a2.q) AS city_qid, COALESCE(a1.n, a2.n) AS city_name, COALESCE(a1.c, a2.c) AS country
FROM i LEFT JOIN a a1 ON a1.k = lower(trim(i.city_text)) LEFT JOIN a a2 ON a2.k = replace(lower(trim(i.city_text)), ' ', '')""")
def city_alias(t):
    good, bad = cleaning.resolve_city(_alias_input(t), "city_text", cleaning.alias_table(t.spark))
    none = F.lit(None).cast("string")
    return good.drop("file_key").unionByName(bad.select("*", none.alias("city_qid"), none.alias("city_name"), none.alias("country")))


@query("canonical_city", """
SELECT user_id, CASE WHEN c IN ('梅田', '北区', 'Osaka') THEN 'Osaka' ELSE c END AS city
FROM (SELECT c_custkey AS user_id, CASE c_custkey % 4 WHEN 0 THEN '梅田' WHEN 1 THEN '北区' WHEN 2 THEN 'Osaka' ELSE c_mktsegment END AS c FROM customer)""")
def canonical_city(t):
    m = F.col("c_custkey") % 4
    city = F.when(m == 0, "梅田").when(m == 1, "北区").when(m == 2, "Osaka").otherwise(F.col("c_mktsegment"))
    rows = t.raw("customer").select(F.col("c_custkey").alias("user_id"), city.alias("city"))
    return rows.select("user_id", cleaning.canonical_city("city").alias("city"))


FORCED_FREE, FORCED_PAID = ["c01", "c09", "c19", "c02"], ["c02", "c04", "c14"]
add_view("v_forced", """
SELECT DISTINCT category_name AS name, 'free' AS forced FROM v_poi_categories WHERE category_id IN ('c01', 'c09', 'c19', 'c02')
UNION SELECT DISTINCT category_name, 'paid' FROM v_poi_categories WHERE category_id IN ('c02', 'c04', 'c14')""")


@query("forced_name_sets", "SELECT name, forced FROM v_forced")
def forced_name_sets(t):
    return labels.forced_name_sets(t.poi_categories, FORCED_FREE, FORCED_PAID)


_FREE_SQL = " OR ".join(f"contains(lower(name), '{x}')" for x in labels.FREE_FRAGMENTS)
_PAID_SQL = " OR ".join(f"contains(lower(name), '{x}')" for x in labels.PAID_FRAGMENTS)
add_view("v_forced_labels", f"""
SELECT label_id, name, CASE WHEN f THEN true WHEN p THEN false ELSE free END AS free, CASE WHEN f THEN 0 WHEN p THEN COALESCE(price_tier, 2) ELSE price_tier END AS price_tier,
  CASE WHEN f THEN COALESCE(source, 'force_name_free') WHEN p THEN COALESCE(source, 'force_name_paid') ELSE source END AS source
FROM (SELECT l.*, (name IN (SELECT name FROM v_forced WHERE forced = 'free') OR {_FREE_SQL}) AS f, (name IN (SELECT name FROM v_forced WHERE forced = 'paid') OR {_PAID_SQL}) AS p FROM v_labels l WHERE l.label_id NOT LIKE 'alt::%' OR l.free)
UNION ALL
SELECT 'name_' || forced || '::' || name, name, forced = 'free', CASE WHEN forced = 'free' THEN 0 ELSE 2 END, 'force_name_' || forced
FROM v_forced WHERE name NOT IN (SELECT name FROM v_labels l WHERE l.label_id NOT LIKE 'alt::%' OR l.free)""")


@query("force_labels", "SELECT * FROM v_forced_labels")
def force_labels(t):
    given = t.price_labels.where(~F.startswith("label_id", F.lit("alt::")) | F.col("free"))
    return labels.force_labels(given, labels.forced_name_sets(t.poi_categories, FORCED_FREE, FORCED_PAID))


add_view("v_medians", """
SELECT c.category_id, median(CASE WHEN p.price_tier BETWEEN 0 AND 4 THEN CAST(p.price_tier AS DOUBLE) END) AS med_price, median(p.rating) AS med_rating, median(CAST(p.total_ratings AS DOUBLE)) AS med_total
FROM v_poi_categories c JOIN v_pois p ON p.poi_id = c.poi_id GROUP BY c.category_id""")


@query("category_medians", "SELECT category_id, round(med_price, 6) AS med_price, round(med_rating, 6) AS med_rating, round(med_total, 6) AS med_total FROM v_medians")
def category_medians(t):
    return labels.category_medians(t.poi_categories, t.pois).select("category_id", *[r6(c).alias(c) for c in ("med_price", "med_rating", "med_total")])


@query("impute_price", """
WITH n AS (SELECT lower(trim(name)) AS ln, bool_or(free) AS nf, arg_min(price_tier, label_id) FILTER (WHERE price_tier IS NOT NULL) AS nt FROM v_labels GROUP BY 1),
j AS (SELECT c.poi_id, c.ord, l.free AS idf, l.price_tier AS idt, n.nf, n.nt, m.med_price FROM v_poi_categories c LEFT JOIN v_labels l ON l.label_id = c.category_id
  LEFT JOIN n ON n.ln = lower(trim(c.category_name)) LEFT JOIN v_medians m ON m.category_id = c.category_id),
g AS (SELECT poi_id, COALESCE(bool_or(idf), false) AS idf, arg_min(idt, ord) FILTER (WHERE idt IS NOT NULL) AS idt,
  arg_min(COALESCE(nf, false), ord) FILTER (WHERE nf OR nt IS NOT NULL) AS nf, arg_min({'t': nt}, ord) FILTER (WHERE nf OR nt IS NOT NULL) AS nt, arg_min(med_price, ord) FILTER (WHERE med_price IS NOT NULL) AS med FROM j GROUP BY poi_id),
r AS (SELECT p.poi_id, p.price_tier, (g.idf OR (g.idt IS NULL AND COALESCE(g.nf, false))) AS f, COALESCE(g.idt, g.nt.t, CAST(round_even(g.med, 0) AS INT)) AS tr FROM v_pois p LEFT JOIN g ON g.poi_id = p.poi_id)
SELECT poi_id, CASE WHEN f THEN 0 ELSE COALESCE(tr, price_tier) END AS price_tier, (f OR COALESCE(tr = 0, false)) AS is_free FROM r""")
def impute_price(t):
    med = labels.category_medians(t.poi_categories, t.pois)
    return labels.impute_price(t.pois, t.poi_categories, t.price_labels, med)


@query("impute_rating_counts", """
WITH g AS (SELECT c.poi_id, arg_min(m.med_rating, c.ord) FILTER (WHERE m.med_rating IS NOT NULL) AS mr, arg_min(m.med_total, c.ord) FILTER (WHERE m.med_total IS NOT NULL) AS mt
 FROM v_poi_categories c JOIN v_medians m ON m.category_id = c.category_id GROUP BY c.poi_id)
SELECT p.poi_id, round(COALESCE(p.rating, g.mr), 6) AS rating, CAST(COALESCE(CASE WHEN p.total_ratings % 3 <> 0 THEN p.total_ratings END, round_even(g.mt, 0), 0) AS BIGINT) AS total_ratings
FROM v_pois p LEFT JOIN g ON g.poi_id = p.poi_id""")
def impute_rating_counts(t):
    med = labels.category_medians(t.poi_categories, t.pois)
    pois = t.pois.withColumn("total_ratings", F.when(F.col("total_ratings") % 3 != 0, F.col("total_ratings")))
    return labels.impute_rating_counts(pois, t.poi_categories, med).select("poi_id", r6("rating").alias("rating"), "total_ratings")


@query("fill_latlon", """
SELECT c.poi_id, c.n, round(p.lat, 6) AS lat, round(p.lon, 6) AS lon FROM (SELECT poi_id, count(*) AS n FROM v_visits GROUP BY poi_id) c LEFT JOIN v_pois p ON p.poi_id = c.poi_id""")
def fill_latlon(t):
    rows = t.visits.groupBy("poi_id").agg(F.count("*").alias("n"))
    return cleaning.fill_latlon(rows, t.pois).select("poi_id", "n", r6("lat").alias("lat"), r6("lon").alias("lon"))


@query("coalesce_latlon_names", "SELECT poi_id, lat, lon FROM v_pois")
def coalesce_latlon_names(t):
    renamed = t.pois.select("poi_id", F.col("lat").alias("lat_x"), (F.col("lat") + 1).alias("latitude"), F.col("lon").alias("lng"))
    return cleaning.coalesce_latlon_names(renamed).select("poi_id", "lat", "lon")


@query("prepare_bundle", """
SELECT 'visit' AS part, CAST(trail_id AS BIGINT) * 100 + seq AS id, replace(trim(venue_id), 'foursquare:', '') AS a, replace(venue_city, 'wd:', '') AS b, TRY_CAST("timestamp" AS TIMESTAMP) AS ts, CAST(NULL AS DOUBLE) AS x FROM v_raw_checkins
UNION ALL SELECT 'poi', poi_id, name, city_id, NULL, CAST(price_tier AS DOUBLE) FROM v_pois""")
def prepare_bundle(t):
    v = cleaning.prepare_visits(t.raw_checkins).select(
        F.lit("visit").alias("part"), (F.col("trail_id").cast("long") * 100 + F.col("seq")).alias("id"), F.col("venue_id").alias("a"),
        F.col("venue_city").alias("b"), F.col("timestamp").alias("ts"), F.lit(None).cast("double").alias("x"))
    texty = t.pois.withColumn("price_tier", F.coalesce(F.col("price_tier").cast("string"), F.lit("n/a")))
    p = cleaning.prepare_pois(texty).select(F.lit("poi").alias("part"), F.col("poi_id").alias("id"), F.col("name").alias("a"), F.col("city_id").alias("b"),
                                            F.lit(None).cast("timestamp").alias("ts"), F.col("price_tier").alias("x"))
    return v.unionByName(p)


@query("label_eval", """
WITH tr AS (SELECT DISTINCT category_id AS label_id, category_id IN ('c01', 'c09', 'c13', 'c18', 'c19') AS gt_free, CASE WHEN category_id < 'c10' THEN 1 END AS gt_tier FROM v_poi_categories),
j AS (SELECT tr.*, l.name, COALESCE(l.free, false) AS pred, l.price_tier FROM tr LEFT JOIN v_labels l ON l.label_id = tr.label_id),
c AS (SELECT count(*) AS n_truth, count(*) FILTER (WHERE name IS NOT NULL AND gt_free AND pred) AS tp, count(*) FILTER (WHERE name IS NOT NULL AND NOT gt_free AND pred) AS fp,
 count(*) FILTER (WHERE name IS NOT NULL AND gt_free AND NOT pred) AS fn, count(*) FILTER (WHERE name IS NOT NULL AND NOT gt_free AND NOT pred) AS tn,
 count(*) FILTER (WHERE name IS NOT NULL AND gt_tier IS NOT NULL AND NOT pred AND price_tier IS NOT NULL) AS n_tier,
 count(*) FILTER (WHERE name IS NOT NULL AND gt_tier IS NOT NULL AND NOT pred AND price_tier = gt_tier) AS tier_ok FROM j),
r AS (SELECT *, COALESCE(tp / NULLIF(tp + fp, 0), 0.0) AS precision, COALESCE(tp / NULLIF(tp + fn, 0), 0.0) AS recall FROM c)
SELECT n_truth, tp, fp, fn, tn, n_tier, tier_ok, round(precision, 6) AS precision, round(recall, 6) AS recall, round(COALESCE(2 * precision * recall / NULLIF(precision + recall, 0), 0.0), 6) AS f1,
 round(COALESCE(tier_ok / NULLIF(n_tier, 0), 0.0), 6) AS tier_accuracy FROM r""")
def label_eval(t):
    truth = t.poi_categories.select(F.col("category_id").alias("label_id")).distinct().select(
        "label_id", F.col("label_id").isin("c01", "c09", "c13", "c18", "c19").alias("gt_free"), F.when(F.col("label_id") < "c10", 1).alias("gt_tier"))
    out = labels.label_eval(t.price_labels, truth)
    return out.withColumns({c: r6(c) for c in ("precision", "recall", "f1", "tier_accuracy")})


@query("label_crosscheck", """
WITH j AS (SELECT l.*, m.med_price, m.med_price = 0 AS gt, CAST(round_even(m.med_price, 0) AS INT) AS gtt FROM v_labels l JOIN v_medians m ON m.category_id = l.label_id WHERE m.med_price IS NOT NULL AND l.label_id NOT IN ('c01', 'c02')),
c AS (SELECT count(*) AS n_tested, count(*) FILTER (WHERE gt AND free) AS tp, count(*) FILTER (WHERE NOT gt AND free) AS fp, count(*) FILTER (WHERE gt AND NOT free) AS fn, count(*) FILTER (WHERE NOT gt AND NOT free) AS tn,
 count(*) FILTER (WHERE NOT gt AND NOT free AND price_tier IS NOT NULL) AS n_tier, count(*) FILTER (WHERE NOT gt AND NOT free AND price_tier = gtt) AS tier_ok,
 COALESCE(sum(abs(price_tier - gtt)) FILTER (WHERE NOT gt AND NOT free), 0) AS diff FROM j),
r AS (SELECT *, COALESCE(tp / NULLIF(tp + fp, 0), 0.0) AS precision, COALESCE(tp / NULLIF(tp + fn, 0), 0.0) AS recall FROM c)
SELECT n_tested, tp, fp, fn, tn, n_tier, tier_ok, round(precision, 6) AS precision, round(recall, 6) AS recall, round(COALESCE(2 * precision * recall / NULLIF(precision + recall, 0), 0.0), 6) AS f1,
 round(COALESCE(tier_ok / NULLIF(n_tier, 0), 0.0), 6) AS tier_accuracy, round(CAST(COALESCE(diff / NULLIF(n_tier, 0), 0.0) AS DOUBLE), 6) AS mae FROM r""")
def label_crosscheck(t):
    out = labels.label_crosscheck(t.price_labels, t.poi_categories, t.pois, ["c01", "c02"])
    return out.withColumns({c: r6(c) for c in ("precision", "recall", "f1", "tier_accuracy", "mae")})
