"""Queries: fusion of engine scores."""
from __future__ import annotations

from pyspark.sql import functions as F

from trailweave.catalog.engines import _recent, ucases
from trailweave.catalog.oracle_views import add_view
from trailweave.catalog.registry import query, shared
from trailweave.functions.numeric import r9
from trailweave.operators import engines as eng
from trailweave.operators import features, fusion
from trailweave.operators import transitions as tr
from trailweave.session import materialize

add_view("v_escores", """
SELECT case_id, 'markov' AS engine, poi_id, score / max(score) OVER (PARTITION BY case_id) AS score FROM v_umarkov
UNION ALL SELECT case_id, 'embed', poi_id, score / max(score) OVER (PARTITION BY case_id) FROM v_uembed
UNION ALL SELECT case_id, 'als', poi_id, score / max(score) OVER (PARTITION BY case_id) FROM (SELECT case_id, poi_id, score FROM v_als_known) x""")
add_view("v_mcase", "SELECT case_id, CASE case_id % 4 WHEN 0 THEN 'hybrid' WHEN 1 THEN 'markov' WHEN 2 THEN 'embed' ELSE 'als' END AS mode FROM v_ucase")


@shared
def scores(t):
    cases, history = ucases(t)
    markov = eng.markov2_backoff(cases, tr.transitions_poi(t.visits), tr.transitions_order2(t.visits), 100)
    ctx = tr.last_n_rows(_recent(t), cases.select("case_id", "current_poi"), 8).select("case_id", "poi_id")
    embed = eng.embed_context(ctx, t.item_vectors, 50)
    known = cases.join(t.user_vectors.select("user_id"), "user_id", "left_semi")
    als = eng.als_score(known, history.join(known.select("case_id"), "case_id", "left_semi"), t.user_vectors, t.item_vectors, 50).withColumn("score", r9("score"))
    out = None
    for name, df in (("markov", markov), ("embed", embed), ("als", als)):
        one = eng.max_normalize(df).select("case_id", F.lit(name).alias("engine"), "poi_id", "score")
        out = one if out is None else out.unionByName(one)
    return materialize(out)


def mode_cases(t):
    m = F.col("case_id") % 4
    mode = F.when(m == 0, "hybrid").when(m == 1, "markov").when(m == 2, "embed").otherwise("als")
    return ucases(t)[0].withColumn("mode", mode)


@query("engine_gating", """
WITH g AS (SELECT s.*, max(s.score) OVER (PARTITION BY s.case_id, s.engine) AS m FROM v_escores s JOIN v_mcase c USING (case_id)
 WHERE (s.engine = 'markov' AND c.mode IN ('hybrid', 'markov', 'embed')) OR (s.engine = 'embed' AND c.mode IN ('hybrid', 'embed')) OR (s.engine = 'als' AND c.mode IN ('hybrid', 'als')))
SELECT case_id, engine, poi_id, round(score / m, 9) AS score FROM g WHERE m > 0 AND poi_id IN (SELECT poi_id FROM v_pois WHERE rating IS NOT NULL)""")
def engine_gating(t):
    out = fusion.engine_gating(scores(t), mode_cases(t), t.pois.where("rating IS NOT NULL"))
    return out.select("case_id", "engine", "poi_id", r9("score").alias("score"))


add_view("v_flags", """
SELECT r.req_id AS case_id, r.user_id IS NOT NULL AS has_user, (r.current_poi IS NOT NULL OR s.poi_id IS NOT NULL) AS has_current, r.req_id % 2 = 0 AS has_embed, r.req_id % 3 = 0 AS has_als
FROM v_requests r LEFT JOIN v_snap s ON s.req_id = r.req_id""")


@query("weight_selection", "".join([
    "WITH s AS (SELECT *, CASE WHEN has_user AND has_current THEN 'user_current' WHEN has_user THEN 'user_only' WHEN has_current THEN 'current_only' WHEN has_embed OR has_als THEN 'embed_or_als' ELSE 'cold_start' END AS ws FROM v_flags) ",
    "SELECT case_id, ws AS weight_set, w.content, w.item, w.markov, CASE WHEN has_embed THEN w.embed ELSE 0.0 END AS embed, CASE WHEN has_als THEN w.als ELSE 0.0 END AS als FROM s JOIN (VALUES ",
    ", ".join("('" + k + "', " + ", ".join(f"CAST({x} AS DOUBLE)" for x in v) + ")" for k, v in fusion.WEIGHTS.items()),
    ") AS w(name, content, item, markov, embed, als) ON w.name = s.ws"]))
def weight_selection(t):
    anchors = t.requests.select(F.col("req_id").alias("case_id"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"))
    snapped = eng.snap_to_poi(anchors, t.pois, features.item_counts(t.visits), 0.3, ["Intersection", "State", "Home (private)"])
    flags = t.requests.select(F.col("req_id").alias("case_id"), "user_id", "current_poi").join(snapped, "case_id", "left").select(
        "case_id", F.col("user_id").isNotNull().alias("has_user"), (F.col("current_poi").isNotNull() | F.col("poi_id").isNotNull()).alias("has_current"),
        (F.col("case_id") % 2 == 0).alias("has_embed"), (F.col("case_id") % 3 == 0).alias("has_als"))
    out = fusion.weight_selection(flags)
    return out.select("case_id", "weight_set", *[F.col("weights")[i].alias(e) for i, e in enumerate(fusion.ENGINES)])


@query("weighted_sum", """
SELECT case_id, poi_id, round(sum(score * CASE engine WHEN 'markov' THEN 0.15 WHEN 'embed' THEN 0.05 ELSE 0.55 END), 9) AS score FROM v_escores GROUP BY 1, 2""")
def weighted_sum(t):
    weights = ucases(t)[0].select("case_id", F.array(*[F.lit(x) for x in fusion.WEIGHTS["user_current"]]).alias("weights"))
    return fusion.weighted_sum(scores(t), weights).withColumn("score", r9("score"))


@query("union_engine_ids", "SELECT case_id, poi_id, count(*) AS n_engines FROM v_escores GROUP BY 1, 2")
def union_engine_ids(t):
    return fusion.union_ids(scores(t))


@query("rrf", """
WITH e AS (SELECT unnest(['content', 'item', 'markov', 'embed', 'als']) AS engine),
r AS (SELECT *, row_number() OVER (PARTITION BY case_id, engine ORDER BY score DESC, poi_id) - 1 AS rk FROM v_escores),
n AS (SELECT case_id, engine, count(*) AS size FROM v_escores GROUP BY 1, 2),
ids AS (SELECT DISTINCT case_id, poi_id FROM v_escores)
SELECT i.case_id, i.poi_id, round(sum(1.0 / (30 + COALESCE(r.rk, n.size, 0) + 1)), 9) AS score FROM ids i CROSS JOIN e LEFT JOIN r ON r.case_id = i.case_id AND r.engine = e.engine AND r.poi_id = i.poi_id
LEFT JOIN n ON n.case_id = i.case_id AND n.engine = e.engine GROUP BY 1, 2""")
def rrf(t):
    return fusion.rrf(scores(t)).withColumn("score", r9("score"))


@query("single_mode", "SELECT case_id, poi_id, round(score, 9) AS score FROM v_escores WHERE engine = 'embed'")
def single_mode(t):
    return fusion.single_mode(scores(t), "embed").withColumn("score", r9("score"))


@query("minmax_norm", """
SELECT city_id, poi_id, round(CASE WHEN max(COALESCE(rating, 0)) OVER w - min(COALESCE(rating, 0)) OVER w <= 1e-12 THEN 0 ELSE (COALESCE(rating, 0) - min(COALESCE(rating, 0)) OVER w) / (max(COALESCE(rating, 0)) OVER w - min(COALESCE(rating, 0)) OVER w) END, 9) AS norm
FROM v_pois WINDOW w AS (PARTITION BY city_id)""")
def minmax_norm(t):
    return fusion.minmax_norm(t.pois.select("city_id", "poi_id", "rating"), ["city_id"], "rating").select("city_id", "poi_id", r9("norm").alias("norm"))


add_view("v_blend_w", "SELECT case_id, engine, CASE engine WHEN 'markov' THEN CAST(0.45 AS DOUBLE) WHEN 'embed' THEN CAST(0.35 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS weight FROM (SELECT DISTINCT case_id, engine FROM v_escores)")


@query("blend_routes", """
WITH n AS (SELECT s.case_id, s.poi_id, w.weight, CASE WHEN max(score) OVER g - min(score) OVER g <= 1e-12 THEN 0 ELSE (score - min(score) OVER g) / (max(score) OVER g - min(score) OVER g) END AS norm
 FROM v_escores s JOIN v_blend_w w ON w.case_id = s.case_id AND w.engine = s.engine AND w.weight > 0 WINDOW g AS (PARTITION BY s.case_id, s.engine)),
b AS (SELECT case_id AS req_id, poi_id, round(sum(weight * norm), 9) AS score FROM n GROUP BY 1, 2)
SELECT req_id, poi_id, round(score, 9) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY score DESC, poi_id) AS rank FROM b) WHERE rank <= 20""")
def blend_routes(t):
    parts = scores(t).select(F.col("case_id").alias("req_id"), F.col("engine").alias("variant"), "poi_id", "score")
    w = F.when(F.col("variant") == "markov", 0.45).when(F.col("variant") == "embed", 0.35).otherwise(0.0)
    weights = parts.select("req_id", "variant").distinct().withColumn("weight", w)
    return fusion.blend_routes(parts, weights, 20).withColumn("score", r9("score"))
