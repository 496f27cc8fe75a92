"""All route variants of a table of requests in one plan."""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from trailweave.operators import fusion, intents, prefs, routes, variants
from trailweave.plans import recommend as rec
from trailweave.session import materialize

# sub-requests of one request get case_id = req_id * 8 + number
SUB = {"history": 0, "soft": 1, "strict": 2, "model": 3, "full": 4}


@dataclass
class MultiRoute:
    """routes (req_id, variant, rank, poi_id, score, is_surprise), omitted, warnings, rejected, signals."""

    routes: DataFrame
    omitted: DataFrame
    warnings: DataFrame
    rejected: DataFrame
    signals: DataFrame
    pools: DataFrame


@dataclass
class MultiRouteParams:
    recommend: rec.RecommendParams = field(default_factory=rec.RecommendParams)
    surprise: variants.SurpriseParams = field(default_factory=variants.SurpriseParams)


def _sub(sig: DataFrame, name: str, where, k, mode, user=None, current=None, place=None, with_prefs=False, weight=0.0, strict=False, diversify=True) -> DataFrame:
    none = lambda t: F.lit(None).cast(t)
    mode = mode if not isinstance(mode, str) else F.lit(mode)
    keep = F.lit(with_prefs) if isinstance(with_prefs, bool) else with_prefs
    only = lambda c, t: F.when(keep, F.col(c)).otherwise(none(t))
    return sig.where(where).select(
        (F.col("req_id") * 8 + SUB[name]).alias("case_id"), F.lit("ALL").alias("scope"),
        (user if user is not None else none("long")).alias("user_id"), (current if current is not None else none("long")).alias("current_poi"),
        (place[0] if place else none("double")).alias("lat"), (place[1] if place else none("double")).alias("lon"), k.cast("int").alias("k"), mode.alias("mode"),
        (weight if not isinstance(weight, float) else F.lit(weight)).alias("distance_weight"), F.lit(diversify).alias("diversify"),
        only("free_only", "boolean").alias("free_only"), only("max_price_tier", "int").alias("max_price_tier"),
        (F.lit("strict") if strict else only("category_mode", "string")).alias("category_mode"), keep.alias("with_prefs"))


def sub_requests(sig: DataFrame) -> DataFrame:
    """One row per recommendation a request needs; ``sig`` carries signals and parsed preferences."""
    k = F.col("k")
    h, i, l = F.col("history"), F.col("inputs"), F.col("location")
    n_signals = h.cast("int") + i.cast("int") + l.cast("int")
    mode = F.when(i & ~h & ~l, "content").otherwise("hybrid")
    weight = F.when(l, F.when(F.coalesce("proximity", F.lit(False)), 0.45).otherwise(0.30)).otherwise(0.0)
    user = F.when(h, F.col("user_id"))
    parts = [
        _sub(sig, "history", h, k, "hybrid", user=F.col("user_id")),
        _sub(sig, "soft", i, F.greatest(k * 6, F.least(F.lit(300), k + 60)), "content", with_prefs=True),
        _sub(sig, "strict", i & (F.size("categories") > 0), F.greatest(k * 12, F.lit(400)), "content", with_prefs=True, strict=True),
        _sub(sig, "model", l, F.greatest(k * 20, F.lit(500)), "hybrid", current=F.col("current_poi")),
        # with two or more variants the blend takes the place of this list
        _sub(sig, "full", n_signals < 2, variants.full_pool_size(k), mode, user=user, current=F.col("current_poi"), place=(F.col("lat"), F.col("lon")), with_prefs=i, weight=weight),
    ]
    out = parts[0]
    for q in parts[1:]:
        out = out.unionByName(q)
    return out


def build_multi_routes(requests: DataFrame, f: rec.Features, p: MultiRouteParams | None = None) -> MultiRoute:
    """``requests`` is (req_id, user_id, current_poi, lat, lon, prefs, category_mode, k, proximity [, city_id])."""
    p = p or MultiRouteParams()
    table = prefs.prefs_table(requests)
    sig, rejected = variants.signals(requests, f.visits, table)
    sig = materialize(sig.drop("category_mode").join(table, "req_id"))
    sig = sig if "city_id" in sig.columns else sig.withColumn("city_id", F.lit(None).cast("string"))
    tok = prefs.pref_tokens(requests).where("kind = 'category'")
    subs = materialize(sub_requests(sig))
    case_tok = subs.where("with_prefs").select("case_id", F.floor(F.col("case_id") / 8).cast("long").alias("req_id")).join(tok, "req_id").select("case_id", "pos", "token")
    recs = rec.recommend(subs.drop("with_prefs"), case_tok, f, p.recommend)
    recs = materialize(recs.withColumn("req_id", F.floor(F.col("case_id") / 8).cast("long")).withColumn("sub", F.pmod("case_id", F.lit(8))))
    of = lambda n: recs.where(F.col("sub") == SUB[n]).select("req_id", "rank", "poi_id", "score")

    named = materialize(intents.poi_intents(f.pois).join(f.pois.select("poi_id", "primary_category"), "poi_id"))
    uni = prefs.normalize_categories(tok, "req_id")
    asked = materialize(intents.intent_user(uni, ["req_id"], "token", "pos"))
    words = asked.select("req_id", F.col("intent").alias("word"), "pos", F.lit(True).alias("is_intent")).unionByName(
        uni.join(asked.select("req_id").distinct(), "req_id", "left_anti").select("req_id", F.lower("token").alias("word"), "pos", F.lit(False).alias("is_intent")))

    history = of("history")
    both = of("strict").withColumn("strict", F.lit(True)).unionByName(of("soft").withColumn("strict", F.lit(False)))
    merged = both.groupBy("req_id", "poi_id").agg(F.max("strict").alias("strict"), F.max_by("score", F.col("strict").cast("int")).alias("score"))
    inputs = variants.trim_coverage(merged.join(sig.select("req_id", "k"), "req_id"), words, named)
    located = variants.radius_profile(sig.where("location"))
    gated = variants.gated_pois(located, f.pois, F.greatest(F.col("k") * 6, F.lit(80)))
    location = variants.variant_location(variants.local_scores(gated, of("model")))
    parts = None
    for name, df in (("history", history), ("inputs", inputs), ("location", location)):
        one = df.select("req_id", F.lit(name).alias("variant"), "rank", "poi_id", "score")
        parts = one if parts is None else parts.unionByName(one)
    parts = materialize(parts)

    several = parts.groupBy("req_id").agg(F.countDistinct("variant").alias("_v")).where("_v >= 2").select("req_id")
    size = sig.select("req_id", variants.full_pool_size(F.col("k")).alias("size"))
    blend = fusion.blend_routes(parts.join(several, "req_id", "left_semi"), variants.variant_weights(sig), size)
    pool = blend.select("req_id", "rank", "poi_id", "score").unionByName(of("full").join(several, "req_id", "left_anti"))
    pool = materialize(pool.join(f.pois.select("poi_id", "lat", "lon"), "poi_id").join(sig.select("req_id", "k"), "req_id"))
    full = variants.soft_surprise(pool.where("rank <= k").drop("k"), pool.drop("k"), sig, asked, named.select("poi_id", "intent"), p.surprise)
    out = parts.withColumn("is_surprise", F.lit(False)).unionByName(full.select("req_id", F.lit("full").alias("variant"), "rank", "poi_id", "score", "is_surprise"))
    out = materialize(out)
    return MultiRoute(out, variants.omitted_variants(sig, out), variants.route_warnings(sig, out), rejected, sig, pool)


def planning_requests(sig: DataFrame, pool_k: int = 1000) -> DataFrame:
    """Sub-requests for the larger, undiversified pools that routes are planned on, per variant."""
    k = F.greatest(F.col("k"), F.lit(pool_k))
    h, i, l = F.col("history"), F.col("inputs"), F.col("location")
    place = (F.col("lat"), F.col("lon"))
    mode = F.when(i & ~h & ~l, "content").otherwise("hybrid")
    parts = [
        _sub(sig, "history", h, k, "hybrid", user=F.col("user_id"), diversify=False),
        _sub(sig, "soft", i, k, "content", with_prefs=True, diversify=False),
        _sub(sig, "model", l, k, "hybrid", current=F.col("current_poi"), place=place, weight=0.9, diversify=False),
        _sub(sig, "full", F.lit(True), k, mode, user=F.when(h, F.col("user_id")), current=F.col("current_poi"), place=place, with_prefs=i,
             weight=F.when(l, 0.35).otherwise(0.0), diversify=False),
    ]
    out = parts[0]
    for q in parts[1:]:
        out = out.unionByName(q)
    return out


def recommend_then_plan(requests: DataFrame, f: rec.Features, m: MultiRoute, p: MultiRouteParams | None = None, planner: routes.PlannerParams | None = None) -> DataFrame:
    """(req_id, variant, step, poi_id, total_km): planned and ordered route of every variant.

    Where planning finds nothing, the variant's own list is ordered instead.
    """
    p, planner = p or MultiRouteParams(), planner or routes.PlannerParams()
    subs = materialize(planning_requests(m.signals, planner.candidate_pool))
    tok = prefs.pref_tokens(requests).where("kind = 'category'")
    case_tok = subs.where("with_prefs").select("case_id", F.floor(F.col("case_id") / 8).cast("long").alias("req_id")).join(tok, "req_id").select("case_id", "pos", "token")
    recs = rec.recommend(subs.drop("with_prefs"), case_tok, f, p.recommend)
    name = F.element_at(F.create_map(*[F.lit(x) for pair in ((0, "history"), (1, "inputs"), (3, "location"), (4, "full")) for x in pair]), F.pmod("case_id", F.lit(8)).cast("int"))
    rows = recs.select(F.floor(F.col("case_id") / 8).cast("long").alias("req_id"), name.alias("variant"), "poi_id", "score")
    place = f.pois.select("poi_id", "lat", "lon", "primary_category")
    start = F.col("variant").isin("location", "full")
    anchor = m.signals.select("req_id", "k", F.col("lat").alias("_la"), F.col("lon").alias("_lo"))

    def anchored(df):
        return df.join(anchor, "req_id").withColumns({"a_lat": F.when(start, F.col("_la")), "a_lon": F.when(start, F.col("_lo"))}).drop("_la", "_lo")

    have = m.routes.select("req_id", "variant").distinct()
    keys = ["req_id", "variant"]
    planned = routes.plan_route(anchored(rows.join(have, keys, "left_semi").join(place, "poi_id")), planner, keys)
    planned = materialize(planned)
    own = m.routes.join(planned.select(*keys).distinct(), keys, "left_anti").join(place, "poi_id").select(*keys, F.col("rank").alias("step"), "poi_id", "lat", "lon")
    stops = planned.select(*keys, "step", "poi_id", "lat", "lon").unionByName(own)
    return routes.build_route(anchored(stops).drop("k"), keys)


