"""Recommendations for a whole table of requests.

Candidates come from two sides. Sparse engines (co-visit, Markov, embeddings, factors) give (case, POI) rows.
Content similarity is constant over a POI class - same category names, primary category,
price tier and free flag - so filters, boosts and scores are worked out per (case, class) and
only the members that can reach the result are expanded to POIs.

Both sides are cut before they meet: from each engine's best rows and the best classes every case gets a floor that its k-th result
cannot fall below, and rows and classes whose bound does not reach the floor are dropped. What distances are divided
by, the farthest of all POIs that pass a request's filters, is found by branch and bound and not from the candidates.
"""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from trailweave.functions.farthest import farthest
from trailweave.functions.geo import haversine_km
from trailweave.functions.numeric import r9, top_per_group, by_score
from trailweave.functions.sequence import positions
from trailweave.operators import engines as eng
from trailweave.operators import features, fusion, intents, prefs, rerank
from trailweave.operators import transitions as tr
from trailweave.session import materialize


@dataclass
class RecommendParams:
    markov_topn: int = 2000
    backoff: float = 0.3
    hub_alpha: float = 0.5
    snap_radius_km: float = 0.3
    embed_topn: int = 2000
    embed_context_n: int = 3
    embed_hub_alpha: float = 0.0
    als_topn: int = 500
    max_per_category: int = 2
    floor_rows: int = 64  # rows of each engine that a case's floor is worked out from
    excluded: list[str] = field(default_factory=lambda: list(rerank.EXCLUDED_CATEGORIES))


@dataclass
class Features:
    """Feature tables shared by all requests, written once."""

    visits: DataFrame
    pois: DataFrame
    counts: DataFrame
    vectors: DataFrame
    sig_of: DataFrame
    cooc: DataFrame
    trans1: DataFrame
    trans2: DataFrame
    trans_cat: DataFrame
    poi_class: DataFrame
    classes: DataFrame
    labels: DataFrame
    item_vectors: DataFrame | None = None
    factors: tuple[DataFrame, DataFrame] | None = None


def build_features(
    visits: DataFrame, pois: DataFrame, cats: DataFrame, p: RecommendParams | None = None,
    item_vectors: DataFrame | None = None, factors: tuple[DataFrame, DataFrame] | None = None,
) -> Features:
    """``item_vectors`` (poi_id, vec) and ``factors`` ((user_id, vec), (poi_id, vec)) bring in the embedding and factor engines."""
    p = p or RecommendParams()
    pois = pois if "scope" in pois.columns else pois.withColumn("scope", F.lit("ALL"))
    vectors, sig_of = map(materialize, features.tfidf_by_signature(cats, pois))
    usable = rerank.exclude_category(rerank.has_metadata(pois), p.excluded).join(sig_of.drop("scope"), "poi_id", "left").fillna(0, ["sig"])
    # labels (signature and primary category) and classes are numbered, so that joins carry numbers
    texts = features.signatures(cats).withColumnRenamed("sig", "sig_text")
    labelled = usable.select("poi_id", "sig", "primary_category").join(texts, "poi_id", "left").groupBy("sig", "primary_category").agg(F.max("sig_text").alias("sig_text"))
    labelled = materialize(positions(labelled, [], ["sig", "primary_category"], "label").withColumn("label", F.col("label").cast("int")))
    kinds = ["sig", "primary_category", "price_tier", "is_free"]
    numbers = positions(usable.select(*kinds).distinct(), [], kinds, "cls").select(*[F.col(c).alias(f"_{c}") for c in kinds], F.col("cls").cast("int").alias("cls"))
    same = F.lit(True)
    for c in kinds:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    marked = usable.join(labelled.drop("sig_text"), ["sig", "primary_category"]).join(numbers, same).select("scope", "poi_id", *kinds, "label", "cls")
    poi_class = materialize(positions(marked, ["scope", "cls"], ["poi_id"], "pos"))
    classes = materialize(poi_class.groupBy("scope", "cls", *kinds, "label").agg(F.count("*").alias("n_pois")))
    names = labelled.select(
        "label", F.explode(F.array_distinct(F.array_append(F.filter(F.split(F.coalesce("sig_text", F.lit("")), r"\|"), lambda x: x != ""), F.col("primary_category")))).alias("name")).distinct()
    labels = materialize(names.join(intents.intent_classify(names.select("name").distinct(), "name").select("name", "intent", "confidence"), "name"))
    return Features(
        visits, pois, materialize(features.item_counts(visits)), vectors, sig_of, materialize(features.cooccurrence(visits)),
        materialize(tr.transitions_poi(visits)), materialize(tr.transitions_order2(visits)), materialize(tr.transitions_cat(visits, pois)),
        poi_class, classes, labels, item_vectors, factors)


def parse_requests(requests: DataFrame, mode: str = "hybrid", distance_weight: float = 0.3, diversify: bool = True) -> tuple[DataFrame, DataFrame]:
    """(requests in the form ``recommend`` takes, category tokens) from raw requests."""
    tok = prefs.pref_tokens(requests).select(F.col("req_id").alias("case_id"), "pos", "token", "kind")
    table = prefs.prefs_table(requests).select("req_id", "free_only", "max_price_tier", "category_mode")
    reqs = requests.drop("category_mode").join(table, "req_id").select(
        F.col("req_id").alias("case_id"), F.lit("ALL").alias("scope"), "user_id", "current_poi", "lat", "lon", F.col("k").cast("int").alias("k"),
        F.lit(mode).alias("mode"), F.lit(float(distance_weight)).alias("distance_weight"), F.lit(diversify).alias("diversify"),
        "free_only", "max_price_tier", "category_mode")
    return reqs, tok.where("kind = 'category'").drop("kind")


def sequence_context(reqs: DataFrame, f: Features, p: RecommendParams) -> DataFrame:
    """(case_id, scope, user_id, current_poi, prev_poi): current POI given or snapped from the coordinates."""
    anchors = reqs.where("current_poi IS NULL AND lat IS NOT NULL AND lon IS NOT NULL").select("case_id", F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"))
    snapped = eng.snap_to_poi(anchors, f.pois, f.counts, p.snap_radius_km, p.excluded).withColumnRenamed("poi_id", "_snap")
    last = tr.last_items(f.visits.join(reqs.select("user_id").distinct(), "user_id", "left_semi"), 2)
    rows = reqs.select("case_id", "scope", "user_id", "current_poi").join(snapped, "case_id", "left").join(last, "user_id", "left")
    cur = F.coalesce("current_poi", "_snap")
    return rows.select("case_id", "scope", "user_id", cur.alias("current_poi"), tr.prev_poi(F.col("last_items"), cur).alias("prev_poi"))


def engine_rows(reqs: DataFrame, cases: DataFrame, history: DataFrame, f: Features, p: RecommendParams) -> dict[str, DataFrame]:
    """By engine (case_id, poi_id, score): what the sparse engines give, each scaled to a largest score of one."""
    def in_mode(df: DataFrame, engine: str) -> DataFrame:
        return df.join(reqs.where(F.col("mode").isin("hybrid", engine)).select("case_id"), "case_id", "left_semi")

    parts = {"item": eng.item_score(in_mode(history, "item"), f.cooc)}
    mcases = in_mode(cases, "markov")
    chain = materialize(eng.markov2_backoff(mcases, f.trans1, f.trans2, p.markov_topn, p.backoff))
    chain = chain.unionByName(eng.markov_cat_fallback(mcases, chain, f.trans_cat, f.pois))
    parts["markov"] = eng.hub_penalty(chain, f.counts, p.hub_alpha)
    given = reqs.select("case_id", "scope", "user_id", "current_poi")  # a POI snapped from coordinates is no context
    if f.item_vectors is not None:
        ecases = in_mode(given, "embed")
        recent = ecases.select("case_id", "user_id").join(tr.user_history(f.visits.join(ecases.select("user_id").distinct(), "user_id", "left_semi")), "user_id").select("case_id", "pos", "poi_id")
        context = tr.last_n_rows(recent, ecases.select("case_id", "current_poi"), p.embed_context_n).select("case_id", "poi_id")
        embed = eng.embed_select(ecases, materialize(context), in_mode(history, "embed"), f.item_vectors, p.embed_topn)
        parts["embed"] = eng.hub_penalty(embed, f.counts, p.embed_hub_alpha)
    if f.factors is not None:
        parts["als"] = eng.als_score(in_mode(given, "als"), in_mode(history, "als"), *f.factors, p.als_topn)
    return {engine: eng.max_normalize(materialize(scores.select("case_id", "poi_id", "score"))) for engine, scores in parts.items()}


def strongest(rows: DataFrame, n: int) -> DataFrame:
    """Up to ``n`` of the best rows of every case, without sorting rows: those above the lowest of 256 steps of the score that
    leaves no more. Ties that would exceed n are left out together."""
    step = F.least(F.lit(255), F.floor(F.col("score") * 256)).cast("int")
    counts = rows.groupBy("case_id", step.alias("_s")).agg(F.count("*").alias("_n"))
    down = W.partitionBy("case_id").orderBy(F.desc("_s")).rowsBetween(W.unboundedPreceding, 0)
    lowest = counts.withColumn("_upto", F.sum("_n").over(down)).where(F.col("_upto") <= n).groupBy("case_id").agg(F.min("_s").alias("_low"))
    return rows.join(lowest, "case_id").where(step >= F.col("_low")).drop("_low")


def filter_trees(info: DataFrame, seen: DataFrame, f: Features, facts: DataFrame, matches: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(queries, points, gone) of ``farthest`` for cases with a location whose candidates are all POIs that have categories.

    A tree holds the POIs that pass one price and free filter, for a strict request those of one label; requests with the
    same filter share it, and only trees that some request looks in are filled.
    """
    tiers = f.poi_class.agg(F.coalesce(F.min("price_tier"), F.lit(0)).alias("lo"), F.coalesce(F.max("price_tier"), F.lit(0)).alias("hi")).first()
    lo, hi = int(tiers["lo"]) - 1, int(tiers["hi"])
    tier = F.greatest(F.lit(lo), F.least(F.lit(hi), F.coalesce("max_price_tier", F.lit(hi)))).cast("int")
    free = F.when(F.col("free_only").isNull(), 0).when(F.col("free_only"), 1).otherwise(2)
    strict = F.col("has_prefs") & (F.col("category_mode") == "strict")
    asked = info.select("case_id", "scope", F.col("lat").alias("q_lat"), F.col("lon").alias("q_lon"), free.alias("free"), tier.alias("tier"), strict.alias("strict"))
    sure = matches.join(facts.select("label", "max_conf"), "label").where(rerank.strict_match()).select("case_id", "label")
    open_cases = asked.where("not strict").withColumn("label", F.lit(-1))
    wanted = materialize(open_cases.unionByName(asked.where("strict").join(sure, "case_id")).drop("strict"))
    keys = ["scope", "free", "tier", "label"]
    used = wanted.select(*keys).distinct()
    placed = f.poi_class.where("sig > 0").join(f.pois.select("poi_id", "lat", "lon"), "poi_id")
    own = F.when(F.coalesce("is_free", F.lit(False)), 1).otherwise(2)
    passing = placed.select("scope", "poi_id", "lat", "lon", "label", F.explode(F.array(F.lit(0), own)).alias("free"), "price_tier").withColumn(
        "tier", F.explode(F.sequence(F.coalesce("price_tier", F.lit(lo)).cast("int"), F.lit(hi)))).drop("price_tier")
    tree = F.concat_ws("|", *keys).alias("tree")
    both = passing.withColumn("label", F.lit(-1)).unionByName(passing).join(used, keys, "left_semi")
    members = materialize(both.select(tree, "poi_id", "lat", "lon"))
    queries = wanted.select("case_id", tree, "q_lat", "q_lon")
    gone = seen.join(queries.select("case_id", "tree"), "case_id").join(members, ["tree", "poi_id"]).groupBy("case_id", "tree", "lat", "lon").agg(F.count("*").alias("m"))
    return queries, members.groupBy("tree", "lat", "lon").agg(F.count("*").alias("n")), gone


def recommend(reqs: DataFrame, tokens: DataFrame, f: Features, p: RecommendParams | None = None) -> DataFrame:
    """(case_id, rank, poi_id, score, distance_km, source) for every request.

    ``reqs`` is (case_id, scope, user_id, current_poi, lat, lon, k, mode, distance_weight,
    diversify, free_only, max_price_tier, category_mode); ``tokens`` is (case_id, pos, token).
    """
    p = p or RecommendParams()
    reqs = materialize(reqs)
    cases = materialize(sequence_context(reqs, f, p))
    history = materialize(reqs.select("case_id", "user_id").join(features.interactions(f.visits), "user_id").select("case_id", "poi_id", "n"))
    current = reqs.where("current_poi IS NOT NULL").select("case_id", F.col("current_poi").alias("poi_id"))
    seen = materialize(history.select("case_id", "poi_id").unionByName(current).distinct())

    content_cases = cases.join(reqs.where(F.col("mode").isin("hybrid", "content")).select("case_id"), "case_id", "left_semi")
    reach = materialize(eng.content_reach(content_cases, history.join(content_cases.select("case_id"), "case_id", "left_semi"), seen, f.vectors, f.sig_of))
    engines = engine_rows(reqs, cases, history, f, p)
    known = f.pois.select("scope", "poi_id")
    scoped = cases.select("case_id", "scope")

    def in_scope(rows: DataFrame) -> DataFrame:
        return rows.join(scoped, "case_id").join(known, ["scope", "poi_id"], "left_semi")

    # the co-visit engine has by far the most rows, so the others are summed up first
    others = None
    for engine in engines.keys() - {"item"}:
        one = in_scope(engines[engine]).withColumn("engine", F.lit(engine))
        others = one if others is None else others.unionByName(one)
    others = materialize(others)
    flags = cases.select("case_id", F.col("current_poi").isNotNull().alias("has_current")).join(
        history.groupBy("case_id").agg(F.lit(True).alias("has_user")), "case_id", "left")
    for engine in ("embed", "als"):
        flags = flags.join(others.where(F.col("engine") == engine).select("case_id").distinct().withColumn(f"has_{engine}", F.lit(True)), "case_id", "left")
    weights = fusion.weight_selection(flags).select("case_id", "weights").join(reqs.select("case_id", "mode"), "case_id")
    one_each = F.array(*[F.lit(1.0)] * 5)
    weights = weights.select("case_id", F.when(F.col("mode") == "hybrid", F.col("weights")).otherwise(one_each).alias("weights"))

    wanted = intents.intent_user(tokens, ["case_id"], "token", "pos")
    matches = materialize(rerank.preference_matches(f.labels, tokens, wanted))
    facts = rerank.label_facts(f.labels)
    with_prefs = tokens.select("case_id").distinct().withColumn("_p", F.lit(True))
    profiles = materialize(reach.select("case_id", "scope").distinct())
    asked = materialize(reqs.join(with_prefs, "case_id", "left").join(weights, "case_id").join(profiles.select("case_id", F.lit(True).alias("_all")), "case_id", "left").select(
        "case_id", "scope", "k", "lat", "lon", "distance_weight", "diversify", "free_only", "max_price_tier", "category_mode",
        F.coalesce("_p", F.lit(False)).alias("has_prefs"), F.coalesce("_all", F.lit(False)).alias("has_content"), "weights"))
    located = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    far = farthest(*filter_trees(asked.where(located & F.col("has_content")), seen, f, facts, matches))
    info = materialize(asked.join(far, "case_id", "left"))

    def screened(rows: DataFrame) -> DataFrame:
        """Rows with class attributes: price and free filter, then preference boosts or filter."""
        return rerank.apply_preferences(rows.where(rerank.price_free_filter()), facts, matches)

    sims = reach.select("case_id", "sig", F.when(F.col("top") > 0, F.col("score") / F.col("top")).alias("_c"))
    place = f.pois.select("poi_id", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    shares = info.select("case_id", "weights")
    weighed = others.join(shares, "case_id").select("case_id", "scope", "engine", "poi_id", (F.col("score") * fusion.weight_of(F.col("weights"), F.col("engine"))).alias("score"))
    item_weight = F.col("weights")[fusion.ENGINES.index("item")]
    item = engines["item"]

    def near_rows(sums: DataFrame) -> DataFrame:
        """(case, POI) sums of sparse engines with the content part, filters and boosts; seen POIs left out."""
        near = sums.join(f.poi_class.drop("pos"), ["scope", "poi_id"]).join(sims, ["case_id", "sig"], "left").join(info.drop("scope"), "case_id")
        near = near.withColumn("score", F.col("score") + F.col("weights")[0] * F.coalesce("_c", F.lit(0.0))).drop("_c")
        return eng.exclude(screened(near), seen)

    similar = reach.select("case_id", "scope", "sig", (F.col("score") / F.col("top")).alias("score")).join(f.classes, ["scope", "sig"]).join(info.drop("scope"), "case_id")
    similar = materialize(screened(similar.withColumn("score", F.col("score") * F.col("weights")[0])).select("case_id", "scope", "cls", "n_pois", "k", "lat", "lon", "distance_weight", "diversify", "score", "primary_category"))

    # floors: the k-th of what a case is sure to have; a POI that the others score below zero is worth less than its class
    sums = materialize(weighed.groupBy("case_id", "scope", "poi_id").agg(F.sum("score").alias("score")))
    below = materialize(sums.where("score < 0"))
    best_items = materialize(in_scope(strongest(item, p.floor_rows)).join(shares, "case_id").select("case_id", "scope", "poi_id", (F.col("score") * item_weight).alias("score")))
    strong = strongest(sums, p.floor_rows).unionByName(best_items).unionByName(below.join(best_items.select("case_id", "poi_id"), ["case_id", "poi_id"], "left_semi"))
    strong = strong.groupBy("case_id", "scope", "poi_id").agg(F.sum("score").alias("score"))
    worst = F.when(located, 1 - F.col("distance_weight")).otherwise(1.0)
    lesser = seen.unionByName(below.select("case_id", "poi_id")).distinct()
    gone = lesser.join(info.select("case_id", "scope"), "case_id").join(f.poi_class.select("scope", "poi_id", "cls"), ["scope", "poi_id"]).groupBy("case_id", "cls").agg(F.count("*").alias("_gone"))
    sure = similar.select("case_id", "cls", "n_pois", "k", "diversify", "primary_category", (F.col("score") * worst).alias("score")).join(gone, ["case_id", "cls"], "left")
    sure = sure.withColumn("_free", F.col("n_pois") - F.coalesce("_gone", F.lit(0))).where("_free > 0")
    some = F.least(F.col("_free"), F.when(F.col("diversify"), F.lit(p.max_per_category)).otherwise(F.col("k"))).cast("int")
    sure = sure.select("case_id", F.lit(-1).cast("long").alias("poi_id"), "k", "diversify", "primary_category", "score", F.explode(F.sequence(F.lit(1), some)).alias("_i"))
    strong = near_rows(strong).join(place, "poi_id")
    apart = haversine_km(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon"))
    drop = F.when(located, 1 - F.col("distance_weight") * F.when(F.col("far") > 0, apart / (F.col("far") + 1e-8)).otherwise(F.lit(1.0))).otherwise(1.0)
    strong = strong.select("case_id", "poi_id", "k", "diversify", "primary_category", (F.col("score") * drop).alias("score"), F.lit(0).alias("_i"))
    floors = materialize(rerank.kth_best(_one_per_place(sure, strong), p.max_per_category))

    # what cannot reach the floor goes; a case whose divisor is that of its own candidates keeps them all
    best_boost = F.when(F.col("has_prefs"), (1 + rerank.CATEGORY_BOOST) * F.when(F.col("category_mode") == "strict", 1.0).otherwise(1 + rerank.INTENT_BOOST)).otherwise(1.0)
    no_floor = F.lit(float("-inf"))
    limits = materialize(info.join(floors, "case_id", "left").select(
        "case_id", F.when(F.col("has_content"), F.col("weights")[0]).otherwise(0.0).alias("_content"), item_weight.alias("_item"),
        F.when(located & ~F.col("has_content"), no_floor).otherwise((F.coalesce("floor", no_floor) - SLACK) / best_boost).alias("_floor")))
    bounded = lambda rows, bound: rows.join(limits, "case_id").where(bound >= F.col("_floor")).drop("_content", "_item", "_floor")
    # sums of the others need the floor with the best co-visit score; a co-visit score is added to those, or reaches it without them
    likely = materialize(bounded(sums, F.col("score") + F.col("_item") + F.col("_content")))
    marks = likely.select("case_id", "poi_id", F.lit(True).alias("_likely"))
    marks = marks.unionByName(below.select("case_id", "poi_id").join(marks, ["case_id", "poi_id"], "left_anti").withColumn("_likely", F.lit(False)))
    added = item.join(marks, ["case_id", "poi_id"], "left").join(limits, "case_id").where(
        F.coalesce("_likely", F.col("score") * F.col("_item") + F.col("_content") >= F.col("_floor")))
    added = in_scope(added.select("case_id", "poi_id", (F.col("score") * F.col("_item")).alias("score")))
    total = likely.unionByName(added).groupBy("case_id", "scope", "poi_id").agg(F.sum("score").alias("score"))
    reaching = materialize(bounded(total, F.col("score") + F.col("_content")))
    cols = ["case_id", "poi_id", "score", "primary_category"]
    kept = materialize(near_rows(reaching).select("case_id", "scope", "cls", "poi_id", "score", "primary_category"))

    # members of a class that are seen, already candidates on the sparse side, or worth less than the class
    taken = materialize(lesser.unionByName(reaching.select("case_id", "poi_id")).distinct())
    used = taken.join(info.select("case_id", "scope"), "case_id").join(f.poi_class.select("scope", "poi_id", "cls"), ["scope", "poi_id"]).groupBy("case_id", "cls").agg(F.count("*").alias("_used"))

    def members(rows: DataFrame, by_distance: Column) -> DataFrame:
        """Expand (case, class) rows; where distance doesn't decide only the first members by id can matter."""
        sized = rows.join(used, ["case_id", "cls"], "left").fillna(0, ["_used"])
        upto = F.when(by_distance, F.col("n_pois")).otherwise(F.least(F.col("n_pois"), F.col("_used") + F.col("k"))).cast("long")
        spread = sized.select("case_id", "scope", "cls", "score", "primary_category", upto.alias("upto"))
        return eng.exclude(eng.expand_classes(spread, f.poi_class.select("scope", "cls", "poi_id", "pos"), "cls"), taken).select(*cols)

    chosen = similar.join(floors, "case_id", "left").where(F.col("score") >= F.coalesce("floor", no_floor) - SLACK).drop("floor")
    cand = materialize(kept.select(*cols).unionByName(members(chosen, located)))
    # cases with too few candidates also take POIs of dissimilar classes, at score zero
    per_cat = cand.where("score > 0").groupBy("case_id", "primary_category").agg(F.count("*").alias("_n")).join(info.select("case_id", "k", "diversify"), "case_id")
    filled = per_cat.groupBy("case_id").agg(F.sum(F.when(F.col("diversify"), F.least("_n", F.lit(p.max_per_category))).otherwise(F.col("_n"))).alias("_have"))
    heavy = located & (F.col("distance_weight") >= 1)  # then even a similar POI can come to nothing
    short = profiles.join(info.select("case_id", "k", "lat", "lon", "distance_weight"), "case_id").join(filled, "case_id", "left").where((F.coalesce("_have", F.lit(0)) < F.col("k")) | heavy).select("case_id", "scope")
    zero = short.join(f.classes.where("sig > 0"), "scope").join(reach.select("case_id", "sig"), ["case_id", "sig"], "left_anti").withColumn("score", F.lit(0.0)).join(info.drop("scope"), "case_id")
    cand = cand.unionByName(members(screened(zero), F.lit(False)))

    cand = cand.join(info.select("case_id", "k", "lat", "lon", "distance_weight", "diversify", "far"), "case_id").join(place, "poi_id")
    cand = cand.withColumn("distance_km", apart)
    scored = rerank.rerank_distance(cand, F.col("distance_weight"), far="far").withColumn("score", r9("score"))
    keep = ["case_id", "poi_id", "score", "distance_km", "k", "primary_category"]
    plain = scored.where(~F.col("diversify")).select(*keep)
    varied = top_per_group(scored.where("diversify").select(*keep), ["case_id", "primary_category"], by_score(), p.max_per_category, "_cr").drop("_cr")
    best = top_per_group(plain.unionByName(varied), ["case_id"], by_score(), "k")

    bare = cases.join(profiles, "case_id", "left_anti").join(sums.select("case_id").distinct(), "case_id", "left_anti")
    visited = in_scope(item.join(bare.select("case_id"), "case_id", "left_semi")).select("case_id").distinct()
    nothing = bare.join(visited, "case_id", "left_anti").join(info.select("case_id", "k"), "case_id")
    backup = eng.popularity_fallback(nothing, f.pois, F.col("k"))
    backup = top_per_group(backup.join(info.select("case_id", "k"), "case_id"), ["case_id"], by_score(), "k")
    return best.select("case_id", "rank", "poi_id", "score", "distance_km", F.lit("engines").alias("source")).unionByName(
        backup.select("case_id", "rank", "poi_id", "score", F.lit(None).cast("double").alias("distance_km"), F.lit("popularity").alias("source")))


#: How far rounding of scores to nine digits can move a bound.
SLACK = 1e-8


def _one_per_place(sure: DataFrame, strong: DataFrame) -> DataFrame:
    """Class members and single POIs a case is sure of, without counting one POI on both sides: classes alone where they have the better k-th value."""
    return sure.select("case_id", F.lit("classes").alias("side"), "k", "diversify", "primary_category", "score").unionByName(
        strong.select("case_id", F.lit("pois").alias("side"), "k", "diversify", "primary_category", "score"))


def with_details(recs: DataFrame, pois: DataFrame) -> DataFrame:
    return recs.join(pois.select("poi_id", "name", "city_id", "primary_category", "rating", "price_tier", "is_free", "lat", "lon"), "poi_id", "left")
