"""Candidate filters, boosts, distance re-ranking and diversification."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trailweave.functions.numeric import attach, by_score, top_per_group


def gauss(x: Column, target: Column, sigma: Column) -> Column:
    return F.exp(-F.pow(x - target, F.lit(2.0)) / (2 * sigma * sigma))


def exp_decay(x: Column, beta: Column) -> Column:
    return F.exp(-beta * x)


def diverse_top_k(df: DataFrame, keys: list[str], score: str, category: str, k: int | str, max_per_category: int = 2, item: str = "poi_id") -> DataFrame:
    """Greedy top-k with a cap per category, written as two ranks: inside the category, then overall.

    Greedy picking in score order skips exactly the rows ranked beyond the cap in their
    category, so the result is the same.
    """
    order = by_score(score, item)
    capped = top_per_group(df, keys + [category], order, max_per_category, "_cr").drop("_cr")
    return top_per_group(capped, keys, order, k)


# Boosts and thresholds of preference matching, and categories never suggested.
CATEGORY_BOOST, INTENT_BOOST, INCONCLUSIVE_FACTOR, STRICT_MIN_CONF = 0.2, 0.3, 0.8, 0.35
EXCLUDED_CATEGORIES = ["Intersection", "State", "Home (private)"]


def not_current(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("poi_id").eqNullSafe(F.col("current_poi")))


def has_metadata(pois: DataFrame) -> DataFrame:
    return pois.dropna(subset=["name", "primary_category", "lat", "lon"])


def exclude_category(rows: DataFrame, excluded: list[str] | None = None) -> DataFrame:
    return rows.where(~F.col("primary_category").isin(*(excluded or EXCLUDED_CATEGORIES)))


def price_free_filter() -> Column:
    """Paid only when free_only is false, free only when true; price unknown or within the limit."""
    free = F.coalesce(F.col("is_free"), F.lit(False))
    by_free = F.col("free_only").isNull() | (F.col("free_only") == free)
    by_price = F.col("max_price_tier").isNull() | F.col("price_tier").isNull() | (F.col("price_tier") <= F.col("max_price_tier"))
    return by_free & by_price


def preference_matches(labels: DataFrame, tokens: DataFrame, wanted_intents: DataFrame) -> DataFrame:
    """(case_id, label, pref_match, intent_match) for labels that match a request in some way.

    ``labels`` is (label, name, intent): the category names behind a label; ``tokens`` is
    (case_id, token) and ``wanted_intents`` (case_id, intent). Both joins are on a word, so a
    request only meets labels it shares a word with.
    """
    by_name = tokens.select("case_id", F.lower("token").alias("_l")).distinct().join(
        labels.select("label", F.lower("name").alias("_l")).distinct(), "_l").select("case_id", "label", F.lit(True).alias("pref_match"), F.lit(False).alias("intent_match"))
    by_intent = wanted_intents.select("case_id", "intent").distinct().join(
        labels.where("intent <> 'inconclusive'").select("label", "intent").distinct(), "intent").select("case_id", "label", F.lit(False).alias("pref_match"), F.lit(True).alias("intent_match"))
    return by_name.unionByName(by_intent).groupBy("case_id", "label").agg(F.bool_or("pref_match").alias("pref_match"), F.bool_or("intent_match").alias("intent_match"))


def strict_match() -> Column:
    """Whether a strict request keeps a label that matches it: by name, or by an intent that is sure enough."""
    return F.coalesce("pref_match", F.lit(False)) | (F.coalesce("intent_match", F.lit(False)) & (F.coalesce("max_conf", F.lit(0.0)) >= STRICT_MIN_CONF))


def kth_best(rows: DataFrame, max_per_category: int) -> DataFrame:
    """(case_id, floor): the k-th best score of each case, or of its better ``side``, under the cap per category; none where there are fewer than k.

    ``rows`` is (case_id, side, k, diversify, primary_category, score).
    """
    capped = top_per_group(rows.where("diversify"), ["case_id", "side", "primary_category"], [F.col("score").desc()], max_per_category, "_cr").drop("_cr")
    best = top_per_group(rows.where(~F.col("diversify")).unionByName(capped), ["case_id", "side"], [F.col("score").desc()], "k")
    return best.where(F.col("rank") == F.col("k")).groupBy("case_id").agg(F.max("score").alias("floor"))


def label_facts(labels: DataFrame) -> DataFrame:
    """(label, only_inconclusive, max_conf) from (label, name, intent, confidence)."""
    return labels.groupBy("label").agg(F.bool_and(F.col("intent") == "inconclusive").alias("only_inconclusive"), F.max("confidence").alias("max_conf"))


def apply_preferences(rows: DataFrame, facts: DataFrame, matches: DataFrame, score: str = "score") -> DataFrame:
    """Boost or filter rows (case_id, label, has_prefs, category_mode, score) by preferences."""
    out = rows.join(facts, "label", "left").join(matches, ["case_id", "label"], "left")
    pm, im = F.coalesce("pref_match", F.lit(False)), F.coalesce("intent_match", F.lit(False))
    strict = F.col("category_mode") == "strict"
    oi = F.coalesce("only_inconclusive", F.lit(False))
    s = F.col(score) * F.when(pm, 1.0 + CATEGORY_BOOST).otherwise(1.0)
    soft = s * F.when(im, 1.0 + INTENT_BOOST).otherwise(1.0) * F.when(oi, INCONCLUSIVE_FACTOR).otherwise(1.0)
    keep = ~F.col("has_prefs") | ~strict | strict_match()
    return out.where(keep).withColumn(
        score, F.when(~F.col("has_prefs"), F.col(score)).when(strict, s).otherwise(soft)).drop("only_inconclusive", "max_conf", "pref_match", "intent_match")


def rerank_distance(rows: DataFrame, weight: Column, keys: list[str] | None = None, far: str | None = None) -> DataFrame:
    """score * (1 - weight * d / (largest d + 1e-8)) for groups with a location; d is ``distance_km``.

    The largest d is that of the rows, or the value of column ``far`` where it is not null: rows may then be a part of the candidates.
    """
    keys = keys or ["case_id"]
    biggest = F.max("distance_km") if far is None else F.coalesce(F.max(far), F.max("distance_km"))
    scaled = attach(rows, keys, biggest.alias("_far"))
    factor = 1.0 - weight * F.col("distance_km") / (F.col("_far") + 1e-8)
    return scaled.withColumn("score", F.when(F.col("_far") > 0, F.col("score") * factor).otherwise(F.col("score"))).drop("_far")
