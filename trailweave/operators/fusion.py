"""Combining engine scores."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from trailweave.functions.numeric import attach, by_score, r9, top_per_group

# Engines in weight order, modes, and the weight vectors by available signals.
ENGINES = ["content", "item", "markov", "embed", "als"]
MODES = ["embed", "item", "markov", "als", "hybrid", "content", "random", "popular", "rrf"]
WEIGHTS = {
    "user_current": [0.10, 0.15, 0.15, 0.05, 0.55],
    "user_only": [0.10, 0.20, 0.10, 0.05, 0.55],
    "current_only": [0.10, 0.15, 0.35, 0.05, 0.35],
    "embed_or_als": [0.15, 0.15, 0.10, 0.15, 0.45],
    "cold_start": [0.60, 0.20, 0.20, 0.00, 0.00],
    "trail_current": [0.0, 0.30635107904580194, 0.6100411771308729, 0.08360774382332524, 0.0],
}
RRF_K = 30
# The modes each engine takes part in when a request is scored.
ENGINE_MODES = {
    "content": ["hybrid", "content", "embed"], "item": ["hybrid", "item", "embed"], "markov": ["hybrid", "markov", "embed"],
    "embed": ["hybrid", "embed"], "als": ["hybrid", "als"],
}


def engine_gating(scores: DataFrame, cases: DataFrame, pois: DataFrame) -> DataFrame:
    """Rows of engines that run in the mode of their case, POIs with metadata only, re-normalised.

    ``scores`` is (case_id, engine, poi_id, score), ``cases`` carries ``mode``.
    """
    allowed = F.lit(False)
    for engine, modes in ENGINE_MODES.items():
        allowed = allowed | ((F.col("engine") == engine) & F.col("mode").isin(*modes))
    rows = scores.join(cases.select("case_id", "mode"), "case_id").where(allowed)
    rows = attach(rows, ["case_id", "engine"], F.max("score").alias("_max")).where("_max > 0")
    rows = rows.withColumn("score", F.col("score") / F.col("_max")).drop("_max", "mode")
    return rows.join(pois.select("poi_id"), "poi_id", "left_semi")


def weight_array(name: Column) -> Column:
    out = F.lit(None).cast("array<double>")
    for key, values in WEIGHTS.items():
        out = F.when(name == key, F.array(*[F.lit(float(v)) for v in values])).otherwise(out)
    return out


def weight_name(has_user: Column, has_current: Column, has_model: Column, trail: bool = False) -> Column:
    first = F.when(has_current, "trail_current") if trail else F.when(F.lit(False), "")
    return (first.when(has_user & has_current, "user_current").when(has_user, "user_only")
            .when(has_current, "current_only").when(has_model, "embed_or_als").otherwise("cold_start"))


def weight_selection(flags: DataFrame, trail: bool = False) -> DataFrame:
    """Adds ``weights`` (5 values) from has_user, has_current, has_embed, has_als per case."""
    f = lambda c: F.coalesce(c, F.lit(False))
    name = weight_name(f("has_user"), f("has_current"), f("has_embed") | f("has_als"), trail)
    w = weight_array(name)
    zeroed = F.array(w[0], w[1], w[2], F.when(f("has_embed"), w[3]).otherwise(F.lit(0.0)), F.when(f("has_als"), w[4]).otherwise(F.lit(0.0)))
    return flags.withColumns({"weight_set": name, "weights": zeroed})


def weight_of(weights: Column, engine: Column) -> Column:
    return F.element_at(weights, F.array_position(F.array(*[F.lit(e) for e in ENGINES]), engine).cast("int"))


def weighted_sum(scores: DataFrame, weights: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Sum of weight * score over engines; ``weights`` is (keys..., weights array)."""
    keys = keys or ["case_id"]
    rows = scores.join(weights.select(*keys, "weights"), keys)
    return rows.groupBy(*keys, "poi_id").agg(r9(F.sum(F.col("score") * weight_of(F.col("weights"), F.col("engine")))).alias("score"))


def union_ids(scores: DataFrame) -> DataFrame:
    return scores.groupBy("case_id", "poi_id").agg(F.count("*").alias("n_engines"))


def rrf(scores: DataFrame, rrf_k: int = RRF_K, n_engines: int = len(ENGINES)) -> DataFrame:
    """Reciprocal rank fusion over (case_id, engine, poi_id, score).

    An id missing in an engine has that engine's size as its rank; an engine without rows has size 0.
    """
    w = W.partitionBy("case_id", "engine").orderBy(*by_score())
    ranked = attach(scores, ["case_id", "engine"], F.count("*").alias("_size")).withColumn("_rank", F.row_number().over(w) - 1)
    return rrf_from_ranks(ranked.select("case_id", "engine", "poi_id", "_rank", "_size"), rrf_k, n_engines)


def rrf_absent(sizes: DataFrame, rrf_k: int = RRF_K, n_engines: int = len(ENGINES)) -> DataFrame:
    """(case_id, _absent): the value of being absent from every engine, from (case_id, engine, _size)."""
    return sizes.groupBy("case_id").agg(
        (F.sum(1.0 / (F.lit(rrf_k) + F.col("_size") + 1)) + (F.lit(n_engines) - F.count("*")) / F.lit(rrf_k + 1.0)).alias("_absent"))


def rrf_from_ranks(ranked: DataFrame, rrf_k: int = RRF_K, n_engines: int = len(ENGINES), sizes: DataFrame | None = None) -> DataFrame:
    """The same from 0-based ranks (case_id, engine, poi_id, _rank, _size).

    Written as the sum over present ranks plus, per case, the value of being absent everywhere,
    minus that value for the engines an id is present in; so no id x engine grid is built.
    ``sizes`` (case_id, engine, _size) is needed when some engine's rows are only partly listed.
    """
    sizes = sizes if sizes is not None else ranked.select("case_id", "engine", "_size").distinct()
    absent = rrf_absent(sizes, rrf_k, n_engines)
    present = ranked.groupBy("case_id", "poi_id").agg(
        F.sum(1.0 / (F.lit(rrf_k) + F.col("_rank") + 1) - 1.0 / (F.lit(rrf_k) + F.col("_size") + 1)).alias("_gain"))
    return present.join(absent, "case_id").select("case_id", "poi_id", r9(F.col("_gain") + F.col("_absent")).alias("score"))


def single_mode(scores: DataFrame, engine: str) -> DataFrame:
    return scores.where(F.col("engine") == engine).select("case_id", "poi_id", "score")


def minmax_norm(df: DataFrame, keys: list[str], score: str = "score", out: str = "norm") -> DataFrame:
    """(s - lo) / (hi - lo) per group, 0 without spread, a missing score counts as 0."""
    s = F.coalesce(score, F.lit(0.0))
    rows = attach(df, keys, F.min(s).alias("_lo"), F.max(s).alias("_hi"))
    spread = F.col("_hi") - F.col("_lo")
    return rows.withColumn(out, F.when(spread <= 1e-12, 0.0).otherwise((s - F.col("_lo")) / spread)).drop("_lo", "_hi")


def blend_routes(parts: DataFrame, weights: DataFrame, k: DataFrame | int) -> DataFrame:
    """(req_id, poi_id, score, rank): weighted sum of per-variant normalised scores, best k.

    ``k`` is a number or a table (req_id, size).

    ``parts`` is (req_id, variant, poi_id, score), ``weights`` is (req_id, variant, weight).
    """
    rows = parts.join(weights.where("weight > 0"), ["req_id", "variant"])
    normed = minmax_norm(rows, ["req_id", "variant"])
    summed = normed.groupBy("req_id", "poi_id").agg(r9(F.sum(F.col("weight") * F.col("norm"))).alias("score"))
    if isinstance(k, int):
        return top_per_group(summed, ["req_id"], by_score(), k)
    return top_per_group(summed.join(k, "req_id"), ["req_id"], by_score(), "size").drop("size")
