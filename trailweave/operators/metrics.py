"""Ranking metrics over recommendation lists of at most k rows per case."""
from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from trailweave.functions.text import null_like

RANK_METRICS = ["hit", "precision", "recall", "mrr", "ndcg"]
CATEGORY_METRICS = ["cat_hit", "cat_precision", "cat_recall", "cat_ndcg"]
# The metrics that are averaged per mode.
EVAL_METRICS = ["hit", "precision", "recall", "ndcg", "cat_hit", "cat_precision", "cat_recall", "cat_ndcg", "novelty", "diversity"]


def ideal_dcg(n: Column, k: int) -> Column:
    """Discounted gain of min(n, k) hits at the top of the list."""
    sums, total = [], 0.0
    for i in range(1, k + 1):
        total += 1.0 / log2(i + 1)
        sums.append(total)
    return F.try_element_at(F.array(*[F.lit(x) for x in sums]), F.least(n, F.lit(k)).cast("int"))


def poi_primary_map(pois: DataFrame, cats: DataFrame) -> DataFrame:
    """(poi_id, category): primary category, else the first category of the bridge table."""
    bridge = cats.where("category_name IS NOT NULL").groupBy("poi_id").agg(F.min_by("category_name", "ord").alias("_b"))
    prim = pois.select("poi_id", null_like(F.col("primary_category")).alias("_p"))
    return prim.join(bridge, "poi_id", "full_outer").select("poi_id", F.coalesce("_p", null_like(F.col("_b"))).alias("category")).where("category IS NOT NULL")


def rank_metrics(recs: DataFrame, truth: DataFrame, k: int, keys: list[str] | None = None) -> DataFrame:
    """(keys..., hit, precision, recall, mrr, ndcg) for recs (keys..., poi_id, rank), rank from 1."""
    keys = keys or ["case_id"]
    sizes = truth.groupBy("case_id").agg(F.count("*").alias("_t"))
    rows = recs.where(F.col("rank") <= k).join(truth.withColumn("_h", F.lit(1)), ["case_id", "poi_id"], "left")
    agg = rows.groupBy(*keys).agg(
        F.count("_h").alias("_hits"), F.min(F.when(F.col("_h") == 1, F.col("rank"))).alias("_first"),
        F.coalesce(F.sum(F.when(F.col("_h") == 1, 1.0 / F.log2(F.col("rank") + 1.0))), F.lit(0.0)).alias("_dcg"))
    return from_hits(agg.join(sizes, "case_id", "left"), keys, k)


def from_hits(lists: DataFrame, keys: list[str], k: int) -> DataFrame:
    """``rank_metrics`` from each list's hits, place of the first, discounted gain and number of true items (_hits, _first, _dcg, _t)."""
    t = F.coalesce("_t", F.lit(0))
    return lists.select(
        *keys, F.when(F.col("_hits") > 0, 1.0).otherwise(0.0).alias("hit"), (F.col("_hits") / F.lit(float(k))).alias("precision"),
        F.coalesce(F.col("_hits") / F.nullif(t, F.lit(0)), F.lit(0.0)).alias("recall"), F.coalesce(1.0 / F.col("_first"), F.lit(0.0)).alias("mrr"),
        F.coalesce(F.col("_dcg") / ideal_dcg(t, k), F.lit(0.0)).alias("ndcg"))


def category_metrics(recs: DataFrame, truth: DataFrame, primary: DataFrame, k: int, keys: list[str] | None = None) -> DataFrame:
    """The same on categories; a relevant category counts at its first place only."""
    keys = keys or ["case_id"]
    wanted = truth.join(primary, "poi_id").select("case_id", "category").distinct()
    sizes = wanted.groupBy("case_id").agg(F.count("*").alias("_t"))
    rows = recs.where(F.col("rank") <= k).join(primary, "poi_id", "left").join(wanted.withColumn("_h", F.lit(1)), ["case_id", "category"], "left")
    first = rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys, "category").orderBy("rank")))
    counted = (F.col("_h") == 1) & (F.col("_n") == 1)
    agg = first.groupBy(*keys).agg(
        F.count_if(F.coalesce(counted, F.lit(False))).alias("_hits"),
        F.coalesce(F.sum(F.when(counted, 1.0 / F.log2(F.col("rank") + 1.0))), F.lit(0.0)).alias("_dcg"))
    out = agg.join(sizes, "case_id", "left")
    t = F.coalesce("_t", F.lit(0))
    return out.select(
        *keys, F.when(F.col("_hits") > 0, 1.0).otherwise(0.0).alias("cat_hit"), (F.col("_hits") / F.lit(float(k))).alias("cat_precision"),
        F.coalesce(F.col("_hits") / F.nullif(t, F.lit(0)), F.lit(0.0)).alias("cat_recall"),
        F.coalesce(F.col("_dcg") / ideal_dcg(t, k), F.lit(0.0)).alias("cat_ndcg"))


def novelty(recs: DataFrame, counts: DataFrame, keys: list[str] | None = None, scoped: bool = False) -> DataFrame:
    """Mean of -log2((c + 1) / (N + V)) / log2(N + V); N visits over V visited POIs in training.

    With ``scoped``, recs and counts carry a scope column and N, V are per scope.
    """
    keys = keys or ["case_id"]
    groups = ["scope"] if scoped else []
    totals = counts.groupBy(*groups).agg((F.sum("n_visits") + F.greatest(F.count("*"), F.lit(1))).cast("double").alias("_d"))
    rows = recs.join(counts.select("poi_id", "n_visits"), "poi_id", "left")
    rows = rows.join(totals, "scope") if scoped else rows.join(F.broadcast(totals), F.lit(True))
    value = -F.log2((F.coalesce("n_visits", F.lit(0)) + 1.0) / F.col("_d")) / F.log2("_d")
    return rows.groupBy(*keys).agg(F.avg(value).alias("novelty"))


def diversity(recs: DataFrame, primary: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Distinct categories over list length; POIs without a category share one unknown category."""
    keys = keys or ["case_id"]
    rows = recs.join(primary, "poi_id", "left").groupBy(*keys, F.coalesce("category", F.lit("__unknown__")).alias("_c")).agg(F.count("*").alias("_n"))
    return rows.groupBy(*keys).agg((F.count("*") / F.sum("_n")).alias("diversity"))


def all_metrics(recs: DataFrame, truth: DataFrame, primary: DataFrame, counts: DataFrame, k: int, keys: list[str], scoped: bool = False) -> DataFrame:
    """One row per list with every metric, from one join per lookup and one aggregate per list."""
    truth_cats = truth.join(primary, "poi_id").select("case_id", "category").distinct()
    sizes = truth.groupBy("case_id").agg(F.count("*").alias("_t")).join(truth_cats.groupBy("case_id").agg(F.count("*").alias("_tc")), "case_id", "left")
    groups = ["scope"] if scoped else []
    totals = counts.groupBy(*groups).agg((F.sum("n_visits") + F.greatest(F.count("*"), F.lit(1))).cast("double").alias("_d"))
    rows = (
        recs.where(F.col("rank") <= k).join(truth.select("case_id", "poi_id", F.lit(1).alias("_h")), ["case_id", "poi_id"], "left")
        .join(primary.select("poi_id", "category"), "poi_id", "left").join(counts.select("poi_id", "n_visits"), "poi_id", "left")
        .join(truth_cats.withColumn("_ch", F.lit(1)), ["case_id", "category"], "left")
    )
    rows = rows.join(totals, "scope") if scoped else rows.join(F.broadcast(totals), F.lit(True))
    first = F.row_number().over(W.partitionBy(*keys, "category").orderBy("rank")) == 1
    rows = rows.withColumn("_ch", F.when(first, F.col("_ch"))).withColumn("_g", 1.0 / F.log2(F.col("rank") + 1.0))
    surprise = -F.log2((F.coalesce("n_visits", F.lit(0)) + 1.0) / F.col("_d")) / F.log2("_d")
    agg = rows.groupBy(*keys).agg(
        F.count("_h").alias("_hits"), F.min(F.when(F.col("_h") == 1, F.col("rank"))).alias("_first"), F.sum(F.when(F.col("_h") == 1, F.col("_g"))).alias("_dcg"),
        F.count("_ch").alias("_chits"), F.sum(F.when(F.col("_ch") == 1, F.col("_g"))).alias("_cdcg"), F.avg(surprise).alias("novelty"),
        (F.size(F.collect_set(F.coalesce("category", F.lit("__unknown__")))) / F.count("*")).alias("diversity"))
    out = agg.join(sizes, "case_id", "left").fillna(0, ["_t", "_tc"])
    share = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    flag = lambda c: F.when(F.col(c) > 0, 1.0).otherwise(0.0)
    gain = lambda d, n: F.coalesce(F.col(d) / ideal_dcg(F.col(n), k), F.lit(0.0))
    return out.select(
        *keys, flag("_hits").alias("hit"), (F.col("_hits") / float(k)).alias("precision"), share("_hits", "_t").alias("recall"),
        F.coalesce(1.0 / F.col("_first"), F.lit(0.0)).alias("mrr"), gain("_dcg", "_t").alias("ndcg"),
        flag("_chits").alias("cat_hit"), (F.col("_chits") / float(k)).alias("cat_precision"), share("_chits", "_tc").alias("cat_recall"),
        gain("_cdcg", "_tc").alias("cat_ndcg"), "novelty", "diversity")


def to_long(wide: DataFrame, keys: list[str], names: list[str] = EVAL_METRICS) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])
    return wide.select(*keys, F.explode(cells).alias("_x")).select(*keys, "_x.metric", "_x.value")


def metrics_pivot(long: DataFrame, names: list[str] = EVAL_METRICS) -> DataFrame:
    return long.groupBy("mode").pivot("metric", names).agg(F.avg("value"))
