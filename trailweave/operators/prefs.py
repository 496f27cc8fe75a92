"""Preference parsing over a table of requests."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Preference keywords and the prefixes of an explicit price limit.
FREE_WORDS, PAID_WORDS = ["free", "gratis"], ["paid", "pago"]
PRICE_WORDS = {1: ["cheap", "budget", "barato"], 2: ["mid", "medio"], 3: ["expensive", "caro"]}
PRICE_PREFIXES = ["price:", "max_price:", "max-price:", "price_tier:", "price-tier:"]


def budget_to_tier(budget: Column) -> Column:
    return F.when(budget == "low", 1).when(budget == "medium", 2).otherwise(3)


def pref_tokens(requests: DataFrame, key: str = "req_id") -> DataFrame:
    """(key, pos, token, kind, free, tier): one row per non-blank token.

    ``kind`` is "free", "price" or "category"; a price token that does not parse is a category.
    """
    rows = requests.where("prefs IS NOT NULL").select(key, F.posexplode(F.split("prefs", ",", -1)).alias("pos", "raw"))
    rows = rows.withColumn("token", F.trim("raw")).where("token <> ''")
    low = F.lower("token")
    tier = F.lit(None).cast("int")
    for value, words in PRICE_WORDS.items():
        tier = F.when(low.isin(*words), value).otherwise(tier)
    prefixed = F.lit(False)
    for p in PRICE_PREFIXES:
        prefixed = prefixed | F.startswith(low, F.lit(p))
    after = F.trim(F.regexp_extract("token", r"^[^:]*:(.*)$", 1))
    number = F.when(after.rlike(r"^[+-]?\d+$"), after.try_cast("int"))
    tier = F.when(prefixed, number).otherwise(tier)
    free = F.when(low.isin(*FREE_WORDS), True).when(low.isin(*PAID_WORDS), False)
    return rows.withColumns({"free": free, "tier": tier}).withColumn(
        "kind", F.when(F.col("free").isNotNull(), "free").when(F.col("tier").isNotNull(), "price").otherwise("category")).drop("raw")


def prefs_table(requests: DataFrame, key: str = "req_id") -> DataFrame:
    """(key, categories, free_only, max_price_tier, category_mode); a later token wins.

    ``categories`` holds the tokens of one request text, so its length is bounded by that text.
    """
    tok = pref_tokens(requests, key)
    is_cat = F.col("kind") == "category"
    agg = tok.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.when(is_cat, F.struct("pos", "token")))), lambda x: x["token"]).alias("categories"),
        F.max_by("free", F.when(F.col("kind") == "free", F.col("pos"))).alias("free_only"),
        F.max_by("tier", F.when(F.col("kind") == "price", F.col("pos"))).alias("max_price_tier"))
    mode = F.lower(F.trim(F.coalesce("category_mode", F.lit("soft"))))
    return requests.select(key, F.when(mode.isin("soft", "strict"), mode).otherwise("soft").alias("category_mode")).join(agg, key, "left").select(
        key, F.coalesce("categories", F.array().cast("array<string>")).alias("categories"), "free_only", "max_price_tier", "category_mode")


def normalize_categories(tok: DataFrame, key: str = "req_id") -> DataFrame:
    """(key, pos, token): category tokens, case-insensitive duplicates removed, first one kept."""
    cats = tok.where("kind = 'category'").withColumn("_l", F.lower("token"))
    return cats.groupBy(key, "_l").agg(F.min("pos").alias("pos"), F.min_by("token", "pos").alias("token")).drop("_l")
