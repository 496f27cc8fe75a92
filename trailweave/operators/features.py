"""Popularity, interaction, co-visit and TF-IDF features as long tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trailweave.functions.numeric import attach
from trailweave.functions.sequence import positions

# Distinct POIs of one trail handled by one (trail, chunk) group of the pair join.
PAIR_CHUNK = 2048
# Fixed value: a token is a run of word characters.
TOKEN = r"(?U)\w+"


def item_counts(visits: DataFrame) -> DataFrame:
    return visits.groupBy("poi_id").agg(F.count("*").alias("n_visits"))


def interactions(visits: DataFrame) -> DataFrame:
    return visits.groupBy("user_id", "poi_id").agg(F.count("*").alias("n"))


def trail_pairs(visits: DataFrame, trail: str = "trail_id", chunk: int = PAIR_CHUNK) -> DataFrame:
    """(trail, a, b) with a < b over the distinct POIs of each trail.

    A trail with many POIs is joined in chunks: its left side is spread over
    ceil(n / chunk) groups and its right side is copied to each of them, so no task gets the
    whole trail.
    """
    distinct = visits.select(F.col(trail).alias("trail_id"), "poi_id").distinct()
    sized = attach(distinct, ["trail_id"], F.ceil(F.count("*") / chunk).cast("int").alias("_chunks"))
    left = sized.select("trail_id", F.col("poi_id").alias("a"), F.pmod(F.xxhash64("poi_id"), F.col("_chunks")).cast("int").alias("_c"))
    right = sized.select("trail_id", F.col("poi_id").alias("b"), F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)).alias("_c"))
    return left.join(right, ["trail_id", "_c"]).where("a < b").drop("_c")


def cooccurrence(visits: DataFrame, trail: str = "trail_id") -> DataFrame:
    """(a, b, n): symmetric counts of trails holding both POIs.

    Counted once per unordered pair with map-side combination, mirrored afterwards.
    """
    half = trail_pairs(visits, trail).groupBy("a", "b").agg(F.count("*").alias("n"))
    mirror = F.array(F.struct(F.col("a").alias("a"), F.col("b").alias("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return half.select(F.explode(mirror).alias("x"), "n").select("x.a", "x.b", "n")


def tokens(cats: DataFrame) -> DataFrame:
    """(poi_id, term, tf): word counts over the category names of a POI."""
    words = F.regexp_extract_all(F.lower("category_name"), F.lit(TOKEN), F.lit(0))
    return cats.select("poi_id", F.explode(words).alias("term")).groupBy("poi_id", "term").agg(F.count("*").alias("tf"))


def signatures(cats: DataFrame) -> DataFrame:
    """(poi_id, sig): the sorted category names of a POI as text.

    POIs with equal signatures have equal TF-IDF vectors, so vectors and similarities are
    computed once per signature and expanded to POIs only where needed.
    """
    return cats.where("category_name IS NOT NULL").groupBy("poi_id").agg(
        F.array_join(F.array_sort(F.collect_list("category_name")), "|").alias("sig"))


def number_signatures(sig_text: DataFrame) -> DataFrame:
    """(poi_id, sig, sig_text): signatures numbered from 1 in text order; joins then carry a number."""
    ids = positions(sig_text.select(F.col("sig").alias("sig_text")).distinct(), [], ["sig_text"], "sig").withColumn("sig", F.col("sig").cast("int"))
    return sig_text.withColumnRenamed("sig", "sig_text").join(ids, "sig_text").select("poi_id", "sig", "sig_text")


def tfidf_by_signature(cats: DataFrame, scope: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Signature vectors and the POI-to-signature map.

    Returns (scope, sig, term, weight) and (scope, poi_id, sig); ``sig`` is a number in the
    order of the signature text. Weights are tf * (ln((1 + n) / (1 + df)) + 1), L2-normalised;
    n and df count POIs of the scope. ``scope`` is (poi_id, scope); without it all POIs share
    the scope "ALL".
    """
    numbered = number_signatures(signatures(cats))
    scoped = numbered.join(scope.select("poi_id", "scope"), "poi_id") if scope is not None else numbered.withColumn("scope", F.lit("ALL"))
    sig_sizes = scoped.groupBy("scope", "sig", "sig_text").agg(F.count("*").alias("n_pois"))
    words = F.regexp_extract_all(F.lower("sig_text"), F.lit(TOKEN), F.lit(0))
    tf = sig_sizes.select("scope", "sig", "n_pois", F.explode(words).alias("term")).groupBy("scope", "sig", "n_pois", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("scope", "term").agg(F.sum("n_pois").alias("df"))
    total = sig_sizes.groupBy("scope").agg(F.sum("n_pois").alias("n_docs"))
    raw = tf.join(df, ["scope", "term"]).join(total, "scope").withColumn(
        "raw", F.col("tf") * (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1))
    normed = attach(raw, ["scope", "sig"], F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("_norm"))
    vectors = normed.select("scope", "sig", "term", (F.col("raw") / F.col("_norm")).alias("weight"))
    return vectors, scoped.select("scope", "poi_id", "sig")


def tfidf(cats: DataFrame) -> DataFrame:
    """(poi_id, term, weight)."""
    vectors, sig_of = tfidf_by_signature(cats)
    return sig_of.join(vectors, ["scope", "sig"]).select("poi_id", "term", "weight")
