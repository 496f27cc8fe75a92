"""Visit, POI, category, request and vector tables derived from the star-schema parquet files.

Every property is a lazy DataFrame, so an operator only reads the columns it uses.
"""
from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

# The 24 category names of the derived POI table, by p_partkey % 24.
CATEGORY_NAMES = [
    "Art Museum", "Park", "Sushi Restaurant", "Airport", "Karaoke Bar", "Department Store",
    "Car Wash", "Hospital", "Movie Theater", "Metro Station", "Onsen", "Zoo", "Soccer Stadium",
    "Garden", "Hotel", "Intersection", "Buddhist Temple", "Coffee Shop", "Night Club", "Library",
    "Gym", "Rest Area", "Home (private)", "Theme Park",
]


def _nth(values, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def category_name_of(index):
    return _nth(CATEGORY_NAMES, index)


def category_id_of(index):
    return F.concat(F.lit("c"), F.lpad(index.cast("string"), 2, "0"))


def city_of(poi):
    bucket = poi % 10
    return F.when(bucket < 6, "C1").when(bucket < 9, "C2").otherwise("C3")


class Tables:
    """The input tables of one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def pois(self) -> DataFrame:
        key = F.col("p_partkey").cast("long")
        located = key % 97 != 0
        priced = key % 7 != 0
        tier = (F.col("p_size") % 5).cast("int")
        return self.raw("part").select(
            key.alias("poi_id"),
            F.col("p_name").alias("name"),
            F.when(located, F.lit(34.60) + ((key * 7919) % 1000).cast("double") * F.lit(0.00015)).alias("lat"),
            F.when(located, F.lit(135.40) + ((key * 104729) % 997).cast("double") * F.lit(0.0002)).alias("lon"),
            city_of(key).alias("city_id"),
            F.when(key % 5 != 0, F.round(F.lit(5.0) + (F.col("p_retailprice") - 900) / 20, 1)).alias("rating"),
            F.when(priced, tier).alias("price_tier"),
            ((key * 31) % 500).cast("int").alias("total_ratings"),
            category_name_of(key % 24).alias("primary_category"),
            (priced & (tier == 0)).alias("is_free"),
        )

    @cached_property
    def poi_categories(self) -> DataFrame:
        key = F.col("p_partkey").cast("long")
        first = F.struct(F.lit(0).alias("ord"), (key % 24).alias("ci"))
        second = F.struct(F.lit(1).alias("ord"), ((key * 5 + 3) % 24).alias("ci"))
        rows = F.when(key % 2 == 0, F.array(first, second)).otherwise(F.array(first))
        return (
            self.raw("part").select(key.alias("poi_id"), F.explode(rows).alias("c"))
            .select("poi_id", "c.ord", category_id_of(F.col("c.ci")).alias("category_id"),
                    category_name_of(F.col("c.ci")).alias("category_name"))
        )

    @cached_property
    def visits(self) -> DataFrame:
        items = self.raw("lineitem").select(
            F.col("l_orderkey").alias("trail_id"), F.col("l_partkey").alias("poi_id"),
            F.col("l_linenumber").alias("seq"), F.col("l_suppkey").alias("tie"))
        trails = self.raw("orders").select(
            F.col("o_orderkey").alias("trail_id"), F.col("o_custkey").alias("user_id"),
            F.col("o_orderdate").alias("ts"))
        return items.join(trails, "trail_id").select(
            "trail_id", "user_id", "poi_id", city_of(F.col("poi_id")).alias("venue_city"), "ts", "seq", "tie")

    @cached_property
    def raw_checkins(self) -> DataFrame:
        """Uncleaned check-ins: prefixed ids, blanks, unparsable timestamps, a foreign city."""
        v = self.visits
        pick = (F.col("trail_id") + F.col("seq")) % 13
        ts = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
        return v.select(
            F.col("trail_id").cast("string").alias("trail_id"), F.col("user_id").cast("string").alias("user_id"),
            F.when(pick == 3, F.lit(None).cast("string"))
            .otherwise(F.concat(F.lit(" foursquare:"), F.col("poi_id").cast("string"), F.lit(" "))).alias("venue_id"),
            F.concat(F.lit("schema:"), category_name_of(F.col("poi_id") % 24)).alias("venue_category"),
            F.lit("schema:Place").alias("venue_schema"),
            F.when(pick == 5, F.lit("wd:C9")).otherwise(F.concat(F.lit("wd:"), F.col("venue_city"))).alias("venue_city"),
            F.lit("wd:X1").alias("venue_country"),
            F.when(pick == 7, F.lit("not a time")).when(pick == 9, F.lit(None).cast("string")).otherwise(ts).alias("timestamp"),
            F.col("seq"), F.col("tie"),
        )

    @cached_property
    def raw_pois(self) -> DataFrame:
        """Nested vendor documents as JSON text, two shapes mixed; some have no coordinates."""
        p = self.pois
        pid = F.col("poi_id").cast("string")
        s = F.concat
        key = F.when(F.col("poi_id") % 3 == 0, "fsq_place_id").otherwise("fsq_id")
        coords = F.when(
            F.col("poi_id") % 2 == 0,
            s(F.lit('"latitude":'), F.col("lat").cast("string"), F.lit(',"longitude":'), F.col("lon").cast("string")),
        ).otherwise(s(F.lit('"geocodes":{"main":{"latitude":'), F.col("lat").cast("string"), F.lit(',"longitude":'),
                      F.col("lon").cast("string"), F.lit("}}")))
        coords = F.coalesce(coords, F.lit('"latitude":null'))
        cat_id = F.when(F.col("poi_id") % 11 == 0, "").otherwise("x")
        name = F.when(F.col("poi_id") % 4 == 1, s(F.lit(',"name":"n'), pid, F.lit('"'))).otherwise("")
        loc = F.when(F.col("poi_id") % 6 == 1, s(F.lit(',"location":{"locality":"'), F.col("city_id"),
                                                 F.lit('","country":"JP"}'))).otherwise("")
        stats = (F.when(F.col("poi_id") % 5 == 1, s(F.lit(',"stats":{"usersCount":'), F.col("total_ratings").cast("string"), F.lit("}")))
                 .when(F.col("poi_id") % 5 == 2, s(F.lit(',"ratingSignals":'), F.col("total_ratings").cast("string"))).otherwise(""))
        price = (F.when(F.col("poi_id") % 4 == 0, s(F.lit(',"price":{"tier":'), (F.col("poi_id") % 5).cast("string"), F.lit("}")))
                 .when(F.col("poi_id") % 4 == 2, s(F.lit(',"price":'), (F.col("poi_id") % 5).cast("string"))).otherwise(""))
        return p.select("poi_id", s(
            F.lit('{"'), key, F.lit('":"foursquare:'), pid, F.lit('",'), coords,
            F.lit(',"categories":[{"id":"'), cat_id, F.lit('","name":"'), F.coalesce("primary_category", F.lit("")), F.lit('"}]'),
            name, F.coalesce(loc, F.lit("")), F.coalesce(stats, F.lit("")), price, F.lit("}")).alias("doc"))

    @cached_property
    def price_labels(self) -> DataFrame:
        """Category price labels; some ids are known only by name, some tiers are missing."""
        n = F.col("n")
        return (
            self.poi_categories.groupBy("category_id", "category_name").agg(F.count("*").alias("n"))
            .select(
                F.when(F.substring("category_id", 3, 1).isin("3", "7"), F.concat(F.lit("alt::"), F.col("category_id")))
                .otherwise(F.col("category_id")).alias("label_id"),
                F.col("category_name").alias("name"),
                (n % 5 == 0).alias("free"),
                F.when(n % 3 != 0, (n % 4).cast("int")).alias("price_tier"),
                F.when(n % 2 == 0, "model").alias("source"),
            )
        )

    @cached_property
    def requests(self) -> DataFrame:
        """One request per customer, in six signal mixes (none, user, place, preferences, ...)."""
        ck = F.col("c_custkey").cast("long")
        kind = ck % 6
        variant = F.floor(ck / 6) % 3
        placed = kind.isin(2, 3, 5)
        prefs = (
            F.when(kind == 2, "museum,park,cheap")
            .when((kind == 4) & (variant == 0), "Sushi Restaurant,free,price:x")
            .when((kind == 4) & (variant == 1), "coffee, Coffee , zoo,mid,,")
            .when(kind == 4, "price_tier: 2,Onsen,gratis,paid")
            .when(kind == 5, "paid,max_price:2, zoo")
        )
        return self.raw("customer").select(
            ck.alias("req_id"),
            F.when(kind.isin(1, 2, 5), ck).alias("user_id"),
            F.when((kind == 2) | ((kind == 3) & (ck % 4 == 1)), (ck * 13) % 2000 + 1).alias("current_poi"),
            F.when(placed, F.lit(34.60) + ((ck * 7919) % 1000).cast("double") * F.lit(0.00015)).alias("lat"),
            F.when(placed, F.lit(135.40) + ((ck * 104729) % 997).cast("double") * F.lit(0.0002)).alias("lon"),
            prefs.alias("prefs"),
            F.when(kind == 4, "strict").otherwise("soft").alias("category_mode"),
            F.when(kind == 4, 5).when(kind.isin(2, 3), 8).otherwise(10).cast("int").alias("k"),
            (ck % 4 == 1).alias("proximity"),
        )

    @cached_property
    def item_vectors(self) -> DataFrame:
        return self.raw("embeddings").select(
            (F.col("vec_id") + 1).cast("long").alias("poi_id"), F.col("embedding").cast("array<double>").alias("vec"))

    @cached_property
    def user_vectors(self) -> DataFrame:
        return self.raw("embeddings").select(
            (F.col("vec_id") * 3 + 1).cast("long").alias("user_id"), F.col("embedding").cast("array<double>").alias("vec"))
