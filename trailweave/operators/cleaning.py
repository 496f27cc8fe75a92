"""Cleaning, normalisation and merging of check-ins and POIs."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trailweave.functions import text
from trailweave.functions.geo import valid_latlon
from trailweave.functions.sequence import positions

# Accepted cities by alias (lower case): city id, file key, name, country.
CITY_ALIASES = {
    "osaka": ("Q35765", "Osaka", "Osaka", "Japan"),
    "istanbul": ("Q406", "Istanbul", "Istanbul", "Turkey"),
    "estambul": ("Q406", "Istanbul", "Istanbul", "Turkey"),
    "petalingjaya": ("Q864965", "PetalingJaya", "Petaling Jaya", "Malaysia"),
    "petaling jaya": ("Q864965", "PetalingJaya", "Petaling Jaya", "Malaysia"),
}
# City-name variants rewritten to one canonical name.
CITY_VARIANTS = {
    "Osaka": [
        "大阪市", "大阪市中央区", "大阪市西区", "大阪市福島区", "大阪市天王寺区", "中央区", "港区", "北区",
        "浪速区", "西成区", "梅田", "福島区", "キタ", "都島区", "天王寺区", "西区", "東成区", "Osaka",
    ],
}
# The check-in text columns that are normalised, and the time format written out.
TEXT_COLUMNS = ["venue_id", "venue_category", "venue_schema", "venue_city", "venue_country"]
ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def clean_visits(raw: DataFrame, valid_cities: list[str]) -> DataFrame:
    """Valid cities only, no null venue or time, normalised text, parsed UTC time as ISO text."""
    kept = raw.where(F.col("venue_city").isin(*valid_cities)).dropna(subset=["venue_id", "timestamp"])
    parsed = F.col("timestamp").try_cast("timestamp")
    return (
        kept.withColumn("ts", parsed).where("ts IS NOT NULL")
        .withColumns({c: text.normalize_field(F.col(c)) for c in TEXT_COLUMNS})
        .withColumn("timestamp", F.date_format("ts", ISO_FORMAT))
    )


def dense_reindex(df: DataFrame, column: str, row_seq: str, out: str, hot_rows: int | None = None) -> DataFrame:
    """(column, out): ids numbered 1..N by first appearance in ``row_seq`` order; nulls are left out."""
    first = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.min(row_seq).alias("_first"))
    return positions(first, [], ["_first", column], out, hot_rows).select(column, out)


def extract_city_ids(visits: DataFrame, city: str, order: str) -> DataFrame:
    """Distinct cleaned venue ids of a city with their first-seen order value."""
    ids = visits.where(F.col("venue_city") == city).select(text.clean_id(F.col("venue_id")).alias("venue_id"), F.col(order))
    return ids.where("venue_id IS NOT NULL").groupBy("venue_id").agg(F.min(order).alias("first_seen"))


def _nonempty(c: Column) -> Column:
    return F.when(c != "", c)


def normalize_pois(raw: DataFrame) -> DataFrame:
    """Nested vendor records (sources.scans.RAW_POI_SCHEMA) to the canonical POI record."""
    fid = F.coalesce(_nonempty(F.col("fsq_id")), _nonempty(F.col("fsq_place_id")))
    use_main = F.col("latitude").isNull()
    cats = F.filter(
        F.transform(F.coalesce("categories", F.array().cast("array<struct<id: string, fsq_category_id: string, name: string>>")),
                    lambda c: F.struct(F.coalesce(_nonempty(c["id"]), _nonempty(c["fsq_category_id"])).alias("id"), _nonempty(c["name"]).alias("name"))),
        lambda c: c["id"].isNotNull() & c["name"].isNotNull())
    nonzero = lambda c: F.when(c != 0, c)
    return (
        raw.withColumn("fid", fid).where("fid IS NOT NULL")
        .withColumn("categories", cats)
        .withColumn("primary_category", F.try_element_at("categories", F.lit(1))["name"])
        .select(
            F.col("fid").alias("fsq_id"),
            F.coalesce(_nonempty(F.col("name")), "primary_category", F.concat(F.lit("POI-"), "fid")).alias("name"),
            F.when(use_main, F.col("geocodes.main.latitude")).otherwise(F.col("latitude")).alias("lat"),
            F.when(use_main, F.col("geocodes.main.longitude")).otherwise(F.col("longitude")).alias("lon"),
            F.col("location.locality").alias("city"), F.col("location.country").alias("country"), "rating",
            F.coalesce(nonzero(F.col("stats.total_ratings")), F.col("stats.usersCount"), F.col("ratingSignals")).alias("total_ratings"),
            F.coalesce(F.get_json_object("price", "$.tier").try_cast("double"), F.col("price").try_cast("double")).alias("price"),
            "categories", "primary_category",
        )
    )


def merge_poi_sources(first: DataFrame, second: DataFrame, key: str = "fsq_id") -> DataFrame:
    """Full outer merge; values of the second source that are not null, '' or [] override."""
    columns = [c for c in first.columns if c != key]
    types = dict(first.dtypes)

    def pick(c: str) -> Column:
        b = F.col(f"b.{c}")
        if types[c].startswith("array"):
            b = F.when(F.size(b) > 0, b)
        elif types[c] == "string":
            b = _nonempty(b)
        # rows of only the second source keep their values as they are
        return F.when(F.col(f"a.{key}").isNull(), F.col(f"b.{c}")).otherwise(F.coalesce(b, F.col(f"a.{c}"))).alias(c)

    joined = first.alias("a").join(second.alias("b"), F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    return joined.select(F.coalesce(F.col(f"a.{key}"), F.col(f"b.{key}")).alias(key), *[pick(c) for c in columns])


def keep_valid_pois(pois: DataFrame, city_name: str, country: str) -> DataFrame:
    kept = pois.where(valid_latlon(F.col("lat"), F.col("lon")) & (F.size("categories") > 0))
    fill = lambda c, v: F.when(F.trim(c) != "", F.col(c)).otherwise(F.lit(v))
    return kept.withColumns({"city": fill("city", city_name), "country": fill("country", country)})


def prune_visits(visits: DataFrame, valid: DataFrame, city: str) -> DataFrame:
    """Drop visits of one city whose POI is not valid; visits of other cities are untouched."""
    marks = valid.select("poi_id").distinct().withColumn("_ok", F.lit(True))
    return visits.join(marks, "poi_id", "left").where((F.col("venue_city") != city) | F.col("_ok")).drop("_ok")


def alias_table(spark, aliases: dict | None = None) -> DataFrame:
    rows = [(k, *v) for k, v in (aliases or CITY_ALIASES).items()]
    return spark.createDataFrame(rows, "alias string, city_qid string, file_key string, city_name string, country string")


def resolve_city(df: DataFrame, column: str, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(resolved rows, rows with an unknown alias). The alias table is a small fixed list."""
    key = F.lower(F.trim(column))
    tried = df.withColumns({"_k1": key, "_k2": F.replace(key, F.lit(" "), F.lit(""))})
    small = F.broadcast(aliases)
    cols = ["city_qid", "file_key", "city_name", "country"]
    a1 = small.select(F.col("alias").alias("_k1"), F.struct(*cols).alias("_m1"))
    a2 = small.select(F.col("alias").alias("_k2"), F.struct(*cols).alias("_m2"))
    joined = tried.join(a1, "_k1", "left").join(a2, "_k2", "left").withColumn("_m", F.coalesce("_m1", "_m2")).drop("_k1", "_k2", "_m1", "_m2")
    return joined.where("_m IS NOT NULL").select(*df.columns, "_m.*"), joined.where("_m IS NULL").select(*df.columns)


def canonical_city(column: str, variants: dict[str, list[str]] | None = None) -> Column:
    out = F.col(column)
    for canon, names in (variants or CITY_VARIANTS).items():
        out = F.when(F.col(column).isin(*names), canon).otherwise(out)
    return out


def fill_latlon(df: DataFrame, pois: DataFrame) -> DataFrame:
    """Left join POI coordinates where the rows have none."""
    place = pois.select("poi_id", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    have = [c for c in ("lat", "lon") if c in df.columns]
    joined = df.join(place, "poi_id", "left")
    lat = F.coalesce("lat", "_lat") if "lat" in have else F.col("_lat")
    lon = F.coalesce("lon", "_lon") if "lon" in have else F.col("_lon")
    return joined.withColumns({"lat": lat, "lon": lon}).drop("_lat", "_lon")


def coalesce_latlon_names(df: DataFrame) -> DataFrame:
    """Take lat/lon from the first alternative column name present, when they are missing."""
    # Alternative coordinate column names in order of preference.
    choices = {"lat": ("lat_x", "lat_y", "latitude"), "lon": ("lon_x", "lon_y", "lng", "longitude")}
    out = df
    for name, others in choices.items():
        found = next((c for c in others if c in df.columns), None)
        if name not in df.columns and found:
            out = out.withColumn(name, F.col(found))
    return out


def prepare_visits(visits: DataFrame) -> DataFrame:
    return visits.withColumns({
        "venue_id": text.clean_id(F.col("venue_id")), "venue_city": text.clean_id(F.col("venue_city"), "wd:"),
        "timestamp": F.col("timestamp").try_cast("timestamp")})


def prepare_pois(pois: DataFrame) -> DataFrame:
    numbers = [c for c in ("lat", "lon", "rating", "price_tier", "total_ratings") if c in pois.columns]
    return pois.withColumns({c: F.col(c).try_cast("double") for c in numbers})
