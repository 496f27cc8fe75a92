"""Reading and writing of visits, POIs, categories, saved routes and exports."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

# The raw check-in columns and the nested vendor POI fields.
CHECKIN_SCHEMA = (
    "trail_id string, user_id string, venue_id string, venue_category string, venue_schema string, "
    "venue_city string, venue_country string, timestamp string"
)
RAW_POI_SCHEMA = (
    "fsq_id string, fsq_place_id string, name string, latitude double, longitude double, "
    "geocodes struct<main: struct<latitude: double, longitude: double>>, "
    "location struct<locality: string, country: string>, "
    "categories array<struct<id: string, fsq_category_id: string, name: string>>, "
    "rating double, stats struct<total_ratings: double, usersCount: double>, ratingSignals double, price string"
)


def read_checkins_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.schema(CHECKIN_SCHEMA).option("header", True).csv(path)
    return df.select(*columns) if columns else df


def read_poi_json(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """Rows of POI objects; other values are dropped and a missing path gives no rows.

    By default a line holds one object or a list. With ``whole_files`` a file holds one object or list over any number
    of lines; such files can't be split, so each should fit a task.
    """
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
        return spark.createDataFrame([], RAW_POI_SCHEMA)
    return spark.read.schema(RAW_POI_SCHEMA).option("mode", "DROPMALFORMED").option("multiLine", whole_files).json(path)


def load_visits(visits: DataFrame, city: str | None = None, limit: int | None = None) -> DataFrame:
    out = visits.where(F.col("venue_city") == city) if city else visits
    out = out.select("trail_id", "user_id", "poi_id", "venue_city", "ts", "seq")
    return out.limit(limit) if limit else out


def load_pois(pois: DataFrame, city: str | None = None, city_id: str | None = None, columns: list[str] | None = None) -> DataFrame:
    out = pois
    if city:
        out = out.where(F.col("city").ilike(city))
    if city_id:
        out = out.where(F.col("city_id") == city_id)
    return out.select(*columns) if columns else out


def load_poi_categories(cats: DataFrame, pois: DataFrame | None = None) -> DataFrame:
    return cats if pois is None else cats.join(pois.select("poi_id"), "poi_id", "left_semi")


def load_all(visits: DataFrame, pois: DataFrame, cats: DataFrame, city_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    city_pois = pois.where(F.col("city_id") == city_id)
    return visits.where(F.col("venue_city") == city_id), city_pois, load_poi_categories(cats, city_pois)


def pois_stats(pois: DataFrame, id_column: str = "poi_id", city_id: str | None = None) -> DataFrame:
    """Ids as text and rating counts without nulls; optional columns are found by looking at the schema."""
    total = F.coalesce(F.col("total_ratings").cast("long"), F.lit(0)) if "total_ratings" in pois.columns else F.lit(0).cast("long")
    out = pois.where(F.col("city_id") == city_id) if city_id else pois
    return out.select(F.col(id_column).cast("string").alias("poi_id"), total.alias("total_ratings"),
                      *[c for c in ("primary_category", "lat", "lon") if c in pois.columns])


def first_nonempty_source(sources: DataFrame) -> DataFrame:
    """Per city keep the rows of the first non-empty candidate source, then one row per id.

    ``sources`` has city_id, source_rank, row_rank, poi_id and payload columns.
    """
    best = sources.groupBy("city_id").agg(F.min("source_rank").alias("source_rank"))
    kept = sources.join(best, ["city_id", "source_rank"])
    w = W.partitionBy("poi_id").orderBy("city_id", "row_rank")
    return kept.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def upsert(existing: DataFrame, incoming: DataFrame, key: str, load_seq: str) -> DataFrame:
    """Incoming rows replace existing rows of the same key; within incoming the latest load wins."""
    rows = existing.withColumn(load_seq, F.lit(-1).cast("long")).unionByName(incoming)
    w = W.partitionBy(key).orderBy(F.col(load_seq).desc())
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", load_seq)


def insert_categories_ignore(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Add (poi, category) pairs that have an id and a name and are not there yet; first one wins."""
    valid = incoming.where((F.col("category_id") != "") & (F.col("category_name") != ""))
    first = (
        valid.groupBy("poi_id", "category_id").agg(F.min_by("category_name", "ord").alias("category_name"))
        .join(existing, ["poi_id", "category_id"], "left_anti")
    )
    return existing.select("poi_id", "category_id", "category_name").unionByName(first)


def incremental_merge(existing: DataFrame, fetched: DataFrame, key: str, row_seq: str) -> DataFrame:
    """Existing rows, first one per key, overwritten by fetched rows, last one per key."""
    rows = existing.withColumn("_p", F.struct(F.lit(0), -F.col(row_seq))).unionByName(
        fetched.withColumn("_p", F.struct(F.lit(1), F.col(row_seq).cast("long"))))
    w = W.partitionBy(key).orderBy(F.col("_p").desc())
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_p")


def pending_ids(wanted: DataFrame, existing: DataFrame, key: str, max_requests: int | None, order: str) -> DataFrame:
    missing = wanted.join(existing, key, "left_anti")
    return missing.orderBy(order).limit(max_requests) if max_requests else missing


def route_filter(user_id: int | None = None, city_id: str | None = None) -> Column:
    cond = F.lit(True)
    if user_id is not None:
        cond = cond & (F.col("user_id") == user_id)
    if city_id is not None:
        cond = cond & (F.col("city_id") == city_id)
    return F.coalesce(cond, F.lit(False))


def list_saved_routes(routes: DataFrame, limit: int, user_id: int | None = None, city_id: str | None = None) -> DataFrame:
    n = max(1, min(1000, limit))
    return routes.where(route_filter(user_id, city_id)).orderBy(F.col("created_at").desc(), F.col("route_id").desc()).limit(n)


def delete_saved_routes(routes: DataFrame, user_id: int | None = None, city_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(remaining rows, one-row count of deleted rows)."""
    gone = route_filter(user_id, city_id)
    return routes.where(~gone), routes.where(gone).agg(F.count("*").alias("deleted"))


def new_saved_routes(routes: DataFrame) -> DataFrame:
    """Rows to append, with a generated id and creation time."""
    return routes.select(F.expr("uuid()").alias("route_id"), F.current_timestamp().alias("created_at"), "*")


def point_feature() -> Column:
    """One GeoJSON point feature per stop; ``step`` is 1-based."""
    return F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"),
        F.struct(F.col("poi_id").alias("fsq_id"), F.col("name"), F.col("primary_category"), F.col("rating"),
                 F.col("price_tier"), F.col("step").alias("order")).alias("properties"),
    )


def to_geojson(stops: DataFrame, key: str) -> DataFrame:
    """One FeatureCollection per route of bounded length (at most k stops)."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("step", point_feature().alias("f")))), lambda x: x["f"])
    doc = F.struct(F.lit("FeatureCollection").alias("type"), ordered.alias("features"))
    return stops.groupBy(key).agg(F.to_json(doc, {"ignoreNullFields": "false"}).alias("geojson"))


def to_records(df: DataFrame) -> DataFrame:
    """Rows as JSON text, not-a-number written as null."""
    cleaned = [
        F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c)
        for c, t in df.dtypes
    ]
    return df.select(F.to_json(F.struct(*cleaned), {"ignoreNullFields": "false"}).alias("record"))
