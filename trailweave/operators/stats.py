"""Dataset statistics: counts, coverage, distributions, spatial and temporal summaries."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trailweave.functions.geo import mercator_x, mercator_y
from trailweave.functions.numeric import top_per_group
from trailweave.functions.sequence import exact_quantiles, running_total
from trailweave.operators.features import item_counts


def city_stats(visits: DataFrame, pois: DataFrame) -> DataFrame:
    """Per city: visits, users, trails, mean trail length, POIs and matrix sparsity."""
    trails = visits.groupBy(F.col("venue_city").alias("city_id"), "trail_id").agg(F.count("*").alias("n"))
    lengths = trails.groupBy("city_id").agg(F.sum("n").alias("n_visits"), F.count("*").alias("n_trails"), F.avg("n").alias("avg_trail"))
    users = visits.groupBy(F.col("venue_city").alias("city_id")).agg(F.countDistinct("user_id").alias("n_users"))
    n_pois = pois.groupBy("city_id").agg(F.count("*").alias("n_pois"))
    rows = n_pois.join(lengths, "city_id", "left").join(users, "city_id", "left")
    rows = rows.select("city_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_visits", "n_users", "n_trails", "n_pois")],
                       F.coalesce("avg_trail", F.lit(0.0)).alias("avg_trail"))
    return rows.withColumn("sparsity", 1.0 - F.col("n_visits") / F.greatest(F.col("n_users") * F.col("n_pois"), F.lit(1)))


def minmax_columns(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Column-wise min-max; a column without spread is divided by one."""
    ends = df.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    joined = df.join(F.broadcast(ends), F.lit(True))

    def norm(c: str) -> Column:
        spread = F.col(f"_hi_{c}") - F.col(f"_lo_{c}")
        return ((F.col(c) - F.col(f"_lo_{c}")) / F.when(spread > 0, spread).otherwise(F.lit(1.0))).alias(c)

    return joined.select(key, *[norm(c) for c in columns])


def visits_per_label(visits: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """Visits per city and label; POI counts come first so the join is per POI and not per visit."""
    counts = visits.groupBy("venue_city", "poi_id").agg(F.count("*").alias("n"))
    return counts.join(labels, "poi_id").groupBy("venue_city", label).agg(F.sum("n").alias("n_visits"))


def label_supply_demand(visits: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """Per label the number of POIs and of check-ins, zero where one side is absent."""
    supply = labels.groupBy(label).agg(F.count("*").alias("n_pois"))
    demand = item_counts(visits).join(labels, "poi_id", "left").groupBy(F.coalesce(label, F.lit("Other")).alias(label)).agg(F.sum("n_visits").alias("n_visits"))
    return supply.join(demand, label, "full_outer").select(
        label, F.coalesce("n_pois", F.lit(0)).alias("n_pois"), F.coalesce("n_visits", F.lit(0)).alias("n_visits"))


def top_categories(cats: DataFrame, n: int = 15) -> DataFrame:
    return cats.groupBy("category_name").agg(F.count("*").alias("cnt")).orderBy(F.col("cnt").desc(), "category_name").limit(n)


def top_primary(pois: DataFrame, cats: DataFrame, n: int = 5) -> DataFrame:
    """Per city the n most frequent first categories; POI primary names where a city has no category rows."""
    listed = cats.where("ord = 0").join(pois.select("poi_id", "city_id"), "poi_id").groupBy("city_id", "category_name").agg(F.count("*").alias("cnt"))
    bare = pois.join(listed.select("city_id").distinct(), "city_id", "left_anti")
    fallback = bare.groupBy("city_id", F.coalesce("primary_category", F.lit("Unknown")).alias("category_name")).agg(F.count("*").alias("cnt"))
    return top_per_group(listed.unionByName(fallback), ["city_id"], [F.col("cnt").desc(), F.col("category_name")], n)


def table_counts(visits: DataFrame, pois: DataFrame, cats: DataFrame) -> DataFrame:
    """Row counts of the three tables, POIs per city, visits per city."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), F.lit("").alias("city_id"), "n")
             for name, df in (("visits", visits), ("pois", pois), ("poi_categories", cats))]
    parts.append(pois.groupBy("city_id").agg(F.count("*").alias("n")).select(F.lit("pois_by_city").alias("what"), "city_id", "n"))
    parts.append(visits.groupBy(F.col("venue_city").alias("city_id")).agg(F.count("*").alias("n")).select(F.lit("visits_by_city").alias("what"), "city_id", "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _missing(c: str, dtype: str) -> Column:
    if dtype == "string":
        return F.col(c).isNull() | (F.trim(c) == "")
    if dtype.startswith("array"):
        return F.col(c).isNull() | (F.size(c) <= 0)
    return F.col(c).isNull()


def null_profile(df: DataFrame, columns: list[str], by: str | None = None) -> DataFrame:
    """Long table (by, column, n_null, n_rows, pct_null) from one pass over the data."""
    types = dict(df.dtypes)
    groups = [by] if by else []
    wide = df.groupBy(*groups).agg(F.count("*").alias("n_rows"), *[F.count_if(_missing(c, types[c])).alias(f"_n_{c}") for c in columns])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_n_{c}").alias("n_null")) for c in columns])
    return wide.select(*groups, "n_rows", F.explode(cells).alias("x")).select(
        *groups, "x.column", "x.n_null", "n_rows", (100.0 * F.col("x.n_null") / F.greatest("n_rows", F.lit(1))).alias("pct_null"))


def duplicate_ids(df: DataFrame, key: str, by: str) -> DataFrame:
    per_id = df.groupBy(by, key).agg(F.count("*").alias("n"))
    return per_id.groupBy(by).agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_ids"), (F.sum("n") - F.count("*")).alias("n_duplicates"))


def coverage(visits: DataFrame, pois: DataFrame, by: str = "venue_city") -> DataFrame:
    """Distinct visited ids found in the POI table, per city and over all cities."""
    known = pois.select("poi_id").distinct().withColumn("_ok", F.lit(True))
    ids = visits.select(by, "poi_id").distinct().join(known, "poi_id", "left")
    per_city = ids.groupBy(by).agg(F.count("*").alias("n_ids"), F.count("_ok").alias("matched"))
    overall = ids.groupBy("poi_id").agg(F.max("_ok").alias("_ok")).agg(F.count("*").alias("n_ids"), F.count("_ok").alias("matched"))
    both = per_city.unionByName(overall.select(F.lit("ALL").alias(by), "n_ids", "matched"))
    return both.withColumns({
        "missing": F.col("n_ids") - F.col("matched"),
        "coverage_pct": F.coalesce(100.0 * F.col("matched") / F.nullif("n_ids", F.lit(0)), F.lit(0.0))})


def city_summary(visits: DataFrame, pois: DataFrame, cats: DataFrame) -> DataFrame:
    """One row per city: volumes, coverage, null percentages and the five most frequent categories."""
    base = city_stats(visits, pois).select("city_id", "n_visits", "n_users", "n_trails")
    cov = coverage(visits, pois).select(F.col("venue_city").alias("city_id"), F.col("n_ids").alias("n_unique_visit_pois"), F.round("coverage_pct", 2).alias("poi_coverage_pct"))
    cols = ["lat", "lon", "name", "rating", "price_tier", "total_ratings"]
    nulls = pois.groupBy("city_id").agg(*[
        F.round(100.0 * F.count_if(F.col(c).isNull()) / F.greatest(F.count("*"), F.lit(1)), 2).alias(f"null_{c}_pct") for c in cols])
    top = top_primary(pois, cats, 5).groupBy("city_id").agg(F.concat_ws("; ", F.transform(
        F.array_sort(F.collect_list(F.struct("rank", F.format_string("%s (%d)", "category_name", "cnt").alias("txt")))), lambda x: x["txt"])).alias("top5_primary_categories"))
    out = base.join(cov, "city_id", "left").join(nulls, "city_id", "left").join(top, "city_id", "left")
    return out.fillna({"top5_primary_categories": "-", "n_unique_visit_pois": 0, "poi_coverage_pct": 0.0})


def visits_profile(visits: DataFrame) -> DataFrame:
    return visits.agg(
        F.count("*").alias("n_rows"), F.countDistinct("user_id").alias("n_users"), F.countDistinct("trail_id").alias("n_trails"),
        F.countDistinct("poi_id").alias("n_venues"), F.min("ts").alias("ts_min"), F.max("ts").alias("ts_max"))


def visit_counts(visits: DataFrame) -> DataFrame:
    """Long table (dimension, id, n) of visits per city, user and trail."""
    parts = [visits.groupBy(F.col(c).cast("string").alias("id")).agg(F.count("*").alias("n")).select(F.lit(d).alias("dimension"), "id", "n")
             for d, c in (("city", "venue_city"), ("user", "user_id"), ("trail", "trail_id"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def category_catalog(cats: DataFrame, pois: DataFrame) -> DataFrame:
    """Counts per (category id, name), per city and over all cities (city_id null)."""
    rows = cats.where("category_id <> '' AND category_name <> ''").join(pois.select("poi_id", "city_id"), "poi_id")
    per_city = rows.groupBy("city_id", "category_id", "category_name").agg(F.count("*").alias("n"))
    overall = per_city.groupBy("category_id", "category_name").agg(F.sum("n").alias("n"))
    return per_city.unionByName(overall.select(F.lit(None).cast("string").alias("city_id"), "category_id", "category_name", "n"))


def inconsistent_categories(cats: DataFrame) -> DataFrame:
    """Category ids seen with more than one name."""
    names = cats.select("category_id", "category_name").distinct()
    return names.groupBy("category_id").agg(F.count("*").alias("n_names"), F.min("category_name").alias("first_name"), F.max("category_name").alias("last_name")).where("n_names > 1")


def hour_dow(events: DataFrame, ts: str = "ts") -> DataFrame:
    """Check-ins by hour and weekday (0 = Monday), all 24 x 7 cells, one column per weekday."""
    spark = events.sparkSession
    hours = spark.range(24).select(F.col("id").cast("int").alias("hour"))
    counted = events.where(F.col(ts).isNotNull()).groupBy(F.hour(ts).alias("hour")).agg(
        *[F.count_if(F.weekday(ts) == d).alias(f"d{d}") for d in range(7)])
    return hours.join(counted, "hour", "left").select("hour", *[F.coalesce(f"d{d}", F.lit(0)).alias(f"d{d}") for d in range(7)])


def trail_length_hist(visits: DataFrame) -> DataFrame:
    """Trails per number of distinct POIs, with the mean and median over all trails on each row."""
    lengths = visits.select("trail_id", "poi_id").distinct().groupBy("trail_id").agg(F.count("*").alias("n_pois"))
    hist = lengths.groupBy("n_pois").agg(F.count("*").alias("n_trails"))
    overall = hist.agg((F.sum(F.col("n_pois") * F.col("n_trails")) / F.sum("n_trails")).alias("mean"), F.expr("percentile(n_pois, 0.5, n_trails)").alias("median"))
    return hist.join(F.broadcast(overall), F.lit(True))


def user_activity(visits: DataFrame) -> DataFrame:
    """(n, n_users): how many users made n visits."""
    return visits.groupBy("user_id").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("n_users"))


def lorenz_curve(visits: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Corner points of the curve of cumulative visits against cumulative users, least active first.

    Users with the same activity lie on one straight piece, so one point per activity level
    describes the whole curve and no per-user ranking is needed.
    """
    levels = user_activity(visits).withColumn("visits", F.col("n") * F.col("n_users"))
    cum = running_total(running_total(levels, ["n"], "n_users", "cum_users", hot_rows), ["n"], "visits", "cum_visits", hot_rows)
    total = levels.agg(F.sum("n_users").alias("_u"), F.sum("visits").alias("_v"))
    return cum.join(F.broadcast(total), F.lit(True)).select(
        "n", "n_users", (F.col("cum_users") / F.col("_u")).alias("user_share"), (F.col("cum_visits") / F.col("_v")).alias("visit_share"))


def activity_histogram(visits: DataFrame, bins: int = 50) -> DataFrame:
    """Users per equal-width bin of activity; the last bin includes the maximum."""
    levels = user_activity(visits)
    ends = levels.agg(F.min("n").alias("_lo"), F.max("n").alias("_hi"))
    width = F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1)) / F.lit(float(bins))
    b = F.least(F.lit(bins - 1), F.floor((F.col("n") - F.col("_lo")) / width)).cast("long")
    return levels.join(F.broadcast(ends), F.lit(True)).groupBy(b.alias("bin")).agg(F.sum("n_users").alias("n_users"))


def top_matrix(visits: DataFrame, n_users: int = 50, n_pois: int = 50) -> tuple[DataFrame, DataFrame]:
    """Cells visited at least once among the top users and POIs, and the sparsity of that matrix."""
    def top(column: str, n: int) -> DataFrame:
        return F.broadcast(visits.groupBy(column).agg(F.count("*").alias("c")).orderBy(F.col("c").desc(), column).limit(n).select(column))

    users, pois = top("user_id", n_users), top("poi_id", n_pois)
    cells = visits.join(users, "user_id", "left_semi").join(pois, "poi_id", "left_semi").groupBy("user_id", "poi_id").agg(F.count("*").alias("n"))
    size = users.agg(F.count("*").alias("u")).join(pois.agg(F.count("*").alias("p")), F.lit(True))
    sparsity = cells.agg(F.count("*").alias("filled")).join(size, F.lit(True)).select(
        "filled", (1.0 - F.coalesce(F.col("filled") / F.nullif(F.col("u") * F.col("p"), F.lit(0)), F.lit(0.0))).alias("sparsity"))
    return cells, sparsity


def located_xy(df: DataFrame) -> DataFrame:
    return df.where("lat IS NOT NULL AND lon IS NOT NULL").withColumns({"x": mercator_x(F.col("lon")), "y": mercator_y(F.col("lat"))})


def grid(df: DataFrame, cells: int, pad: float, hot_rows: int | None = None, weight: str | None = None) -> DataFrame:
    """Adds square cell numbers; 0..cells-1 cover the 1 % to 99 % coordinate extent widened by ``pad``.

    Points beyond the extent keep their (negative or larger) cell numbers, none is dropped.
    """
    qx = exact_quantiles(df, "x", {"x0": 0.01, "x1": 0.99}, hot_rows, weight)
    qy = exact_quantiles(df, "y", {"y0": 0.01, "y1": 0.99}, hot_rows, weight)
    ends = F.broadcast(qx.join(qy, F.lit(True)))
    out = df.join(ends, F.lit(True))

    def cell(v: str, lo: str, hi: str) -> Column:
        spread = F.col(hi) - F.col(lo)
        return F.floor((F.col(v) - (F.col(lo) - pad * spread)) / (spread * (1 + 2 * pad) / cells)).cast("long")

    return out.withColumns({"cx": cell("x", "x0", "x1"), "cy": cell("y", "y0", "y1")})


def spatial_bin_mean(pois: DataFrame, cells: int = 95, min_count: int = 2, hot_rows: int | None = None) -> DataFrame:
    """Mean rating per cell with at least ``min_count`` POIs; a missing rating counts as zero."""
    placed = grid(located_xy(pois), cells, 0.16, hot_rows)
    return placed.groupBy("cx", "cy").agg(F.count("*").alias("n"), F.avg(F.coalesce("rating", F.lit(0.0))).alias("rating")).where(F.col("n") >= min_count)


def checkin_density(visits: DataFrame, pois: DataFrame, cells: int = 60, hot_rows: int | None = None) -> DataFrame:
    """Check-ins per cell; visits are counted per POI before the coordinates are joined."""
    placed = located_xy(item_counts(visits).join(pois.select("poi_id", "lat", "lon"), "poi_id"))
    return grid(placed, cells, 0.07, hot_rows, "n_visits").groupBy("cx", "cy").agg(F.sum("n_visits").alias("n_visits"))


def poi_map_table(pois: DataFrame, intents: DataFrame) -> DataFrame:
    """POIs with coordinates and intent; a missing rating becomes the median rating."""
    placed = pois.where("lat IS NOT NULL AND lon IS NOT NULL")
    med = placed.where("rating IS NOT NULL").groupBy("rating").agg(F.count("*").alias("n")).agg(F.expr("percentile(rating, 0.5, n)").alias("_m"))
    return placed.join(F.broadcast(med), F.lit(True)).join(intents, "poi_id").select(
        "poi_id", "lat", "lon", "intent", F.coalesce("rating", "_m", F.lit(1.0)).alias("rating"))
