"""Trail sequences and transition models as long tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from trailweave.functions.numeric import attach, by_score, top_per_group
from trailweave.functions.sequence import lead_values, positions

TRAIL_ORDER = ["ts", "seq", "poi_id", "tie"]
USER_ORDER = ["ts", "trail_id", "seq", "poi_id", "tie"]


def trail_positions(visits: DataFrame, out: str = "pos", hot_rows: int | None = None) -> DataFrame:
    """Every visit with its 1-based position in the trail."""
    return positions(visits, ["trail_id"], TRAIL_ORDER, out, hot_rows)


def trail_lengths(visits: DataFrame) -> DataFrame:
    return visits.groupBy("trail_id").agg(F.count("*").alias("n_visits"))


def trail_pieces(placed: DataFrame, piece: int, halo: int, values: list[str]) -> DataFrame:
    """(trail_id, trail_key, piece, items): trails in pieces of ``piece`` places, each with up to ``halo`` places more on both sides.

    ``placed`` has trail_id, pos and the ``values``; ``items`` are structs (pos, own, values...) in order, ``own`` false in the
    margins. Every place is its own in one piece, and there all places at most ``halo`` away are at hand.
    """
    at = lambda p: F.floor(p / piece).cast("long")
    place = F.col("pos") - 1
    spread = placed.withColumn("piece", F.explode(F.sequence(at(F.greatest(place - halo, F.lit(0))), at(place + halo))))
    item = F.struct("pos", (at(place) == F.col("piece")).alias("own"), *values)
    arrays = spread.groupBy("trail_id", "piece").agg(F.array_sort(F.collect_list(item)).alias("items"), F.bool_or(at(place) == F.col("piece")).alias("_any"))
    return arrays.where("_any").select("trail_id", F.xxhash64("trail_id").alias("trail_key"), "piece", "items")


def trail_sequences(visits: DataFrame, min_len: int = 2, piece: int = 1000, hot_rows: int | None = None, halo: int = 0) -> DataFrame:
    """(trail_id, piece, venues, first, own): ordered venue arrays, long trails cut into pieces of ``piece`` so that no array grows beyond it.

    With a ``halo`` of the window's width a piece also has the places around it; its own are the ``own`` ones from index ``first`` on, and
    pairs whose centre is its own are together those of the uncut trail. Trails shorter than ``min_len`` are left out.
    """
    placed = trail_positions(visits.select("trail_id", *TRAIL_ORDER), "pos", hot_rows)
    arrays = trail_pieces(placed.select("trail_id", "pos", "poi_id"), piece, halo, ["poi_id"])
    own = F.filter("items", lambda x: x["own"])
    rows = arrays.select("trail_id", "piece", F.transform("items", lambda x: x["poi_id"]).alias("venues"),
                         (own[0]["pos"] - F.col("items")[0]["pos"]).cast("int").alias("first"), F.size(own).alias("own"))
    return rows.where((F.col("own") >= min_len) | (F.col("piece") > 0))


def user_history(visits: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """(user_id, pos, poi_id): ordered visits per user, one row per visit."""
    return positions(visits.select("user_id", *USER_ORDER), ["user_id"], USER_ORDER, "pos", hot_rows).select("user_id", "pos", "poi_id")


def conditional(pairs: DataFrame, given: list[str], then: str, p: str = "p") -> DataFrame:
    """Counts (given..., then, n) to conditional probabilities."""
    return attach(pairs, given, F.sum("n").alias("_total")).withColumn(p, F.col("n") / F.col("_total")).drop("_total")


def consecutive(visits: DataFrame, columns: list[str], steps: int = 1, hot_rows: int | None = None, key: list[str] | None = None) -> DataFrame:
    """Adds next_<column> (and next_<column>_2) along each trail."""
    return lead_values(visits, key or ["trail_id"], TRAIL_ORDER, {c: f"next_{c}" for c in columns}, steps, hot_rows)


def transition_counts(visits: DataFrame, hot_rows: int | None = None, scope: list[str] | None = None) -> DataFrame:
    """(scope..., a, b, n): how often b follows a on a trail; ``scope`` names columns that are constant on a trail."""
    scope = scope or []
    pairs = consecutive(visits.select("trail_id", *scope, *TRAIL_ORDER), ["poi_id"], 1, hot_rows)
    return (
        pairs.where("next_poi_id IS NOT NULL")
        .groupBy(*scope, F.col("poi_id").alias("a"), F.col("next_poi_id").alias("b")).agg(F.count("*").alias("n"))
    )


def transitions_poi(visits: DataFrame, hot_rows: int | None = None, scope: list[str] | None = None) -> DataFrame:
    """(scope..., a, b, n, p): first-order transition probabilities, self-transitions included."""
    return conditional(transition_counts(visits, hot_rows, scope), [*(scope or []), "a"], "b")


def transitions_order2(visits: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """(p, a, b, n, p2): probability of b after the pair (p, a)."""
    rows = consecutive(visits.select("trail_id", *TRAIL_ORDER), ["poi_id"], 2, hot_rows).where("next_poi_id_2 IS NOT NULL")
    counts = rows.groupBy(F.col("poi_id").alias("p"), F.col("next_poi_id").alias("a"), F.col("next_poi_id_2").alias("b")).agg(F.count("*").alias("n"))
    return conditional(counts, ["p", "a"], "b", "p2")


def transitions_cat(visits: DataFrame, pois: DataFrame, hot_rows: int | None = None, scope: list[str] | None = None) -> DataFrame:
    """(scope..., cat_a, cat_b, n, p): both ends need a known primary category.

    POI transitions are counted first, so the category lookup runs on distinct POI pairs.
    """
    scope = scope or []
    cats = pois.where("primary_category IS NOT NULL").select("poi_id", "primary_category")
    counts = (
        transition_counts(visits, hot_rows, scope)
        .join(cats.select(F.col("poi_id").alias("a"), F.col("primary_category").alias("cat_a")), "a")
        .join(cats.select(F.col("poi_id").alias("b"), F.col("primary_category").alias("cat_b")), "b")
        .groupBy(*scope, "cat_a", "cat_b").agg(F.sum("n").alias("n"))
    )
    return conditional(counts, [*scope, "cat_a"], "cat_b")


def labelled_visits(visits: DataFrame, poi_label: DataFrame, label: str) -> DataFrame:
    """Visits whose POI has a label; the others are removed before pairing."""
    return visits.join(poi_label.where(F.col(label).isNotNull()).select("poi_id", label), "poi_id")


def transitions_label(visits: DataFrame, poi_label: DataFrame, label: str, hot_rows: int | None = None) -> DataFrame:
    """Row-normalised label matrix with zero cells for every pair of labels that occur."""
    rows = labelled_visits(visits, poi_label, label)
    pairs = consecutive(rows, [label], 1, hot_rows).where(F.col(f"next_{label}").isNotNull())
    counts = pairs.groupBy(F.col(label).alias("label_a"), F.col(f"next_{label}").alias("label_b")).agg(F.count("*").alias("n"))
    labels = rows.select(F.col(label).alias("label")).distinct()
    # one row holding the label set (a handful of intents), so the spine is an explode and not a product
    spine = labels.agg(F.array_sort(F.collect_set("label")).alias("all"))
    cells = spine.select(F.explode("all").alias("label_a"), "all").select("label_a", F.explode("all").alias("label_b"))
    totals = counts.groupBy("label_a").agg(F.sum("n").alias("total"))
    return (
        cells.join(counts, ["label_a", "label_b"], "left").join(totals, "label_a", "left")
        .select("label_a", "label_b", F.coalesce("n", F.lit(0)).cast("long").alias("n"),
                F.coalesce(F.col("n") / F.col("total"), F.lit(0.0)).alias("p"))
    )


def transition_graph(matrix: DataFrame, threshold: float = 0.03, min_edges: int = 2, min_edges_transport: int = 3) -> DataFrame:
    """Edges to keep per source: those above the threshold, or the strongest few when too few pass."""
    rows = matrix.where((F.col("label_a") != F.col("label_b")) & (F.col("p") > 0))
    need = F.when(F.lower("label_a") == "transport", min_edges_transport).otherwise(min_edges)
    rows = attach(rows, ["label_a"], F.count_if(F.col("p") >= threshold).alias("_passing"))
    rank = F.row_number().over(W.partitionBy("label_a").orderBy(F.col("p").desc(), "label_b"))
    rows = rows.withColumn("_rank", rank)
    keep = F.when(F.col("_passing") >= need, F.col("p") >= threshold).otherwise(F.col("_rank") <= need)
    return rows.where(keep).drop("_passing", "_rank")


def position_links(visits: DataFrame, poi_label: DataFrame, label: str, min_count: int = 2, hot_rows: int | None = None) -> DataFrame:
    """Label links between the 1st-2nd and the 2nd-3rd stop of trails with three stops or more."""
    rows = labelled_visits(visits, poi_label, label)
    placed = trail_positions(rows, "pos", hot_rows).where("pos <= 3")
    first = placed.groupBy("trail_id").agg(*[F.max(F.when(F.col("pos") == i, F.col(label))).alias(f"l{i}") for i in (1, 2, 3)])
    first = first.where("l3 IS NOT NULL")
    links = first.select(F.explode(F.array(
        F.struct(F.lit(1).alias("step"), F.col("l1").alias("source"), F.col("l2").alias("target")),
        F.struct(F.lit(2).alias("step"), F.col("l2").alias("source"), F.col("l3").alias("target")))).alias("x")).select("x.*")
    return links.groupBy("step", "source", "target").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def top_edges(visits: DataFrame, pois: DataFrame, top_n: int = 40, hot_rows: int | None = None) -> DataFrame:
    """Strongest POI-to-POI edges without self loops whose ends both have coordinates, with visit counts."""
    edges = (
        transition_counts(visits, hot_rows).where("a <> b")
        .orderBy(F.col("n").desc(), "a", "b").limit(top_n)
    )
    ends = edges.select(F.explode(F.array("a", "b")).alias("poi_id")).distinct()
    counts = visits.join(F.broadcast(ends), "poi_id", "left_semi").groupBy("poi_id").agg(F.count("*").alias("visit_count"))
    info = pois.where("lat IS NOT NULL AND lon IS NOT NULL").join(F.broadcast(ends), "poi_id", "left_semi").select("poi_id").join(
        counts, "poi_id", "left").select("poi_id", F.coalesce("visit_count", F.lit(0)).alias("visit_count"))
    return (
        edges.join(info.select(F.col("poi_id").alias("a"), F.col("visit_count").alias("visits_a")), "a")
        .join(info.select(F.col("poi_id").alias("b"), F.col("visit_count").alias("visits_b")), "b")
    )


def edge_graph(edges: DataFrame, top_pois: int = 20) -> DataFrame:
    """Edges among the POIs with the largest edge weight, with the share of each source's kept weight."""
    weight = edges.select(F.explode(F.array("a", "b")).alias("poi_id"), "n").groupBy("poi_id").agg(F.sum("n").alias("w"))
    top = weight.orderBy(F.col("w").desc(), "poi_id").limit(top_pois).select("poi_id")
    kept = edges.join(F.broadcast(top.withColumnRenamed("poi_id", "a")), "a", "left_semi").join(
        F.broadcast(top.withColumnRenamed("poi_id", "b")), "b", "left_semi")
    return conditional(kept.select("a", "b", "n"), ["a"], "b")


def located_visits(visits: DataFrame, pois: DataFrame) -> DataFrame:
    return visits.join(pois.where("lat IS NOT NULL AND lon IS NOT NULL").select("poi_id", "lat", "lon"), "poi_id")


def real_trails_sample(visits: DataFrame, pois: DataFrame, n: int = 50, min_stops: int = 4) -> DataFrame:
    """Stops of the first ``n`` trails having at least ``min_stops`` stops with coordinates."""
    stops = located_visits(visits, pois)
    first = trail_lengths(stops).where(F.col("n_visits") >= min_stops).orderBy("trail_id").limit(n).select("trail_id")
    return trail_positions(stops.join(F.broadcast(first), "trail_id", "left_semi"), "step").select("trail_id", "step", "poi_id", "lat", "lon")


def longest_trail(visits: DataFrame, pois: DataFrame, min_stops: int = 6, city: str = "venue_city") -> DataFrame:
    """Per city, the steps of the trail with most stops that have coordinates and a time."""
    stops = located_visits(visits.where("ts IS NOT NULL"), pois)
    lengths = stops.groupBy(city, "trail_id").agg(F.count("*").alias("n")).where(F.col("n") >= min_stops)
    best = top_per_group(lengths, [city], [F.col("n").desc(), F.col("trail_id")], 1).select(city, "trail_id")
    chosen = stops.join(best, [city, "trail_id"], "left_semi")
    return positions(chosen, [city, "trail_id"], TRAIL_ORDER, "step").select(city, "trail_id", "step", "poi_id")


def next_poi_top(visits: DataFrame, k: int = 10, hot_rows: int | None = None) -> DataFrame:
    """For each user the k likeliest unseen successors of the last visited POI."""
    last = visits.groupBy("user_id").agg(F.max_by("poi_id", F.struct(*USER_ORDER)).alias("a"))
    seen = visits.select("user_id", F.col("poi_id").alias("b")).distinct()
    cands = last.join(transitions_poi(visits, hot_rows), "a").join(seen, ["user_id", "b"], "left_anti")
    scored = cands.select("user_id", F.col("a").alias("current_poi"), F.col("b").alias("poi_id"), F.round("p", 9).alias("score"))
    return top_per_group(scored, ["user_id"], by_score(), k)


def leg_distance(stops: DataFrame, key: list[str], step: str, anchor: tuple[Column, Column] | None = None) -> DataFrame:
    """Adds leg_km: distance from the previous stop; for the first stop from the anchor, or null.

    Routes are short (at most k stops), so a plain window per route is enough.
    """
    from trailweave.functions.geo import haversine_km

    w = W.partitionBy(*key).orderBy(step)
    plat, plon = F.lag("lat").over(w), F.lag("lon").over(w)
    if anchor is not None:
        first = F.row_number().over(w) == 1
        plat, plon = F.when(first, anchor[0]).otherwise(plat), F.when(first, anchor[1]).otherwise(plon)
    return stops.withColumns({"_plat": plat, "_plon": plon}).withColumn(
        "leg_km", haversine_km(F.col("_plat"), F.col("_plon"), F.col("lat"), F.col("lon"))).drop("_plat", "_plon")


def trail_legs(visits: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """leg_km to the next stop for visits that carry lat/lon, trails of any length."""
    from trailweave.functions.geo import haversine_km

    rows = lead_values(visits, ["trail_id"], TRAIL_ORDER, {"lat": "n_lat", "lon": "n_lon", "poi_id": "next_poi_id"}, 1, hot_rows)
    return rows.where("next_poi_id IS NOT NULL").withColumn(
        "leg_km", haversine_km(F.col("lat"), F.col("lon"), F.col("n_lat"), F.col("n_lon"))).drop("n_lat", "n_lon")


def last_n_context(history: Column, current: Column, n: int) -> Column:
    """Last n items with the current one moved to the end; n <= 0 keeps only the last one."""
    moved = F.when(current.isNotNull(), F.concat(F.array_remove(history, current), F.array(current))).otherwise(history)
    keep = max(int(n), 1)
    return F.when(F.size(moved) > keep, F.slice(moved, -keep, keep)).otherwise(moved)


def last_n_rows(history: DataFrame, currents: DataFrame, n: int) -> DataFrame:
    """Row form of the context for histories of any length.

    ``history`` is (case_id, pos, poi_id), ``currents`` is (case_id, current_poi or null).
    Only the last n rows per case survive the map-side group limit.
    """
    keep = max(int(n), 1)
    rows = history.join(currents, "case_id")
    rows = rows.where(F.col("current_poi").isNull() | (F.col("poi_id") != F.col("current_poi"))).select("case_id", "pos", "poi_id")
    now = currents.where("current_poi IS NOT NULL").select("case_id", F.lit(2 ** 62).cast("long").alias("pos"), F.col("current_poi").alias("poi_id"))
    return top_per_group(rows.unionByName(now), ["case_id"], [F.col("pos").desc()], keep, "back").drop("pos")


def prev_poi(history: Column, current: Column) -> Column:
    """Second-to-last item when the last equals the current one, else the last."""
    last = F.try_element_at(history, F.lit(-1))
    return F.when((F.size(history) >= 2) & (last == current), F.try_element_at(history, F.lit(-2))).otherwise(last)


def last_items(visits: DataFrame, n: int) -> DataFrame:
    """(user_id, last_items): the last n visited POIs per user, oldest first."""
    newest = top_per_group(visits.select("user_id", "poi_id", *[c for c in USER_ORDER if c != "poi_id"]), ["user_id"],
                           [F.col(c).desc() for c in USER_ORDER], n, "back")
    return newest.groupBy("user_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct((-F.col("back")).alias("o"), "poi_id"))), lambda x: x["poi_id"]).alias("last_items"))
