"""Train/test splits and evaluation cases."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from trailweave.functions.numeric import top_per_group
from trailweave.functions.sequence import positions
from trailweave.operators.features import interactions
from trailweave.operators.transitions import TRAIL_ORDER, USER_ORDER
from trailweave.session import materialize


def _tail_split(visits: DataFrame, key: str, order: list[str], test_size: int, min_train: int, hot_rows: int | None = None) -> DataFrame:
    """Adds ``part``: the last ``test_size`` rows of each group are "test"; small groups drop out."""
    sizes = visits.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") >= test_size + max(min_train, 1))
    placed = positions(visits, [key], order, "_pos", hot_rows).join(sizes, key)
    part = F.when(F.col("_pos") > F.col("_n") - test_size, "test").otherwise("train")
    return placed.select(*visits.columns, part.alias("part"))


def split_user(visits: DataFrame, test_size: int = 1, min_train: int = 1) -> DataFrame:
    return _tail_split(visits, "user_id", USER_ORDER, test_size, min_train)


def split_trail(visits: DataFrame, test_size: int = 1, min_train: int = 1) -> DataFrame:
    return _tail_split(visits, "trail_id", TRAIL_ORDER, test_size, min_train)


def split_last_trail(visits: DataFrame, min_train: int = 1, min_test_pois: int = 4) -> DataFrame:
    """Adds ``part``: the last trail of a user is "test" when it and the rest are long enough."""
    trails = visits.groupBy("user_id", "trail_id").agg(F.max("ts").alias("_end"), F.count("*").alias("_n"))
    users = trails.groupBy("user_id").agg(
        F.max_by("trail_id", F.struct("_end", "trail_id")).alias("trail_id"), F.max_by("_n", F.struct("_end", "trail_id")).alias("_test"),
        F.sum("_n").alias("_all"), F.count("*").alias("_trails"))
    tested = users.where((F.col("_trails") >= 2) & (F.col("_test") >= min_test_pois) & (F.col("_all") - F.col("_test") >= min_train))
    marks = tested.select("user_id", "trail_id", F.lit("test").alias("_part"))
    return visits.join(marks, ["user_id", "trail_id"], "left").select(*visits.columns, F.coalesce("_part", F.lit("train")).alias("part"))


@dataclass
class Cases:
    """cases (case_id, scope, user_id, current_poi, prev_poi), history (case_id, poi_id, n),
    seen (case_id, poi_id), truth (case_id, poi_id), all_cases (before skipping empty truth)."""

    cases: DataFrame
    history: DataFrame
    seen: DataFrame
    truth: DataFrame
    all_cases: DataFrame

    def materialize(self) -> "Cases":
        """The same cases as written tables, since every engine and metric starts from them."""
        return Cases(*[materialize(df) for df in (self.cases, self.history, self.seen, self.truth, self.all_cases)])

    @property
    def skipped(self) -> DataFrame:
        return self.all_cases.join(self.cases.select("case_id"), "case_id", "left_anti")


def _last_two(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    newest = top_per_group(rows, [key], [F.col(c).desc() for c in order], 2, "_back")
    pick = lambda i: F.max(F.when(F.col("_back") == i, F.col("poi_id")))
    return newest.groupBy(key).agg(pick(1).alias("current_poi"), pick(2).alias("prev_poi"))


def _finish(base: DataFrame, history: DataFrame, seen: DataFrame, truth: DataFrame, drop_seen_truth: bool) -> Cases:
    truth = truth.select("case_id", "poi_id").distinct()
    if drop_seen_truth:
        truth = truth.join(seen, ["case_id", "poi_id"], "left_anti")
    live = truth.select("case_id").distinct()
    cases = base.join(live, "case_id", "left_semi").select("case_id", F.lit("ALL").alias("scope"), "user_id", "current_poi", "prev_poi")
    keep = cases.select("case_id")
    return Cases(cases, history.join(keep, "case_id", "left_semi"), seen.join(keep, "case_id", "left_semi"), truth.join(keep, "case_id", "left_semi"), base)


def cases_user(split: DataFrame) -> Cases:
    train, test = split.where("part = 'train'"), split.where("part = 'test'")
    base = _last_two(train, "user_id", USER_ORDER).withColumn("case_id", F.col("user_id"))
    history = interactions(train).withColumnRenamed("user_id", "case_id")
    return _finish(base, history, history.select("case_id", "poi_id"), test.select(F.col("user_id").alias("case_id"), "poi_id"), True)


def cases_trail(split: DataFrame, drop_seen_truth: bool = True) -> Cases:
    train, test = split.where("part = 'train'"), split.where("part = 'test'")
    owner = train.groupBy("trail_id").agg(F.max_by("user_id", F.struct(*TRAIL_ORDER)).alias("user_id"))
    base = _last_two(train, "trail_id", TRAIL_ORDER).join(owner, "trail_id").withColumnRenamed("trail_id", "case_id")
    history = base.select("case_id", "user_id").join(interactions(train), "user_id").select("case_id", "poi_id", "n")
    seen = train.select(F.col("trail_id").alias("case_id"), "poi_id").distinct()
    return _finish(base, history, seen, test.select(F.col("trail_id").alias("case_id"), "poi_id"), drop_seen_truth)


def cases_last_trail(split: DataFrame) -> Cases:
    """Seed: first POI of the held-out trail; truth: its other POIs; previous POI unknown."""
    train, test = split.where("part = 'train'"), split.where("part = 'test'")
    first = test.groupBy("user_id").agg(F.min_by("poi_id", F.struct(*TRAIL_ORDER)).alias("current_poi"), F.count("*").alias("_n"))
    have_train = train.select("user_id").distinct()
    base = first.where("_n >= 2").join(have_train, "user_id", "left_semi").select(
        F.col("user_id").alias("case_id"), "user_id", "current_poi", F.lit(None).cast("long").alias("prev_poi"))
    history = interactions(train).withColumnRenamed("user_id", "case_id").join(base.select("case_id"), "case_id", "left_semi")
    seen = history.select("case_id", "poi_id").unionByName(base.select("case_id", F.col("current_poi").alias("poi_id"))).distinct()
    return _finish(base, history, seen, test.select(F.col("user_id").alias("case_id"), "poi_id"), True)


def sample_cases(cases: DataFrame, case: str, seed: int, n: int | None) -> DataFrame:
    """A seeded shuffle of the cases, first n kept; ordered by a hash of seed and case."""
    drawn = cases.withColumn("draw", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(case).cast("string"))))
    return drawn.orderBy("draw", case).limit(n) if n else drawn
