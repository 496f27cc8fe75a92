"""Small numeric column helpers shared by all operators."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

RANK_DIGITS = 9


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def r9(c: Column | str) -> Column:
    """Scores are rounded to nine digits before ranking so that ties are ties everywhere."""
    return F.round(F.col(c) if isinstance(c, str) else c, RANK_DIGITS)


def safe_int(c: Column) -> Column:
    """Integer by half-to-even rounding; anything that is not a number becomes null."""
    return F.bround(c.try_cast("double"), 0).cast("long")


def log_norm(c: Column, biggest: Column) -> Column:
    return F.log1p(c) / (F.log1p(biggest) + F.lit(1e-8))


def attach(df: DataFrame, keys: list[str], *aggs: Column) -> DataFrame:
    """Add per-group aggregates to every row by aggregate-and-join.

    Unlike an unordered window this combines map-side first and leaves the rows of a hot
    group spread out: the join may be broadcast by size or split by adaptive execution.
    """
    stats = df.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(*aggs)
    cond = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return df.join(stats, cond).drop(*[f"_k_{k}" for k in keys])


def top_per_group(df: DataFrame, keys: list[str], order: list, n: int | str, rank: str = "rank") -> DataFrame:
    """First ``n`` rows of each group (``n`` may name a column constant within the group)."""
    ranked = df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("long"))
    return ranked.where(F.col(rank) <= (F.col(n) if isinstance(n, str) else n))


def by_score(score: str = "score", item: str = "poi_id") -> list:
    return [F.col(score).desc(), F.col(item).asc()]


def draw(seed, *parts) -> Column:
    """Stable 32-bit integer from a seed and a key, the same in every engine that has md5."""
    text = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


# Rows of one key that a join's task may hold on either side, and pairs it may form of them, before the key is split.
MOST_ROWS, MOST_PAIRS = 200_000, 20_000_000


def balanced_join(
    left: DataFrame, right: DataFrame, keys: list[str], left_id: list[str], right_id: list[str], most: int = MOST_ROWS, most_pairs: int = MOST_PAIRS,
) -> DataFrame:
    """Inner equi-join that splits keys with more than ``most`` rows on a side, or more than ``most_pairs`` pairs, into parts by a hash of that side's ``id`` columns.

    A hot key of l and r rows becomes ceil(l / most) x ceil(r / most) tasks' work or more, each row of one side meeting all parts of the other. The
    table of hot keys has at most (rows / most + pairs / most_pairs) rows and is broadcast. The pairs are the work and may come of a few small files, so keys
    are dealt to a fixed number of tasks that is not lowered by their bytes. Columns named as the keys appear once; no others may clash.
    """
    spark = left.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    counts = left.groupBy(*keys).agg(F.count("*").alias("_nl")).join(right.groupBy(*keys).agg(F.count("*").alias("_nr")), keys, "full").fillna(0, ["_nl", "_nr"])
    by_rows = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / most))
    by_pairs = F.ceil(F.col("_nl") * F.col("_nr") / (by_rows("_nr") * most_pairs))
    hot = counts.where(f"_nl > {most} OR _nr > {most} OR _nl * double(_nr) > {most_pairs}")
    hot = F.broadcast(hot.select(*keys, F.greatest(by_rows("_nl"), F.least("_nl", by_pairs)).cast("int").alias("_l"), by_rows("_nr").cast("int").alias("_r")))

    def dealt(df: DataFrame, own: str, other: str, ids: list[str]) -> DataFrame:
        split, copies = F.coalesce(own, F.lit(1)), F.coalesce(other, F.lit(1))
        marked = df.join(hot, keys, "left").withColumn(f"{own}_part", F.pmod(F.xxhash64(*ids), split).cast("int"))
        return marked.withColumn(f"{other}_part", F.explode(F.sequence(F.lit(0), copies - 1))).drop("_l", "_r").repartition(n, *keys, "_l_part", "_r_part")

    return dealt(left, "_l", "_r", left_id).join(dealt(right, "_r", "_l", right_id), [*keys, "_l_part", "_r_part"]).drop("_l_part", "_r_part")
