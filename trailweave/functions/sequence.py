"""Ordered operations inside groups that may be very large.

A plain window sends a whole group to one task. Here a group that holds an outsized share of
the rows is cut into ordered chunks at split points sampled from that group, the window runs
per (group, chunk), and the few chunk borders are stitched afterwards. The result is the
same as that of the plain window for any split points; they only decide the layout.
The plan is the same at every size.

The split table has about one point for every ``hot_rows`` rows of hot groups, hence at most some
(rows / hot_rows) points in all - 200,000 for 10^12 rows - and is broadcast.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

SAMPLES_PER_CHUNK = 16
# A group below this many rows is sorted by one task without trouble.
DEFAULT_HOT_ROWS = 5_000_000


def split_points(df: DataFrame, key: list[str], order: list[str], hot_rows: int, sample_mod: int) -> DataFrame:
    """(key..., _splits array<struct>) for each group of more than ``hot_rows`` rows, from a sample."""
    point = F.struct(*[F.col(c).alias(c) for c in order])
    sampled = df.select(*key, point.alias("_p")).where(
        F.pmod(F.xxhash64(*[F.col(c) for c in key + order], F.lit(1)), F.lit(sample_mod)) == 0)
    counts = sampled.groupBy(*key).agg(F.count("*").alias("_m")) if key else sampled.agg(F.count("*").alias("_m"))
    hot = (
        counts.where(F.col("_m") * sample_mod > hot_rows)
        .withColumn("_c", F.ceil(F.col("_m") * sample_mod / hot_rows).cast("int"))
    )
    picked = (
        (sampled.join(F.broadcast(hot), key) if key else sampled.join(F.broadcast(hot), F.lit(True)))
        .where(F.pmod(F.xxhash64(F.col("_p"), F.lit(2)),
                      F.greatest(F.lit(1), F.floor(F.col("_m") / (F.col("_c") * SAMPLES_PER_CHUNK)))) == 0)
    )
    lists = picked.groupBy(*key, "_c").agg(F.array_sort(F.collect_list("_p")).alias("_s"))
    cuts = F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("_c") - 1)),
        lambda i: F.element_at("_s", F.greatest(F.lit(1), F.floor(i * F.size("_s") / F.col("_c")).cast("int"))))
    return lists.select(*key, F.array_distinct(cuts).alias("_splits"))


def with_chunks(df: DataFrame, key: list[str], order: list[str], hot_rows: int | None = None, sample_mod: int = 64) -> DataFrame:
    """Add ``_chunk``: 0 for ordinary groups, an order-preserving chunk number for hot ones."""
    hot_rows = hot_rows or DEFAULT_HOT_ROWS
    splits = F.broadcast(split_points(df, key, order, hot_rows, sample_mod))
    point = F.struct(*[F.col(c).alias(c) for c in order])
    marked = (df.join(splits, key, "left") if key else df.join(splits, F.lit(True), "left"))
    passed = F.size(F.filter("_splits", lambda s: s <= point))
    return marked.withColumns({
        "_hot": F.col("_splits").isNotNull(),
        "_chunk": F.when(F.col("_splits").isNull(), 0).otherwise(passed),
    }).drop("_splits")


def lead_values(
    df: DataFrame, key: list[str], order: list[str], values: dict[str, str], steps: int = 1,
    hot_rows: int | None = None, sample_mod: int = 64,
) -> DataFrame:
    """Add, for each step 1..steps, the value ``steps`` rows later in the group.

    ``values`` maps a source column to the output name; step 2 and beyond get a ``_2`` suffix.
    """
    names = {(c, s): out if s == 1 else f"{out}_{s}" for c, out in values.items() for s in range(1, steps + 1)}
    chunked = with_chunks(df, key, order, hot_rows, sample_mod)
    w = W.partitionBy(*key, "_chunk").orderBy(*order)
    row = F.struct(*[F.col(c).alias(c) for c in values])
    inner = chunked.withColumns({f"_l{s}": F.lead(row, s).over(w) for s in range(1, steps + 1)})
    inner = inner.withColumn("_left", F.count("*").over(w.rowsBetween(1, steps)).cast("int"))
    # the first rows of each chunk of a hot group, in order; an ordinary group has chunk 0 only
    order_row = F.struct(*[F.col(c).alias(f"o_{c}") for c in order], row.alias("v"))
    heads = (
        chunked.where("_hot").withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= steps)
        .groupBy(*key, "_chunk").agg(F.array_sort(F.collect_list(order_row)).alias("_h"))
    )
    wc = W.partitionBy(*key).orderBy("_chunk").rowsBetween(1, steps)
    followers = heads.select(*key, "_chunk", F.slice(F.flatten(F.collect_list("_h").over(wc)), 1, steps).alias("_next"))
    joined = inner.join(followers, key + ["_chunk"], "left")
    out = joined
    for (c, s), name in names.items():
        borrowed = F.get("_next", F.lit(s - 1) - F.col("_left"))
        out = out.withColumn(name, F.coalesce(F.col(f"_l{s}"), F.when(F.lit(s) > F.col("_left"), borrowed["v"]))[c])
    return out.drop("_chunk", "_hot", "_left", "_next", *[f"_l{s}" for s in range(1, steps + 1)])


def positions(
    df: DataFrame, key: list[str], order: list[str], out: str = "pos",
    hot_rows: int | None = None, sample_mod: int = 64,
) -> DataFrame:
    """Add the 1-based position of each row in its group (the whole table when ``key`` is empty)."""
    chunked = with_chunks(df, key, order, hot_rows, sample_mod)
    sizes = chunked.groupBy(*key, "_chunk").agg(F.count("*").alias("_rows"))
    before = W.partitionBy(*(key or [F.lit(0)])).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*key, "_chunk", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_off"))
    local = F.row_number().over(W.partitionBy(*key, "_chunk").orderBy(*order)).cast("long")
    return (
        chunked.withColumn("_local", local).join(offsets, key + ["_chunk"])
        .withColumn(out, F.col("_local") + F.col("_off")).drop("_chunk", "_hot", "_local", "_off")
    )


def exact_quantiles(df: DataFrame, column: str, qs: dict[str, float], hot_rows: int | None = None, weight: str | None = None) -> DataFrame:
    """One row with linearly interpolated quantiles, found by position instead of one big sort task.

    ``weight`` names a row-count column when each row stands for several equal values.
    """
    values = df.where(F.col(column).isNotNull()).select(F.col(column).alias("v"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("w"))
    counted = values.groupBy("v").agg(F.sum("w").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    ranked = running_total(counted, ["v"], "n", "upto", hot_rows)
    joined = ranked.join(F.broadcast(total), F.lit(True))
    aggs = []
    for name, q in qs.items():
        at = (F.col("total") - 1) * F.lit(q)
        lo, hi = F.floor(at), F.ceil(at)
        covers = lambda r: (F.col("upto") > r) & (F.col("upto") - F.col("n") <= r)
        v_lo = F.max(F.when(covers(lo), F.col("v")))
        v_hi = F.max(F.when(covers(hi), F.col("v")))
        frac = F.max(at - lo)
        aggs.append((v_lo + (v_hi - v_lo) * frac).alias(name))
    return joined.agg(*aggs)


def running_total(df: DataFrame, order: list[str], value: str, out: str, hot_rows: int | None = None, sample_mod: int = 64) -> DataFrame:
    """Inclusive running sum over the whole table."""
    chunked = with_chunks(df, [], order, hot_rows, sample_mod)
    sums = chunked.groupBy("_chunk").agg(F.sum(value).alias("_sum"))
    before = W.partitionBy(F.lit(0)).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select("_chunk", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_off"))
    w = W.partitionBy("_chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return (
        chunked.withColumn("_part", F.sum(value).over(w)).join(offsets, "_chunk")
        .withColumn(out, F.col("_part") + F.col("_off")).drop("_chunk", "_hot", "_part", "_off")
    )
