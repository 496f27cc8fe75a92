"""Sharding by extendible hashing, in DataFrame functions alone.

A key's hash is read bit by bit. A bucket at depth d holds the keys that share their first d bits; only a bucket
over the byte limit is split on the next bit. The tree is found from byte counts of fine cells (equal hash
prefixes), so rows are counted once and never moved; cells that are still too large are counted again with
more bits, alone.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailweave.session import materialize

BITS = 60


def key_hash(key: Column) -> Column:
    """The first 60 bits of the key's MD5; a null key counts as the empty string."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def prefix(h: Column, bits: int) -> Column:
    return F.shiftright(h, BITS - bits)


def grow(rows: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """Leaves of the tree between two depths over rows (h, bytes) whose buckets at depth ``low`` are to be split (or tried, at 0).

    (cell, depth, bucket, bucket_bytes, bucket_docs, open): for each prefix of ``high`` bits its leaf; ``open`` where even
    the cell is over the limit.
    """
    cells = materialize(rows.groupBy(prefix(F.col("h"), high).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("docs")))
    first = low + 1 if low else 0
    levels = cells.withColumn("depth", F.explode(F.sequence(F.lit(first), F.lit(high)))).withColumn(
        "bucket", F.expr(f"shiftright(cell, {high} - depth)"))
    nodes = levels.groupBy("depth", "bucket").agg(F.sum("bytes").alias("bucket_bytes"), F.sum("docs").alias("bucket_docs"))
    fitting = levels.select("cell", "depth", "bucket").join(nodes, ["depth", "bucket"]).where((F.col("bucket_bytes") <= limit) | (F.col("bucket_docs") == 1) | (F.col("depth") == high))
    leaf = fitting.groupBy("cell").agg(F.min(F.struct("depth", "bucket", "bucket_bytes", "bucket_docs")).alias("leaf"))
    return materialize(leaf.select("cell", "leaf.*").withColumn("open", (F.col("bucket_bytes") > limit) & (F.col("bucket_docs") > 1)))


def assign(df: DataFrame, limit: int, key: Column, size: Column, spare_bits: int = 4, step: int = 8) -> DataFrame:
    """``df`` with shard string, depth int, shard_bytes long and shard_docs long added (columns so named are replaced).

    The shard's name is its bits, the empty string for the whole. Every shard has at most ``limit`` bytes, save
    a single row over the limit, which is a shard by itself, and rows of one key (or one hash) that have more
    together: those share all bits and stay together. Null sizes count as 0, null keys as the empty string. Repeated
    rows count each. An empty table gives no rows.
    """
    df = df.withColumn("_h", key_hash(key))
    rows = df.select(F.col("_h").alias("h"), F.coalesce(size, F.lit(0)).cast("long").alias("bytes"))
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    low, high = 0, min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + spare_bits)
    found = None
    out = df
    while True:
        leaves = grow(rows, low, high, limit)
        here = leaves.select(F.col("cell").alias("_cell"), F.struct("depth", "bucket", "bucket_bytes", "bucket_docs").alias(f"_leaf{high}"))
        out = out.withColumn("_cell", prefix(F.col("_h"), high)).join(here, "_cell", "left").drop("_cell")
        found = F.col(f"_leaf{high}") if found is None else F.coalesce(F.col(f"_leaf{high}"), found)
        still = leaves.where("open").select("cell")
        if high == BITS or still.isEmpty():
            break
        rows = rows.withColumn("cell", prefix(F.col("h"), high)).join(still, "cell", "left_semi").drop("cell")
        low, high = high, min(BITS, high + step)
    out = out.withColumn("_leaf", found)
    name = F.when(F.col("_leaf.depth") == 0, F.lit("")).otherwise(F.expr("lpad(bin(_leaf.bucket), _leaf.depth, '0')"))
    out = (out.withColumn("shard", name).withColumn("depth", F.col("_leaf.depth")).withColumn("shard_bytes", F.col("_leaf.bucket_bytes"))
           .withColumn("shard_docs", F.col("_leaf.bucket_docs")))
    return out.drop("_h", *[c for c in out.columns if c.startswith("_leaf")])


def directory(assigned: DataFrame) -> DataFrame:
    """The directory over the global depth: for each shard the first and last entry (hash prefixes of that many bits) that lead to it."""
    shards = assigned.select("shard", "depth", "shard_bytes", "shard_docs").distinct()
    deepest = shards.agg(F.max("depth").alias("global_depth"))
    first = F.expr("shiftleft(coalesce(cast(conv(shard, 2, 10) as bigint), 0L), global_depth - depth)")
    free = F.expr("shiftleft(1L, global_depth - depth)")
    return shards.join(F.broadcast(deepest), F.lit(True)).withColumn("first_entry", first).withColumn("last_entry", F.col("first_entry") + free - 1)


def write(assigned: DataFrame, folder: str) -> None:
    """One Parquet file a shard: rows are dealt by shard, and a task writes each of its shards into a folder of its own."""
    assigned.repartition("shard").write.partitionBy("shard").parquet(folder)
