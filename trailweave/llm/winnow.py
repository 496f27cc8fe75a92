"""Document fingerprints by winnowing, in DataFrame functions alone.

A text is a row of units (words, or single characters of scripts without word spaces). Every k units in a row are
hashed; of every ``window`` hashes in a row the smallest is chosen, the rightmost of equal ones, and kept with
its position. Any passage of at least k + window - 1 units that two texts share gives both the same choice.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, WINDOW = 5, 8
#: Letters of scripts written without spaces stand alone; any other run ends at white space or after 64 characters.
UNIT = r"[฀-໿က-႟ក-៿぀-ヿ㐀-鿿]|[^\s฀-໿က-႟ក-៿぀-ヿ㐀-鿿]{1,64}"


def units(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(UNIT), F.lit(0))


def gram_hashes(words: Column, k: int = K) -> Column:
    """Hashes of every k units in a row; fewer units than that are hashed as they are, none give none."""
    whole = F.transform(F.array_repeat(words, 1), lambda w: F.xxhash64(w))
    each = F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.xxhash64(*[words[i + j] for j in range(k)]))
    return F.when(F.size(words) == 0, F.array().cast("array<bigint>")).when(F.size(words) < k, whole).otherwise(each)


def chosen(df: DataFrame, hashes: str, out: str, window: int = WINDOW) -> DataFrame:
    """Adds ``out``: positions (from 0) of the hashes that are the rightmost smallest of some window; a shorter row is one window."""
    h, low = F.col(hashes), F.col("_low")
    windows = F.sequence(F.lit(0), F.size(h) - window)
    smallest = F.transform(windows, lambda i: F.least(*[h[i + j] for j in range(window)]) if window > 1 else h[i])

    def rightmost(i: Column) -> Column:
        pick = F.when(h[i + window - 1] == low[i], i + window - 1)
        for j in range(window - 2, -1, -1):
            pick = pick.when(h[i + j] == low[i], i + j)
        return pick

    last = F.array((F.size(h) - F.array_position(F.reverse(h), F.array_min(h))).cast("int"))
    slid = F.array_distinct(F.transform(windows, rightmost))
    df = df.withColumn("_low", F.when(F.size(h) >= window, smallest))
    return df.withColumn(out, F.when(F.size(h) == 0, F.array().cast("array<int>")).when(F.size(h) < window, last).otherwise(slid)).drop("_low")


def fingerprints(df: DataFrame, text_col: str, prefix: str = "", k: int = K, window: int = WINDOW) -> DataFrame:
    """Adds ``{prefix}positions`` array<int> and ``{prefix}hashes`` array<bigint>, in text order.

    Null counts as empty and gives empty arrays. A text of fewer than k units has the one hash of all its units.
    Equal texts have equal fingerprints. Columns already so named are replaced.
    """
    words, hashes = F.col("_units"), F.col("_grams")
    df = df.withColumn("_units", units(F.coalesce(F.col(text_col), F.lit(""))))
    df = df.withColumn("_grams", gram_hashes(words, k)).drop("_units")
    df = chosen(df, "_grams", f"{prefix}positions", window)
    return df.withColumn(f"{prefix}hashes", F.transform(f"{prefix}positions", lambda p: hashes[p])).drop("_grams")


def likeness(a: Column, b: Column) -> Column:
    """Twice the shared distinct hashes over the distinct hashes of both (0 to 1); two empty fingerprints are alike (1)."""
    shared = F.size(F.array_intersect(a, b))
    both = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(both == 0, F.lit(1.0)).otherwise(2.0 * shared / both)


def as_text(positions: Column, hashes: Column) -> Column:
    return F.concat_ws(",", F.zip_with(hashes, positions, lambda h, p: F.concat_ws(":", F.lower(F.hex(h)), p)))


def range_of(value: Column, limits: list[int]) -> Column:
    """How many of the sorted limits are at most ``value`` (0 for null), by two steps of about the square root of their number."""
    if not limits:
        return F.lit(0)
    step = int(len(limits) ** 0.5) + 1
    groups = [limits[i:i + step] for i in range(0, len(limits), step)]
    heads = F.lit([g[0] for g in groups])
    group = F.size(F.filter(heads, lambda x: x <= value))
    inside = F.size(F.filter(F.array(*[F.lit(g) for g in groups])[group - 1], lambda x: x <= value))
    return F.when(value.isNull() | (value < limits[0]), 0).otherwise((group - 1) * step + inside)


def dealt_with_next(df: DataFrame, id_col: str, ranges: int) -> DataFrame:
    """Rows dealt by ranges of the id (``_range``), each range also holding the first row of the following one (``_halo`` 1), the last
    range the first row of all. Only the limits and first ids of the ranges pass through the driver."""
    ids = df.select(F.col(id_col).cast("long").alias("id"))
    limits = ids.agg(F.percentile_approx("id", [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0] if ranges > 1 else []
    limits = sorted(set(limits or []))
    firsts = {r["r"]: r["id"] for r in ids.withColumn("r", range_of(F.col("id"), limits)).groupBy("r")
              .agg(F.min(F.struct(F.col("id").isNotNull().alias("k"), "id")).alias("s")).select("r", "s.id").collect()}
    used = sorted(firsts)
    own = F.struct(range_of(F.col(id_col), limits).alias("r"), F.lit(0).alias("halo"))
    copies = F.array(own)
    if used:
        starts = F.array(*[F.struct(F.lit(firsts[r]).cast("long").alias("id"), F.lit(used[i - 1]).alias("r")) for i, r in enumerate(used)])
        earlier = F.filter(starts, lambda x: x["id"].eqNullSafe(F.col(id_col)))
        copies = F.when(F.size(earlier) > 0, F.array(own, F.struct(earlier[0]["r"].alias("r"), F.lit(1).alias("halo")))).otherwise(copies)
    spread = df.withColumn("_copy", F.explode(copies))
    return spread.withColumn("_range", F.col("_copy.r")).withColumn("_halo", F.col("_copy.halo")).drop("_copy").repartition("_range")


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """Each document, its edited text and both fingerprints.

    The edited text has the last floor(n/2) code points replaced by the first as many (or all) of the next document's,
    in ascending order of doc_id (nulls first, equal ids by text); after the last comes the first, so a single
    document follows itself. Result: doc_id, text, edited, positions, hashes, edited_positions, edited_hashes,
    next_hashes; a row per input row. A null text counts as empty; other columns are left out; no rows give none.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt = fingerprints(dealt_with_next(docs, "doc_id", 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))), "text", k=k, window=window)
    order = Window.partitionBy("_range").orderBy("_halo", F.col("doc_id").asc_nulls_first(), "text")
    paired = dealt.withColumn("next_text", F.lead("text").over(order)).withColumn("next_hashes", F.lead("hashes").over(order)).where("_halo = 0")
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 2) as int))"), F.substring(F.col("next_text"), F.lit(1), half))
    return fingerprints(paired.withColumn("edited", edited).drop("next_text", "_range", "_halo"), "edited", "edited_", k, window)
