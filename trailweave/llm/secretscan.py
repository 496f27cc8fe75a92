"""Secrets by named patterns and by a battery of randomness tests, in DataFrame functions alone.

Three patterns give the base spans. Every other run of at least 20 characters of an encoding's kind is a candidate: its encoding is
inferred, then three tests look at it as digits of that encoding - Pearson's chi-squared for a uniform alphabet, the
number of runs of digits below and above the middle, and the correlation of neighbouring digits. Keys pass all
three; words, counters and filler fail one.

Passing says little about a short string, so a candidate also has to be a discovery. Under the null hypothesis that it
is ordinary text its chi-squared is noncentral, with a noncentrality in proportion to its length; how far below
that it lies gives a p-value, and the Benjamini-Hochberg procedure over all candidates of the table, within
classes of length, keeps the share of false discoveries below a chosen rate.

Counts of symbols and of neighbours come from the lengths of strings with those taken out, so a candidate of many
megabytes needs no list of its characters.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailweave.session import materialize

KINDS = ["assign", "access", "hex", "random"]
#: (pattern, what a text must match first). Possessive, as no character of one part can begin the next.
SOURCES = [
    (r"""(?i:password|passwd|secret|token|api_?key)["']?+\x20*+[:=]\x20*+["']?+([A-Za-z0-9+/_.=-]++)""", r"""(?i:password|passwd|secret|token|api_?key)["']?+\x20*+[:=]"""),
    ("AKIA[A-Z0-9]++", "AKIA[A-Z0-9]{12}"),
    ("[0-9a-f]{32,}+", "[0-9a-f]{32}"),
    ("[A-Za-z0-9+/_-]{20,}+=*+", "[A-Za-z0-9+/_-]{20}"),
]
BASE = 3

UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Encodings in the order in which they are tried, with their digits in order, what a body must match (at least one letter and one
#: digit for the smallest) and the chance that two characters of ordinary text, restricted to those digits, are the same.
ENCODINGS = [
    ("hex", DIGITS + "abcdef", "^(?=.*[a-f])(?=.*[0-9])[0-9a-f]+$", 0.25),
    ("HEX", DIGITS + "ABCDEF", "^(?=.*[A-F])(?=.*[0-9])[0-9A-F]+$", 0.25),
    ("base32", UPPER + "234567", "^[A-Z2-7]+$", 0.066),
    ("base62", UPPER + LOWER + DIGITS, "^(?=.*[A-Za-z])[A-Za-z0-9]+$", 0.066),
    ("base64", UPPER + LOWER + DIGITS + "+/", "^(?=.*[A-Za-z])[A-Za-z0-9+/]+$", 0.066),
    ("base64url", UPPER + LOWER + DIGITS + "-_", "^(?=.*[A-Za-z])[A-Za-z0-9_-]+$", 0.066),
]

#: The share of false discoveries, how many standard deviations a test may be off, and the finest p-value told apart, in tenths of a decimal place.
RATE, PASSING, FINEST = 0.01, 3.0, 600


def pick(encoding: Column, values: list) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), encoding)


def levels(digits: str, names: str) -> str:
    """For each digit the name of the equal part of the alphabet it lies in."""
    return "".join(names[i * len(names) // len(digits)] for i in range(len(digits)))


def occurrences(text: Column, part: Column) -> Column:
    """How often a string that can't overlap itself occurs."""
    return (F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)


def translated(body: Column, encoding: Column, names: str) -> Column:
    out = F.lit(None).cast("string")
    for e, (_, digits, _, _) in enumerate(ENCODINGS):
        out = F.when(encoding == e, F.translate(body, digits, levels(digits, names))).otherwise(out)
    return out


def battery(df: DataFrame, body: str, encoding: str) -> DataFrame:
    """Adds ``uniform``, ``runs`` and ``serial``, standard scores of the tests under randomness, and ``textlike``, the score of
    chi-squared below what ordinary text of that length gives (large: unlike text).

    ``encoding`` is an index into ENCODINGS; a null one gives nulls.
    """
    b, e = F.col(body), F.col(encoding)
    n = F.length(b).cast("double")
    k = pick(e, [len(d) for _, d, _, _ in ENCODINGS]).cast("double")
    squares = F.expr(f"aggregate(sequence(1, length(_digits)), 0D, (s, i) -> s + power(length({body}) - length(replace({body}, substr(_digits, i, 1), '')), 2))")
    df = df.withColumn("_digits", pick(e, [d for _, d, _, _ in ENCODINGS]))
    df = df.withColumn("_chi", squares * k / n - n).withColumn("_half", translated(b, e, "LH")).withColumn("_quarter", translated(b, e, "abcd"))
    free = k - 1
    uniform = (F.cbrt(F.greatest(F.col("_chi"), F.lit(0.0)) / free) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))  # Wilson and Hilferty
    low = occurrences(F.col("_half"), F.lit("L")) / n
    changes = occurrences(F.col("_half"), F.lit("LH")) + occurrences(F.col("_half"), F.lit("HL"))
    share = 2 * low * (1 - low)
    runs = F.when(share > 0, (changes - (n - 1) * share) / F.sqrt((n - 1) * share * (1 - share))).otherwise(-F.sqrt(n))
    quarter, value = F.col("_quarter"), dict(zip("abcd", (-3, -1, 1, 3)))
    products = F.lit(0.0)
    for x in "abcd":
        others = [occurrences(quarter, F.lit(x + y)) for y in "abcd" if y != x]
        same = occurrences(quarter, F.lit(x)) - sum(others, F.lit(0.0)) - F.endswith(quarter, F.lit(x)).cast("int")
        products = products + value[x] * value[x] * same + sum((value[x] * value[y] * o for y, o in zip([y for y in "abcd" if y != x], others)), F.lit(0.0))
    serial = products / 5 / F.sqrt(n - 1)  # a digit's value has mean 0 and variance 5
    excess = n * (k * pick(e, [c for _, _, _, c in ENCODINGS]) - 1)
    textlike = (free + excess - F.col("_chi")) / F.sqrt(2 * (free + 2 * excess))
    return df.withColumns({"uniform": uniform, "runs": runs, "serial": serial, "textlike": textlike}).drop("_digits", "_chi", "_half", "_quarter")


def discoveries(df: DataFrame, score: str, length: str, rate: float = RATE) -> DataFrame:
    """Adds ``found``: whether a row's one-sided p-value passes Benjamini and Hochberg's procedure among the rows of its class of length
    (powers of two); null scores are no hypotheses.

    Half of exp(-z^2 / 2) bounds the normal tail from above. P-values are rounded up to tenths of a decimal place, so that a class is
    at most FINEST + 1 counts and the limits are found without sorting rows.
    """
    z = F.col(score)
    p = F.when(z > 0, 0.5 * F.exp(-z * z / 2)).otherwise(F.lit(1.0))
    place = F.least(F.lit(FINEST), F.floor(-10 * F.log10(F.greatest(p, F.lit(1e-300)))).cast("int"))
    df = df.withColumn("_class", F.when(z.isNotNull(), F.floor(F.log2(F.col(length))).cast("int"))).withColumn("_place", F.when(z.isNotNull(), place))
    counts = df.where("_class is not null").groupBy("_class", "_place").agg(F.count("*").alias("n"))
    down = Window.partitionBy("_class").orderBy(F.desc("_place"))
    passed = counts.withColumn("k", F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, 0))).withColumn("m", F.sum("n").over(Window.partitionBy("_class")))
    limits = passed.where(F.pow(F.lit(10.0), -F.col("_place") / 10) <= rate * F.col("k") / F.col("m")).groupBy("_class").agg(F.min("_place").alias("_limit"))
    # a row a class of length, and there are at most 31 of them
    return df.join(F.broadcast(limits), "_class", "left").withColumn("found", F.coalesce(F.col("_place") >= F.col("_limit"), F.lit(False))).drop("_class", "_place", "_limit")


def matches(text: Column, source: int) -> Column:
    """Matches of one pattern with the length of the gap before each; for assignments also how long the value is."""
    pattern, needs = SOURCES[source]
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)) if source == 0 else found
    empty = F.struct(F.lit(source).alias("source"), F.lit(0).alias("i"), F.lit(0).alias("gap"), F.lit(0).alias("size"), F.lit(0).alias("value"), F.lit("").alias("m"))
    rows = F.transform(F.arrays_zip(found.alias("m"), value.alias("v"), F.slice(gaps, 1, F.greatest(F.size(gaps) - 1, F.lit(0))).alias("gap")),
                       lambda x, i: F.struct(F.lit(source).alias("source"), i.alias("i"), F.length(x["gap"]).alias("gap"), F.length(x["m"]).alias("size"), F.length(x["v"]).alias("value"),
                                             (x["m"] if source == BASE else F.lit("")).alias("m")))
    return F.when(text.rlike(needs), rows).otherwise(F.array_remove(F.array(empty), empty))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, kind, start, end, base, encoding, uniform, runs, serial, textlike): a row per span that may count, one of nulls for a text without any.

    Base spans pass their rule (a value of 8 characters, a key of 16); the others overlap none of them. ``row`` tells input rows apart.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    numbered = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("row", F.monotonically_increasing_id())
    found = numbered.select("row", "doc_id", F.explode_outer(F.concat(*[matches(F.col("text"), s) for s in range(len(SOURCES))])).alias("x")).select("row", "doc_id", "x.*")
    found = materialize(found)  # row numbers are given once
    before = Window.partitionBy("row", "source").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = found.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(before).cast("long"))
    placed = placed.withColumn("start", (F.col("end") - F.col("size")).cast("long")).withColumn("kind", F.col("source"))
    sound = F.when(F.col("kind") == 0, F.col("value") >= 8).when(F.col("kind") == 1, F.col("size") >= 16).otherwise(F.lit(True))
    placed = placed.withColumn("base", F.coalesce(sound & (F.col("kind") < BASE), F.lit(False)))
    order = Window.partitionBy("row").orderBy("start", "end", "kind")
    reach = F.max(F.when(F.col("base"), F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    back = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("end"), F.desc("kind"))
    follow = F.min(F.when(F.col("base"), F.col("start"))).over(back.rowsBetween(Window.unboundedPreceding, 0))
    placed = placed.withColumn("_reach", reach).withColumn("_follow", follow)
    free = (F.col("kind") == BASE) & ~F.coalesce(F.col("_reach") > F.col("start"), F.lit(False)) & ~F.coalesce(F.col("_follow") < F.col("end"), F.lit(False))
    counts = F.col("base") | F.coalesce(free, F.lit(False))
    body = F.rtrim("m", F.lit("="))
    kinds = F.lit(None).cast("int")
    for e in reversed(range(len(ENCODINGS))):
        kinds = F.when(body.rlike(ENCODINGS[e][2]), e).otherwise(kinds)
    placed = placed.withColumn("_body", F.when(free, body)).withColumn("encoding", F.when(free, kinds))
    tested = battery(placed, "_body", "encoding")
    kept = [F.when(counts, F.col(c)).alias(c) for c in ("kind", "start", "end")]
    return tested.select("row", "doc_id", *kept, "base", "encoding", "uniform", "runs", "serial", "textlike")


def find(docs: DataFrame, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans (row, doc_id, kind, start, end, base, encoding) of all texts; a text without spans has a row of null kind.

    Positions count code points, the end exclusive. Base spans are the leftmost non-overlapping matches of each pattern that
    pass its rule; a match that fails is passed over without another try. Added spans overlap no base span. A null text
    counts as empty, null and repeated doc_ids are told apart by ``row``, other columns are left out, no rows give none.
    Runs of digits alone have no encoding and are never added.
    """
    scored = discoveries(materialize(candidates(docs, id_col, text_col)).withColumn("_length", F.col("end") - F.col("start")), "textlike", "_length", rate)
    random = (F.col("uniform") <= PASSING) & (F.abs("runs") <= PASSING) & (F.abs("serial") <= PASSING)
    kept = F.col("kind").isNotNull() & (F.col("base") | (F.col("found") & F.coalesce(random, F.lit(False))))
    names = pick(F.col("encoding"), [name for name, _, _, _ in ENCODINGS])
    return scored.select("row", "doc_id", *[F.when(kept, F.col(c)).alias(c) for c in ("kind", "start", "end", "base")], F.when(kept, names).alias("encoding"))


def joined(spans: Column) -> Column:
    """Spans as kind:start:end by start, then kind as listed."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(F.array(*[F.lit(k) for k in KINDS]), s["kind"]), s["start"], s["end"])), ",")


def report(spans: DataFrame) -> DataFrame:
    """A row per input row: doc_id, base counts by kind, base_sha256, all spans, and n_random, how many of those the tests added."""
    span = F.struct("start", "kind", "end")
    counts = [F.sum(F.when(F.col("kind") == k, 1).otherwise(0)).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    rows = spans.groupBy("row", "doc_id").agg(*counts, F.collect_list(F.when(F.col("base"), span)).alias("b"), F.collect_list(F.when(F.col("kind").isNotNull(), span)).alias("s"))
    return rows.select("doc_id", *[f"n_{k}" for k in KINDS[:BASE]], F.sha2(joined(F.col("b")).cast("binary"), 256).alias("base_sha256"), joined(F.col("s")).alias("spans"), "n_random")
