"""Personal data by weak supervision, in DataFrame functions alone.

Strict patterns give the base spans, which always count. Looser patterns give further candidates. Regex,
validity, gazetteer and context labelers vote on every candidate; expectation-maximisation over the counts of
vote patterns estimates how reliable each labeler is, and a logistic span classifier trained on its posteriors
decides which candidates are added.

Texts are read once: a pattern's matches and the gaps between them give lengths, and sums of lengths give
positions in code points. All patterns are possessive or bounded, so no text costs more than linear time.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailweave.session import materialize

KINDS = ["email", "ip", "card", "phone"]
LOCAL, HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: (kind, pattern, what a text must contain). A leftmost match starts where a run of its first class starts, or where the last match ended.
STRICT = [
    (0, rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{HOST}++(?:\.{HOST}++)++", "@"),
    (1, r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "[0-9]\\.[0-9]"),
    (2, r"(?:\G|(?<![0-9]))[0-9](?:[ -]?[0-9])++", "[0-9]"),
    (3, r"\+[0-9][ ().0-9-]+[0-9]", "\\+[0-9]"),
]
LOOSE = [
    (0, rf"(?i)(?<!{LOCAL}){LOCAL}{{1,64}}+ ?[\[(] ?at ?[\])] ?{HOST}{{1,63}}+(?: ?(?:\.|[\[(] ?dot ?[\])]) ?{HOST}{{1,63}}+)++", "(?i)[\\[(] ?at ?[\\])]"),
    (1, r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])", ":[0-9A-Fa-f]{1,4}:"),
    (3, r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9A-Za-z])", "[0-9]{3}[-. ][0-9]{4}"),
]
SOURCES = [*STRICT, *LOOSE]

# Gazetteers of domain ends, calling codes and card issuers' first digits, and words of the context.
DOMAIN_ENDS = r"(?i)(?:\.|dot ?[\])] ?)(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu|it|nl|ch|at|us|ca|au|example|test)$"
CALLING_CODES = r"^\+(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|35|6011|65|62)"
NEAR = [
    r"(?i)(?:e-?mail|mail|contact|write|kontakt|correo|courriel|adress)\W{0,3}$",
    r"(?i)(?:\bip\b|host|server|address|addr|login|from|adresse)\W{0,3}$",
    r"(?i)(?:card|visa|mastercard|amex|credit|debit|karte|tarjeta|carte|cc)\W{0,3}$",
    r"(?i)(?:phone|tel|call|mobile|cell|fax|telefon|tel[eé]fono|t[eé]l[eé]phone|whatsapp)\W{0,3}$",
]
AWAY = r"(?i)(?:version|licen[sc]e|v\.?|token|key|hash|sha|md5|id|isbn|doi|=|\"|#|[0-9A-Za-z])\s?$"


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a digit string passes the Luhn check."""
    turned = F.split(F.reverse(number), "")
    weighed = F.transform(turned, lambda d, i: F.when(i % 2 == 1, 2 * d.cast("int") - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int")))
    return F.aggregate(weighed, F.lit(0), lambda total, d: total + F.coalesce(d, F.lit(0))) % 10 == 0


def valid(kind: Column, m: Column) -> Column:
    """The base rule of each kind."""
    n = F.length(digits(m))
    parts = F.forall(F.split(m, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))) < 4) & F.forall(
        F.split(m, r"\."), lambda p: F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 4).try_cast("int"), F.lit(0)) <= 255)
    return (F.when(kind == 0, F.lit(True)).when(kind == 1, parts).when(kind == 2, n.between(16, 19) & F.when(n < 20, luhn(digits(m))).otherwise(False))
            .otherwise(n.between(8, 15)))


def vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def votes(source: Column, kind: Column, m: Column, left: Column, right: Column) -> Column:
    """The labelers' votes: strict pattern, validity, gazetteer, context for, context against; 1 personal, -1 not, 0 no say."""
    strict = source < len(STRICT)
    n = F.length(digits(m))
    near = F.when(kind == 0, left.rlike(NEAR[0])).when(kind == 1, left.rlike(NEAR[1])).when(kind == 2, left.rlike(NEAR[2])).otherwise(left.rlike(NEAR[3]))
    known = (F.when(kind == 0, m.rlike(DOMAIN_ENDS)).when(kind == 1, F.lit(None).cast("boolean")).when(kind == 2, digits(m).rlike(ISSUERS))
             .otherwise(F.when(strict, m.rlike(CALLING_CODES)).otherwise((n == 10) & m.rlike(r"^\(?[2-9]"))))
    sound = F.when(strict, valid(kind, m)).when(kind == 3, n == 10)
    return F.array(
        vote(strict & valid(kind, m), strict & ~valid(kind, m)),
        vote(sound, ~sound),
        vote(known, ~known),
        vote(near, F.lit(False)),
        vote(F.lit(False), left.rlike(AWAY) | right.rlike("^[0-9A-Za-z]")),
    )


VOTERS = 5


def matches(text: Column, source: int) -> Column:
    """Matches of one pattern with the length of the gap before each and a little of the text around."""
    _, pattern, needs = SOURCES[source]
    has = F.contains(text, F.lit(needs)) if needs == "@" else text.rlike(needs)
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    kind = F.struct(F.lit(source).alias("source"), F.lit(0).alias("i"), F.lit(0).alias("gap"), F.lit("").alias("m"), F.lit("").alias("left"), F.lit("").alias("right"))
    rows = F.transform(F.arrays_zip(found.alias("m"), F.slice(gaps, 1, F.greatest(F.size(gaps) - 1, F.lit(0))).alias("gap"), F.slice(gaps, 2, F.greatest(F.size(gaps) - 1, F.lit(0))).alias("after")),
                       lambda x, i: F.struct(F.lit(source).alias("source"), i.alias("i"), F.length(x["gap"]).alias("gap"), x["m"].alias("m"),
                                             F.right(x["gap"], F.lit(24)).alias("left"), F.left(x["after"], F.lit(12)).alias("right")))
    return F.when(has, rows).otherwise(F.array_remove(F.array(kind), kind))


def candidates(docs: DataFrame) -> DataFrame:
    """(row, doc_id, source, kind, start, end, votes): a row per match of any pattern; a row of nulls for a text without any.

    ``row`` tells input rows apart; it is that of ``docs`` if it has one. Card runs of fewer than 13 or more than 19 digits are no candidates.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    row = F.col("row") if "row" in docs.columns else F.monotonically_increasing_id()
    numbered = docs.select("doc_id", text.alias("text"), row.alias("row"))
    found = numbered.select("row", "doc_id", F.explode_outer(F.concat(*[matches(F.col("text"), s) for s in range(len(SOURCES))])).alias("x"))
    found = found.select("row", "doc_id", "x.*").repartition("row")
    before = Window.partitionBy("row", "source").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("m")).over(before)
    placed = found.withColumn("end", end.cast("long")).withColumn("start", (F.col("end") - F.length("m")).cast("long"))
    kind = F.get(F.array(*[F.lit(k) for k, _, _ in SOURCES]), F.col("source"))
    placed = placed.withColumn("kind", kind).withColumn("wanted", F.col("source").isNotNull() & ((F.col("kind") != 2) | F.length(digits(F.col("m"))).between(13, 19)))
    cast = F.when(F.col("wanted"), votes(F.col("source"), F.col("kind"), F.col("m"), F.col("left"), F.col("right")))
    return placed.select("row", "doc_id", *[F.when(F.col("wanted"), F.col(c)).alias(c) for c in ("source", "kind", "start", "end")], cast.alias("votes"))


@dataclass
class Model:
    """Labelers' reliabilities P(vote -1, 0, 1 | not personal, personal) and the span classifier's weights."""

    reliability: np.ndarray
    weights: np.ndarray


def inputs(pattern: np.ndarray, kind: int) -> np.ndarray:
    """Classifier inputs of a vote pattern: for, against, kind, constant."""
    return np.concatenate([pattern > 0, pattern < 0, np.arange(len(KINDS)) == kind, [1]]).astype(float)


def learn(patterns: list[tuple[int, list[int], int]], rounds: int = 30) -> Model:
    """Reliabilities and classifier from (kind, votes, count) rows, of which there are at most kinds x 3^voters."""
    reliability = np.full((VOTERS, 2, 3), 1 / 3)
    reliability[:, 0] = [0.5, 0.3, 0.2]
    reliability[:, 1] = [0.2, 0.3, 0.5]
    prior = np.full(len(KINDS), 0.5)
    start = reliability.copy()
    if not patterns:
        return Model(reliability, np.zeros(2 * VOTERS + len(KINDS) + 1))
    kinds, cast, counts = np.array([p[0] for p in patterns]), np.array([p[1] for p in patterns]), np.array([p[2] for p in patterns], float)
    post = np.zeros(len(patterns))
    for _ in range(rounds):
        log = np.log([1 - prior[kinds], prior[kinds]])
        for v in range(VOTERS):
            log += np.log(reliability[v][:, cast[:, v] + 1])
        post = 1 / (1 + np.exp(np.clip(log[0] - log[1], -30, 30)))
        for y, p in ((0, 1 - post), (1, post)):
            for v in range(VOTERS):
                mass = np.array([(counts * p)[cast[:, v] == s].sum() for s in (-1, 0, 1)]) + 10 * start[v, y]
                reliability[v, y] = mass / mass.sum()
        for k in range(len(KINDS)):
            here = kinds == k
            prior[k] = ((counts * post)[here].sum() + 2) / (counts[here].sum() + 4)
    x = np.array([inputs(c, k) for c, k in zip(cast, kinds)])
    share, weights = counts / counts.sum(), np.zeros(x.shape[1])
    for _ in range(500):
        error = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30))) - post
        weights -= 2.0 * (x.T @ (share * error) + 1e-4 * weights)
    return Model(reliability, weights)


def spans_score(model: Model, kind: Column, cast: Column) -> Column:
    w = [float(x) for x in model.weights]
    total = F.lit(w[-1]) + F.get(F.array(*[F.lit(x) for x in w[2 * VOTERS:-1]]), kind)
    for v in range(VOTERS):
        total = total + F.when(F.get(cast, F.lit(v)) > 0, w[v]).when(F.get(cast, F.lit(v)) < 0, w[VOTERS + v]).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> tuple[DataFrame, Model]:
    """All candidates as a written table, and the model learned from their votes. ``row_col`` names a column that tells rows apart, if there is one."""
    row = [F.col(row_col).alias("row")] if row_col else []
    found = materialize(candidates(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *row)))
    counted = found.where("kind is not null").groupBy("kind", "votes").count().collect()  # at most kinds x 3^voters rows
    return found, learn([(r["kind"], r["votes"], r["count"]) for r in counted])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, model: Model | None = None) -> tuple[DataFrame, Model]:
    """Spans (row, doc_id, kind, start, end, base boolean) of all texts and the model; a text without spans has one row of null kind.

    Positions count code points, the end exclusive. Base spans are the leftmost non-overlapping matches of each
    strict pattern that pass its rule. Added spans overlap no base span. A null text counts as empty; null and
    repeated doc_ids are told apart by ``row``; other columns are left out. A ``model`` given is used in place of the one learned here.
    """
    found, learned = fit(docs, id_col, text_col, row_col)
    model = model or learned
    base = (F.col("source") < len(STRICT)) & (F.get("votes", F.lit(0)) == 1)
    scored = found.withColumn("base", F.coalesce(base, F.lit(False))).withColumn("score", spans_score(model, F.col("kind"), F.col("votes")))
    order = Window.partitionBy("row").orderBy("start", "end", "source")
    reach = F.max(F.when(F.col("base"), F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    follow = F.min(F.when(F.col("base"), F.col("start"))).over(Window.partitionBy("row").orderBy(F.desc("start"), F.desc("end"), F.desc("source")).rowsBetween(Window.unboundedPreceding, 0))
    scored = scored.withColumn("reach", reach).withColumn("follow", follow)
    free = ~F.coalesce(F.col("reach") > F.col("start"), F.lit(False)) & ~F.coalesce(F.col("follow") < F.col("end"), F.lit(False))
    kept = F.col("kind").isNotNull() & (F.col("base") | ((F.col("score") >= 0.5) & free))
    return scored.select("row", "doc_id", *[F.when(kept, F.col(c)).alias(c) for c in ("kind", "start", "end", "base")]), model


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def report(spans: DataFrame) -> DataFrame:
    """A row per input row: doc_id, base counts by kind, base_sha256 and all spans as kind:start:end, by kind as listed, then start."""
    span = F.struct("kind", "start", "end")
    counts = [F.sum(F.when(F.col("base") & (F.col("kind") == k), 1).otherwise(0)).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    rows = spans.groupBy("row", "doc_id").agg(*counts, F.collect_list(F.when(F.col("base"), span)).alias("b"), F.collect_list(F.when(F.col("kind").isNotNull(), span)).alias("s"))
    return rows.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(joined(F.col("b")).cast("binary"), 256).alias("base_sha256"), joined(F.col("s")).alias("spans"))


#: Code points of the stretches in which a text is written anew.
STRETCH = 4096


def redact(docs: DataFrame, model: Model | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with every span that ``find`` gives replaced by its kind in brackets; other columns stay, a null text stays null.

    Spans that overlap become one, named by the first of them (of those with one start, the longest). Positions are those in the original text, and each text with
    spans is written once, by stretches, so that time grows with its length; texts without spans are not moved. Rows are
    told apart by a number of their own, so null and repeated ids don't matter.
    """
    row = "_row"
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()))
    spans = find(numbered, id_col, text_col, row, model)[0].where("kind is not null")
    order = Window.partitionBy("row").orderBy("start", F.desc("end"), "kind")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    parts = spans.withColumn("new", F.coalesce(F.col("start") >= reach, F.lit(True)).cast("int"))
    parts = parts.withColumn("part", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = parts.groupBy("row", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max(F.when(F.col("new") == 1, F.col("kind"))).alias("kind"))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    cut = merged.withColumn("at", F.explode(F.sequence(F.floor(F.col("start") / STRETCH), F.floor((F.col("end") - 1) / STRETCH))))
    low = F.greatest(F.col("start") - F.col("at") * STRETCH, F.lit(0)).cast("int")
    high = F.least(F.col("end") - F.col("at") * STRETCH, F.lit(STRETCH)).cast("int")
    tag = F.when(F.floor(F.col("start") / STRETCH) == F.col("at"), F.get(names, F.col("kind"))).otherwise("")
    cut = cut.select("row", F.col("at").cast("int").alias("at"), F.struct(low.alias("low"), high.alias("high"), tag.alias("tag")).alias("piece"))
    stretches = cut.groupBy("row", "at").agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
    edits = stretches.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("at", "pieces"))).alias("_edits")).withColumnRenamed("row", row)

    def written(stretch: Column, at: Column) -> Column:
        pieces = F.element_at("_edits", at.cast("int"))
        kept = F.transform(pieces, lambda p, i: F.concat(
            F.substring(stretch, F.coalesce(F.get(pieces, i - 1)["high"], F.lit(0)) + 1, p["low"] - F.coalesce(F.get(pieces, i - 1)["high"], F.lit(0))), p["tag"]))
        return F.when(pieces.isNull(), stretch).otherwise(F.concat(F.array_join(kept, ""), F.substring(stretch, F.element_at(pieces, -1)["high"] + 1, F.lit(STRETCH))))

    joined_up = numbered.join(edits, row, "left")
    stretched = F.regexp_extract_all(F.col(text_col), F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0))
    text = F.when(F.col("_edits").isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(stretched, written), ""))
    return joined_up.withColumn(text_col, text).select(*docs.columns)
