"""Toxicity by weak supervision.

Voters are words and word beginnings mined from labelled rows (a lexicon with its inflections, in any language), a
short list of insults and patterns of form. A generative label model estimates each voter's hit rates on toxic and clean
texts by expectation-maximisation over all documents, started from the labels, and discounts voters that go together; a linear
classifier is trained on its posterior labels of all documents and scores every text.

Words are counted over all labelled rows outside the held-out fold. Documents with the same votes and
number of hits are one row, weighted, in all sums and in the classifier's fit.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailweave.session import materialize

# A seed lexicon of common English insults.
INSULTS = ["idiot", "moron", "stupid", "imbecile", "worthless", "trash", "disgusting", "clown", "scum", "pathetic", "loser", "dumb"]

#: A word: letters only, in lower case.
WORD_SPLIT = r"[^\p{L}]+"
SHORTEST, LONGEST = 3, 7


@dataclass
class Model:
    """Voters, the label model's part for each vote given, and the classifier over votes and hits."""

    voters: list[str]
    label_weights: list[float]
    label_intercept: float
    weights: list[float]
    intercept: float


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic): labelled documents outside the held-out fold. Both sides are dealt by id at every size, as labels grow with the documents."""
    keep = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", "toxic").dropDuplicates(["doc_id"])
    return docs.join(keep.hint("merge"), "doc_id").select("doc_id", "text", "toxic")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def mine_voters(train: DataFrame, known: DataFrame, voters: int, least_gain: float, least_lift: float) -> list[str]:
    """Beginnings of SHORTEST to LONGEST letters and whole words (marked by a final $) that toxic texts have far more often than clean ones.

    ``least_lift`` is in log-odds, ``least_gain`` in the log-likelihood ratio statistic, so that words seen in a few texts by chance don't vote.
    """
    words = F.array_distinct(F.filter(F.split(F.lower("text"), WORD_SPLIT), lambda w: F.length(w) >= 2))
    starts = F.flatten(F.transform(words, lambda w: F.concat(F.array(F.concat(w, F.lit("$"))), F.when(F.length(w) < SHORTEST, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(SHORTEST), F.greatest(F.lit(SHORTEST), F.least(F.length(w), F.lit(LONGEST)))), lambda n: F.substring(w, F.lit(1), n))))))
    totals = known.agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).first()
    toxic, clean = totals["t"] or 0, (totals["n"] or 0) - (totals["t"] or 0)
    if not toxic or not clean:
        return []
    counts = (train.select("toxic", F.explode(F.array_distinct(starts)).alias("start")).groupBy("start").agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).where("t > 0")
              .withColumn("lift", F.log((F.col("t") + 0.5) / toxic) - F.log((F.col("n") - F.col("t") + 0.5) / clean))
              .withColumn("gain", 2 * F.col("t") * F.log(F.col("t") / F.col("n") / (toxic / (toxic + clean)))
                          + 2 * F.when(F.col("n") > F.col("t"), (F.col("n") - F.col("t")) * F.log((F.col("n") - F.col("t")) / F.col("n") / (clean / (toxic + clean)))).otherwise(0.0))
              .where((F.col("lift") >= least_lift) & (F.col("gain") >= least_gain)))
    # by how much a voter tells; one that begins like a chosen one is taken only if it is much surer, or else says the same again
    found = counts.orderBy(F.desc("gain"), F.desc(F.length("start")), "start").limit(60 * voters).collect()
    chosen: dict[str, tuple[str, float]] = {}
    for row in found:
        bare = row["start"].rstrip("$")
        kin = [lift for b, (_, lift) in chosen.items() if b.startswith(bare) or bare.startswith(b)]
        if bare not in chosen and all(row["lift"] >= lift + 1 for lift in kin) and len(chosen) < voters:
            chosen[bare] = (row["start"], row["lift"])
    return [start for start, _ in chosen.values()]


def alternatives(voters: list[str]) -> str:
    """A pattern of the longest voter that begins a word, with shared beginnings written once, so that a word costs its length and not the number of voters."""
    def branch(rest: list[str]) -> str:
        ends = ["" for v in rest if v == ""] + [r"(?![\p{L}])" for v in rest if v == "$"]
        firsts = sorted({v[0] for v in rest if v not in ("", "$")})
        ways = [f + branch([v[1:] for v in rest if v[:1] == f and v != "$"]) for f in firsts] + sorted(set(ends), reverse=True)
        return ways[0] if len(ways) == 1 else "(?:" + "|".join(ways) + ")"

    return branch(sorted(set(voters)))


def vote_columns(df: DataFrame, voters: list[str]) -> DataFrame:
    """Adds ``votes``, the ascending numbers of the voters that hit the text (form patterns come last), and ``hits``: one scan for all."""
    text = F.coalesce(F.col("text"), F.lit(""))
    if voters:
        pattern = r"(?<![\p{L}])(" + alternatives(voters) + ")"
        found = F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(1))
    else:
        found = F.array().cast("array<string>")
    df = df.withColumn("_found", found).withColumn("hits", F.size("_found"))
    df = df.withColumn("_found", F.array_distinct("_found"))
    bare = [v.rstrip("$") for v in voters]
    implied = [[k for k, v in enumerate(voters) if v == b or v.rstrip("$") == b or b.startswith(v)] for b in bare]  # a longer beginning hits its shorter kin too
    numbers = (F.array_distinct(F.flatten(F.transform("_found", lambda x: F.array(*[F.lit(n) for n in implied])[F.array_position(F.lit(bare), x).cast("int") - 1])))
               if voters else F.array().cast("array<int>"))
    capitals = F.length(F.regexp_replace(text, r"[^\p{Lu}]", "")) * 2 > F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    forms = [F.when(capitals, len(voters)), F.when(F.contains(text, F.lit("!!")), len(voters) + 1), F.when(F.col("hits") == 0, len(voters) + 2)]
    return df.withColumn("votes", F.array_sort(F.concat(numbers, F.array_compact(F.array(*forms))))).drop("_found")


#: Labelled documents that the label model's posterior of a vote pattern counts for.
PRIOR = 4.0

#: Mostly capitals, exclamation, and no word voter hit, which speaks for clean.
FORMS = 3


def label_model(patterns: DataFrame, width: int, rounds: int = 8) -> tuple[np.ndarray, float]:
    """Weight of each vote and intercept of the log-odds of toxic, from (votes, texts, toxic, clean): vote patterns, their number of
    texts and how many of these are labelled either way.

    Expectation-maximisation of the voters' hit rates on both classes, started from the labelled shares. A voter that does not
    hit abstains: toxic texts of one language lack all words of the others, so absence tells nothing by itself. The discount of
    a voter is one over the summed correlations of its votes with all voters (itself included) within the classes, counted
    from 0 at a half to 1 at one, so that a group that votes as one counts as one. Each round sums over all patterns in Spark; what reaches
    the driver is a row a voter, or at most one a pair of voters.
    """
    free = F.col("texts") - F.col("toxic") - F.col("clean")
    totals = patterns.agg(F.sum("texts").alias("texts"), F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).first()
    mean = (totals["toxic"] + 0.05) / (totals["toxic"] + totals["clean"] + 1)
    post = F.when(F.col("toxic") + F.col("clean") > 0, (F.col("toxic") + mean) / (F.col("toxic") + F.col("clean") + 1)).when(F.exists("votes", lambda v: v < width - FORMS), 0.5).otherwise(mean)
    discount = np.ones(width)
    weights, intercept = np.zeros(width), 0.0
    for step in range(rounds):
        a, b = (F.col("toxic") + free * F.col("p")).alias("a"), (F.col("clean") + free * (1 - F.col("p"))).alias("b")
        split = patterns.withColumn("p", post).select("votes", a, b)
        sums = np.zeros((width + 1, 2))
        for r in split.select(F.explode(F.concat(F.array(F.lit(width)), "votes")).alias("v"), "a", "b").groupBy("v").agg(F.sum("a"), F.sum("b")).collect():
            sums[r[0]] = r[1], r[2]
        mass = sums[width]
        rates = (sums[:width] + 0.1) / (mass + 1)
        if step in (2, rounds - 3):  # correlations within the classes
            together = np.zeros((2, width, width))
            pairs = split.select(F.explode("votes").alias("i"), "votes", "a", "b").select("i", F.explode("votes").alias("j"), "a", "b")
            for r in pairs.groupBy("i", "j").agg(F.sum("a"), F.sum("b")).collect():
                together[:, r[0], r[1]] = r[2], r[3]
            cov = sum(together[c] - mass[c] * np.outer(rates[:, c], rates[:, c]) for c in (0, 1))
            scale = np.sqrt(np.clip(np.diag(cov), 1e-9, None))
            related = np.clip(2 * cov / np.outer(scale, scale) - 1, 0, 1)
            np.fill_diagonal(related, 1)
            discount = 1 / related.sum(1)
        prior = (mass[0] + 1) / (mass.sum() + 2)
        weights, intercept = np.log(rates[:, 0] / rates[:, 1]) * discount, math.log(prior / (1 - prior))
        post = sigmoid(F.lit(intercept) + dot(F.col("votes"), weights.tolist()))
    return weights, intercept


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def dot(votes: Column, weights: list[float]) -> Column:
    """The sum of the weights of the votes given."""
    return F.aggregate(votes, F.lit(0.0), lambda total, v: total + F.lit([float(w) for w in weights])[v])


def fit(docs: DataFrame, labels: DataFrame, voters: int = 200, least_gain: float = 24.0, least_lift: float = 1.5) -> tuple[Model, DataFrame]:
    """The model, and a written table (doc_id, votes, hits) of all documents.

    ``voters`` is the size of the model: of the words that tell enough it takes those that tell most, because correlations of all pairs
    of voters come to the driver. Words are counted in all labelled rows. Without labels of both kinds only the fixed list votes.
    """
    train = training_rows(docs, labels)  # texts are not written: only the count of words reads them
    known = materialize(train.select("doc_id", "toxic"))
    found = mine_voters(train, known, voters, least_gain, least_lift)
    found += [w for w in INSULTS if not any(w.startswith(v.rstrip("$")) or v.startswith(w) for v in found)]
    voted = materialize(vote_columns(docs, found).select("doc_id", "votes", "hits"))
    width = len(found) + FORMS
    cases = materialize(voted.join(known.dropDuplicates(["doc_id"]).hint("merge"), "doc_id", "left").groupBy("votes", "hits").agg(
        F.count("*").alias("texts"), F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"), F.sum(F.when(F.col("toxic") == 0, 1).otherwise(0)).alias("clean")))
    if cases.isEmpty():
        return Model(found, [0.0] * width, 0.0, [0.0] * (width + 1), 0.0), voted
    patterns = materialize(cases.groupBy("votes").agg(*[F.sum(c).alias(c) for c in ("texts", "toxic", "clean")]))
    label_weights, label_intercept = label_model(patterns, width)

    # the label model speaks for PRIOR documents of each vote pattern, next to the labelled ones that cast it
    known = patterns.select("votes", F.col("toxic").alias("_toxic"), (F.col("toxic") + F.col("clean")).alias("_known"))
    cases = cases.join(known, "votes")
    post = (PRIOR * sigmoid(F.lit(label_intercept) + dot(F.col("votes"), label_weights.tolist())) + F.col("_toxic")) / (PRIOR + F.col("_known"))
    inputs = F.concat(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.array_contains("votes", i).cast("double")), F.array(log_hits()))
    soft = F.array(F.struct(F.lit(1.0).alias("label"), (F.col("texts") * post).alias("w")), F.struct(F.lit(0.0).alias("label"), (F.col("texts") * (1 - post)).alias("w")))
    rows = materialize(cases.select(inputs.alias("x"), F.explode(soft).alias("y")).select("x", "y.*"))
    fitted = LogisticRegression(maxIter=50, regParam=1e-4, weightCol="w", standardization=False).fit(rows.select(array_to_vector("x").alias("features"), "label", "w"))
    return Model(found, label_weights.tolist(), label_intercept, fitted.coefficients.toArray().tolist(), float(fitted.intercept)), voted


def log_hits() -> Column:
    return F.log1p(F.col("hits").cast("double"))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, held_out boolean, score double 0 to 1, predicted int), a row per input row.

    ``labels`` has doc_id and toxic (0 or 1; others and nulls are left out). Only labels of rows whose crc32 of the id is
    no multiple of 5 are used. Scores come from the text alone; a null text counts as empty and is scored too.
    A row with a null id is scored, but not held out and never learned from. Other columns are left out.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    model, voted = fit(docs, labels, **options)
    scores = voted.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model_score(model).alias("score"))
    return scores.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def model_score(model: Model) -> Column:
    """The classifier's score from the columns votes and hits."""
    return sigmoid(F.lit(model.intercept) + dot(F.col("votes"), model.weights[:-1]) + log_hits() * model.weights[-1])


def clean_only(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` (with text) that score below 0.5, with their own columns; rows are judged where they lie."""
    return vote_columns(docs, model.voters).where(model_score(model) < 0.5).select(*docs.columns)
