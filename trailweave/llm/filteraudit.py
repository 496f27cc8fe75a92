"""Filter interaction audit by min-plus removal ranks.

A document is the row of filters it fails; a chain is a permutation of the filters. The step at which a chain
removes a document is the least position, in that chain, of the filters the document fails: the min-plus
product of the mask matrix (0 where a filter fails, else infinity) and the matrix of positions, whose columns
are the inverse permutations. All counts follow from that matrix by weighted scatter.

Documents with the same mask are one row of the product, weighted by how many they are, so the product is worked
out once for the 2^n masks and a part's counts are products of its weights with it.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The white space that parts words.
GAPS = " \t\n\x0b\f\r"


def words(text: Column) -> Column:
    """Maximal runs of other characters than ASCII white space."""
    inner = F.btrim(text, F.lit(GAPS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, "[ \t-\r]+"))


def own_failures(text: Column) -> dict[str, Column]:
    """The filters that a text alone decides: A few words, B repeated words, C capitals, D marks."""
    found = words(text)
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.size(found) < 50,
        "B": 100 * F.size(F.array_distinct(found)) < 65 * F.size(found),
        "C": 100 * capitals > 5 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def removal_steps(n: int) -> tuple[list[tuple[int, ...]], np.ndarray]:
    """(chains, steps): every order of n filters and, for each mask and chain, the step from 1 that removes it; n + 1 for never."""
    chains = list(permutations(range(n)))
    positions = np.argsort(np.array(chains).reshape(-1, n), axis=1).T + 1  # a row a filter, a column a chain
    fails = np.arange(1 << n)[:, None] >> np.arange(n) & 1 == 1
    masks = np.where(fails, 0, n + 1)
    product = np.full((1 << n, len(chains)), n + 1)
    for f in range(n):
        product = np.minimum(product, masks[:, f, None] + positions[f])
    return chains, product


MEASURES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audit(weights: DataFrame, letters: str, part: str = "part") -> DataFrame:
    """Rows (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every chain and step.

    ``weights`` has a row per part and mask: part, mask int (bit i for letter i), docs, good and toxic long. A part has
    n! x n rows, zeros included; no rows give none. Counts are exact 64-bit integers.
    """
    n = len(letters)
    by_mask = [F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0)).alias(f"{c}_{m}") for c in ("docs", "good", "toxic") for m in range(1 << n)]
    spread = weights.groupBy(part).agg(*by_mask)
    spread = spread.select(part, *[F.array(*[F.col(f"{c}_{m}") for m in range(1 << n)]).alias(c) for c in ("docs", "good", "toxic")])
    schema = f"{part} string, filter_order string, step int, " + ", ".join(f"{m} long" for m in MEASURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chains, ranks = removal_steps(n)
        filters = np.array(chains).reshape(-1)  # of every (chain, step) in order
        steps = np.tile(np.arange(1, n + 1), len(chains))
        by_column = np.repeat(ranks, n, axis=1)
        fails = (np.arange(1 << n)[:, None] >> filters & 1) == 1
        removed, after, late = by_column == steps, by_column > steps, fails & (by_column < steps)
        alone = np.arange(1 << n)[:, None] == 1 << filters
        orders = pa.array(["".join(letters[f] for f in c) for c in chains for _ in range(n)])
        scatter = {"kept": after, "removed": removed, "redundant": late, "unique_fails": alone}
        scatter = {k: v.astype(np.int64) for k, v in scatter.items()}
        for batch in batches:
            for row in batch.to_pylist():
                docs, good, toxic = (np.array(row[c], np.int64) for c in ("docs", "good", "toxic"))
                out = {k: docs @ v for k, v in scatter.items()}
                out |= {"good_lost": good @ scatter["removed"], "toxic_lost": toxic @ scatter["removed"]}
                share = np.zeros(n, np.int64)
                np.add.at(share, filters, out["removed"])
                out["shapley"] = share[filters]
                yield pa.RecordBatch.from_arrays([pa.array([row[part]] * len(steps), pa.string()), orders, pa.array(steps, pa.int32()),
                                                  *[pa.array(out[m], pa.int64()) for m in MEASURES]], [part, "filter_order", "step", *MEASURES])

    return spread.mapInArrow(run, schema)


def masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, docs, good, toxic): how many documents of each part fail each set of the filters A to E, and how many of those are labelled.

    E fails where a smaller id has the same text, anywhere in the table: a null id is neither smaller nor larger than
    any, equal ids are not smaller, and every repeated row counts. A null text counts as empty (which fails A alone, and E), a null part
    as the empty string. A document is good (toxic) if any label row of its id has quality (toxic) 1. Other columns are left out.

    Texts are read once and leave as digests. Equal rows meet first, then equal texts of one part and label, so
    a text that a third of all rows share comes to few rows before it is compared.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    read = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    own = sum((F.when(fails, 1 << bit).otherwise(0) for bit, fails in enumerate(own_failures(F.col("text")).values())), F.lit(0))
    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256))
    rows = read.select("id", "part", digest.alias("digest"), own.alias("own")).groupBy("id", "part", "digest", "own").agg(F.count("*").alias("n"))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(
        F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    rows = rows.join(known, "id", "left").fillna(False, ["good", "toxic"])
    groups = rows.groupBy("digest", "own", "part", "good", "toxic").agg(
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("least"), F.sum("n").alias("n"),
        F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("unnumbered"))
    smallest = groups.groupBy("digest").agg(F.min("least.id").alias("first"))
    met = groups.join(smallest, "digest")
    new = F.col("unnumbered") + F.when(F.col("least.id") == F.col("first"), F.col("least.n")).otherwise(0)
    both = F.array(F.struct(F.col("own").alias("mask"), new.alias("n")), F.struct((F.col("own") + 16).alias("mask"), (F.col("n") - new).alias("n")))
    counted = met.select("part", "good", "toxic", F.explode(both).alias("x")).select("part", "good", "toxic", "x.mask", "x.n")
    return counted.groupBy("part", "mask").agg(
        F.sum("n").alias("docs"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))
