"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full sets, union-find grouping.

Texts with equal shingle sets are one class, so copies are counted, never paired. Classes that agree on one band
of their signatures are candidates. In a band's bucket every class is first compared with the bucket's smallest
id alone; only where the links found so far leave a bucket in several components are its members compared with
each other, tile by tile and across components, which keeps groups of thousands of copies away from all pairs
without leaving a pair out. Sketches (a byte per signature component) select, full sets confirm.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailweave.session import materialize

#: Signature length, and the bands cut from its front; the whole signature makes the sketch.
LENGTH, BANDS, ROWS = 256, 25, 5
#: A pair at the limit stays more than three standard deviations above this distance below it.
SLACK = 0.075
#: Bytes of a sketch: one a signature component, then the band keys.
WIDTH = LENGTH + 8 * BANDS
TILE = 256
SALTS = 16
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SIGNATURE = "doc_id long, n_shingles long, set_hash binary, bands array<long>, sketch binary"


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes every output bit with about even odds."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordIds(dict):
    """Hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: str | None, words: WordIds, k: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; A-Z lower-cased, words end at ASCII white space."""
    found = (text or "").encode().translate(LOWER).split()
    if not found:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    n = min(k, len(ids))
    total = np.full(len(ids) - n + 1, n, np.uint64)
    for j in range(n):
        total = mix(total + ids[j:len(ids) - n + 1 + j])
    return np.unique(total)


def superminhash(elements: np.ndarray, doc: np.ndarray, docs: int, m: int = LENGTH) -> np.ndarray:
    """(docs, m) signatures of the sets ``elements[doc == d]``.

    At step j an element offers j + r to the slot its own permutation has at place j, so each of its m offers goes
    to another slot. Offers of step j are at least j: a document whose slots all hold less than j + 1 needs no
    further step, which for sets much larger than m is the first or the second.
    """
    best = np.full(docs * m, np.inf)
    places = None
    for j in range(m):
        with np.errstate(over="ignore"):
            draw = mix(elements + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        at = (j + (draw & np.uint64(0xFFFFFF)).astype(np.int64) % (m - j))
        rows = np.arange(len(elements))
        if places is None:
            slot = at
        else:
            slot = places[rows, at].astype(np.int64)
        np.minimum.at(best, doc * m + slot, j + (draw >> np.uint64(24)).astype(np.float64) * 2.0**-40)
        unsettled = best.reshape(docs, m).max(1) >= j + 1
        stay = unsettled[doc]
        if not stay.any():
            break
        if places is None:
            places = np.tile(np.arange(m, dtype=np.uint8), (int(stay.sum()), 1))
        else:
            places = places[stay]
        elements, doc, at, slot = elements[stay], doc[stay], at[stay], slot[stay]
        rows = np.arange(len(elements))
        places[rows, at] = places[rows, j]
        places[rows, j] = slot
    return best.reshape(docs, m)


def signature_rows(ids: list, sets: list[np.ndarray]) -> pa.RecordBatch:
    full = [k for k, s in enumerate(sets) if len(s)]
    hashes: list = [None] * len(sets)
    bands: list = [None] * len(sets)
    sketches: list = [None] * len(sets)
    if full:
        signed = superminhash(np.concatenate([sets[k] for k in full]), np.repeat(np.arange(len(full)), [len(sets[k]) for k in full]), len(full))
        bits = mix(signed.view(np.uint64))
        banded = np.zeros((len(full), BANDS), np.uint64)
        for band in range(BANDS):
            key = np.full(len(full), band + 1, np.uint64)
            for r in range(ROWS):
                key = mix(key + bits[:, band * ROWS + r])
            banded[:, band] = key
        small = bits.astype(np.uint8)
        for row, k in enumerate(full):
            hashes[k] = xxhash.xxh3_128_digest(sets[k].tobytes())
            bands[k] = banded[row].view(np.int64)
            sketches[k] = small[row].tobytes() + banded[row].tobytes()
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(hashes, pa.binary()),
                                       pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                                      ["doc_id", "n_shingles", "set_hash", "bands", "sketch"])


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """One pass over the texts: set size, set hash, band keys and sketch of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds()
        for batch in batches:
            ids, sets, size = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(doc_id)
                sets.append(shingles(text.as_py(), words, k))
                size += len(sets[-1])
                if size > 200_000:
                    yield signature_rows(ids, sets)
                    ids, sets, size = [], [], 0
            if ids:
                yield signature_rows(ids, sets)

    return docs.mapInArrow(run, SIGNATURE)


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """(node, shingles array<long>) of the documents given."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [shingles(text.as_py(), words, k).view(np.int64) for text in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    return docs.mapInArrow(run, "node long, shingles array<long>")


def agreement(pairs: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose sketches agree in at least that share of places."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, WIDTH)[:, :LENGTH] for c in (2, 3))
            yield batch.select([0, 1]).filter(pa.array((left == right).mean(1) >= least))

    return pairs.select("a", "b", "sketch_a", "sketch_b").mapInArrow(run, "a long, b long")


def tile_pairs(tiles: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of different components within each tile whose sketches agree in at least that share of places.

    Rows (bucket, i, j, chunk, node, label, sketch) come sorted by tile; a tile has two chunks of about TILE rows. A pair
    that meets in several bands is given by the first of them alone.
    """
    def pairs(band: int, rows: list) -> list[tuple[int, int]]:
        nodes, labels = np.array([x[1] for x in rows]), np.array([x[2] for x in rows])
        chunk = np.array([x[0] for x in rows])
        both = np.frombuffer(b"".join(x[3] for x in rows), np.uint8).reshape(-1, WIDTH)
        sketch, keys = both[:, :LENGTH], np.ascontiguousarray(both[:, LENGTH:]).view(np.int64)[:, :band]
        crossing = chunk.min() != chunk.max()
        out = []
        for r in range(len(rows) - 1):
            other = slice(r + 1, None)
            wanted = labels[other] != labels[r]
            if crossing:
                wanted &= chunk[other] != chunk[r]
            if wanted.any():
                close = np.flatnonzero(wanted)
                close = close[(sketch[other][close] == sketch[r]).mean(1) >= least] + r + 1
                close = close[~(keys[close] == keys[r]).any(1)]
                out += [(min(nodes[r], nodes[x]), max(nodes[r], nodes[x])) for x in close]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(found: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([int(x[c]) for x in found], pa.int64()) for c in (0, 1)], ["a", "b"])

        key, rows, found = (0, 0, 0, 0), [], []
        for batch in batches:
            for bucket, i, j, band, chunk, node, label, sketch in zip(*(batch.column(c).to_pylist() for c in range(8))):
                if (bucket, i, j, band) != key:
                    if len(rows) > 1:
                        found += pairs(key[3], rows)
                    key, rows = (bucket, i, j, band), []
                rows.append((chunk, node, label, sketch))
            if found:
                yield made(found)
                found = []
        if len(rows) > 1:
            found += pairs(key[3], rows)
        if found:
            yield made(found)

    placed = tiles.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return placed.select("bucket", "i", "j", "band", "chunk", "node", "label", "sketch").mapInArrow(run, "a long, b long").distinct()


def forest(edges: DataFrame) -> DataFrame:
    """Each batch of edges replaced by (node, root) of its union-find forest: no more rows than nodes, the same components."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            root: dict[int, int] = {}

            def find(x: int) -> int:
                while root.setdefault(x, x) != x:
                    root[x] = root.setdefault(root[x], root[x])
                    x = root[x]
                return x

            for a, b in zip(frame.a.tolist(), frame.b.tolist()):
                a, b = find(a), find(b)
                if a != b:
                    root[max(a, b)] = min(a, b)
            rows = [(x, find(x)) for x in list(root) if find(x) != x]
            yield pd.DataFrame(rows, columns=["a", "b"], dtype="int64")

    return edges.select("a", "b").mapInPandas(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): every node of an edge with the smallest id it reaches.

    Alternating large and small stars over edges kept as (larger, smaller); each round is written out, and
    the rounds end when the edges stay the same, which then are stars around the smallest ids.
    """
    current = materialize(forest(edges).distinct())
    mark = None
    while True:
        new = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == mark or not new[0]:
            break
        mark = new
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").unionByName(low.select("a", F.col("m").alias("b")))
        current = materialize(small.distinct())
    return current.select(F.col("a").alias("node"), F.col("b").alias("component"))


def confirmed(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets share at least ``percent`` of their union."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = materialize(shingle_sets(docs.join(ends, "doc_id", "left_semi"), k))
    left, right = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"set_{c}")) for c in ("a", "b"))
    shared = F.size(F.array_intersect("set_a", "set_b")).cast("long")
    union = F.size("set_a") + F.size("set_b") - shared
    return pairs.join(left, "a").join(right, "b").where(100 * shared >= percent * union).select("a", "b")


def salt(of: Column) -> Column:
    return F.pmod(F.xxhash64(of), F.lit(SALTS)).cast("int")


def near_duplicates(docs: DataFrame, percent: int = 80, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles long, component_id long, kept boolean), a row per input row.

    Two documents are linked if 100 * |intersection| >= percent * |union| of their k-word shingle sets; a text
    with fewer than k words has its whole word sequence as the one shingle. ``component_id`` is the smallest
    doc_id reachable over links, ``kept`` says whether it is the row's own. A null or empty text, or one of
    white space, has an empty set and is linked with nothing. Rows that repeat a doc_id are one document. A row
    with a null doc_id can't be named by others: its component_id is null and it is kept. Other columns are left
    out. Candidates come from bands: at the limit of 80 % a pair shares one with a chance above 0.9999 and passes the sketch with one above 0.998;
    pairs above the limit do so nearly always.
    """
    least = percent / 100 - SLACK
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = materialize(signatures(docs, k))
    named = signed.where("n_shingles > 0 and doc_id is not null")
    classes = materialize(named.groupBy("set_hash").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies")))
    reps = materialize(named.join(classes.select(F.col("node").alias("doc_id"), "set_hash"), ["doc_id", "set_hash"], "left_semi")
                       .select(F.col("doc_id").alias("node"), "bands", "sketch"))

    exploded = reps.select("node", F.posexplode("bands").alias("band", "bucket"))
    shared = exploded.groupBy("bucket").agg(F.min("node").alias("pivot"), F.count("*").alias("n")).where("n > 1")
    members = materialize(exploded.join(shared, "bucket"))
    sketch = reps.select("node", "sketch")

    def sketched(df: DataFrame, side: str) -> DataFrame:
        return df.join(sketch.select(F.col("node").alias(side), F.col("sketch").alias(f"sketch_{side}")), side)

    stars = members.where("node != pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    close = materialize(agreement(sketched(sketched(stars, "b"), "a"), least))
    links = materialize(confirmed(close, docs, k, percent))
    found = components(links)

    # buckets that the stars left in several components
    labelled = members.join(found, "node", "left").select("bucket", "band", "n", "node", F.coalesce("component", "node").alias("label"))
    split = labelled.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("bucket")
    chunks = F.ceil(F.col("n") / TILE).cast("int")
    tiles = (labelled.join(split, "bucket").join(sketch, "node")
             .withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
             .withColumn("t", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
             .withColumn("i", F.least("chunk", "t")).withColumn("j", F.greatest("chunk", "t")))
    rest = materialize(tile_pairs(tiles, least).join(close, ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        found = components(links.unionByName(confirmed(rest, docs, k, percent)))

    several = classes.where("copies > 1").join(found, "node", "left").select("set_hash", F.coalesce("component", "node").alias("of_class"))
    several = several.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = (signed.select("doc_id", "n_shingles", "set_hash").withColumn("salt", salt(F.col("doc_id"))).join(several, ["set_hash", "salt"], "left")
            .join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("of_class", "component", "doc_id"))
    return (rows.withColumn("component_id", component)
            .select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")))
