"""Exact nearest items for many query vectors, as block products that bounds leave out where they can.

Items are dealt to cells, each with a centre c and a radius r. For an item x of a cell q.x = q.c + q.(x - c), which by Cauchy and
Schwarz is at most q.c + |q| r. A query first meets the cells whose centres promise most, as many as
it takes to fill its list; its n-th best there is a floor, and then only cells whose bound reaches that floor are multiplied.
The result is that of comparing every pair, for any centres; they only decide how much is left out.

Neighbouring cells are put together to tiles. A query is sent once to a tile, with a bit for every cell it has to meet, and comes back with one
list, so what is shuffled grows with the number of tiles and not with that of cells.

Centres come from a bounded sample of the items (``SAMPLE`` rows) and are at most ``MOST_CELLS`` vectors, so they travel with the tasks.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from trailweave.functions.numeric import by_score, r9, top_per_group
from trailweave.session import materialize

# Numbers a block of vectors may hold (131,072 rows of 64), and pairs that are worth a task of their own.
BLOCK_VALUES, TASK_PAIRS, CHUNK_SCORES = 8_388_608, 268_435_456, 4_194_304
CELL_ROWS, MOST_CELLS, SAMPLE = 256, 1024, 16_384
# Scores are rounded to nine digits, so a bound may fall short of a floor by this much and still matter.
SLACK = 1e-8


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.vstack(vectors.to_numpy())


def _unit(a: np.ndarray) -> np.ndarray:
    return a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-300)


def centres(items: DataFrame, n_items: int, cells: int, unit: bool, rounds: int = 5) -> np.ndarray:
    """About ``cells`` centres by Lloyd's rounds over a hashed sample of the item vectors."""
    every = max(1, n_items // SAMPLE)
    sample = items.where(F.pmod(F.xxhash64("poi_id", F.lit(7)), F.lit(every)) == 0).select("poi_id", "vec").limit(2 * SAMPLE).toArrow()
    order = np.argsort(sample.column("poi_id").to_numpy())
    lists = sample.column("vec").combine_chunks()
    x = np.asarray(lists.flatten(), dtype=float).reshape(len(lists), -1)[order]
    if unit:
        x = _unit(x)
    c = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)]
    for _ in range(rounds):
        near = np.argmax(x @ c.T - 0.5 * (c * c).sum(axis=1), axis=1)
        sums, sizes = np.zeros_like(c), np.bincount(near, minlength=len(c))
        np.add.at(sums, near, x)
        c = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], c)
    return c


@dataclass
class Cells:
    """Items dealt to cells as a written table (poi_id, item_vec, cell), and each cell's centre, radius and number of items."""

    items: DataFrame
    centre: np.ndarray
    radius: np.ndarray
    size: np.ndarray


def deal(items: DataFrame, unit: bool, cells: int | None = None) -> Cells:
    """Every item to the cell of its nearest centre; rows without a vector are left out."""
    items = items.where("vec IS NOT NULL").select("poi_id", "vec")
    n = items.count()
    c = centres(items, n, cells or min(MOST_CELLS, -(-n // CELL_ROWS)), unit) if n else np.zeros((1, 1))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = _unit(_matrix(b["vec"])) if unit else _matrix(b["vec"])
                near = np.argmax(x @ c.T - 0.5 * (c * c).sum(axis=1), axis=1)
                yield pd.DataFrame({"poi_id": b["poi_id"], "item_vec": list(x), "cell": near.astype("int32"), "away": np.linalg.norm(x - c[near], axis=1)})

    placed = materialize(items.mapInPandas(place, "poi_id long, item_vec array<double>, cell int, away double"))
    radius, size = np.zeros(len(c)), np.zeros(len(c), int)
    for r in placed.groupBy("cell").agg(F.max("away").alias("r"), F.count("*").alias("n")).collect():  # a row a cell
        radius[r["cell"]], size[r["cell"]] = r["r"], r["n"]
    return Cells(placed.drop("away"), c, radius, size)


def probes(scores: np.ndarray, size: np.ndarray, want: np.ndarray) -> np.ndarray:
    """Which cells each query meets first: the most promising centres until they hold ``want`` items."""
    order = np.argsort(-scores, axis=1, kind="stable")
    before = np.cumsum(size[order], axis=1) - size[order]
    first = np.zeros(scores.shape, bool)
    np.put_along_axis(first, order, before < want[:, None], axis=1)
    return first & (size > 0)


@dataclass
class Tiles:
    """Cells put together to tiles of about as many items as a block may hold; a cell larger than that is a tile of several parts."""

    of_cell: np.ndarray
    size: np.ndarray
    parts: np.ndarray


def tiles_of(index: Cells, rows: int) -> Tiles:
    """Neighbouring cells, by their place along the direction in which the centres differ most, fill a tile after the other."""
    c = index.centre - index.centre.mean(axis=0)
    order = np.argsort(c @ np.linalg.svd(c, full_matrices=False)[2][0], kind="stable")
    of_cell, sizes = np.zeros(len(order), int), [0]
    for cell in order:
        if sizes[-1] and sizes[-1] + index.size[cell] > rows:
            sizes.append(0)
        of_cell[cell] = len(sizes) - 1
        sizes[-1] += int(index.size[cell])
    size = np.array(sizes)
    return Tiles(of_cell, size, np.maximum(1, -(-size // rows)))


def chosen_cells(queries: DataFrame, index: Cells, tiles: Tiles, floors: bool) -> DataFrame:
    """Adds ``mask``, a bit for each cell that a query meets first or, given the ``floor`` it reached there, that it still has to, the ``tiles`` they are in and the ``work``, items a tile."""
    c, radius, size, tile = index.centre, index.radius, index.size, tiles.of_cell

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            q = _matrix(b["vec"])
            scores = q @ c.T
            mask = probes(scores, size, b["want"].to_numpy())
            if floors:
                bound = scores + np.linalg.norm(q, axis=1, keepdims=True) * radius
                mask = ~mask & (size > 0) & (bound + SLACK >= b["floor"].to_numpy()[:, None])
            met = [np.unique(tile[m]).astype("int32") for m in mask]
            yield b.assign(mask=[m.tobytes() for m in np.packbits(mask, axis=1)], tiles=met, work=mask @ size / np.maximum([len(m) for m in met], 1))

    return queries.mapInPandas(run, ", ".join(f"{n} {t}" for n, t in queries.dtypes) + ", mask binary, tiles array<int>, work double")


def with_cells(queries: DataFrame) -> DataFrame:
    """``mask`` as the array of cell numbers, ``cells``."""
    bit = lambda i: F.get(F.transform(F.sequence(F.lit(1), F.length("mask")), lambda j: F.conv(F.hex(F.substring("mask", j, 1)), 16, 10).cast("int")), F.floor(i / 8).cast("int"))
    every = F.sequence(F.lit(0), F.length("mask") * 8 - 1)
    return queries.withColumn("cells", F.filter(every, lambda i: bit(i).bitwiseAND(F.pow(F.lit(2.0), 7 - i % 8).cast("int")) > 0)).drop("mask", "tiles", "work")


def best_of_block(q: np.ndarray, mask: np.ndarray, want: np.ndarray, floor: np.ndarray, x: np.ndarray, ids: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) rows: each query's best ``want`` items that reach its floor, of the cells in its mask. Items are ordered by cell."""
    present, starts = np.unique(cell, return_index=True)
    ends = np.append(starts[1:], len(cell))
    mask, finite = mask[:, present], bool(np.isfinite(x).all())
    # queries with lists of like length and the same first cell are multiplied together
    order = np.lexsort((np.argmax(mask, axis=1), np.frexp(want)[1]))
    step, out = max(1, CHUNK_SCORES // len(x)), []
    for at in range(0, len(order), step):
        rows = order[at:at + step]
        used = np.flatnonzero(mask[rows].any(axis=0))
        if not len(used):
            continue
        cols = np.concatenate([np.arange(starts[u], ends[u]) for u in used]) if len(used) < len(present) else slice(None)
        s = q[rows] @ x[cols].T
        s[np.repeat(~mask[np.ix_(rows, used)], (ends - starts)[used], axis=1)] = -np.inf
        if not finite:
            s[np.isnan(s)] = -np.inf
        low, keep = floor[rows] - SLACK, int(want[rows].max())
        if keep < s.shape[1] and np.count_nonzero(s >= low[:, None]) > 2 * keep * len(rows):
            low = np.maximum(low, np.partition(s, s.shape[1] - keep, axis=1)[:, s.shape[1] - keep] - SLACK)
        r, c = np.nonzero((s >= low[:, None]) & (s > -np.inf))
        score, found = np.round(s[r, c], 9), ids[cols][c]
        by = np.lexsort((found, -score, r))
        r, score, found = r[by], score[by], found[by]
        rank = np.arange(len(r)) - np.searchsorted(r, r)
        best = rank < want[rows][r]
        out.append((rows[r[best]], found[best], score[best]))
    return tuple(np.concatenate(part) for part in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, "int64"), np.zeros(0))


def multiplied(queries: DataFrame, index: Cells, tiles: Tiles, block_rows: int, query_blocks: int | None) -> DataFrame:
    """(case_id, poi_id, score, want): each query's best ``want`` of the cells of its mask in every tile part.

    A tile's queries are cut into blocks by hash; the items of a tile part meet a block of queries in one task.
    """
    pairs = queries.select("case_id", "vec", "want", "floor", "mask", F.explode("tiles").alias("tile"))
    asked, work = np.zeros(len(tiles.size), int), np.zeros(len(tiles.size))
    for r in queries.select("work", F.explode("tiles").alias("tile")).groupBy("tile").agg(F.count("*").alias("n"), F.sum("work").alias("work")).collect():  # a row a tile
        asked[r["tile"]], work[r["tile"]] = r["n"], r["work"]
    spread = 4 * queries.sparkSession.sparkContext.defaultParallelism
    parts = [int(p) for p in tiles.parts]
    blocks = [query_blocks or max(1, -(-int(a) // block_rows), min(int(w) // TASK_PAIRS + 1, spread)) for a, w in zip(asked, work)]
    of = lambda values: F.get(F.lit(values), F.col("tile"))
    q = pairs.withColumn("qb", F.pmod(F.xxhash64("case_id"), of(blocks)).cast("int")).withColumn("ib", F.explode(F.sequence(F.lit(0), of(parts) - 1)))
    used = [int(a > 0) for a in asked]
    i = index.items.withColumn("tile", F.get(F.lit([int(t) for t in tiles.of_cell]), F.col("cell"))).where(of(used) == 1).withColumn(
        "ib", F.pmod(F.xxhash64("poi_id"), of(parts)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), of(blocks) - 1)))
    n_cells = len(index.size)

    def multiply(qs: pd.DataFrame, its: pd.DataFrame) -> pd.DataFrame:
        if qs.empty or its.empty:
            return pd.DataFrame({"case_id": pd.Series(dtype="int64"), "poi_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64"), "want": pd.Series(dtype="int64")})
        its = its.sort_values(["cell", "poi_id"])
        bits = np.frombuffer(b"".join(qs["mask"]), np.uint8).reshape(len(qs), -1)
        mask = np.unpackbits(bits, axis=1, count=n_cells).astype(bool)
        want = qs["want"].to_numpy()
        row, ids, score = best_of_block(_matrix(qs["vec"]), mask, want, qs["floor"].to_numpy(float), _matrix(its["item_vec"]), its["poi_id"].to_numpy(), its["cell"].to_numpy())
        return pd.DataFrame({"case_id": qs["case_id"].to_numpy()[row], "poi_id": ids, "score": score, "want": want[row]})

    keys = ["tile", "qb", "ib"]
    return q.groupBy(*keys).cogroup(i.groupBy(*keys)).applyInPandas(multiply, "case_id long, poi_id long, score double, want long")


@dataclass
class Search:
    """``best`` (case_id, poi_id, score, rank) and the queries with the ``cells`` they met first and met later."""

    best: DataFrame
    first: DataFrame
    later: DataFrame
    n_cells: int


def search(
    queries: DataFrame, items: DataFrame, n: int, metric: str = "cosine",
    query_blocks: int | None = None, item_blocks: int | None = None, block_rows: int | None = None,
) -> Search:
    unit = metric == "cosine"
    index = deal(items, unit, item_blocks)
    block_rows = block_rows or max(1, BLOCK_VALUES // index.centre.shape[1])
    tiles = tiles_of(index, block_rows)
    want = F.lit(n) + (F.col("more") if "more" in queries.columns else F.lit(0))
    length = F.greatest(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)), F.lit(1e-300))
    vec = F.transform("vec", lambda x: x / length) if unit else F.col("vec")
    asked = queries.where("vec IS NOT NULL").select(F.col("case_id").cast("long").alias("case_id"), vec.alias("vec"), want.cast("long").alias("want"))
    asked = asked if index.size.any() else asked.where("false")  # without items there is nothing to find
    first = materialize(chosen_cells(asked.withColumn("floor", F.lit(float("-inf"))), index, tiles, False))
    top = lambda rows: top_per_group(rows.withColumn("score", r9("score")), ["case_id"], by_score(), "want")
    found = materialize(top(multiplied(first, index, tiles, block_rows, query_blocks)).drop("rank"))
    floors = found.groupBy("case_id", "want").agg(F.count("*").alias("_n"), F.min("score").alias("_low")).where("_n >= want").select("case_id", F.col("_low").alias("floor"))
    reached = first.drop("mask", "tiles", "work", "floor").join(floors, "case_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    later = materialize(chosen_cells(reached, index, tiles, True))
    best = top(found.unionByName(multiplied(later, index, tiles, block_rows, query_blocks))).drop("want")
    return Search(best, with_cells(first), with_cells(later), int((index.size > 0).sum()))


def top_items(
    queries: DataFrame, items: DataFrame, n: int, metric: str = "cosine",
    query_blocks: int | None = None, item_blocks: int | None = None, block_rows: int | None = None,
) -> DataFrame:
    """(case_id, poi_id, score, rank): the n best items per query by cosine or dot product, ties to the smaller id.

    ``queries`` is (case_id, vec), ``items`` is (poi_id, vec). ``item_blocks`` is the number of cells and ``query_blocks`` that of
    blocks a tile's queries are cut into, else they come from row counts. A column ``more`` of the queries asks
    for that many more than n each.
    """
    return search(queries, items, n, metric, query_blocks, item_blocks, block_rows).best


def width(vectors: DataFrame) -> int:
    """Length of the first vector found, 0 without any."""
    row = vectors.where("vec IS NOT NULL").select(F.size("vec").alias("n")).first()
    return row["n"] if row else 0


def mean_vectors(rows: DataFrame, key: str, n: int, weight: str | None = None, unit: bool = False) -> DataFrame:
    """(key, vec): (weighted) mean per key of vectors of ``n`` numbers; ``unit`` scales each vector to length one first.

    A key's sums are one row from every task, not a row for each number of each vector.
    """
    from trailweave.functions.numeric import l2

    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    vec = F.transform("vec", lambda x: x / F.col("_len")) if unit else F.col("vec")
    src = rows.withColumn("_len", l2(F.col("vec"))) if unit else rows
    parts = src.where("vec IS NOT NULL").select(key, w.alias("_w"), vec.alias("vec"))
    sums = parts.groupBy(key).agg(F.sum("_w").alias("_w"), *[F.sum(F.col("_w") * F.get("vec", F.lit(i))).alias(f"_{i}") for i in range(n)])
    return sums.select(key, F.array(*[F.col(f"_{i}") / F.col("_w") for i in range(n)]).cast("array<double>").alias("vec"))
