"""Chunked sequence operations give the results of a plain pass, whatever the chunk size."""
import random

import pytest
from pyspark.sql import functions as F

from trailweave.functions import sequence as sq


def rows(seed=1):
    rng = random.Random(seed)
    out = [("hot", rng.randint(0, 40), rng.randint(0, 5), i) for i in range(600)]
    out += [(f"k{j}", rng.randint(0, 40), rng.randint(0, 5), 1000 + j * 10 + i) for j in range(30) for i in range(rng.randint(1, 6))]
    return out


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(rows(), "key string, ts int, seq int, id int").repartition(5)


@pytest.mark.parametrize("hot_rows", [None, 20, 150])
def test_lead(table, hot_rows):
    got = {(r.key, r.id): (r.n, r.n_2) for r in sq.lead_values(table, ["key"], ["ts", "seq", "id"], {"id": "n"}, 2, hot_rows, 1).collect()}
    want = {}
    for key in {r[0] for r in rows()}:
        ids = [r[3] for r in sorted((r for r in rows() if r[0] == key), key=lambda r: r[1:])]
        for i, x in enumerate(ids):
            want[(key, x)] = (ids[i + 1] if i + 1 < len(ids) else None, ids[i + 2] if i + 2 < len(ids) else None)
    assert got == want


@pytest.mark.parametrize("hot_rows", [None, 20, 150])
def test_positions_in_groups_and_over_the_table(table, hot_rows):
    got = {(r.key, r.id): r.pos for r in sq.positions(table, ["key"], ["ts", "seq", "id"], "pos", hot_rows, 1).collect()}
    for key in {r[0] for r in rows()}:
        ids = [r[3] for r in sorted((r for r in rows() if r[0] == key), key=lambda r: r[1:])]
        assert [got[(key, x)] for x in ids] == list(range(1, len(ids) + 1))
    everywhere = {r.id: r.pos for r in sq.positions(table, [], ["ts", "seq", "id"], "pos", hot_rows, 1).collect()}
    ids = [r[3] for r in sorted(rows(), key=lambda r: r[1:])]
    assert [everywhere[x] for x in ids] == list(range(1, len(ids) + 1))


@pytest.mark.parametrize("hot_rows", [None, 25])
def test_running_total_and_quantiles(table, hot_rows):
    got = {r.id: r.s for r in sq.running_total(table, ["ts", "id"], "seq", "s", hot_rows, 1).collect()}
    total, want = 0, {}
    for r in sorted(rows(), key=lambda r: (r[1], r[3])):
        total += r[2]
        want[r[3]] = total
    assert got == want
    q = sq.exact_quantiles(table.withColumn("x", F.col("ts") * 1.5), "x", {"a": 0.01, "b": 0.5, "c": 0.99}, hot_rows).first()
    import numpy as np

    xs = [r[1] * 1.5 for r in rows()]
    assert [q.a, q.b, q.c] == pytest.approx([np.quantile(xs, p) for p in (0.01, 0.5, 0.99)])


def test_hot_group_is_split_into_chunks(table):
    chunks = sq.with_chunks(table, ["key"], ["ts", "seq", "id"], 20, 1).where("key = 'hot'").groupBy("_chunk").count().collect()
    assert len(chunks) > 10 and max(c["count"] for c in chunks) < 150
