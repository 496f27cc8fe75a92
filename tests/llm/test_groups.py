"""Near-duplicates, neighbours and toxicity against brute force and held-out labels; the pipeline end to end."""
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from trailweave.llm import ann, catalog, dedup, toxicity
from trailweave.session import materialize

SF = "/root/testdata/sf0.001"


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4)))


def brute_groups(texts, percent):
    sets = {k: shingle_set(t) for k, t in texts.items()}
    root = {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in texts:
        for b in texts:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {k: (len(sets[k]), find(k)) for k in texts}


def copies(seed):
    """Copies in many states of edit: groups that only chains of links hold together, and some that none does."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    texts = []
    for _ in range(6):
        word = rng.choices(vocabulary, k=rng.choice([12, 60, 150, 400]))
        for _ in range(60):
            edited = list(word)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 8])):
                edited[rng.randrange(len(edited))] = rng.choice(vocabulary)
            texts.append(" ".join(edited))
    texts += [" ".join(rng.choices(vocabulary, k=n)) for n in range(0, 60)]
    texts += ["", " \n\t", None, "One two", "one  TWO", "one two", "Éa é ÉA b c", "éa é Éa b c", "x " * 3000, "x " * 3001]
    rng.shuffle(texts)
    return dict(enumerate(texts))


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(rows, percent):
    texts = copies(percent)
    df = rows([(k, t, "clash", 5) for k, t in texts.items()], "doc_id long, text string, kept string, node int", 4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in dedup.near_duplicates(df, percent).collect()}
    assert got == brute_groups(texts, percent)


def test_near_duplicates_edge_rows(rows):
    schema = "doc_id long, text string"
    got = sorted(map(str, map(tuple, dedup.near_duplicates(rows([(None, "a b"), (4, "a b"), (4, "a b"), (2, "A  b"), (7, None)], schema)).collect())))
    assert got == ["(2, 1, 2, True)", "(4, 1, 2, False)", "(4, 1, 2, False)", "(7, 0, 7, True)", "(None, 1, None, True)"]
    assert dedup.near_duplicates(rows([], schema)).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(5)
    for n in (1, 3, 40, 3000):
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        shared = n - n // 4
        b = np.concatenate([a[:shared], rng.integers(0, 2**63, n // 4).astype(np.uint64)])
        signed = dedup.superminhash(np.concatenate([a, b]), np.repeat([0, 1], [n, n]), 2)
        assert np.isfinite(signed).all()
        assert abs((signed[0] == signed[1]).mean() - shared / (2 * n - shared)) < 0.16


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000 + i, 1000) for i in range(1, 200)] + [(5000, 2)]
    random.Random(2).shuffle(edges)
    df = spark.createDataFrame([(min(e), max(e)) for e in edges], "a long, b long").repartition(6)
    got = {r.node: r.component for r in dedup.components(df).collect()}
    assert got == {**{i: 0 for i in range(1, 301)}, **{1000 + i: 1000 for i in range(1, 200)}, 5000: 0}


def brute_nearest(data, queries, k):
    good = {i: np.array(v, float) for i, v in data if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    out = []
    for q in queries:
        if q not in good:
            continue
        scored = [(-(good[q] @ v / np.sqrt(good[q] @ good[q]) / np.sqrt(v @ v)), i) for i, v in good.items() if i != q and len(v) == len(good[q])]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted((round(s, 12), i) for s, i in scored)[:k])]
    return out


@pytest.mark.parametrize("blocks", [(4096, 32768), (7, 40)])
def test_nearest(rows, monkeypatch, blocks):
    monkeypatch.setattr(ann, "QUERY_BLOCK", blocks[0])
    monkeypatch.setattr(ann, "BLOCK", blocks[1])
    monkeypatch.setattr(ann, "STRIP", 16)
    rng = np.random.default_rng(1)
    data = [(i, rng.normal(size=8).tolist()) for i in range(300)] + [(400 + i, [1.0] * 8) for i in range(150)] + [(600 + i, (1e-3 * np.ones(8) + 1e-6 * rng.normal(size=8)).tolist()) for i in range(50)]
    data += [(700, None), (750, []), (800, [0.0] * 8), (850, [float("nan")] * 8), (900, [None] * 8), (None, [1.0] * 8), (950, [1.0, 2.0]), (951, [2.0, 1.0]), (1000, [float("inf")] * 8)]
    df = rows([(i, v, "clash") for i, v in data], "vec_id long, embedding array<double>, rank string")
    got = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in ann.nearest(df, df.where("vec_id % 50 = 0"), 5).collect())
    want = sorted((q, r, i, round(s, 9)) for q, r, i, s in brute_nearest(data, [i for i, _ in data if i is not None and i % 50 == 0], 5))
    assert [(x[0], x[1], x[3]) for x in got] == [(x[0], x[1], x[3]) for x in want]
    assert sum(a[2] == b[2] for a, b in zip(got, want)) >= 0.98 * len(want)  # scores equal but for rounding may change places
    assert ann.nearest(df.where("false"), df.where("false")).count() == 0


def test_toxicity_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score(docs, labels).join(labels, "doc_id").where("held_out").select("toxic", "score", "predicted").collect()
    toxic, clean = ([r for r in got if r.toxic == y] for y in (1, 0))
    assert sum(r.predicted for r in toxic) >= 0.5 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.02 * len(clean)
    assert np.mean([a.score > b.score for a in toxic for b in clean]) > 0.8


def test_toxicity_edge_rows(spark, rows):
    schema = "doc_id long, text string, score string"
    texts = [(1, "You idiot, you MORON"), (2, "a fine day"), (2, "a fine day"), (3, None), (4, ""), (None, "x"), (6, "word " * 30000)]
    docs = rows([(k, t, "clash") for k, t in texts], schema)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.score(docs, none).collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert {r.doc_id for r in got if r.predicted} == {1}
    odd = spark.createDataFrame([(1, None), (None, 1), (2, 5)], "doc_id long, toxic int")
    assert toxicity.score(docs, odd).count() == 7
    assert toxicity.score(docs.where("false"), none).count() == 0


def test_pipeline(spark):
    docs = catalog.table(spark, SF, "documents")
    columns = docs.columns
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = materialize(stage(spark, before, SF))
        assert after.columns == columns, name
        assert after.join(before, "doc_id", "left_anti").isEmpty()
        before = after
    texts = {r.doc_id: r.text for r in after.collect()}
    assert 0.5 * docs.count() < len(texts) < docs.count()
    assert after.where(F.col("n_chars") != F.length("text")).isEmpty()
    pieces = materialize(corpus_pipeline.STAGES[-1][1](spark, before, SF))
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == set(texts)


def test_held_out_toxicity(spark):
    """Learned outside the fold, at least nine tenths of the fold's toxic documents are found and clean ones left alone."""
    sf = "/root/testdata/sf0.1"
    scored = toxicity.score(catalog.table(spark, sf, "documents"), catalog.table(spark, sf, "labels"))
    got = scored.join(catalog.table(spark, sf, "labels"), "doc_id").where("held_out").select("toxic", "predicted").collect()
    toxic, clean = [r.predicted for r in got if r.toxic == 1], [r.predicted for r in got if r.toxic == 0]
    assert len(toxic) > 80 and sum(toxic) >= 0.9 * len(toxic) and sum(clean) <= 0.02 * len(clean)


def test_alternatives_take_the_longest_voter():
    voters = ["abc", "ab$", "abcd$", "x", "xyz$", "ü"]
    pattern = re.compile(toxicity.alternatives(voters).replace(r"[\p{L}]", "[^\\W\\d_]"))
    got = {w: (m[0] if (m := pattern.match(w)) else None) for w in ["abcde", "abcd", "ab", "abx", "xy", "xyz", "xyza", "über", "b"]}
    assert got == {"abcde": "abc", "abcd": "abcd", "ab": "ab", "abx": None, "xy": "x", "xyz": "xyz", "xyza": "x", "über": "ü", "b": None}
