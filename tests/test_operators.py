"""Operators against brute force on small fixtures with nulls, ties and odd inputs."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailweave.functions import geo, numeric, text, vectors
from trailweave.operators import engines as eng
from trailweave.operators import features, fusion, labels, prefs, rerank, routes, splits, variants
from trailweave.operators import transitions as tr


def visits(spark, rows):
    return spark.createDataFrame([(t, u, p, "C1", i, i, 0) for i, (t, u, p) in enumerate(rows)], "trail_id long, user_id long, poi_id long, venue_city string, ts long, seq int, tie long")


def test_transitions_keep_self_loops_and_skip_single_stops(spark):
    v = visits(spark, [(1, 1, 7), (2, 1, 7), (2, 1, 7), (3, 1, 7), (3, 1, 8), (3, 1, 9)])
    got = {(r.a, r.b): (r.n, r.p) for r in tr.transitions_poi(v).collect()}
    assert got == {(7, 7): (1, 0.5), (7, 8): (1, 0.5), (8, 9): (1, 1.0)}
    assert [(r.p, r.a, r.b, r.p2) for r in tr.transitions_order2(v).collect()] == [(7, 8, 9, 1.0)]


def test_transition_rows_sum_to_one_and_cooccurrence_is_symmetric(spark):
    rng = random.Random(3)
    v = visits(spark, [(rng.randint(1, 40), rng.randint(1, 9), rng.randint(1, 25)) for _ in range(400)])
    assert all(abs(r.s - 1) < 1e-9 for r in tr.transitions_poi(v).groupBy("a").agg(F.sum("p").alias("s")).collect())
    whole = {(r.a, r.b): r.n for r in features.cooccurrence(v).collect()}
    assert whole and all(whole[(b, a)] == n for (a, b), n in whole.items())
    small = {tuple(r) for r in features.trail_pairs(v, chunk=2).collect()}
    assert small == {tuple(r) for r in features.trail_pairs(v).collect()}


def test_context_and_previous_poi(spark):
    df = spark.createDataFrame([([1, 2, 3], 2), ([1, 2, 3], None), ([1], 1), ([], 5)], "h array<long>, c long")
    got = [tuple(r) for r in df.select(tr.last_n_context(F.col("h"), F.col("c"), 2), tr.last_n_context(F.col("h"), F.col("c"), 0), tr.prev_poi(F.col("h"), F.col("c"))).collect()]
    assert got == [([3, 2], [2], 3), ([2, 3], [3], 3), ([1], [1], 1), ([5], [5], None)]


def test_split_sizes(spark):
    v = visits(spark, [(1, 1, p) for p in range(5)] + [(2, 2, 1)])
    parts = {(r.user_id, r.poi_id): r.part for r in splits.split_user(v, 2, 1).collect()}
    assert parts == {(1, 0): "train", (1, 1): "train", (1, 2): "train", (1, 3): "test", (1, 4): "test"}
    single = splits.split_last_trail(v, 1, 4).select("part").distinct().collect()
    assert [r.part for r in single] == ["train"]


def test_all_truth_seen_is_skipped(spark):
    v = visits(spark, [(1, 1, 5), (1, 1, 6), (2, 1, 5), (2, 1, 6), (2, 1, 5), (2, 1, 6)])
    c = splits.cases_last_trail(splits.split_last_trail(v, 1, 4))
    assert c.cases.count() == 0 and c.skipped.count() == 1


def test_preferences(spark):
    df = spark.createDataFrame([(1, "a, Free ,paid,price:x,PRICE:2,,  ", "strict"), (2, None, "odd")], "req_id int, prefs string, category_mode string")
    got = {r.req_id: (r.categories, r.free_only, r.max_price_tier, r.category_mode) for r in prefs.prefs_table(df).collect()}
    assert got == {1: (["a", "price:x"], False, 2, "strict"), 2: ([], None, None, "soft")}


def test_text_and_numbers(spark):
    df = spark.createDataFrame([(" Café  del   MAR ", "2.5"), ("NaN", "3.5"), ("wd:x", "oops")], "s string, n string")
    got = [tuple(r) for r in df.select(text.norm_text(F.col("s")), text.null_like(F.col("s")), numeric.safe_int(F.col("n")), text.normalize_field(F.col("s"))).collect()]
    assert got == [("cafe del mar", "Café  del   MAR", 2, "Café  del   MAR"), ("nan", None, 4, "NaN"), ("wd:x", "wd:x", None, "x")]


def test_impute_price_order(spark):
    pois = spark.createDataFrame([(1, 3), (2, None), (3, 4), (4, None)], "poi_id long, price_tier int").withColumns({"rating": F.lit(None).cast("double"), "total_ratings": F.lit(None).cast("int")})
    cats = spark.createDataFrame([(1, 0, "a", "A"), (1, 1, "b", "B"), (2, 0, "a", "A"), (3, 0, "x", "Zed"), (4, 0, "q", "Q")], "poi_id long, ord int, category_id string, category_name string")
    lab = spark.createDataFrame([("a", "A", False, 2, None), ("b", "B", True, None, None), ("other", "zed ", False, 1, None)], "label_id string, name string, free boolean, price_tier int, source string")
    got = {r.poi_id: (r.price_tier, r.is_free) for r in labels.impute_price(pois, cats, lab, labels.category_medians(cats, pois)).collect()}
    assert got == {1: (0, True), 2: (2, False), 3: (1, False), 4: (None, False)}


def test_diverse_top_k_equals_greedy(spark):
    rng = random.Random(5)
    data = [(c, i, float(rng.randint(0, 6)), f"k{rng.randint(0, 3)}") for c in range(4) for i in range(30)]
    df = spark.createDataFrame(data, "case_id int, poi_id int, score double, category string")
    got = {(r.case_id, r["rank"]): r.poi_id for r in rerank.diverse_top_k(df, ["case_id"], "score", "category", 6, 2).collect()}
    for c in range(4):
        used, out = {}, []
        for _, i, _, k in sorted((x for x in data if x[0] == c), key=lambda x: (-x[2], x[1])):
            if used.get(k, 0) < 2 and len(out) < 6:
                used[k] = used.get(k, 0) + 1
                out.append(i)
        assert [got[(c, j + 1)] for j in range(len(out))] == out


def test_rrf_counts_missing_ids_at_engine_size(spark):
    df = spark.createDataFrame([(1, "item", 10, 0.9), (1, "item", 11, 0.5), (1, "markov", 11, 1.0)], "case_id int, engine string, poi_id int, score double")
    got = {r.poi_id: r.score for r in fusion.rrf(df).collect()}
    empty = 3 / 31
    assert got[10] == pytest.approx(1 / 31 + 1 / 32 + empty, abs=1e-8) and got[11] == pytest.approx(1 / 32 + 1 / 31 + empty, abs=1e-8)


def dense_content(cats, hist, seen):
    """Brute-force content order per case: score, signature, id."""
    docs = {}
    for p, name in cats:
        docs.setdefault(p, []).append(name)
    sig = {p: "|".join(sorted(ns)) for p, ns in docs.items()}
    tok = {p: [w for n in ns for w in n.lower().split()] for p, ns in docs.items()}
    df = {}
    for ws in tok.values():
        for w in set(ws):
            df[w] = df.get(w, 0) + 1
    vec = {}
    for p, ws in tok.items():
        raw = {w: ws.count(w) * (math.log((1 + len(docs)) / (1 + df[w])) + 1) for w in set(ws)}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        vec[p] = {w: x / norm for w, x in raw.items()}
    out = {}
    for case, items in hist.items():
        total = sum(n for p, n in items.items() if p in vec)
        prof = {}
        for p, n in items.items():
            for w, x in vec.get(p, {}).items():
                prof[w] = prof.get(w, 0) + n / total * x
        pn = math.sqrt(sum(x * x for x in prof.values())) + 1e-8
        sc = {p: round(sum(prof.get(w, 0) * x for w, x in v.items()) / (pn * (1 + 1e-8)), 9) for p, v in vec.items() if p not in seen[case]}
        out[case] = sorted(((p, s) for p, s in sc.items()), key=lambda x: (-x[1], sig[x[0]], x[0]))
    return out


def test_content_top_k_and_ranks_equal_dense_scoring(spark):
    rng = random.Random(11)
    names = ["Art Museum", "Park", "Sushi Bar", "Wine Bar", "Zoo", "Science Museum"]
    cats = [(p, names[rng.randint(0, 5)]) for p in range(80)] + [(p, "Gift Shop") for p in range(0, 80, 7)]
    hist = {1: {3: 2, 9: 1}, 2: {p: 1 for p, n in cats if n == "Zoo"}, 3: {0: 1, 7: 4}}
    seen = {c: set(h) | {5} for c, h in hist.items()}
    want = dense_content(cats, hist, seen)
    cat_df = spark.createDataFrame([(p, i, f"c{n}", n) for i, (p, n) in enumerate(cats)], "poi_id long, ord int, category_id string, category_name string")
    cases = spark.createDataFrame([(c, "ALL") for c in hist], "case_id long, scope string")
    history = spark.createDataFrame([(c, p, n) for c, h in hist.items() for p, n in h.items()], "case_id long, poi_id long, n long")
    seen_df = spark.createDataFrame([(c, p) for c, s in seen.items() for p in s], "case_id long, poi_id long")
    vec, sig_of = features.tfidf_by_signature(cat_df)
    reach = eng.content_reach(cases, history, seen_df, vec, sig_of)
    top = {(r.case_id, r["rank"]): (r.poi_id, r.score) for r in eng.content_top_k(reach, seen_df, sig_of, 15).collect()}
    for c, rows in want.items():
        assert [top[(c, i + 1)] for i in range(15)] == rows[:15]
    needed = spark.createDataFrame([(c, p) for c in hist for p in range(80) if p not in seen[c] and p % 3 == 0], "case_id long, poi_id long")
    ranks = {(r.case_id, r.poi_id): r.rank0 for r in eng.content_ranks(needed, reach, seen_df, sig_of).collect()}
    for c, rows in want.items():
        place = {p: i for i, (p, _) in enumerate(rows)}
        assert all(ranks[(c, p)] == place[p] for (cc, p) in ranks if cc == c)


def test_top_items_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    q, items = rng.normal(size=(9, 5)), rng.normal(size=(40, 5))
    qd = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "case_id long, vec array<double>")
    it = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(items)], "poi_id long, vec array<double>")
    got = {(r.case_id, r["rank"]): r.poi_id for r in vectors.top_items(qd, it, 4, "dot", query_blocks=2, item_blocks=3).collect()}
    for i in range(9):
        order = sorted(range(40), key=lambda j: (-round(float(q[i] @ items[j]), 9), j))[:4]
        assert [got[(i, k + 1)] for k in range(4)] == order


@pytest.mark.parametrize("radius", [0.5, 60.0])
def test_radius_join_equals_brute_force(spark, radius):
    rng = random.Random(7)
    pts = [(i, rng.choice([35.0, -60.0, 0.0]) + rng.uniform(-0.5, 0.5), rng.choice([179.8, -179.9, 10.0]) + rng.uniform(-0.1, 0.1)) for i in range(150)]
    pts = [(i, la, lo - 360 if lo > 180 else lo + 360 if lo < -180 else lo) for i, la, lo in pts]
    anchors = [(i, la + 0.001, lo) for i, la, lo in pts[:25]]
    a = spark.createDataFrame(anchors, "case_id long, a_lat double, a_lon double")
    p = spark.createDataFrame(pts, "poi_id long, lat double, lon double")
    got = sorted((r.case_id, r.poi_id) for r in geo.radius_join(a, p, radius).collect())
    want = sorted((i, j) for i, la, lo in anchors for j, lb, lp in pts if float(routes.km_from(la, lo, np.array([lb]), np.array([lp]))[0]) <= radius)
    assert got == want


def plain_plan(cands, k, anchor, p):
    """Straight-line version of the greedy planner."""
    weight, longest = p.effective(anchor is not None)
    picked, here, used = [], anchor, {}
    if anchor is None:
        picked, here = [0], cands[0][1:3]
        used[cands[0][4]] = 1
    while len(picked) < k:
        best = None
        for relaxed in (False, True):
            for i, (_, la, lo, s, cat) in enumerate(cands):
                d = float(routes.km_from(here[0], here[1], np.array([la]), np.array([lo]))[0])
                if i in picked or used.get(cat, 0) >= p.max_per_category:
                    continue
                if d < p.pair_min_km and not (relaxed and anchor is not None and not picked):
                    continue
                if not relaxed and not p.min_leg_km <= d <= longest:
                    continue
                u = round(s - weight * d + (p.diversity_bonus if not used.get(cat) else 0), 9)
                if best is None or u > best[0]:
                    best = (u, i)
            if best:
                break
        if best is None:
            break
        i = best[1]
        picked.append(i)
        here = cands[i][1:3]
        used[cands[i][4]] = used.get(cands[i][4], 0) + 1
    return [cands[i][0] for i in picked]


@pytest.mark.parametrize("anchored", [True, False])
def test_plan_route_equals_plain_loop(spark, anchored):
    rng = random.Random(13)
    data, p = {}, routes.PlannerParams(k=6)
    for c in range(12):
        spread = [0.002, 0.02, 0.2][c % 3]
        rows = [(i, 35 + rng.uniform(-spread, spread), 135 + rng.uniform(-spread, spread), round(rng.random(), 3), f"k{rng.randint(0, 2 if c % 2 else 6)}") for i in range(25)]
        data[c] = sorted(rows, key=lambda r: (-r[3], r[0]))
    df = spark.createDataFrame([(c, *r) for c, rows in data.items() for r in rows], "case_id long, poi_id long, lat double, lon double, score double, primary_category string")
    if anchored:
        df = df.withColumns({"a_lat": F.lit(35.0), "a_lon": F.lit(135.0)})
    got = {}
    for r in routes.plan_route(df, p).orderBy("case_id", "step").collect():
        got.setdefault(r.case_id, []).append(r.poi_id)
    for c, rows in data.items():
        assert got[c] == plain_plan(rows, 6, (35.0, 135.0) if anchored else None, p)


def plain_two_opt(order, dist, fixed):
    length = lambda o: sum(dist[a][b] for a, b in zip(o, o[1:]))
    best = list(order)
    if len(best) < 4:
        return best
    for _ in range(80):
        for i in range(1 if fixed else 0, len(best) - 2):
            cand = next((best[:i] + best[i:j + 1][::-1] + best[j + 1:] for j in range(i + 1, len(best) - 1)
                         if length(best[:i] + best[i:j + 1][::-1] + best[j + 1:]) + 1e-9 < length(best)), None)
            if cand:
                best = cand
                break
        else:
            break
    return best


@pytest.mark.parametrize("fixed", [True, False])
def test_two_opt_equals_plain_loop_and_never_lengthens(fixed):
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 4, 6, 9):
        lat, lon = 35 + rng.uniform(0, 0.1, n), 135 + rng.uniform(0, 0.1, n)
        dist = routes.distance_matrix(lat, lon)
        path = routes.shorten(list(range(n)), dist, fixed)
        assert sorted(path) == list(range(n)) and path[-1] == n - 1
        assert path == plain_two_opt(range(n), dist, fixed)


def test_route_order_uses_anchor_and_drops_it(spark):
    df = spark.createDataFrame([(1, 1, 10, 0.0, 0.3), (1, 2, 11, 0.0, 0.1), (1, 3, 12, 0.0, 0.2), (1, 4, 13, None, 0.2)], "r long, step long, poi_id long, lat double, lon double")
    out = routes.build_route(df.withColumns({"a_lat": F.lit(0.0), "a_lon": F.lit(0.0)}), ["r"]).orderBy("step").collect()
    assert [x.poi_id for x in out] == [11, 12, 10]
    assert out[0].total_km == pytest.approx(0.3 * math.pi / 180 * 6371, rel=1e-6)


def test_coverage_picks_next_row_when_a_word_shares_its_best(spark):
    rows = spark.createDataFrame([(1, 1, 0.9, False, 3), (1, 2, 0.8, False, 3), (1, 3, 0.7, False, 3), (1, 4, 0.1, False, 3)], "req_id long, poi_id long, score double, strict boolean, k int")
    named = spark.createDataFrame([(1, "x", "blue green"), (2, "x", "red"), (3, "x", "red"), (4, "x", "green")], "poi_id long, intent string, primary_category string")
    wanted = spark.createDataFrame([(1, "blue", 0, False), (1, "green", 1, False)], "req_id long, word string, pos int, is_intent boolean")
    got = [r.poi_id for r in variants.trim_coverage(rows, wanted, named).orderBy("rank").collect()]
    assert got == [1, 4, 2]


def test_popular_and_random_leave_out_seen(spark):
    pois = spark.createDataFrame([(p, "ALL") for p in range(30)], "poi_id long, scope string")
    counts = spark.createDataFrame([(p, p % 5) for p in range(30) if p % 5], "poi_id long, n_visits long")
    cases = spark.createDataFrame([(1, "ALL"), (2, "ALL")], "case_id long, scope string")
    seen = spark.createDataFrame([(1, p) for p in (4, 9, 14)] + [(2, p) for p in range(28)], "case_id long, poi_id long")
    pop = [(r.case_id, r.poi_id) for r in eng.popular(cases, seen, pois, counts, 3).orderBy("case_id", "rank").collect()]
    assert pop == [(1, 19), (1, 24), (1, 29), (2, 29), (2, 28)]
    rnd = eng.random_baseline(cases, seen, pois, 5).collect()
    assert sum(r.case_id == 1 for r in rnd) == 5 and {r.poi_id for r in rnd if r.case_id == 2} == {28, 29}


def test_poi_json_of_either_layout_and_missing_files(spark, tmp_path):
    from trailweave.sources import scans

    (tmp_path / "lines.json").write_text('{"fsq_id": "a"}\n[{"fsq_id": "b"}, {"fsq_id": "c"}]\n42\n')
    (tmp_path / "pretty.json").write_text('[\n  {"fsq_id": "d"},\n  {\n    "fsq_id": "e"\n  }\n]\n')
    ids = lambda name, whole: sorted(r.fsq_id for r in scans.read_poi_json(spark, str(tmp_path / name), whole).select("fsq_id").where("fsq_id is not null").collect())
    assert ids("lines.json", False) == ["a", "b", "c"]
    assert ids("pretty.json", True) == ["d", "e"]
    assert ids("absent.json", False) == []


def test_norm_text_decomposes_compatibility_letters(spark):
    from trailweave.functions.text import norm_text

    rows = spark.createDataFrame([(" Ｃafé  ﬁn\tÅ ",), ("plain  A",), (None,), ("",)], "t string")
    assert [r.n for r in rows.select(norm_text(rows.t).alias("n")).collect()] == ["cafe fin a", "plain a", None, ""]


def test_lists_are_full_however_much_was_seen(spark):
    import numpy as np

    from trailweave.operators import engines

    rng = np.random.default_rng(4)
    items = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(60)], "poi_id long, vec array<double>")
    users = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0])], "user_id long, vec array<double>")
    cases = spark.createDataFrame([(7, 1)], "case_id long, user_id long")
    seen = spark.createDataFrame([(7, i, 1) for i in range(50)], "case_id long, poi_id long, n long")
    assert engines.als_score(cases, seen, users, items, 10).count() == 10
    assert engines.embed_context(seen.select("case_id", "poi_id"), items, 10).count() == 10


@pytest.mark.parametrize("metric", ["cosine", "dot"])
def test_pruned_search_is_exact_and_leaves_most_pairs_out(spark, metric):
    """Clustered vectors with ties, a zero vector and lists longer than a cell: brute force's rows from a small part of the pairs."""
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(40, 16)) * 6
    x = np.round(middles[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 16)) * 0.3, 3)
    x[7] = 0
    x[100:130] = x[100]
    q = x[rng.choice(3000, 120, replace=False)] + 0.01
    q[3] = 0
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9999, None)], "poi_id long, vec array<double>")
    queries = spark.createDataFrame([(i, v.tolist(), 300 if i % 50 == 0 else 0) for i, v in enumerate(q)] + [(777, None, 0)], "case_id long, vec array<double>, more int")
    found = vectors.search(queries, items, 10, metric, item_blocks=60, block_rows=64)
    unit = (lambda a: a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-300)) if metric == "cosine" else (lambda a: a)
    scores = np.round(unit(q) @ unit(x).T, 9)
    got = {(r.case_id, r["rank"]): (r.poi_id, r.score) for r in found.best.collect()}
    for i in range(len(q)):
        n = 310 if i % 50 == 0 else 10
        order = np.argsort(-scores[i], kind="stable")[:n]
        assert [got[i, k + 1][0] for k in range(n)] == order.tolist() or np.allclose([got[i, k + 1][1] for k in range(n)], scores[i][order], atol=2e-9)
    assert len(got) == 120 * 10 + 3 * 300
    met = sum(len(r.cells) for t in (found.first, found.later) for r in t.where("case_id % 50 <> 0 and case_id <> 3").collect())
    assert met < 0.25 * found.n_cells * 116


def test_balanced_join_splits_hot_keys(spark):
    """One key holds nine tenths of both sides: the plain join's rows, dealt to many parts of bounded size."""
    left = [(0 if i % 10 else i, i) for i in range(600)] + [(None, 1)]
    right = [(0 if i % 10 else i, i) for i in range(500)] + [(None, 2)]
    l, r = spark.createDataFrame(left, "k long, a long"), spark.createDataFrame(right, "k long, b long")
    got = numeric.balanced_join(l, r, ["k"], ["a"], ["b"], 50)
    want = l.join(r, "k")
    assert got.columns == want.columns and got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_crowded_cell(spark):
    """Half of all POIs and anchors at one place: the same pairs as without splitting, and no part over twice the median."""
    rng = random.Random(11)
    pts = [(i, 34.7 if i % 2 else rng.uniform(34.6, 34.8), 135.5 if i % 2 else rng.uniform(135.4, 135.6)) for i in range(800)]
    anchors = spark.createDataFrame(pts[:300], "case_id long, a_lat double, a_lon double")
    pois = spark.createDataFrame(pts, "poi_id long, lat double, lon double")
    split, whole = geo.radius_join(anchors, pois, 1.0, most=20), geo.radius_join(anchors, pois, 1.0)
    pairs = lambda df: sorted((r.case_id, r.poi_id, round(r.distance_km, 9)) for r in df.collect())
    assert pairs(split) == pairs(whole) and len(pairs(whole)) > 150 * 400
    keys = ["_cy"]
    hot = numeric.balanced_join(anchors.withColumn("_cy", F.floor("a_lat")), pois.withColumn("_cy", F.floor("lat")), keys, ["case_id"], ["poi_id"], 20)
    assert hot.count() == 300 * 800


def test_search_without_items_or_queries(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "poi_id long, vec array<double>")
    queries = spark.createDataFrame([(5, [1.0, 1.0]), (6, None)], "case_id long, vec array<double>")
    assert vectors.top_items(queries, items.where("poi_id = 2"), 3).count() == 0
    assert vectors.top_items(queries.where("false"), items, 3).count() == 0
    assert [(r.case_id, r.poi_id, r["rank"]) for r in vectors.top_items(queries, items, 3).collect()] == [(5, 1, 1)]
