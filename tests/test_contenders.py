"""Lists of all modes from contenders, next to the same from every score."""
import random
from collections import defaultdict

from trailweave.operators import fusion
from trailweave.operators.splits import Cases
from trailweave.plans import evaluation as ev

K, RRF_K, POIS = 3, 2, 240


def tables(rng):
    sig = {p: 1 + p % 12 for p in range(POIS)}
    raw, seen, reach, history, cases = [], [], [], [], []
    for case in range(7):
        cases.append((case, "ALL", case, case if case % 2 else None, None))
        gone = set(rng.sample(range(POIS), 5 * case))
        seen += [(case, p) for p in gone]
        history += [(case, p, 1) for p in gone]
        for e, n in (("item", 90), ("markov", 2 + case), ("embed", 150), ("als", 0 if case == 3 else 60)):
            ids = rng.sample(range(POIS), n) + [POIS + 5]
            raw += [(case, e, p, rng.randint(1, 4) * 1.0 if e == "item" else rng.uniform(-1, 1) if case != 6 else rng.uniform(-9, 1), *(("ALL", sig[p]) if p in sig else (None, None))) for p in ids]
        if case != 5:
            near = {s: round(rng.uniform(0.1, 1), 9) for s in rng.sample(range(1, 13), 8)}
            for s, score in near.items():
                n, ns = sum(v == s for v in sig.values()), sum(sig[p] == s for p in gone)
                reach.append((case, "ALL", s, score, n, ns, n - ns, max(near.values())))
    return sig, raw, seen, reach, history, cases


def plain(sig, raw, seen, reach, cases):
    """(case_id, mode, poi_id, rank) by scoring and sorting everything."""
    gone, out = set(seen), []
    for case, _, _, current, _ in cases:
        rows, top = defaultdict(dict), {}
        for c, e, p, score, scope, _ in raw:
            if c == case:
                top[e] = max(top.get(e, score), score)
        for c, e, p, score, scope, _ in raw:
            if c == case and top[e] > 0 and scope and (case, p) not in gone:
                rows[e][p] = score / top[e]
        cos = {s: score / t for c, _, s, score, *_, t in reach if c == case}
        if cos:
            rows["content"] = {p: cos.get(s, 0.0) for p, s in sig.items() if (case, p) not in gone}
        user = any(c == case for c, _ in seen)
        model = bool(rows["embed"] or rows["als"])
        name = "user_current" if user and current is not None else "user_only" if user else "current_only" if current is not None else "embed_or_als" if model else "cold_start"
        weights = dict(zip(fusion.ENGINES, fusion.WEIGHTS[name]))
        modes, places = {}, {}
        for e, own in rows.items():
            order = sorted(own, key=lambda p: (-own[p], sig[p] if e == "content" else 0, p))
            places[e] = {p: i for i, p in enumerate(order)}
            modes[e] = own
        ids = {p for own in rows.values() for p in own}
        modes["hybrid"] = {p: round(sum(weights[e] * own.get(p, 0.0) for e, own in rows.items()), 9) for p in ids}
        modes["rrf"] = {p: round(sum(1 / (RRF_K + places.get(e, {}).get(p, len(places.get(e, {}))) + 1) for e in fusion.ENGINES), 9) for p in ids}
        for mode, own in modes.items():
            out += [(case, mode, p, i + 1) for i, p in enumerate(sorted(own, key=lambda p: (-own[p], sig[p], p))[:K])]
    return out


def test_contenders_give_every_list_and_are_few(spark):
    sig, raw, seen, reach, history, cases = tables(random.Random(5))
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    c = Cases(df(cases, "case_id long, scope string, user_id long, current_poi long, prev_poi long"), df(history, "case_id long, poi_id long, n long"), df(seen, "case_id long, poi_id long"), None, None)
    sig_of = df([("ALL", p, s) for p, s in sig.items()], "scope string, poi_id long, sig long")
    s = ev.Scored(df(raw, "case_id long, engine string, poi_id long, score double, in_scope string, sig long"), c.cases, c.seen,
                  df(reach, "case_id long, scope string, sig long, score double, n_pois long, n_seen long, avail long, top double"), sig_of)
    p = ev.EvalParams(k=K, rrf_k=RRF_K, modes=["embed", "item", "markov", "als", "hybrid", "content", "rrf"])
    kept = []
    whole = ev.contenders
    ev.contenders = lambda *args: kept.append(whole(*args)) or kept[0]
    try:
        got = ev.recommend_modes(c, s, df([], "poi_id long, user_id long"), df([], "poi_id long"), p)
        assert sorted(map(tuple, got.collect())) == sorted(plain(sig, raw, seen, reach, cases))
    finally:
        ev.contenders = whole
    gone, scored = set(seen), [r for r in raw if r[3] == max(x[3] for x in raw if x[:2] == r[:2])]
    top = {r[:2]: r[3] for r in scored}
    want = sorted((c, e, p, score / top[c, e], g) for c, e, p, score, scope, g in raw if scope and (c, p) not in gone and top[c, e] > 0)
    assert sorted(map(tuple, s.sparse.select("case_id", "engine", "poi_id", "score", "sig").collect())) == want
    assert kept[0].count() < s.sparse.select("case_id", "poi_id").distinct().count() / 3
