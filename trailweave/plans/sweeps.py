"""Parameter sweeps: a grid crossed with the cases, all trials in one job; best by (nDCG, MRR)."""
from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, functions as F

from trailweave.functions.numeric import attach, by_score, draw, r9, top_per_group
from trailweave.operators import engines as eng
from trailweave.operators import features, fusion, metrics, routes, splits
from trailweave.operators import transitions as tr
from trailweave.operators.splits import Cases
from trailweave.plans import evaluation as ev
from trailweave.session import materialize

# Default search spaces and the weights of the route objective.
MARKOV_GRID = {"backoff": [0.3, 0.35, 0.45], "hub_alpha": [0.0, 0.5]}
EMBED_GRID = {"context_n": [1, 2, 3], "topn": [500, 1000, 2000], "hub_alpha": [0.0, 0.2, 0.5]}
ALS_GRID = {"rank": [64, 128], "reg": [0.01], "iterations": [15], "alpha": [40.0]}
ROUTE_GRID = {"candidate_pool": [300, 600, 1000], "pair_min_km": [0.15, 0.22, 0.30], "distance_weight": [0.2, 0.35, 0.5],
              "diversity_bonus": [0.0, 0.06, 0.1], "max_per_category": [1, 2, 3]}
OBJECTIVE = {"cat_match_ratio": 0.45, "unique_cat_ratio": 0.35, "pct_legs_too_close": -0.50, "pct_legs_too_far": -0.50}


def combos(grid: dict) -> list[dict]:
    return [dict(zip(grid, values)) for values in itertools.product(*grid.values())]


def trial_array(trials: list[dict]) -> Column:
    """The grid as an array literal; exploding it crosses each row with every trial."""
    return F.array(*[F.struct(F.lit(i).alias("trial"), *[F.lit(v).alias(k) for k, v in t.items()]) for i, t in enumerate(trials)])


def sample(c: Cases, n: int | None, seed: int = 42, per: str | None = None) -> Cases:
    """A seeded sample of n cases (of each value of ``per``, a column of the cases), with the rows that belong to them."""
    if n is None:
        return c
    if per:
        drawn = splits.sample_cases(c.cases.select("case_id", per), "case_id", seed, None)
        keep = materialize(top_per_group(drawn, [per], [F.col("draw"), F.col("case_id")], n).select("case_id"))
    else:
        keep = materialize(splits.sample_cases(c.cases.select("case_id"), "case_id", seed, n).select("case_id"))
    cut = lambda df: df.join(keep, "case_id", "left_semi")
    return Cases(cut(c.cases), cut(c.history), cut(c.seen), cut(c.truth), c.all_cases).materialize()


def tuner_seen(c: Cases) -> DataFrame:
    """History, current and previous POI of each case."""
    both = c.cases.select("case_id", F.explode(F.array("current_poi", "prev_poi")).alias("poi_id")).where("poi_id IS NOT NULL")
    return c.history.select("case_id", "poi_id").unionByName(both).distinct()


def trial_metrics(scores: DataFrame, c: Cases, k: int) -> DataFrame:
    """(trial, hit, mrr, ndcg, recall): means over all cases, a case without scores counting as zero."""
    keys = ["trial", "case_id"]
    recs = top_per_group(scores, keys, by_score(), k)
    return trial_means(metrics.rank_metrics(recs, c.truth, k, keys), c)


def trial_means(per: DataFrame, c: Cases) -> DataFrame:
    """The means of ``trial_metrics`` from rows (trial, case_id, metrics...) of the cases that have a list."""
    names = ["hit", "mrr", "ndcg", "recall"]
    total = c.cases.agg(F.count("*").alias("_n"))
    return per.groupBy("trial").agg(*[F.sum(m).alias(m) for m in names]).join(F.broadcast(total), F.lit(True)).select("trial", *[(F.col(m) / F.col("_n")).alias(m) for m in names])


def with_trials(results: DataFrame, trials: list[dict]) -> DataFrame:
    spark = results.sparkSession
    cols = list(trials[0])
    table = spark.createDataFrame([(i, *t.values()) for i, t in enumerate(trials)], ["trial", *cols]).withColumn("trial", F.col("trial").cast("int"))
    return F.broadcast(table).join(results, "trial")


def best_trial(results: DataFrame) -> DataFrame:
    return results.orderBy(r9("ndcg").desc(), r9("mrr").desc(), "trial").limit(1)


def sweep_markov(c: Cases, train: DataFrame, pois: DataFrame, k: int = 20, topn: int = 150, grid: dict | None = None) -> DataFrame:
    """One row per (backoff, hub_alpha) with mean metrics.

    Transitions are joined once, and whatever a candidate needs (seen, known, its visits, whether it is true) is looked up once. Then a case's
    candidates lie in one partition, where the trials are ranked and measured, so nothing that is multiplied by them is shuffled.
    """
    trials = combos(grid or MARKOV_GRID)
    t1, t2 = tr.transitions_poi(train), tr.transitions_order2(train)
    one = c.cases.join(t1.select(F.col("a").alias("current_poi"), F.col("b").alias("poi_id"), F.col("p").alias("p1")), "current_poi").select("case_id", "poi_id", "p1", F.lit(0.0).alias("p2"))
    two = c.cases.join(t2.select(F.col("p").alias("prev_poi"), F.col("a").alias("current_poi"), F.col("b").alias("poi_id"), "p2"), ["prev_poi", "current_poi"]).select("case_id", "poi_id", F.lit(0.0).alias("p1"), "p2")
    both = one.unionByName(two).groupBy("case_id", "poi_id").agg(F.sum("p1").alias("p1"), F.sum("p2").alias("p2"))
    marks = tuner_seen(c).select("case_id", "poi_id", F.lit(1).alias("_seen"), F.lit(0).alias("_true")).unionByName(
        c.truth.select("case_id", "poi_id", F.lit(0).alias("_seen"), F.lit(1).alias("_true"))).groupBy("case_id", "poi_id").agg(F.max("_seen").alias("_seen"), F.max("_true").alias("_true"))
    known = pois.select("poi_id", F.lit(True).alias("_known")).distinct().join(features.item_counts(train), "poi_id", "left")
    marked = both.join(marks, ["case_id", "poi_id"], "left").join(known, "poi_id", "left").select(
        "case_id", "poi_id", "p1", "p2", F.coalesce("n_visits", F.lit(1)).cast("double").alias("_n"), (F.coalesce("_true", F.lit(0)) == 1).alias("_true"),
        (F.coalesce("_known", F.lit(False)) & (F.coalesce("_seen", F.lit(0)) == 0)).alias("_free"))
    # each task multiplies its rows by the trials, so there are as many times more tasks
    parts = int(c.cases.sparkSession.conf.get("spark.sql.shuffle.partitions")) * len(trials)
    rows = marked.repartition(parts, "case_id").select("case_id", "poi_id", "_n", "_true", "_free", "p1", "p2", F.explode(trial_array(trials)).alias("t")).select(
        "case_id", "poi_id", "_n", "_true", "_free", "t.trial", "t.hub_alpha", r9((1 - F.col("t.backoff")) * F.col("p2") + F.col("t.backoff") * F.col("p1")).alias("score"))
    keys, a = ["case_id", "trial"], F.col("hub_alpha")
    kept = top_per_group(rows, keys, by_score(), topn).drop("rank").where("_free")
    scored = kept.withColumn("score", r9(F.when(a > 0, F.col("score") / F.pow("_n", a)).otherwise(F.col("score"))))
    at, hit = F.col("rank"), F.col("_true")
    lists = top_per_group(scored, keys, by_score(), k).groupBy(*keys).agg(
        F.count_if(hit).alias("_hits"), F.min(F.when(hit, at)).alias("_first"), F.coalesce(F.sum(F.when(hit, 1.0 / F.log2(at + 1.0))), F.lit(0.0)).alias("_dcg"))
    sizes = c.truth.groupBy("case_id").agg(F.count("*").alias("_t"))
    per = metrics.from_hits(lists.join(sizes, "case_id", "left"), keys, k)
    return with_trials(trial_means(per, c), trials)


def sweep_embed_score(c: Cases, train: DataFrame, pois: DataFrame, vectors: DataFrame, k: int = 20, grid: dict | None = None) -> DataFrame:
    """One row per (context_n, topn, hub_alpha); neighbours are searched once per context length."""
    g = grid or EMBED_GRID
    trials = combos(g)
    recent = c.cases.select("case_id", "user_id").join(tr.user_history(train), "user_id").select("case_id", "pos", "poi_id")
    near = None
    for n in g["context_n"]:
        ctx = tr.last_n_rows(recent, c.cases.select("case_id", "current_poi"), n).select("case_id", "poi_id")
        one = eng.embed_context(ctx, vectors, max(g["topn"])).withColumn("context_n", F.lit(n))
        near = one if near is None else near.unionByName(one)
    near = near.withColumn("_rank", F.row_number().over(_by_case("context_n")))
    rows = near.select("case_id", "poi_id", "score", F.col("context_n").alias("_c"), "_rank", F.explode(trial_array(trials)).alias("t")).where(
        (F.col("t.context_n") == F.col("_c")) & (F.col("_rank") <= F.col("t.topn"))).select("case_id", "poi_id", "score", "t.trial", "t.hub_alpha")
    kept = eng.exclude(rows, tuner_seen(c)).join(pois.select("poi_id"), "poi_id", "left_semi")
    scored = eng.hub_penalty(kept, features.item_counts(train), "hub_alpha").withColumn("score", r9("score"))
    return with_trials(trial_metrics(scored.select("trial", "case_id", "poi_id", "score"), c, k), trials)


def _by_case(extra: str):
    from pyspark.sql import Window as W

    return W.partitionBy("case_id", extra).orderBy(F.col("score").desc(), "poi_id")


def sweep_als(c: Cases, train: DataFrame, pois: DataFrame, k: int = 20, grid: dict | None = None, max_trials: int | None = None, topn: int = 1200) -> DataFrame:
    """One row per ALS setting; models are fitted one after the other, scored and measured together."""
    trials = combos(grid or ALS_GRID)[:max_trials]
    inter = materialize(features.interactions(train))
    scored = None
    for i, t in enumerate(trials):
        users, items = eng.train_als(inter, t["rank"], t["reg"], t["iterations"], t["alpha"])
        one = eng.als_score(c.cases, c.history, users, items, topn).withColumn("trial", F.lit(i))
        scored = one if scored is None else scored.unionByName(one)
    kept = eng.exclude(scored, tuner_seen(c)).join(pois.select("poi_id"), "poi_id", "left_semi")
    return with_trials(trial_metrics(kept.select("trial", "case_id", "poi_id", r9("score").alias("score")), c, k), trials)


def weight_trials(spark, base: list[float], trials: int, jitter: float = 0.12, seed: int = 42) -> DataFrame:
    """(trial, weights): the base vector, then jittered, clipped and renormalised copies."""
    rows = spark.range(trials).select(F.col("id").cast("int").alias("trial"))
    parts = [
        F.greatest(F.lit(0.0), F.lit(float(v)) + (draw(seed, F.lit("w"), F.col("trial"), F.lit(i)) / float(1 << 32) * 2 - 1) * jitter)
        for i, v in enumerate(base)]
    raw = F.array(*parts)
    total = F.aggregate(raw, F.lit(0.0), lambda s, x: s + x)
    scaled = F.transform(raw, lambda x: x / F.when(total > 0, total).otherwise(F.lit(1.0)))
    return rows.select("trial", F.when(F.col("trial") == 0, F.array(*[F.lit(float(v)) for v in base])).otherwise(scaled).alias("weights"))


def fused_rows(c: Cases, s: ev.Scored, k: int) -> DataFrame:
    """Engine rows of the cases, seen POIs left out first and each engine scaled to one afterwards."""
    lower = s.sparse.where("score < 0").groupBy("case_id").agg(F.countDistinct("poi_id").alias("more"))
    best = eng.content_top_k(s.reach, c.seen, s.sig_of, k, more=lower)
    ids = s.sparse.select("case_id", "poi_id", "sig").unionByName(best.select("case_id", "poi_id", "sig")).distinct()
    rows = s.sparse.unionByName(s.content_rows(ids)).select("case_id", "engine", "poi_id", "score")
    rows = attach(rows, ["case_id", "engine"], F.max("score").alias("_m")).where("_m > 0")
    return rows.withColumn("score", F.col("score") / F.col("_m")).drop("_m")


def sweep_hybrid(c: Cases, train: DataFrame, pois: DataFrame, cats: DataFrame, k: int = 20, trials: int = 25, base: list[float] | None = None, item_vectors: DataFrame | None = None,
                 als: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(trial, weights, metrics): engine scores once, then every weight vector."""
    p = ev.EvalParams(k=k, backoff=0.35, markov_topn=150)
    s = ev.engine_scores(c, train, pois, cats, p, item_vectors, als)
    weights = F.broadcast(weight_trials(train.sparkSession, base or fusion.WEIGHTS["trail_current"], trials))
    # the trial table is a small generated grid: its weights ride on every row as one array
    grid = weights.agg(F.collect_list(F.struct("trial", "weights")).alias("_grid"))
    rows = materialize(fused_rows(c, s, k)).join(F.broadcast(grid), F.lit(True)).select("case_id", "engine", "poi_id", "score", F.explode("_grid").alias("t"))
    scored = rows.groupBy(F.col("t.trial").alias("trial"), "case_id", "poi_id").agg(r9(F.sum(F.col("score") * fusion.weight_of(F.col("t.weights"), F.col("engine")))).alias("score"))
    return weights.join(trial_metrics(scored, c, k), "trial")


def route_objective() -> Column:
    out = F.lit(0.0)
    for name, w in OBJECTIVE.items():
        out = out + F.lit(w) * F.col(name)
    return out


def sweep_route(c: Cases, train: DataFrame, pois: DataFrame, cats: DataFrame, k: int = 8, max_trials: int | None = None, seed: int = 42, grid: dict | None = None,
                item_vectors: DataFrame | None = None, als: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """One row per planner setting with mean route metrics and the objective; candidates are scored once."""
    import hashlib

    every = combos(grid or ROUTE_GRID)
    every.sort(key=lambda t: hashlib.md5(f"{seed}:{sorted(t.items())}".encode()).hexdigest())
    trials = every[:max_trials]
    s = ev.engine_scores(c, train, pois, cats, ev.EvalParams(k=k, backoff=0.35, markov_topn=200), item_vectors, als)
    weights = c.cases.select("case_id", F.array(*[F.lit(x) for x in fusion.WEIGHTS["trail_current"]]).alias("weights"))
    largest = max(t["candidate_pool"] for t in trials)
    fused = fusion.weighted_sum(fused_rows(c, s, largest), weights)
    pool = materialize(top_per_group(fused, ["case_id"], by_score(), largest).drop("rank"))
    cands = pool.join(pois.select("poi_id", "lat", "lon", "primary_category"), "poi_id")
    base = routes.PlannerParams(k=k, distance_weight_no_anchor=None, max_leg_km_no_anchor=None)
    params = {i: routes.with_params(base, **t) for i, t in enumerate(trials)}
    planned = materialize(routes.plan_route(cands, base, ["trial", "case_id"], params))
    likes = routes.user_top_categories(c.history, pois, cats)
    m = routes.route_metrics(planned, ["trial", "case_id"], likes)
    mean = m.groupBy("trial").agg(F.count("*").alias("n_routes"), *[F.avg(x).alias(x) for x in routes.ROUTE_METRICS]).withColumn("objective", route_objective())
    return with_trials(mean, trials)


def sweep_summary(results: dict[str, tuple[DataFrame, list[str], str]]) -> DataFrame:
    """(parameter, value): the best setting of each sweep; per sweep its rows, parameter names and prefix."""
    out = None
    for _, (df, names, prefix) in results.items():
        best = best_trial(df)
        cells = F.array(*[F.struct(F.lit(f"{prefix}.{n}").alias("parameter"), F.col(n).cast("double").alias("value")) for n in names])
        one = best.select(F.explode(cells).alias("x")).select("x.*")
        out = one if out is None else out.unionByName(one)
    return out
