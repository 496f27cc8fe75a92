"""Queries: splits, cases, metrics, offline evaluation and parameter sweeps."""
from __future__ import annotations

from pyspark.sql import functions as F

from trailweave.catalog.engines import _COOC, RANDOM_SQL, content_views, context_view, markov_view
from trailweave.catalog.oracle_views import add_view
from trailweave.catalog.registry import query, shared
from trailweave.functions.numeric import r6
from trailweave.operators import engines as eng
from trailweave.operators import features, metrics, splits
from trailweave.operators import transitions as tr
from trailweave.plans import evaluation as ev
from trailweave.session import materialize

K = 20

# ---------------------------------------------------------------- splits

_UO, _TO = "ts, trail_id, seq, poi_id, tie", "ts, seq, poi_id, tie"


def _tail_view(name, key, order, test, train):
    add_view(name, f"SELECT * EXCLUDE (pos, n), CASE WHEN pos > n - {test} THEN 'test' ELSE 'train' END AS part FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS pos, count(*) OVER (PARTITION BY {key}) AS n FROM v_visits) WHERE n >= {test + train}")


_tail_view("v_split_user", "user_id", _UO, 2, 1)
_tail_view("v_split_trail", "trail_id", _TO, 1, 2)
add_view("v_split_last", """
WITH t AS (SELECT user_id, trail_id, max(ts) AS e, count(*) AS n FROM v_visits GROUP BY 1, 2),
u AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY e DESC, trail_id DESC) AS rn, sum(n) OVER (PARTITION BY user_id) AS total, count(*) OVER (PARTITION BY user_id) AS k FROM t)
SELECT v.*, CASE WHEN u.trail_id IS NULL THEN 'train' ELSE 'test' END AS part FROM v_visits v LEFT JOIN u ON u.user_id = v.user_id AND u.trail_id = v.trail_id AND u.rn = 1 AND u.k >= 2 AND u.n >= 4 AND u.total - u.n >= 2""")

SPLIT_COLS = ["trail_id", "user_id", "poi_id", "seq", "tie", "part"]


@query("split_user", "SELECT trail_id, user_id, poi_id, seq, tie, part FROM v_split_user")
def split_user(t):
    return splits.split_user(t.visits, 2, 1).select(*SPLIT_COLS)


@query("split_trail", "SELECT trail_id, user_id, poi_id, seq, tie, part FROM v_split_trail")
def split_trail(t):
    return splits.split_trail(t.visits, 1, 2).select(*SPLIT_COLS)


@query("split_last_trail", "SELECT trail_id, user_id, poi_id, seq, tie, part FROM v_split_last")
def split_last_trail(t):
    return splits.split_last_trail(t.visits, 2, 4).select(*SPLIT_COLS)


# ---------------------------------------------------------------- cases

def _case_views(p, split, key, order, drop_seen, last_trail=False):
    add_view(f"{p}_train", f"SELECT * FROM {split} WHERE part = 'train'")
    if last_trail:
        add_view(f"{p}_base", f"""SELECT user_id AS case_id, user_id, arg_min(poi_id, {{'a': ts, 'b': seq, 'c': poi_id, 'd': tie}}) AS current_poi, CAST(NULL AS BIGINT) AS prev_poi FROM {split} WHERE part = 'test' AND user_id IN (SELECT user_id FROM {p}_train) GROUP BY user_id HAVING count(*) >= 2""")
        add_view(f"{p}_seen0", f"SELECT DISTINCT user_id AS case_id, poi_id FROM {p}_train UNION SELECT case_id, current_poi FROM {p}_base")
    else:
        desc = ", ".join(c + " DESC" for c in order.split(", "))
        add_view(f"{p}_base", f"""SELECT {key} AS case_id, max(user_id) AS user_id, max(poi_id) FILTER (WHERE b = 1) AS current_poi, max(poi_id) FILTER (WHERE b = 2) AS prev_poi FROM
 (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {desc}) AS b FROM {p}_train) GROUP BY 1""")
        add_view(f"{p}_seen0", f"SELECT DISTINCT {key} AS case_id, poi_id FROM {p}_train")
    cond = f"AND NOT EXISTS (SELECT 1 FROM {p}_seen0 s WHERE s.case_id = t.{key} AND s.poi_id = t.poi_id)" if drop_seen else ""
    add_view(f"{p}_truth", f"SELECT DISTINCT {key} AS case_id, poi_id FROM {split} t WHERE part = 'test' AND {key} IN (SELECT case_id FROM {p}_base) {cond}")
    add_view(f"{p}_case", f"SELECT * FROM {p}_base WHERE case_id IN (SELECT case_id FROM {p}_truth)")
    add_view(f"{p}_seen", f"SELECT * FROM {p}_seen0 WHERE case_id IN (SELECT case_id FROM {p}_case)")
    add_view(f"{p}_hist", f"SELECT c.case_id, t.poi_id, count(*) AS n FROM {p}_case c JOIN {p}_train t ON t.user_id = c.user_id GROUP BY 1, 2")


_case_views("v_cu", "v_split_user", "user_id", _UO, True)
_case_views("v_ct", "v_split_trail", "trail_id", _TO, False)
_case_views("v_cl", "v_split_last", "user_id", _UO, True, last_trail=True)


def _case_sql(p):
    return f"""
SELECT c.case_id, c.user_id, c.current_poi, c.prev_poi, h.n AS n_history, s.n AS n_seen, t.n AS n_truth, t.first_truth FROM {p}_case c JOIN (SELECT case_id, CAST(sum(n) AS BIGINT) AS n FROM {p}_hist GROUP BY 1) h USING (case_id)
JOIN (SELECT case_id, count(*) AS n FROM {p}_seen GROUP BY 1) s USING (case_id) JOIN (SELECT case_id, count(*) AS n, min(poi_id) AS first_truth FROM {p}_truth GROUP BY 1) t USING (case_id)"""


def _case_rows(c):
    h = c.history.groupBy("case_id").agg(F.sum("n").alias("n_history"))
    s = c.seen.groupBy("case_id").agg(F.count("*").alias("n_seen"))
    tt = c.truth.groupBy("case_id").agg(F.count("*").alias("n_truth"), F.min("poi_id").alias("first_truth"))
    return c.cases.drop("scope").join(h, "case_id").join(s, "case_id").join(tt, "case_id")


def user_cases(t):
    return splits.cases_user(splits.split_user(t.visits, 2, 1))


@shared
def last_trail_cases(t):
    split = materialize(splits.split_last_trail(t.visits, 2, 4))
    return splits.cases_last_trail(split).materialize(), split.where("part = 'train'").drop("part")


@shared
def trail_cases(t):
    split = materialize(splits.split_trail(t.visits, 1, 2))
    return splits.cases_trail(split, False).materialize(), split.where("part = 'train'").drop("part")


@query("cases_user", _case_sql("v_cu"))
def cases_user(t):
    return _case_rows(user_cases(t))


@query("cases_trail", _case_sql("v_ct"))
def cases_trail(t):
    return _case_rows(trail_cases(t)[0])


@query("cases_last_trail", _case_sql("v_cl"))
def cases_last_trail(t):
    return _case_rows(last_trail_cases(t)[0])


@query("cases_skipped", """
SELECT case_id, user_id, current_poi FROM v_ct_base b WHERE NOT EXISTS (SELECT 1 FROM v_ct_truth t WHERE t.case_id = b.case_id AND NOT EXISTS (SELECT 1 FROM v_ct_seen0 s WHERE s.case_id = t.case_id AND s.poi_id = t.poi_id))""")
def cases_skipped(t):
    return splits.cases_trail(splits.split_trail(t.visits, 1, 2)).skipped.select("case_id", "user_id", "current_poi")


# ---------------------------------------------------------------- metrics

add_view("v_primary", "SELECT poi_id, primary_category AS category FROM v_pois")


def metric_views(p, recs, truth, counts, keys="case_id, mode"):
    """Check views of every list metric for recs (case_id, mode, poi_id, rank)."""
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    add_view(f"{p}_rm", f"""
SELECT {keys}, CASE WHEN sum(h) > 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS hit, sum(h) / {K}.0 AS precision, COALESCE(sum(h) / any_value(nt), 0) AS recall, COALESCE(1.0 / min(CASE WHEN h = 1 THEN rank END), 0) AS mrr,
 COALESCE(sum(h / log2(rank + 1)) / (SELECT sum(1 / log2(i + 1)) FROM range(1, 21) r(i) WHERE i <= least(any_value(nt), {K})), 0) AS ndcg
FROM (SELECT r.*, CASE WHEN t.poi_id IS NULL THEN 0 ELSE 1 END AS h, n.nt FROM {recs} r LEFT JOIN {truth} t ON t.case_id = r.case_id AND t.poi_id = r.poi_id LEFT JOIN (SELECT case_id, count(*) AS nt FROM {truth} GROUP BY 1) n ON n.case_id = r.case_id) GROUP BY {keys}""")
    add_view(f"{p}_cm", f"""
SELECT {keys}, CASE WHEN sum(h) > 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS cat_hit, sum(h) / {K}.0 AS cat_precision, COALESCE(sum(h) / any_value(nt), 0) AS cat_recall,
 COALESCE(sum(h / log2(rank + 1)) / (SELECT sum(1 / log2(i + 1)) FROM range(1, 21) r(i) WHERE i <= least(any_value(nt), {K})), 0) AS cat_ndcg
FROM (SELECT r.*, n.nt, CASE WHEN t.category IS NOT NULL AND row_number() OVER (PARTITION BY {", ".join("r." + k for k in keys.split(", "))}, p.category ORDER BY rank) = 1 THEN 1 ELSE 0 END AS h FROM {recs} r LEFT JOIN v_primary p ON p.poi_id = r.poi_id
 LEFT JOIN (SELECT DISTINCT case_id, category FROM {truth} JOIN v_primary USING (poi_id)) t ON t.case_id = r.case_id AND t.category = p.category
 LEFT JOIN (SELECT case_id, count(DISTINCT category) AS nt FROM {truth} JOIN v_primary USING (poi_id) GROUP BY 1) n ON n.case_id = r.case_id) GROUP BY {keys}""")
    add_view(f"{p}_nd", f"""
SELECT {keys}, avg(-log2((COALESCE(c.n_visits, 0) + 1.0) / d.d) / log2(d.d)) AS novelty, count(DISTINCT COALESCE(p.category, '__unknown__')) / count(*) AS diversity FROM {recs} r LEFT JOIN {counts} c USING (poi_id) LEFT JOIN v_primary p USING (poi_id)
 CROSS JOIN (SELECT CAST(sum(n_visits) + count(*) AS DOUBLE) AS d FROM {counts}) d GROUP BY {keys}""")
    add_view(f"{p}_all", f"SELECT a.*, b.* EXCLUDE ({keys}), c.* EXCLUDE ({keys}) FROM {p}_rm a JOIN {p}_cm b ON {on} JOIN {p}_nd c ON {on.replace('b.', 'c.')}")


# lists of the popularity baseline for the user protocol
add_view("v_cu_counts", "SELECT poi_id, count(*) AS n_visits FROM v_cu_train GROUP BY 1")
add_view("v_cu_recs", """
SELECT case_id, 'popular' AS mode, poi_id, rank FROM (SELECT c.case_id, p.poi_id, row_number() OVER (PARTITION BY c.case_id ORDER BY COALESCE(n.n_visits, 0) DESC, p.poi_id) AS rank FROM v_cu_case c CROSS JOIN v_pois p LEFT JOIN v_cu_counts n ON n.poi_id = p.poi_id
 WHERE NOT EXISTS (SELECT 1 FROM v_cu_seen s WHERE s.case_id = c.case_id AND s.poi_id = p.poi_id)) WHERE rank <= 20""")
metric_views("v_cum", "v_cu_recs", "v_cu_truth", "v_cu_counts")


@shared
def _popular_lists(t):
    split = materialize(splits.split_user(t.visits, 2, 1))
    c = splits.cases_user(split).materialize()
    train = split.where("part = 'train'")
    counts = features.item_counts(train)
    recs = eng.popular(c.cases, c.seen, ev.scoped_pois(t.pois), counts, K).select("case_id", F.lit("popular").alias("mode"), "poi_id", "rank")
    return c, recs, counts


def _r(names):
    return ", ".join(f"round(CAST({n} AS DOUBLE), 6) AS {n}" for n in names)


@query("rank_metrics", f"SELECT case_id, {_r(metrics.RANK_METRICS)} FROM v_cum_rm")
def rank_metrics(t):
    c, recs, _ = _popular_lists(t)
    return metrics.rank_metrics(recs, c.truth, K).select("case_id", *[r6(m).alias(m) for m in metrics.RANK_METRICS])


@query("category_metrics", f"SELECT case_id, {_r(metrics.CATEGORY_METRICS)} FROM v_cum_cm")
def category_metrics(t):
    c, recs, _ = _popular_lists(t)
    primary = metrics.poi_primary_map(t.pois, t.poi_categories)
    return metrics.category_metrics(recs, c.truth, primary, K).select("case_id", *[r6(m).alias(m) for m in metrics.CATEGORY_METRICS])


@query("poi_primary_map", """
SELECT p.poi_id, COALESCE(CASE WHEN p.rating IS NOT NULL THEN p.primary_category END, c.category_name) AS category FROM v_pois p LEFT JOIN v_poi_categories c ON c.poi_id = p.poi_id AND c.ord = 0""")
def poi_primary_map(t):
    holes = t.pois.withColumn("primary_category", F.when(F.col("rating").isNull(), "None").otherwise(F.col("primary_category")))
    return metrics.poi_primary_map(holes, t.poi_categories)


@query("novelty", "SELECT case_id, round(novelty, 6) AS novelty FROM v_cum_nd")
def novelty(t):
    _, recs, counts = _popular_lists(t)
    return metrics.novelty(recs, counts).withColumn("novelty", r6("novelty"))


@query("diversity", "SELECT case_id, round(diversity, 6) AS diversity FROM v_cum_nd")
def diversity(t):
    _, recs, _ = _popular_lists(t)
    return metrics.diversity(recs, metrics.poi_primary_map(t.pois, t.poi_categories)).withColumn("diversity", r6("diversity"))


# ---------------------------------------------------------------- evaluation of all modes

def mode_views(p):
    """Dense check views of every mode for the cases of one protocol, features on its training visits."""
    add_view(f"{p}_counts", f"SELECT poi_id, count(*) AS n_visits FROM {p}_train GROUP BY 1")
    add_view(f"{p}_cooc", _COOC.format(v=f"{p}_train"))
    add_view(f"{p}_leads", f"SELECT poi_id, lead(poi_id) OVER (w) AS nx, lead(poi_id, 2) OVER (w) AS nx2 FROM {p}_train WINDOW w AS (PARTITION BY trail_id ORDER BY ts, seq, poi_id, tie)")
    add_view(f"{p}_tr1", f"SELECT a, b, n / sum(n) OVER (PARTITION BY a) AS p FROM (SELECT poi_id AS a, nx AS b, count(*) AS n FROM {p}_leads WHERE nx IS NOT NULL GROUP BY 1, 2)")
    add_view(f"{p}_tr2", f"SELECT p, a, b, n / sum(n) OVER (PARTITION BY p, a) AS p2 FROM (SELECT poi_id AS p, nx AS a, nx2 AS b, count(*) AS n FROM {p}_leads WHERE nx2 IS NOT NULL GROUP BY 1, 2, 3)")
    content_views(p, f"{p}_case", f"{p}_hist", f"{p}_seen")
    markov_view(f"{p}_mk", f"{p}_case", f"{p}_tr1", f"{p}_tr2")
    # embeddings: the mean of the last three of training and current POI, else the neighbours of the current POI, else sums over the history's
    add_view(f"{p}_recent", f"SELECT c.case_id, t.poi_id, row_number() OVER (PARTITION BY c.case_id ORDER BY t.ts, t.trail_id, t.seq, t.poi_id, t.tie) AS pos FROM {p}_case c JOIN {p}_train t ON t.user_id = c.user_id")
    add_view(f"{p}_ctx", f"""
SELECT case_id, poi_id FROM (SELECT case_id, poi_id, row_number() OVER (PARTITION BY case_id ORDER BY pos DESC) AS back FROM
 (SELECT r.* FROM {p}_recent r JOIN {p}_case c USING (case_id) WHERE c.current_poi IS NULL OR r.poi_id <> c.current_poi UNION ALL SELECT case_id, current_poi, 9000000000 FROM {p}_case WHERE current_poi IS NOT NULL)) WHERE back <= 3""")
    add_view(f"{p}_ctx2", f"SELECT * FROM {p}_ctx WHERE case_id IN (SELECT case_id FROM {p}_ctx GROUP BY case_id HAVING count(*) >= 2)")
    add_view(f"{p}_next", f"""
SELECT case_id, current_poi AS poi_id FROM {p}_case WHERE current_poi IN (SELECT poi_id FROM v_unit) AND case_id NOT IN (SELECT case_id FROM {p}_ctx2)
UNION ALL SELECT case_id, poi_id FROM (SELECT r.case_id, r.poi_id, row_number() OVER (PARTITION BY r.case_id ORDER BY r.pos DESC) AS back FROM {p}_recent r JOIN {p}_case c USING (case_id) WHERE c.current_poi IS NOT NULL AND c.current_poi NOT IN (SELECT poi_id FROM v_unit)
 AND r.poi_id IN (SELECT poi_id FROM v_unit) AND case_id NOT IN (SELECT case_id FROM {p}_ctx2)) WHERE back <= 3""")
    context_view(f"{p}_emb_ctx", f"{p}_ctx2", 2000)
    context_view(f"{p}_emb_next", f"{p}_next", 2000)
    add_view(f"{p}_embed", f"""
SELECT case_id, poi_id, score FROM {p}_emb_ctx UNION ALL SELECT case_id, poi_id, score FROM {p}_emb_next
UNION ALL SELECT c.case_id, n.b, round(sum(n.score), 9) FROM {p}_case c JOIN {p}_hist h USING (case_id) JOIN v_near_all n ON n.a = h.poi_id
 WHERE c.current_poi IS NULL AND c.case_id NOT IN (SELECT case_id FROM {p}_ctx2) AND NOT EXISTS (SELECT 1 FROM {p}_hist x WHERE x.case_id = c.case_id AND x.poi_id = n.b) GROUP BY 1, 2""")
    add_view(f"{p}_als_user", f"""
SELECT c.case_id, v.vec FROM {p}_case c JOIN v_user_vectors v USING (user_id)
UNION ALL SELECT case_id, list(m ORDER BY d) FROM (SELECT case_id, d, sum(n * x) / sum(n) AS m FROM (SELECT h.case_id, h.n, unnest(v.vec) AS x, unnest(range(1, len(v.vec) + 1)) AS d FROM {p}_hist h JOIN v_item_vectors v USING (poi_id)
 WHERE h.case_id NOT IN (SELECT c.case_id FROM {p}_case c JOIN v_user_vectors u USING (user_id))) GROUP BY 1, 2) GROUP BY 1""")
    add_view(f"{p}_als", f"""
SELECT case_id, poi_id, score FROM (SELECT s.*, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, poi_id) AS rn FROM (SELECT u.case_id, i.poi_id, round(list_dot_product(u.vec, i.vec), 9) AS score FROM {p}_als_user u CROSS JOIN v_item_vectors i) s
 WHERE NOT EXISTS (SELECT 1 FROM {p}_hist h WHERE h.case_id = s.case_id AND h.poi_id = s.poi_id)) WHERE rn <= 500""")
    add_view(f"{p}_sparse", f"""
WITH i AS (SELECT h.case_id, c.b AS poi_id, CAST(sum(c.n) AS DOUBLE) AS score FROM {p}_hist h JOIN {p}_cooc c ON c.a = h.poi_id WHERE NOT EXISTS (SELECT 1 FROM {p}_hist x WHERE x.case_id = h.case_id AND x.poi_id = c.b) GROUP BY 1, 2),
m AS (SELECT k.case_id, k.poi_id, k.score / sqrt(COALESCE(c.n_visits, 1)) AS score FROM {p}_mk k LEFT JOIN {p}_counts c USING (poi_id)),
e AS (SELECT 'item' AS engine, * FROM i UNION ALL SELECT 'markov', * FROM m UNION ALL SELECT 'embed', * FROM {p}_embed UNION ALL SELECT 'als', * FROM {p}_als),
g AS (SELECT *, max(score) OVER (PARTITION BY engine, case_id) AS top FROM e),
n AS (SELECT case_id, engine, poi_id, score / top AS score FROM g WHERE top > 0)
SELECT n.*, v_sig.sig FROM n JOIN v_sig USING (poi_id) WHERE NOT EXISTS (SELECT 1 FROM {p}_seen s WHERE s.case_id = n.case_id AND s.poi_id = n.poi_id)""")
    add_view(f"{p}_long", f"SELECT case_id, engine, poi_id, score, sig FROM {p}_sparse UNION ALL SELECT case_id, 'content', poi_id, norm, sig FROM {p}_content")
    add_view(f"{p}_modes", f"""
SELECT case_id, engine AS mode, poi_id, sig, score FROM {p}_long
UNION ALL SELECT case_id, 'hybrid', poi_id, sig, round(sum(score * CASE engine WHEN 'content' THEN 0.10 WHEN 'embed' THEN 0.05 WHEN 'als' THEN 0.55 ELSE 0.15 END), 9) FROM {p}_long GROUP BY 1, 3, 4
UNION ALL SELECT case_id, 'rrf', poi_id, sig, round(sum(1.0 / (30 + rk + 1) - 1.0 / (30 + size + 1)) + any_value(absent), 9) FROM
 (SELECT l.*, a.absent, count(*) OVER (PARTITION BY l.case_id, engine) AS size, row_number() OVER (PARTITION BY l.case_id, engine ORDER BY score DESC, CASE WHEN engine = 'content' THEN sig END, poi_id) - 1 AS rk FROM {p}_long l
  JOIN (SELECT case_id, sum(1.0 / (30 + size + 1)) + (5 - count(*)) / 31.0 AS absent FROM (SELECT case_id, engine, count(*) AS size FROM {p}_long GROUP BY 1, 2) GROUP BY 1) a ON a.case_id = l.case_id) GROUP BY 1, 3, 4""")
    add_view(f"{p}_recs", f"""
SELECT case_id, mode, poi_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY case_id, mode ORDER BY score DESC, sig, poi_id) AS rank FROM {p}_modes) WHERE rank <= 20
UNION ALL SELECT case_id, 'popular', poi_id, rank FROM (SELECT c.case_id, q.poi_id, row_number() OVER (PARTITION BY c.case_id ORDER BY COALESCE(n.n_visits, 0) DESC, q.poi_id) AS rank FROM {p}_case c CROSS JOIN v_pois q LEFT JOIN {p}_counts n ON n.poi_id = q.poi_id
 WHERE NOT EXISTS (SELECT 1 FROM {p}_seen s WHERE s.case_id = c.case_id AND s.poi_id = q.poi_id)) WHERE rank <= 20
UNION ALL SELECT case_id, 'random', poi_id, rank FROM ({RANDOM_SQL.format(case=f"{p}_case", seen=f"{p}_seen")})""")
    metric_views(f"{p}_m", f"{p}_recs", f"{p}_truth", f"{p}_counts")
    add_view(f"{p}_lists", f"SELECT m.*, CASE WHEN h.n < 5 THEN 'cold' ELSE 'warm' END AS user_group FROM {p}_m_all m JOIN (SELECT case_id, sum(n) AS n FROM {p}_hist GROUP BY 1) h USING (case_id)")


mode_views("v_cl")


@shared
def _recs(t):
    c, train = last_trail_cases(t)
    p = ev.EvalParams(k=K)
    s = ev.engine_scores(c, train, t.pois, t.poi_categories, p, t.item_vectors, (t.user_vectors, t.item_vectors))
    return c, train, materialize(ev.recommend_modes(c, s, train, t.pois, p))


@shared
def _lists(t):
    c, train, recs = _recs(t)
    return c, materialize(ev.eval_lists(c, recs, train, t.pois, t.poi_categories, K))


@query("recommend_modes", "SELECT case_id, mode, poi_id, rank FROM v_cl_recs")
def recommend_modes(t):
    return _recs(t)[2]


_LONG = " UNION ALL ".join(f"SELECT mode, user_group, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM v_cl_lists" for m in metrics.EVAL_METRICS)


@query("eval_modes", f"SELECT mode, metric, round(avg(value), 6) AS value, count(*) AS n_users FROM ({_LONG}) GROUP BY 1, 2")
def eval_modes(t):
    return ev.eval_modes(_lists(t)[1]).withColumn("value", r6("value"))


@query("cold_warm", f"SELECT mode, metric, user_group, round(avg(value), 6) AS value, count(*) AS n_users FROM ({_LONG}) GROUP BY 1, 2, 3")
def cold_warm(t):
    return ev.cold_warm(_lists(t)[1]).withColumn("value", r6("value"))


@query("metrics_pivot", "SELECT mode, " + ", ".join(f"round(avg(CAST({m} AS DOUBLE)), 6) AS {m}" for m in metrics.EVAL_METRICS) + " FROM v_cl_lists GROUP BY mode")
def metrics_pivot(t):
    out = metrics.metrics_pivot(ev.eval_modes(_lists(t)[1]))
    return out.select("mode", *[r6(m).alias(m) for m in metrics.EVAL_METRICS])


@query("eval_summary", """
SELECT count(DISTINCT case_id) AS cases_evaluated, count(DISTINCT case_id) FILTER (WHERE user_group = 'cold') AS cold_cases, count(DISTINCT case_id) FILTER (WHERE user_group = 'warm') AS warm_cases,
 (SELECT count(*) FROM v_cl_base WHERE case_id NOT IN (SELECT case_id FROM v_cl_case)) AS cases_skipped_all_truth_seen FROM v_cl_lists""")
def eval_summary(t):
    return ev.eval_summary(*_lists(t))


@query("scorer_callback", """
WITH r AS (SELECT case_id, 'x' AS mode, poi_id, rank FROM (SELECT c.case_id, t.b AS poi_id, row_number() OVER (PARTITION BY c.case_id ORDER BY round(t.p, 9) DESC, t.b) AS rank FROM v_cl_case c JOIN v_cl_tr1 t ON t.a = c.current_poi) WHERE rank <= 20),
h AS (SELECT r.*, CASE WHEN t.poi_id IS NULL THEN 0 ELSE 1 END AS h, n.nt FROM r LEFT JOIN v_cl_truth t ON t.case_id = r.case_id AND t.poi_id = r.poi_id LEFT JOIN (SELECT case_id, count(*) AS nt FROM v_cl_truth GROUP BY 1) n ON n.case_id = r.case_id),
m AS (SELECT case_id, CASE WHEN sum(h) > 0 THEN 1.0 ELSE 0.0 END AS hit, COALESCE(1.0 / min(CASE WHEN h = 1 THEN rank END), 0) AS mrr, sum(h) / any_value(nt) AS recall,
 COALESCE(sum(h / log2(rank + 1)) / (SELECT sum(1 / log2(i + 1)) FROM range(1, 21) q(i) WHERE i <= least(any_value(nt), 20)), 0) AS ndcg FROM h GROUP BY 1)
SELECT round(avg(CAST(COALESCE(hit, 0) AS DOUBLE)), 6) AS hit, round(avg(CAST(COALESCE(mrr, 0) AS DOUBLE)), 6) AS mrr, round(avg(COALESCE(ndcg, 0)), 6) AS ndcg, round(avg(COALESCE(recall, 0)), 6) AS recall, count(*) AS n_cases FROM v_cl_case LEFT JOIN m USING (case_id)""")
def scorer_callback(t):
    c, train = last_trail_cases(t)
    trans = tr.transitions_poi(train)
    out = ev.eval_callback(c, lambda cases: eng.markov1(cases.cases, trans, K).drop("rank"), K)
    return out.select(*[r6(m).alias(m) for m in ("hit", "mrr", "ndcg", "recall")], "n_cases")
