"""Queries: feature models and scoring engines."""
from __future__ import annotations

from pyspark.sql import functions as F

from trailweave.catalog.oracle_views import add_view
from trailweave.catalog.registry import query, shared
from trailweave.functions.numeric import r9
from trailweave.operators import engines as eng
from trailweave.operators import factors, features, splits
from trailweave.operators import transitions as tr
from trailweave.session import materialize

# ---------------------------------------------------------------- check views: features on all visits

add_view("v_sig", "SELECT poi_id, string_agg(category_name, '|' ORDER BY category_name) AS sig FROM v_poi_categories GROUP BY poi_id")
add_view("v_terms", r"""
SELECT poi_id, term, count(*) AS tf FROM (SELECT poi_id, unnest(regexp_extract_all(lower(category_name), '\w+')) AS term FROM v_poi_categories) GROUP BY poi_id, term""")
add_view("v_tfidf", """
SELECT poi_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY poi_id)) AS weight FROM
 (SELECT t.poi_id, t.term, t.tf * (ln((1 + (SELECT count(*) FROM v_pois)) / (1 + d.df)) + 1) AS raw FROM v_terms t JOIN (SELECT term, count(*) AS df FROM v_terms GROUP BY term) d USING (term))""")
add_view("v_counts", "SELECT poi_id, count(*) AS n_visits FROM v_visits GROUP BY poi_id")
_COOC = "SELECT a.poi_id AS a, b.poi_id AS b, count(*) AS n FROM (SELECT DISTINCT trail_id, poi_id FROM {v}) a JOIN (SELECT DISTINCT trail_id, poi_id FROM {v}) b ON a.trail_id = b.trail_id AND a.poi_id <> b.poi_id GROUP BY 1, 2"
add_view("v_cooc", _COOC.format(v="v_visits"))

# one case per user: all visits are history, current and previous POI are the last two visits
add_view("v_ucase", """
SELECT user_id AS case_id, user_id, max(poi_id) FILTER (WHERE b = 1) AS current_poi, max(poi_id) FILTER (WHERE b = 2) AS prev_poi FROM
 (SELECT user_id, poi_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, trail_id DESC, seq DESC, poi_id DESC, tie DESC) AS b FROM v_visits) GROUP BY user_id""")
add_view("v_uhist", "SELECT user_id AS case_id, poi_id, count(*) AS n FROM v_visits GROUP BY 1, 2")


def content_views(prefix: str, case: str, hist: str, seen: str) -> None:
    """Dense check views of the content engine for a set of cases."""
    add_view(f"{prefix}_prof", f"""
SELECT case_id, term, sum(share * weight) AS weight FROM (SELECT h.case_id, h.poi_id, h.n / sum(h.n) OVER (PARTITION BY h.case_id) AS share FROM {hist} h WHERE h.poi_id IN (SELECT poi_id FROM v_sig)) x JOIN v_tfidf USING (poi_id) GROUP BY case_id, term""")
    add_view(f"{prefix}_csim", f"""
SELECT p.case_id, t.poi_id, round(sum(p.weight * t.weight) / ((any_value(n.pn) + 1e-8) * (1 + 1e-8)), 9) AS score FROM {prefix}_prof p JOIN v_tfidf t USING (term)
 JOIN (SELECT case_id, sqrt(sum(weight * weight)) AS pn FROM {prefix}_prof GROUP BY case_id) n ON n.case_id = p.case_id GROUP BY p.case_id, t.poi_id""")
    add_view(f"{prefix}_ctop", f"""
SELECT case_id, max(score) AS top FROM {prefix}_csim s WHERE NOT EXISTS (SELECT 1 FROM {hist} h WHERE h.case_id = s.case_id AND h.poi_id = s.poi_id) GROUP BY case_id HAVING max(score) > 0""")
    add_view(f"{prefix}_content", f"""
SELECT t.case_id, p.poi_id, p.sig, COALESCE(s.score, 0) AS score, COALESCE(s.score, 0) / t.top AS norm FROM {prefix}_ctop t CROSS JOIN v_sig p LEFT JOIN {prefix}_csim s ON s.case_id = t.case_id AND s.poi_id = p.poi_id
WHERE NOT EXISTS (SELECT 1 FROM {seen} x WHERE x.case_id = t.case_id AND x.poi_id = p.poi_id)""")


content_views("v_u", "v_ucase", "v_uhist", "v_uhist")


def ucases(t):
    cases = splits._last_two(t.visits, "user_id", tr.USER_ORDER).select(
        F.col("user_id").alias("case_id"), F.lit("ALL").alias("scope"), "user_id", "current_poi", "prev_poi")
    history = features.interactions(t.visits).withColumnRenamed("user_id", "case_id")
    return cases, history


# ---------------------------------------------------------------- features

@query("tfidf", "SELECT poi_id, term, round(weight, 9) AS weight FROM v_tfidf")
def tfidf(t):
    return features.tfidf(t.poi_categories).withColumn("weight", r9("weight"))


@query("cooccurrence", "SELECT * FROM v_cooc")
def cooccurrence(t):
    return features.cooccurrence(t.visits)


@query("user_profile", "SELECT case_id, term, round(weight, 9) AS weight FROM v_u_prof")
def user_profile(t):
    cases, history = ucases(t)
    vectors, sig_of = features.tfidf_by_signature(t.poi_categories)
    return eng.user_profile(history, cases, vectors, sig_of).select("case_id", "term", r9("weight").alias("weight"))


@query("content_score", """
SELECT case_id, poi_id, round(score, 9) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, sig, poi_id) AS rank FROM v_u_content) WHERE rank <= 50""")
def content_score(t):
    cases, history = ucases(t)
    vectors, sig_of = map(materialize, features.tfidf_by_signature(t.poi_categories))
    seen = history.select("case_id", "poi_id")
    reach = materialize(eng.content_reach(cases, history, seen, vectors, sig_of))
    return eng.content_top_k(reach, seen, sig_of, 50).select("case_id", "poi_id", r9("score").alias("score"), "rank")


@query("content_rank", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, sig, poi_id) - 1 AS rank0 FROM v_u_content)
SELECT r.case_id, r.poi_id, r.rank0 FROM r JOIN v_tr1 t ON t.b = r.poi_id JOIN v_ucase c ON c.case_id = r.case_id AND c.current_poi = t.a""")
def content_rank(t):
    cases, history = ucases(t)
    vectors, sig_of = map(materialize, features.tfidf_by_signature(t.poi_categories))
    seen = history.select("case_id", "poi_id")
    reach = materialize(eng.content_reach(cases, history, seen, vectors, sig_of))
    needed = cases.select("case_id", F.col("current_poi").alias("a")).join(tr.transitions_poi(t.visits), "a").select("case_id", F.col("b").alias("poi_id"))
    return eng.content_ranks(eng.exclude(needed, seen), reach, seen, sig_of)


@query("item_score", """
SELECT h.case_id, c.b AS poi_id, CAST(sum(c.n) AS DOUBLE) AS score FROM v_uhist h JOIN v_cooc c ON c.a = h.poi_id
WHERE NOT EXISTS (SELECT 1 FROM v_uhist x WHERE x.case_id = h.case_id AND x.poi_id = c.b) GROUP BY 1, 2""")
def item_score(t):
    _, history = ucases(t)
    return eng.item_score(history, features.cooccurrence(t.visits))


@query("markov1", """
SELECT case_id, poi_id, round(score, 9) AS score, rank FROM (SELECT c.case_id, t.b AS poi_id, round(t.p, 9) AS score, row_number() OVER (PARTITION BY c.case_id ORDER BY round(t.p, 9) DESC, t.b) AS rank FROM v_ucase c JOIN v_tr1 t ON t.a = c.current_poi) WHERE rank <= 20""")
def markov1(t):
    return eng.markov1(ucases(t)[0], tr.transitions_poi(t.visits), 20).withColumn("score", r9("score"))


def markov_view(name: str, case: str, tr1: str, tr2: str, topn: int = 2000, backoff: float = 0.3) -> None:
    add_view(name, f"""
SELECT case_id, poi_id, score FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, poi_id) AS rn FROM (SELECT case_id, poi_id, round(sum(s), 9) AS score FROM
 (SELECT c.case_id, t.b AS poi_id, {backoff} * t.p AS s FROM {case} c JOIN {tr1} t ON t.a = c.current_poi
  UNION ALL SELECT c.case_id, t.b, (1 - {backoff}) * t.p2 FROM {case} c JOIN {tr2} t ON t.a = c.current_poi AND t.p = c.prev_poi) GROUP BY 1, 2)) WHERE rn <= {topn}""")


markov_view("v_umarkov", "v_ucase", "v_tr1", "v_tr2", 100)


@query("markov2_backoff", "SELECT case_id, poi_id, round(score, 9) AS score FROM v_umarkov")
def markov2_backoff(t):
    return eng.markov2_backoff(ucases(t)[0], tr.transitions_poi(t.visits), tr.transitions_order2(t.visits), 100).withColumn("score", r9("score"))


@query("hub_penalty", "SELECT m.case_id, m.poi_id, round(m.score / pow(COALESCE(c.n_visits, 1), 0.5), 9) AS score FROM v_umarkov m LEFT JOIN v_counts c USING (poi_id)")
def hub_penalty(t):
    rows = eng.markov2_backoff(ucases(t)[0], tr.transitions_poi(t.visits), tr.transitions_order2(t.visits), 100)
    return eng.hub_penalty(rows, features.item_counts(t.visits), 0.5).select("case_id", "poi_id", r9("score").alias("score"))


@query("max_normalize", "SELECT case_id, poi_id, round(score / max(score) OVER (PARTITION BY case_id), 9) AS score FROM v_umarkov")
def max_normalize(t):
    rows = eng.markov2_backoff(ucases(t)[0], tr.transitions_poi(t.visits), tr.transitions_order2(t.visits), 100)
    return eng.max_normalize(rows).select("case_id", "poi_id", r9("score").alias("score"))


@query("next_category", """
SELECT case_id, category, round(score, 9) AS score, rank FROM (SELECT c.case_id, t.cat_b AS category, round(t.p, 9) AS score, row_number() OVER (PARTITION BY c.case_id ORDER BY round(t.p, 9) DESC, t.cat_b) AS rank
 FROM v_ucase c JOIN v_pois p ON p.poi_id = c.current_poi JOIN v_trc t ON t.cat_a = p.primary_category) WHERE rank <= 5""")
def next_category(t):
    cats = ucases(t)[0].join(t.pois.select(F.col("poi_id").alias("current_poi"), F.col("primary_category").alias("category")), "current_poi").select("case_id", "category")
    return eng.next_category(cats, tr.transitions_cat(t.visits, t.pois), 5).withColumn("score", r9("score"))


# the users of each nation have transitions of their own, so a POI that none of them left for another starts none
add_view("v_nation_leads", "SELECT v.poi_id, c.c_nationkey AS scope, lead(poi_id) OVER (PARTITION BY trail_id ORDER BY ts, seq, poi_id, tie) AS nx FROM v_visits v JOIN customer c ON c.c_custkey = v.user_id")
add_view("v_nation_trc", """
SELECT scope, cat_a, cat_b, n / sum(n) OVER (PARTITION BY scope, cat_a) AS p FROM (SELECT scope, pa.primary_category AS cat_a, pb.primary_category AS cat_b, count(*) AS n FROM v_nation_leads l JOIN v_pois pa ON pa.poi_id = l.poi_id JOIN v_pois pb ON pb.poi_id = l.nx GROUP BY 1, 2, 3)""")


@query("markov_cat_fallback", """
WITH e AS (SELECT c.case_id, n.c_nationkey AS scope, p.primary_category AS cat_a FROM v_ucase c JOIN customer n ON n.c_custkey = c.user_id JOIN v_pois p ON p.poi_id = c.current_poi
 WHERE NOT EXISTS (SELECT 1 FROM v_nation_leads l WHERE l.scope = n.c_nationkey AND l.poi_id = c.current_poi AND l.nx IS NOT NULL)),
r AS (SELECT x.scope, x.cat_a, p.poi_id, t.p, COALESCE(p.rating, 0) AS rating, max(COALESCE(p.rating, 0)) OVER (PARTITION BY x.scope, x.cat_a) AS m FROM (SELECT DISTINCT scope, cat_a FROM e) x JOIN v_nation_trc t USING (scope, cat_a) JOIN v_pois p ON p.primary_category = t.cat_b),
b AS (SELECT *, row_number() OVER (PARTITION BY scope, cat_a ORDER BY score DESC, poi_id) AS rn FROM (SELECT scope, cat_a, poi_id, round(p * (0.7 + 0.3 * rating / CASE WHEN m > 0 THEN m ELSE 1 END), 9) AS score FROM r))
SELECT e.case_id, b.poi_id, b.score FROM e JOIN b USING (scope, cat_a) WHERE rn <= 20""")
def markov_cat_fallback(t):
    nation = t.raw("customer").select(F.col("c_custkey").cast("long").alias("user_id"), F.col("c_nationkey").alias("scope"))
    visits = t.visits.join(nation, "user_id")
    cases = ucases(t)[0].drop("scope").join(nation, "user_id")
    found = cases.join(tr.transitions_poi(visits, scope=["scope"]).select("scope", F.col("a").alias("current_poi")), ["scope", "current_poi"], "left_semi")
    return eng.markov_cat_fallback(cases, found, tr.transitions_cat(visits, t.pois, scope=["scope"]), t.pois, 20).withColumn("score", r9("score"))


# ---------------------------------------------------------------- embeddings and factors on given vectors

_UNIT = "list_transform(vec, lambda x: x / sqrt(list_dot_product(vec, vec)))"
add_view("v_unit", f"SELECT poi_id, {_UNIT} AS u FROM v_item_vectors")
add_view("v_near", """
SELECT a, b, score FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS rn FROM (SELECT x.poi_id AS a, y.poi_id AS b, round(list_dot_product(x.u, y.u), 9) AS score FROM v_unit x JOIN v_unit y ON x.poi_id <> y.poi_id)) WHERE rn <= 20""")


add_view("v_near_all", """
SELECT a, b, score FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS rn FROM (SELECT x.poi_id AS a, y.poi_id AS b, round(list_dot_product(x.u, y.u), 9) AS score FROM v_unit x JOIN v_unit y ON x.poi_id <> y.poi_id)) WHERE rn <= 2000""")


@query("similar_pois", "SELECT a AS poi_id, b AS similar_id, round(score, 9) AS score FROM v_near")
def similar_pois(t):
    out = eng.similar_pois(t.item_vectors, t.item_vectors, 20)
    return out.select(F.col("case_id").alias("poi_id"), F.col("poi_id").alias("similar_id"), r9("score").alias("score"))


add_view("v_urecent", "SELECT user_id AS case_id, poi_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, trail_id, seq, poi_id, tie) AS pos FROM v_visits")
add_view("v_uctx", """
SELECT case_id, poi_id FROM (SELECT case_id, poi_id, row_number() OVER (PARTITION BY case_id ORDER BY pos DESC) AS back FROM
 (SELECT r.case_id, r.poi_id, r.pos FROM v_urecent r JOIN v_ucase c ON c.case_id = r.case_id WHERE r.poi_id <> c.current_poi UNION ALL SELECT case_id, current_poi, 9000000000 FROM v_ucase)) WHERE back <= 8""")


def context_view(name: str, ctx: str, topn: int) -> None:
    add_view(f"{name}_mean", f"SELECT case_id, list(m ORDER BY d) AS vec FROM (SELECT case_id, d, avg(x) AS m FROM (SELECT c.case_id, unnest(v.u) AS x, unnest(range(1, len(v.u) + 1)) AS d FROM {ctx} c JOIN v_unit v USING (poi_id)) GROUP BY 1, 2) GROUP BY 1")
    add_view(name, f"""
SELECT case_id, poi_id, score FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, poi_id) AS rn FROM (SELECT m.case_id, v.poi_id, round(list_cosine_similarity(m.vec, v.u), 9) AS score FROM {name}_mean m CROSS JOIN v_unit v
 WHERE NOT EXISTS (SELECT 1 FROM {ctx} c WHERE c.case_id = m.case_id AND c.poi_id = v.poi_id))) WHERE rn <= {topn}""")


context_view("v_uembed", "v_uctx", 50)
add_view("v_unext_ctx", """
SELECT case_id, current_poi AS poi_id FROM v_ucase WHERE current_poi IN (SELECT poi_id FROM v_unit)
UNION ALL SELECT case_id, poi_id FROM (SELECT r.case_id, r.poi_id, row_number() OVER (PARTITION BY r.case_id ORDER BY r.pos DESC) AS back FROM v_urecent r JOIN v_ucase c ON c.case_id = r.case_id WHERE c.current_poi NOT IN (SELECT poi_id FROM v_unit) AND r.poi_id IN (SELECT poi_id FROM v_unit)) WHERE back <= 3""")
context_view("v_unext", "v_unext_ctx", 50)


def _recent(t):
    return tr.user_history(t.visits).withColumnRenamed("user_id", "case_id")


@query("embed_context", "SELECT case_id, poi_id, round(score, 9) AS score FROM v_uembed")
def embed_context(t):
    cases, _ = ucases(t)
    ctx = tr.last_n_rows(_recent(t), cases.select("case_id", "current_poi"), 8)
    return eng.embed_context(ctx.select("case_id", "poi_id"), t.item_vectors, 50).withColumn("score", r9("score"))


@query("embed_next", "SELECT case_id, poi_id, round(score, 9) AS score FROM v_unext")
def embed_next(t):
    known = t.visits.join(t.item_vectors.select("poi_id"), "poi_id", "left_semi")
    recent = tr.user_history(known).withColumnRenamed("user_id", "case_id")  # only places with a vector are ever asked for
    return eng.embed_next(ucases(t)[0], t.item_vectors, 50, recent).withColumn("score", r9("score"))


add_view("v_uembed_hist", """
SELECT h.case_id, n.b AS poi_id, round(sum(n.score), 9) AS score FROM v_uhist h JOIN v_near n ON n.a = h.poi_id WHERE NOT EXISTS (SELECT 1 FROM v_uhist x WHERE x.case_id = h.case_id AND x.poi_id = n.b) GROUP BY 1, 2""")


@query("embed_history", "SELECT case_id, poi_id, round(score, 9) AS score FROM v_uembed_hist")
def embed_history(t):
    return eng.embed_history(ucases(t)[1], t.item_vectors, 20).withColumn("score", r9("score"))


# one case per request: context of two or more items, else current POI, else history
add_view("v_rctx", """
SELECT case_id, poi_id FROM (SELECT case_id, poi_id, row_number() OVER (PARTITION BY case_id ORDER BY pos DESC) AS back FROM
 (SELECT q.req_id AS case_id, r.poi_id, r.pos FROM v_requests q JOIN v_urecent r ON r.case_id = q.user_id WHERE q.current_poi IS NULL OR r.poi_id <> q.current_poi
  UNION ALL SELECT req_id, current_poi, 9000000000 FROM v_requests WHERE current_poi IS NOT NULL)) WHERE back <= CASE WHEN case_id % 4 = 1 THEN 1 ELSE 3 END""")
add_view("v_rctx2", "SELECT * FROM v_rctx WHERE case_id IN (SELECT case_id FROM v_rctx GROUP BY case_id HAVING count(*) >= 2)")
add_view("v_rnext", "SELECT req_id AS case_id, current_poi AS poi_id FROM v_requests WHERE current_poi IN (SELECT poi_id FROM v_unit) AND req_id NOT IN (SELECT case_id FROM v_rctx2)")
context_view("v_rsel_ctx", "v_rctx2", 20)
context_view("v_rsel_next", "v_rnext", 20)


@query("embed_select", """
SELECT case_id, poi_id, round(score, 9) AS score FROM v_rsel_ctx UNION ALL SELECT case_id, poi_id, round(score, 9) FROM v_rsel_next
UNION ALL SELECT q.req_id, n.b, round(sum(n.score), 9) FROM v_requests q JOIN v_uhist h ON h.case_id = q.user_id JOIN v_near n ON n.a = h.poi_id
 WHERE q.current_poi IS NULL AND q.req_id NOT IN (SELECT case_id FROM v_rctx2) AND NOT EXISTS (SELECT 1 FROM v_uhist x WHERE x.case_id = q.user_id AND x.poi_id = n.b) GROUP BY 1, 2""")
def embed_select(t):
    cases = t.requests.select(F.col("req_id").alias("case_id"), F.lit("ALL").alias("scope"), "user_id", "current_poi")
    hist = cases.join(features.interactions(t.visits), "user_id").select("case_id", "poi_id", "n")
    recent = cases.select("case_id", "user_id").join(tr.user_history(t.visits), "user_id").select("case_id", "pos", "poi_id")
    ctx = tr.last_n_rows(recent, cases.select("case_id", "current_poi"), 3)
    ctx = ctx.where((F.col("case_id") % 4 != 1) | (F.col("back") == 1)).select("case_id", "poi_id")
    return eng.embed_select(cases, ctx, hist, t.item_vectors, 20).select("case_id", "poi_id", r9("score").alias("score"))


_ALS = """
SELECT case_id, poi_id, round(score, 9) AS score FROM (SELECT s.*, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, poi_id) AS rn FROM
 (SELECT u.case_id, i.poi_id, round(list_dot_product(u.vec, i.vec), 9) AS score FROM ({u}) u CROSS JOIN v_item_vectors i) s WHERE NOT EXISTS (SELECT 1 FROM v_uhist h WHERE h.case_id = s.case_id AND h.poi_id = s.poi_id)) WHERE rn <= 50"""


add_view("v_als_known", _ALS.format(u="SELECT c.case_id, v.vec FROM v_ucase c JOIN v_user_vectors v ON v.user_id = c.user_id"))


def _users(t):
    """The cases and the history of ``ucases`` without current and previous POI."""
    users = t.visits.select("user_id").distinct().withColumn("case_id", F.col("user_id"))
    return users, features.interactions(t.visits).withColumnRenamed("user_id", "case_id")


@query("als_score_known", "SELECT * FROM v_als_known")
def als_score_known(t):
    cases, history = _users(t)
    known = materialize(cases.join(t.user_vectors.select("user_id"), "user_id", "left_semi"))
    return eng.als_score(known, history.join(known.select("case_id"), "case_id", "left_semi"), t.user_vectors, t.item_vectors, 50).withColumn("score", r9("score"))


@query("als_score_cold", _ALS.format(u="""SELECT case_id, list(m ORDER BY d) AS vec FROM (SELECT case_id, d, sum(n * x) / sum(n) AS m FROM (SELECT h.case_id, h.n, unnest(v.vec) AS x, unnest(range(1, len(v.vec) + 1)) AS d
 FROM v_uhist h JOIN v_item_vectors v USING (poi_id) WHERE h.case_id NOT IN (SELECT user_id FROM v_user_vectors)) GROUP BY 1, 2) GROUP BY 1"""))
def als_score_cold(t):
    cases, history = _users(t)
    cold = materialize(cases.join(t.user_vectors.select("user_id"), "user_id", "left_anti"))
    return eng.als_score(cold, history.join(cold.select("case_id"), "case_id", "left_semi"), t.user_vectors, t.item_vectors, 50).withColumn("score", r9("score"))


@query("word2vec_train")
def word2vec_train(t):
    return eng.train_skipgram(t.visits)


@shared
def trained_factors(t):
    return eng.train_als(features.interactions(t.visits))


@query("als_train")
def als_train(t):
    users, items = trained_factors(t)
    return users.select(F.lit("user").alias("side"), F.col("user_id").alias("id"), "vec").unionByName(items.select(F.lit("item").alias("side"), F.col("poi_id").alias("id"), "vec"))


@query("als_residual", "SELECT count(DISTINCT poi_id) AS n_items, true AS solved FROM v_visits")
def als_residual(t):
    """Whether every item's vector, solved last, fulfils its normal equations to a millionth."""
    users, items = trained_factors(t)
    ratings = features.interactions(t.visits).select(F.col("poi_id").alias("row"), F.col("user_id").alias("col"), F.col("n").cast("double").alias("n"))
    gaps = factors.residuals(ratings, items.withColumnRenamed("poi_id", "id"), users.withColumnRenamed("user_id", "id"), 0.01, 40.0)
    return gaps.agg(F.count("*").alias("n_items"), (F.max("residual") < 1e-6).alias("solved"))


# ---------------------------------------------------------------- baselines

def _scoped(t):
    return t.pois.withColumn("scope", F.lit("ALL"))


@query("popular", """
SELECT case_id, poi_id, n_visits, rank FROM (SELECT c.case_id, p.poi_id, COALESCE(n.n_visits, 0) AS n_visits, row_number() OVER (PARTITION BY c.case_id ORDER BY COALESCE(n.n_visits, 0) DESC, p.poi_id) AS rank
 FROM v_ucase c CROSS JOIN v_pois p LEFT JOIN v_counts n ON n.poi_id = p.poi_id WHERE NOT EXISTS (SELECT 1 FROM v_uhist h WHERE h.case_id = c.case_id AND h.poi_id = p.poi_id)) WHERE rank <= 20""")
def popular(t):
    cases, history = ucases(t)
    return eng.popular(cases, history.select("case_id", "poi_id"), _scoped(t), features.item_counts(t.visits), 20)


RANDOM_SQL = """
SELECT case_id, poi_id, rank FROM (SELECT c.case_id, r.poi_id, row_number() OVER (PARTITION BY c.case_id ORDER BY (r.place - c.start + r.size) % r.size) AS rank FROM
 (SELECT case_id, CAST(('0x' || substr(md5(concat_ws(':', '42', 'case', CAST(case_id AS VARCHAR))), 1, 8)) AS BIGINT) % (SELECT count(*) FROM v_pois) AS start FROM {case}) c
 CROSS JOIN (SELECT poi_id, row_number() OVER (ORDER BY md5(concat_ws(':', '42', CAST(poi_id AS VARCHAR))), poi_id) - 1 AS place, count(*) OVER () AS size FROM v_pois) r
 WHERE NOT EXISTS (SELECT 1 FROM {seen} h WHERE h.case_id = c.case_id AND h.poi_id = r.poi_id)) WHERE rank <= 20"""


@query("random_baseline", RANDOM_SQL.format(case="v_ucase", seen="v_uhist"))
def random_baseline(t):
    cases, history = ucases(t)
    return eng.random_baseline(cases, history.select("case_id", "poi_id"), _scoped(t), 20)


add_view("v_quality", """
SELECT poi_id, round(0.7 * CASE WHEN max(COALESCE(rating, 0)) OVER () > 0 THEN COALESCE(rating, 0) / (max(COALESCE(rating, 0)) OVER () + 1e-8) ELSE 0 END
 + 0.3 * CASE WHEN max(total_ratings) OVER () > 0 THEN ln(1 + COALESCE(total_ratings, 0)) / (ln(1 + max(total_ratings) OVER ()) + 1e-8) ELSE 0 END, 9) AS score FROM v_pois""")


@query("popularity_fallback", """
SELECT c.case_id, q.poi_id, round(q.score, 9) AS score FROM v_ucase c CROSS JOIN (SELECT * FROM v_quality ORDER BY score DESC, poi_id LIMIT 10) q""")
def popularity_fallback(t):
    return eng.popularity_fallback(ucases(t)[0], _scoped(t), 10).withColumn("score", r9("score"))


EXCLUDED = ["Intersection", "State", "Home (private)"]
_HAV = "CASE WHEN p.lat + p.lon + r.lat + r.lon IS NOT NULL THEN 2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(p.lat - r.lat) / 2), 2) + cos(radians(r.lat)) * cos(radians(p.lat)) * pow(sin(radians(p.lon - r.lon) / 2), 2)))) END"
add_view("v_snap", f"""
SELECT req_id, poi_id FROM (SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY v DESC, rt DESC, d, poi_id) AS rn FROM (SELECT r.req_id, p.poi_id, CASE WHEN c.poi_id IS NULL THEN 0 ELSE 1 END AS v, COALESCE(p.rating, 0) AS rt, round({_HAV}, 9) AS d
 FROM v_requests r JOIN v_pois p ON p.lat IS NOT NULL AND r.lat IS NOT NULL AND p.primary_category NOT IN ('Intersection', 'State', 'Home (private)') LEFT JOIN v_counts c ON c.poi_id = p.poi_id WHERE {_HAV} <= 0.3)) WHERE rn = 1""")


@query("snap_to_poi", "SELECT req_id, poi_id FROM v_snap")
def snap_to_poi(t):
    anchors = t.requests.select(F.col("req_id").alias("case_id"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"))
    out = eng.snap_to_poi(anchors, t.pois, features.item_counts(t.visits), 0.3, EXCLUDED)
    return out.withColumnRenamed("case_id", "req_id")


