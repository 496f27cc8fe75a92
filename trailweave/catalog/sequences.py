"""Queries: trail sequences, transitions and context."""
from __future__ import annotations

from pyspark.sql import functions as F

from trailweave.catalog.oracle_views import add_view
from trailweave.catalog.registry import query
from trailweave.functions.numeric import r6
from trailweave.operators import intents, transitions

_O = "PARTITION BY trail_id ORDER BY ts, seq, poi_id, tie"
add_view("v_leads", f"SELECT *, lead(poi_id) OVER (w) AS nx, lead(poi_id, 2) OVER (w) AS nx2, row_number() OVER (w) AS pos FROM v_visits WINDOW w AS ({_O})")
add_view("v_tr1", "SELECT a, b, n, n / sum(n) OVER (PARTITION BY a) AS p FROM (SELECT poi_id AS a, nx AS b, count(*) AS n FROM v_leads WHERE nx IS NOT NULL GROUP BY 1, 2)")
add_view("v_tr2", "SELECT p, a, b, n, n / sum(n) OVER (PARTITION BY p, a) AS p2 FROM (SELECT poi_id AS p, nx AS a, nx2 AS b, count(*) AS n FROM v_leads WHERE nx2 IS NOT NULL GROUP BY 1, 2, 3)")
add_view("v_trc", """SELECT cat_a, cat_b, n, n / sum(n) OVER (PARTITION BY cat_a) AS p FROM (SELECT pa.primary_category AS cat_a, pb.primary_category AS cat_b, count(*) AS n
 FROM v_leads l JOIN v_pois pa ON pa.poi_id = l.poi_id JOIN v_pois pb ON pb.poi_id = l.nx GROUP BY 1, 2)""")


@query("next_poi_top10", """
WITH last AS (SELECT user_id, poi_id AS a FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, trail_id DESC, seq DESC, poi_id DESC, tie DESC) AS rn FROM v_visits) WHERE rn = 1),
c AS (SELECT l.user_id, l.a AS current_poi, t.b AS poi_id, round(t.p, 9) AS score FROM last l JOIN v_tr1 t ON t.a = l.a WHERE NOT EXISTS (SELECT 1 FROM v_visits v WHERE v.user_id = l.user_id AND v.poi_id = t.b))
SELECT user_id, current_poi, poi_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, poi_id) AS rank FROM c) WHERE rank <= 10""")
def next_poi_top10(t):
    return transitions.next_poi_top(t.visits, 10).withColumn("score", r6("score"))


@query("transitions_poi", "SELECT a, b, n, round(p, 6) AS p FROM v_tr1")
def transitions_poi(t):
    return transitions.transitions_poi(t.visits).withColumn("p", r6("p"))


@query("transitions_order2", "SELECT p, a, b, n, round(p2, 6) AS p2 FROM v_tr2")
def transitions_order2(t):
    return transitions.transitions_order2(t.visits).withColumn("p2", r6("p2"))


@query("transitions_cat", "SELECT cat_a, cat_b, CAST(n AS BIGINT) AS n, round(p, 6) AS p FROM v_trc")
def transitions_cat(t):
    return transitions.transitions_cat(t.visits, t.pois).withColumn("p", r6("p"))


add_view("v_lab", f"SELECT v.*, i.intent, lead(i.intent) OVER ({_O}) AS ni, row_number() OVER ({_O}) AS pos FROM v_visits v JOIN v_poi_intent i USING (poi_id) WHERE i.intent <> 'inconclusive'")
add_view("v_matrix", """
WITH c AS (SELECT intent AS a, ni AS b, count(*) AS n FROM v_lab WHERE ni IS NOT NULL GROUP BY 1, 2), l AS (SELECT DISTINCT intent FROM v_lab)
SELECT x.intent AS label_a, y.intent AS label_b, COALESCE(n, 0) AS n, COALESCE(n / sum(n) OVER (PARTITION BY x.intent), 0.0) AS p FROM l x CROSS JOIN l y LEFT JOIN c ON c.a = x.intent AND c.b = y.intent""")


def _labels(t):
    return intents.poi_intents(t.pois).where(F.col("intent") != intents.INCONCLUSIVE)


@query("transitions_intent", "SELECT label_a, label_b, n, round(p, 6) AS p FROM v_matrix")
def transitions_intent(t):
    return transitions.transitions_label(t.visits, _labels(t), "intent").withColumn("p", r6("p"))


@query("transition_graph", """
SELECT label_a, label_b, n, round(p, 6) AS p FROM (SELECT *, count(*) FILTER (WHERE p >= 0.12) OVER (PARTITION BY label_a) AS k, row_number() OVER (PARTITION BY label_a ORDER BY p DESC, label_b) AS r FROM v_matrix WHERE label_a <> label_b AND p > 0)
WHERE CASE WHEN k >= CASE WHEN label_a = 'transport' THEN 3 ELSE 2 END THEN p >= 0.12 ELSE r <= CASE WHEN label_a = 'transport' THEN 3 ELSE 2 END END""")
def transition_graph(t):
    m = transitions.transitions_label(t.visits, _labels(t), "intent")
    return transitions.transition_graph(m, threshold=0.12).withColumn("p", r6("p"))


@query("position_links", """
WITH f AS (SELECT trail_id, max(intent) FILTER (WHERE pos = 1) AS l1, max(intent) FILTER (WHERE pos = 2) AS l2, max(intent) FILTER (WHERE pos = 3) AS l3 FROM v_lab GROUP BY trail_id HAVING count(*) >= 3)
SELECT 1 AS step, l1 AS source, l2 AS target, count(*) AS n FROM f GROUP BY 2, 3 HAVING count(*) >= 2 UNION ALL SELECT 2, l2, l3, count(*) FROM f GROUP BY 2, 3 HAVING count(*) >= 2""")
def position_links(t):
    return transitions.position_links(t.visits, _labels(t), "intent")


_TOP_EDGES = """
WITH e AS (SELECT a, b, n FROM v_tr1 WHERE a <> b ORDER BY n DESC, a, b LIMIT {n})
SELECT e.a, e.b, e.n, va.n AS visits_a, vb.n AS visits_b FROM e JOIN v_pois pa ON pa.poi_id = e.a AND pa.lat IS NOT NULL JOIN v_pois pb ON pb.poi_id = e.b AND pb.lat IS NOT NULL
JOIN (SELECT poi_id, count(*) AS n FROM v_visits GROUP BY 1) va ON va.poi_id = e.a JOIN (SELECT poi_id, count(*) AS n FROM v_visits GROUP BY 1) vb ON vb.poi_id = e.b"""
add_view("v_top_edges", _TOP_EDGES.format(n=60))
add_view("v_many_edges", _TOP_EDGES.format(n=5000))


@query("top_edges", "SELECT * FROM v_top_edges")
def top_edges(t):
    return transitions.top_edges(t.visits, t.pois, 60)


@query("edge_graph", """
WITH w AS (SELECT poi_id FROM (SELECT a AS poi_id, n FROM v_many_edges UNION ALL SELECT b, n FROM v_many_edges) GROUP BY poi_id ORDER BY sum(n) DESC, poi_id LIMIT 300)
SELECT a, b, n, round(n / sum(n) OVER (PARTITION BY a), 6) AS p FROM v_many_edges WHERE a IN (SELECT poi_id FROM w) AND b IN (SELECT poi_id FROM w)""")
def edge_graph(t):
    return transitions.edge_graph(transitions.top_edges(t.visits, t.pois, 5000), 300).withColumn("p", r6("p"))


add_view("v_located", f"SELECT v.*, p.lat, p.lon, count(*) OVER (PARTITION BY v.trail_id) AS len, row_number() OVER (PARTITION BY v.trail_id ORDER BY v.ts, v.seq, v.poi_id, v.tie) AS step FROM v_visits v JOIN v_pois p USING (poi_id) WHERE p.lat IS NOT NULL")


@query("real_trails_sample", """
SELECT trail_id, step, poi_id, lat, lon FROM v_located WHERE trail_id IN (SELECT trail_id FROM v_located WHERE len >= 4 GROUP BY trail_id ORDER BY trail_id LIMIT 50)""")
def real_trails_sample(t):
    return transitions.real_trails_sample(t.visits, t.pois)


@query("longest_trail", """
WITH g AS (SELECT venue_city, trail_id, count(*) AS n FROM v_located GROUP BY 1, 2 HAVING count(*) >= 6), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY venue_city ORDER BY n DESC, trail_id) AS rn FROM g) WHERE rn = 1)
SELECT l.venue_city, l.trail_id, row_number() OVER (PARTITION BY l.venue_city, l.trail_id ORDER BY ts, seq, poi_id, tie) AS step, poi_id FROM v_located l JOIN b ON b.venue_city = l.venue_city AND b.trail_id = l.trail_id""")
def longest_trail(t):
    return transitions.longest_trail(t.visits, t.pois)


_HAV = "CASE WHEN {a}lat + {a}lon + {b}lat + {b}lon IS NOT NULL THEN 2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lon - {a}lon) / 2), 2)))) END"


@query("leg_distance", f"""
SELECT trail_id, step, poi_id, round({_HAV.format(a='p', b='')}, 6) AS leg_km FROM (SELECT *, lag(lat) OVER (PARTITION BY trail_id ORDER BY step) AS plat, lag(lon) OVER (PARTITION BY trail_id ORDER BY step) AS plon FROM v_located)""")
def leg_distance(t):
    stops = transitions.trail_positions(transitions.located_visits(t.visits, t.pois), "step")
    return transitions.leg_distance(stops, ["trail_id"], "step").select("trail_id", "step", "poi_id", r6("leg_km").alias("leg_km"))


@query("last_n_context", """
WITH h AS (SELECT r.req_id AS case_id, r.current_poi, v.poi_id, row_number() OVER (PARTITION BY r.req_id ORDER BY ts, trail_id, seq, poi_id, tie) AS pos FROM v_requests r JOIN v_visits v ON v.user_id = r.user_id),
x AS (SELECT case_id, pos, poi_id FROM h WHERE current_poi IS NULL OR poi_id <> current_poi UNION ALL SELECT req_id, 4611686018427387904, current_poi FROM v_requests WHERE current_poi IS NOT NULL)
SELECT case_id, poi_id, back FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY pos DESC) AS back FROM x) WHERE back <= 3""")
def last_n_context(t):
    hist = transitions.user_history(t.visits)
    cases = t.requests.select(F.col("req_id").alias("case_id"), "user_id", "current_poi")
    rows = cases.join(hist, "user_id").select("case_id", "pos", "poi_id")
    return transitions.last_n_rows(rows, cases.select("case_id", "current_poi"), 3)


@query("prev_poi", """
WITH h AS (SELECT r.req_id, r.current_poi, v.poi_id, row_number() OVER (PARTITION BY r.req_id ORDER BY ts DESC, trail_id DESC, seq DESC, poi_id DESC, tie DESC) AS back FROM v_requests r JOIN v_visits v ON v.user_id = r.user_id)
SELECT req_id, CASE WHEN max(poi_id) FILTER (WHERE back = 1) = any_value(current_poi) AND count(*) >= 2 THEN max(poi_id) FILTER (WHERE back = 2) ELSE max(poi_id) FILTER (WHERE back = 1) END AS prev_poi FROM h GROUP BY req_id""")
def prev_poi(t):
    hist = t.requests.select("req_id", "user_id", "current_poi").join(transitions.last_items(t.visits, 2), "user_id")
    return hist.select("req_id", transitions.prev_poi(F.col("last_items"), F.col("current_poi")).alias("prev_poi"))
