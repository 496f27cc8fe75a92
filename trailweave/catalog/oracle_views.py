"""The derived input tables as portable SQL, used as CTEs in front of each check query."""
from __future__ import annotations

import re

from trailweave.sources.fixtures import CATEGORY_NAMES

_CAT_ROWS = ", ".join(f"({i}, 'c{i:02d}', '{n}')" for i, n in enumerate(CATEGORY_NAMES))

VIEWS: dict[str, str] = {
    "v_cat": f"SELECT * FROM (VALUES {_CAT_ROWS}) AS t(ci, category_id, category_name)",
    "v_pois": """
SELECT CAST(p_partkey AS BIGINT) AS poi_id, p_name AS name,
  CASE WHEN p_partkey % 97 = 0 THEN NULL ELSE CAST(34.60 AS DOUBLE) + CAST((p_partkey * 7919) % 1000 AS DOUBLE) * CAST(0.00015 AS DOUBLE) END AS lat,
  CASE WHEN p_partkey % 97 = 0 THEN NULL ELSE CAST(135.40 AS DOUBLE) + CAST((p_partkey * 104729) % 997 AS DOUBLE) * CAST(0.0002 AS DOUBLE) END AS lon,
  CASE WHEN p_partkey % 10 < 6 THEN 'C1' WHEN p_partkey % 10 < 9 THEN 'C2' ELSE 'C3' END AS city_id,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE round(CAST(5 AS DOUBLE) + (p_retailprice - 900) / 20, 1) END AS rating,
  CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(p_size % 5 AS INT) END AS price_tier,
  CAST((p_partkey * 31) % 500 AS INT) AS total_ratings,
  c.category_name AS primary_category,
  (p_partkey % 7 <> 0 AND p_size % 5 = 0) AS is_free
FROM part JOIN v_cat c ON c.ci = p_partkey % 24""",
    "v_poi_categories": """
SELECT CAST(p_partkey AS BIGINT) AS poi_id, 0 AS ord, c.category_id, c.category_name FROM part JOIN v_cat c ON c.ci = p_partkey % 24
UNION ALL
SELECT CAST(p_partkey AS BIGINT), 1, c.category_id, c.category_name FROM part JOIN v_cat c ON c.ci = (p_partkey * 5 + 3) % 24 WHERE p_partkey % 2 = 0""",
    "v_visits": """
SELECT l_orderkey AS trail_id, o_custkey AS user_id, l_partkey AS poi_id,
  CASE WHEN l_partkey % 10 < 6 THEN 'C1' WHEN l_partkey % 10 < 9 THEN 'C2' ELSE 'C3' END AS venue_city,
  o_orderdate AS ts, l_linenumber AS seq, l_suppkey AS tie
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "v_raw_checkins": """
SELECT CAST(trail_id AS VARCHAR) AS trail_id, CAST(user_id AS VARCHAR) AS user_id,
  CASE WHEN (trail_id + seq) % 13 = 3 THEN NULL ELSE ' foursquare:' || CAST(poi_id AS VARCHAR) || ' ' END AS venue_id,
  'schema:' || c.category_name AS venue_category, 'schema:Place' AS venue_schema,
  CASE WHEN (trail_id + seq) % 13 = 5 THEN 'wd:C9' ELSE 'wd:' || venue_city END AS venue_city, 'wd:X1' AS venue_country,
  CASE WHEN (trail_id + seq) % 13 = 7 THEN 'not a time' WHEN (trail_id + seq) % 13 = 9 THEN NULL ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS timestamp,
  seq, tie
FROM v_visits JOIN v_cat c ON c.ci = poi_id % 24""",
    "v_raw_pois": """
SELECT poi_id, '{"' || CASE WHEN poi_id % 3 = 0 THEN 'fsq_place_id' ELSE 'fsq_id' END || '":"foursquare:' || CAST(poi_id AS VARCHAR) || '",' ||
  CASE WHEN poi_id % 2 = 0 THEN '"latitude":' || CAST(lat AS VARCHAR) || ',"longitude":' || CAST(lon AS VARCHAR)
       ELSE '"geocodes":{"main":{"latitude":' || CAST(lat AS VARCHAR) || ',"longitude":' || CAST(lon AS VARCHAR) || '}}' END ||
  ',"categories":[{"id":"' || CASE WHEN poi_id % 11 = 0 THEN '' ELSE 'x' END || '","name":"' || primary_category || '"}]' ||
  CASE WHEN poi_id % 4 = 1 THEN ',"name":"n' || CAST(poi_id AS VARCHAR) || '"' ELSE '' END ||
  CASE WHEN poi_id % 6 = 1 THEN ',"location":{"locality":"' || city_id || '","country":"JP"}' ELSE '' END ||
  CASE WHEN poi_id % 5 = 1 THEN ',"stats":{"usersCount":' || CAST(total_ratings AS VARCHAR) || '}'
       WHEN poi_id % 5 = 2 THEN ',"ratingSignals":' || CAST(total_ratings AS VARCHAR) ELSE '' END ||
  CASE WHEN poi_id % 4 = 0 THEN ',"price":{"tier":' || CAST(poi_id % 5 AS VARCHAR) || '}'
       WHEN poi_id % 4 = 2 THEN ',"price":' || CAST(poi_id % 5 AS VARCHAR) ELSE '' END || '}' AS doc
FROM v_pois WHERE lat IS NOT NULL""",
    "v_labels": """
SELECT CASE WHEN substr(category_id, 3, 1) IN ('3', '7') THEN 'alt::' || category_id ELSE category_id END AS label_id,
  category_name AS name, (count(*) % 5 = 0) AS free,
  CASE WHEN count(*) % 3 <> 0 THEN CAST(count(*) % 4 AS INT) END AS price_tier,
  CASE WHEN count(*) % 2 = 0 THEN 'model' END AS source
FROM v_poi_categories GROUP BY category_id, category_name""",
    "v_requests": """
SELECT CAST(c_custkey AS BIGINT) AS req_id,
  CASE WHEN c_custkey % 6 IN (1, 2, 5) THEN CAST(c_custkey AS BIGINT) END AS user_id,
  CASE WHEN c_custkey % 6 = 2 OR (c_custkey % 6 = 3 AND c_custkey % 4 = 1) THEN CAST((c_custkey * 13) % 2000 + 1 AS BIGINT) END AS current_poi,
  CASE WHEN c_custkey % 6 IN (2, 3, 5) THEN CAST(34.60 AS DOUBLE) + CAST((c_custkey * 7919) % 1000 AS DOUBLE) * CAST(0.00015 AS DOUBLE) END AS lat,
  CASE WHEN c_custkey % 6 IN (2, 3, 5) THEN CAST(135.40 AS DOUBLE) + CAST((c_custkey * 104729) % 997 AS DOUBLE) * CAST(0.0002 AS DOUBLE) END AS lon,
  CASE WHEN c_custkey % 6 = 2 THEN 'museum,park,cheap'
       WHEN c_custkey % 6 = 4 AND (c_custkey // 6) % 3 = 0 THEN 'Sushi Restaurant,free,price:x'
       WHEN c_custkey % 6 = 4 AND (c_custkey // 6) % 3 = 1 THEN 'coffee, Coffee , zoo,mid,,'
       WHEN c_custkey % 6 = 4 THEN 'price_tier: 2,Onsen,gratis,paid'
       WHEN c_custkey % 6 = 5 THEN 'paid,max_price:2, zoo' END AS prefs,
  CASE WHEN c_custkey % 6 = 4 THEN 'strict' ELSE 'soft' END AS category_mode,
  CASE WHEN c_custkey % 6 = 4 THEN 5 WHEN c_custkey % 6 IN (2, 3) THEN 8 ELSE 10 END AS k,
  (c_custkey % 4 = 1) AS proximity
FROM customer""",
    "v_item_vectors": "SELECT CAST(vec_id + 1 AS BIGINT) AS poi_id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings",
    "v_user_vectors": "SELECT CAST(vec_id * 3 + 1 AS BIGINT) AS user_id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings",
}


def add_view(name: str, sql: str) -> None:
    """Register a further named check view; it may refer to views added before it."""
    VIEWS[name] = sql


def with_views(sql: str) -> str:
    """Prefix a check query with the definitions of every view it uses, in dependency order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b{name}\b", text) and name not in needed:
                visit(VIEWS[name])
                needed.append(name)

    visit(sql)
    recursive = any("RECURSIVE" in VIEWS[n] for n in needed)
    # worked out once each, however often later views mention them
    ctes = ",\n".join(f"{n} AS {'' if 'RECURSIVE' in VIEWS[n] else 'MATERIALIZED '}({VIEWS[n].replace('/*RECURSIVE*/', '')})" for n in needed)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        recursive, body = True, body[len("WITH RECURSIVE"):].strip()
        joined = f"{ctes},\n{body}" if ctes else body
    elif body.upper().startswith("WITH"):
        body = body[4:].strip()
        joined = f"{ctes},\n{body}" if ctes else body
    else:
        joined = f"{ctes}\n{body}" if ctes else body
        if not ctes:
            return body
    return ("WITH RECURSIVE " if recursive else "WITH ") + joined
