"""Registered queries against their check SQL in DuckDB on the smallest inputs."""
import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from check import TABLES, norm

SF = "/root/testdata/sf0.001"
SOME = """next_poi_top10 scan_poi_json upsert_pois geojson_export clean_visits dense_reindex normalize_poi merge_poi_sources force_labels impute_price
city_summary category_catalog lorenz_curve spatial_bin_mean intent_classify intent_user prefs_table transitions_order2 transition_graph position_links
last_n_context content_score content_rank item_score markov2_backoff embed_context als_score_cold popular random_baseline snap_to_poi rrf blend_routes
recommend plan_route nn_order route_metrics radius_expand variant_location soft_surprise cases_trail recommend_modes eval_modes sweep_markov""".split()
NAMES = list(entry_points.queries()) if os.environ.get("TRAILWEAVE_ALL") else SOME


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    df = entry_points.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(v) for v in r) for r in df.select(*cols).collect()), key=str)
    sql = entry_points.oracle_sql().get(name)
    if sql is None:
        assert cols
        return
    rel = con.sql(sql)
    assert sorted(rel.columns) == cols
    idx = [rel.columns.index(c) for c in cols]
    assert got == sorted((tuple(norm(r[i]) for i in idx) for r in rel.fetchall()), key=str)


def test_every_check_belongs_to_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
