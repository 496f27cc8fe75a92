"""Benchmark of the headline queries. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose input and cores.
Every query starts from the parquet files; nothing is shared between queries.
"""
from __future__ import annotations

import json
import os
import time

from trailweave.catalog import registry
from trailweave.session import local_session

HEADLINE = [
    "next_poi_top10", "item_counts", "city_stats", "coverage", "clean_visits", "impute_price", "transitions_poi", "transitions_order2",
    "transitions_cat", "cooccurrence", "tfidf", "markov2_backoff", "popular", "content_score", "split_last_trail", "range_join_radius",
    "plan_route", "build_route", "route_metrics", "recommend", "eval_modes",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    registry.load_all()
    spark = local_session(cpus, "trailweave-bench")
    spark.range(1000).selectExpr("sum(id)").collect()
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").limit(1).collect()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        registry._TABLES.clear()
        start = time.time()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    registry._TABLES.clear()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": cpus}))


if __name__ == "__main__":
    main()
