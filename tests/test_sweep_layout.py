"""The sweep over Markov settings shuffles candidates, not candidates times trials."""
import re

from trailweave.operators.splits import Cases
from trailweave.plans import sweeps


def test_nothing_is_shuffled_between_trials_and_their_means(spark):
    train = spark.createDataFrame([(t, t % 3, p, s, s, 0) for t in range(6) for s, p in enumerate([t % 4, (t + 1) % 4, 5])], "trail_id long, user_id long, poi_id long, ts long, seq long, tie long")
    cases = spark.createDataFrame([(t, "ALL", t % 3, (t + 1) % 4, t % 4) for t in range(6)], "case_id long, scope string, user_id long, current_poi long, prev_poi long")
    truth = spark.createDataFrame([(t, 5) for t in range(6)], "case_id long, poi_id long")
    none = spark.createDataFrame([], "case_id long, poi_id long, n long")
    pois = spark.createDataFrame([(i,) for i in range(6)], "poi_id long")
    out = sweeps.sweep_markov(Cases(cases, none, none.drop("n"), truth, cases), train, pois)
    rows = out.collect()
    assert len(rows) == 6 and all(r["hit"] > 0 for r in rows)
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    after_trials = plan.split("Generate explode")[0]
    assert not re.search(r"hashpartitioning\([^)]*trial#\d+, case_id|hashpartitioning\(case_id#\d+L, (trial|poi_id)", after_trials)
