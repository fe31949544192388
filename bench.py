"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from catalog import fixtures
from catalog.queries import all_queries
from phasewise.plans.feature_extraction import feature_table
from phasewise.session import build_session

HEADLINES = [
    "load_clean",
    "drug_explode",
    "org_dedupe",
    "drug_phase_features",
    "feature_table",
    "feature_table_by_joins",
    "pass_rate",
    "org_count_max",
    "length_hist50",
    "class_balance",
    "drug_match_join",
    "drug_funnel",
    "phase_times",
    "phase_store_round_trip",
    "split_80_20",
    "fold_assign",
    "scaled_features",
    "naive_confidence3",
    "multiclass_scores",
    "fit_logistic_regression_pass",
    "fit_random_forest_time",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", master=f"local[{cpus}]", shuffle_partitions=int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    # The JVM and the file cache are warmed up by the table all queries start from.
    fixtures.trials(spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINES:
        begin = time.perf_counter()
        all_queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
    begin = time.perf_counter()
    unstaged = feature_table(
        fixtures.trials(spark, sf_dir), fixtures.STATUSES, fixtures.DESIGNS,
        cutoff=fixtures.CUTOFF,
    )
    unstaged.write.format("noop").mode("overwrite").save()
    seconds["feature_table_unstaged"] = round(time.perf_counter() - begin, 3)
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
