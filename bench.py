"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from emberlake.session import local_session  # noqa: E402

HEADLINE = [
    "q00_risk_by_zone",
    "w01_codes_season_reset",
    "m13_fwi",
    "q01_daily_risk",
    "q02_forecast",
    "j01_nearest_cell",
    "j05_fires_within_10km",
    "q03_fire_statistics",
    "q04_risk_profile",
    "q05_portfolio",
    "q06_trends",
    "q10_explain",
    "q12_batch_risk",
    "g01_feature_assembly",
    "g07_calibrate_score",
    "a21_zone_evaluation",
    "l06_negative_samples",
    "w08_heatmap",
    "w09_tiles",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    from emberlake.registry import catalog
    from emberlake.registry.domain import Domain

    queries = catalog.queries()
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors
    took = {}

    def timed(name: str, work) -> None:
        start = time.time()
        work()
        took[name] = round(time.time() - start, 3)
        print(f"{name} {took[name]}", file=sys.stderr, flush=True)

    # what the product keeps between questions is written first and counts too
    stored = Domain(spark, folder)
    timed("stored_tables", lambda: [stored.stats, stored.carried])
    for name in HEADLINE:
        timed(name, lambda: queries[name](spark, folder).write.format("noop").mode("overwrite").save())  # noqa: B023
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
