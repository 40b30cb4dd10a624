"""Time headline queries: ``BENCH_SF_DIR`` (default sf0.1) on ``local[BENCH_CPUS]``; prints one JSON line.

Each query runs once to warm up and is then timed; results go to Spark's no-op sink, so all of them is computed.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from stillwell.catalog import QUERIES
from stillwell.session import local_session

HEADLINE = [
    "delta_target", "interval_sum", "interval_intensity", "trailing_sums", "trailing_window", "feature_table", "smoothed_normals",
    "weekly_sequence", "channel_stats", "encode_numeric", "grouped_split", "masked_bilinear", "nearest_cell",
    "point_in_polygon", "haversine_filter", "group_slope", "spearman", "group_quartiles", "rolling_months",
    "pressure_rank", "group_rates", "scenario_summary", "edit_effect", "step_table", "replay_bands", "backtest",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    spark = local_session("bench", cpus, int(cpus) if cpus.isdigit() else 8)
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        runs = []
        for attempt in range(repeats + 1):
            spark.catalog.clearCache()                              # no run may read what an earlier one kept
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if attempt:
                runs.append(time.perf_counter() - start)
        times[name] = round(statistics.median(runs), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total seconds over headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
