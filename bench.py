"""Wall time of the headline queries; one JSON line on stdout."""

from __future__ import annotations

import json
import os
import time

from pitpanel import plans
from pitpanel.session import build_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))

HEADLINE = [
    "point_in_time_table", "series_as_known", "merge_two_vintages", "snapshot_diff", "rule_validation", "accounting_repair",
    "public_score_card", "forecast_score_card", "sup_wald_break", "hac_one_regressor", "monte_carlo_band", "leave_year_out_calibration",
    "one_sided_trend", "cluster_bootstrap", "panel_bootstrap_test", "filtered_state_probability", "auc_from_ranks", "rank_agreement",
    "variant_score_table", "state_refit_realtime", "behavioural_anchor", "joint_corridor",
]


def main() -> None:
    spark = build_session("pitpanel-bench", CPUS)
    spark.sparkContext.setLogLevel("ERROR")
    registry = plans.registry()
    registry["calendar_spine"].plan(spark, SF_DIR).write.format("noop").mode("overwrite").save()      # warm-up
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        registry[name].plan(spark, SF_DIR).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
