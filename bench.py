"""Times the headline queries and prints one JSON line.

Every query is computed in full into a sink that discards the rows; planning is part of the time.
The best of two runs counts, so that compilation is not measured. The row-level queries, which move the most data, are timed
apart, so that the headline total stays comparable between rounds.
"""

from __future__ import annotations

import json
import os
import time

from assayline.plans.registry import QUERIES
from assayline.session import local_session

HEADLINE = (
    "percent_plates_my",
    "percent_plates_my_country",
    "percent_plates_my_country_site",
    "affected_plates",
    "abbott_error_codes",
    "top_codes_model",
    "top_codes_instrument",
    "monthly_code_rate",
    "site_code_rate",
    "country_error_series",
    "error_country_series",
    "site_error_series_filled",
    "roche_errors",
    "error_share_all",
    "error_rate_site",
    "error_rate_instrument",
    "error_rate_month",
    "kit_error_totals",
    "plate_status_by_country",
    "test_sample_table",
    "test_perc_table",
    "instruments_country",
    "nearest_lab",
)
ROW_LEVEL = (
    "activity_enriched",
    "codes_nearest_month",
    "error_codes_long",
    "plate_status",
    "tests_last_year",
    "percent_plates_levels",
)
RUNS = 2


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores=cores, shuffle_partitions=8 if cores == "*" else int(cores))
    seconds = {}
    for name in (*HEADLINE, *ROW_LEVEL):
        runs = []
        for _ in range(RUNS):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(min(runs), 3)
    spark.stop()
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds[n] for n in HEADLINE), 3),
                "unit": "sec",
                "queries": {n: seconds[n] for n in HEADLINE},
                "row_level": {n: seconds[n] for n in ROW_LEVEL},
                "sf": scale,
            }
        )
    )


if __name__ == "__main__":
    main()
