"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import time

from ionloom.catalog import QUERIES
from ionloom.session import build_session

HEADLINE = [
    "blank_mean_sd", "freq_and_abundance", "l2_match", "l5_match", "standards_removal", "m2_removal", "neutral_loss_removal",
    "adduct_removal", "smearing", "dup_merge", "crowd_elimination", "carbon_estimate", "sample_match", "align_summary",
    "series_refined", "trend_outliers", "band_filter", "screen_report",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("OFF")
    spark.range(1000).groupBy("id").count().count()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    scale = re.search(r"sf([\d.]+)", folder)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": float(scale.group(1)) if scale else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
