"""Headline queries on local[$BENCH_CPUS] at $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from astrolake.plans.registry import entries, run_entry
from astrolake.session import build_session

HEADLINE = (
    "e07_weighted_stack", "e09_plain_stacks", "d01_image_stats", "d06_fit_plane", "d17_fidelity_metrics", "d19_frame_quality", "f01_select_percent", "f03_select_otsu", "f04_select_utility",
    "c01_match_masters", "c03_match_unique", "c10_nearest", "c12_mosaic_groups", "d26_star_summary", "k01_evaluate_gates", "k08_fit_thresholds", "k15_advise", "j06_batch_search", "a11_sections",
    "l04_resume_plan", "s03_tumbling_quality",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", cores=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    found = entries()
    spark.read.parquet(f"{sf_dir}/region.parquet").count()
    times = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        run_entry(found[name], spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
