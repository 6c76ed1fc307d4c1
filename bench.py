"""Benchmark: headline kpiframe queries on one scale factor.

Prints ONE JSON line: {"metric", "value" (total seconds), "unit", "queries": {name: sec}, "sf", ...}.
Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from kpiframe.plans import registry  # noqa: E402
from kpiframe.session import get_spark  # noqa: E402

HEADLINE = [
    "chart_category_weighted",  # filter + category key + weighted KPI
    "chart_fixed_band",  # numeric band, two responses
    "chart_quantile_band",  # exact distributed NTILE
    "chart_quantile_ties",  # NTILE with straddling values ranked row by row
    "chart_quantile_windows",  # NTILE for high-cardinality x from boundary windows
    "chart_month",  # calendar bucket
    "sigma_tails",  # folds, tails, merged sigma
    "tails_percent",  # percent threshold, ordered tails
    "other_group",  # categorical Other
    "group_cap",  # 2,000+ groups, top-k cap
    "geo_unit",  # unit summary with coordinates
    "geo_boundary_join",  # boundary join + quantile colours
    "profile_kinds",  # profile: kinds, ranges, std sample
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=cpus)
    names = [n for n in HEADLINE if n in registry.QUERIES]
    # Warm-up pass: JVM class loading, JIT and first footer reads are not query time.
    cold: dict[str, float] = {}
    for name in names:
        t0 = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).collect()
        cold[name] = round(time.perf_counter() - t0, 3)
    # Timed: the faster of two passes per query (local scheduling noise is +-20 %).
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    timings: dict[str, float] = {}
    rows: dict[str, int] = {}
    for _ in range(max(1, repeats)):
        for name in names:
            t0 = time.perf_counter()
            result = registry.QUERIES[name](spark, sf_dir).collect()
            elapsed = round(time.perf_counter() - t0, 3)
            timings[name] = min(elapsed, timings.get(name, elapsed))
            rows[name] = len(result)
    match = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_total_sec",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "rows": rows,
        "cold_total_sec": round(sum(cold.values()), 3),
        "repeats": repeats,
        "sf": float(match.group(1)) if match else sf_dir,
        "cpus": cpus,
        "spark": spark.version,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
