"""Benchmark: every query key on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1), ``local[$BENCH_CPUS]``.

Setup (timed apart, ``load_raw_sec``): the six raw commerce tables are derived from the test tables
by Spark and written as Parquet into a fresh folder under ``spark.checkpoint.dir`` -- the form in
which raw tables arrive in production. Then for each key: a new Workspace over those files, the
query executed into Spark's ``noop`` sink (nothing collected), one warm-up and the median of three
runs. Every run builds its DataFrames anew, so no run reuses another's shuffle files.

Prints one JSON line on stdout; progress goes to stderr.
Environment: BENCH_SF_DIR, BENCH_CPUS, BENCH_RUNS (default 3), BENCH_KEYS (comma list, default all),
BENCH_REFRESH (default 1: also time the dashboard refresh job, reported as ``dashboard_refresh_sec``).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
import uuid

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from clickfold.plans.catalog import QUERIES  # noqa: E402
from clickfold.plans.workspace import Workspace  # noqa: E402
from clickfold.session import build_session, scratch_path  # noqa: E402
from clickfold.sources.raw import read_raw  # noqa: E402
from clickfold.sources.schemas import RAW_SCHEMAS  # noqa: E402
from clickfold.sources.testdata import raw_tables  # noqa: E402


def log(*args):
    print(*args, file=sys.stderr, flush=True)


def main() -> int:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    keys = [k for k in os.environ.get("BENCH_KEYS", "").split(",") if k] or list(QUERIES)
    spark = build_session(f"local[{cpus}]", cpus, app="clickfold-bench",
                          extra={"spark.driver.memory": "16g"})

    raw_root = scratch_path(spark, f"bench-raw-{uuid.uuid4().hex[:8]}")
    t0 = time.time()
    raw = raw_tables(spark, sf_dir)
    for name in RAW_SCHEMAS:
        # A few files per table so scans are split across the cores, as a landing folder would be.
        getattr(raw, name).repartition(cpus).write.mode("overwrite").parquet(os.path.join(raw_root, name))
    load_raw = time.time() - t0
    log(f"raw tables written to {raw_root} in {load_raw:.2f}s")

    def run_once(key: str) -> float:
        start = time.time()
        ws = Workspace(read_raw(spark, raw_root))
        QUERIES[key](ws).write.format("noop").mode("overwrite").save()
        return time.time() - start

    results, failed = {}, []
    for key in keys:
        try:
            run_once(key)  # warm-up: JIT, codegen caches, file listing
            times = [run_once(key) for _ in range(runs)]
        except Exception as exc:  # noqa: BLE001 - one failing key must not lose the others' timings
            failed.append(key)
            results[key] = None
            log(f"{key:38s} FAILED: {type(exc).__name__}: {str(exc)[:300]}")
            continue
        results[key] = round(statistics.median(times), 3)
        log(f"{key:38s} {results[key]:.3f}s  runs={[round(t, 3) for t in times]}")

    # The production pattern: stage and derive once, then every published view from the files.
    refresh_sec = None
    if os.environ.get("BENCH_REFRESH", "1") == "1":
        from clickfold.plans.refresh import refresh
        start = time.time()
        refresh(spark, raw_root, scratch_path(spark, f"bench-views-{uuid.uuid4().hex[:8]}"))
        refresh_sec = round(time.time() - start, 3)
        log(f"dashboard refresh (materialise + 12 views) {refresh_sec:.3f}s")

    total = round(sum(v for v in results.values() if v is not None), 3)
    print(json.dumps({
        "metric": "sum_of_median_query_seconds",
        "value": total,
        "unit": "sec",
        "queries": results,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": cpus,
        "runs": runs,
        "load_raw_sec": round(load_raw, 3),
        "dashboard_refresh_sec": refresh_sec,
        "failed": failed,
    }))
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
