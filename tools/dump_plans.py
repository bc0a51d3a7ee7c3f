"""Write PLANS.md: the final (AQE) physical plans of the central queries.

Raw tables are derived from the test folder once and written as Parquet (as in bench.py); each
query runs once over the files -- lazily, and over a bucketed materialised workspace -- and its
executed plan is recorded. Usage: ``python tools/dump_plans.py [sf_dir] > PLANS.md``.
"""

from __future__ import annotations

import os
import re
import sys
import uuid

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from clickfold.plans.catalog import QUERIES  # noqa: E402
from clickfold.plans.workspace import Workspace  # noqa: E402
from clickfold.session import build_session, scratch_path  # noqa: E402
from clickfold.sources.raw import read_raw  # noqa: E402
from clickfold.sources.schemas import RAW_SCHEMAS  # noqa: E402
from clickfold.sources.testdata import raw_tables  # noqa: E402

LAZY = ("stage_events", "dedupe_users", "cart_product_map", "stock_check", "repeat_rate", "revenue_by_source",
        "traffic_overview", "product_to_cart_by_category")
BUCKETED = ("cart_product_map", "abandonment_by_stock", "funnel_by_source")


def _clean(plan: str) -> str:
    plan = re.sub(r"#\d+L?", "", plan)            # expression ids
    plan = re.sub(r", \[plan_id=\d+\]", "", plan)
    plan = re.sub(r"Location: [^,]+, ", "", plan)
    plan = re.sub(r"clickfold_[0-9a-f]{12}_", "clickfold_<run>_", plan)
    return "\n".join(line[:180] for line in plan.splitlines())


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("local[8]", 8, app="clickfold-plans")
    root = scratch_path(spark, f"plans-raw-{uuid.uuid4().hex[:8]}")
    raw = raw_tables(spark, sf_dir)
    for name in RAW_SCHEMAS:
        getattr(raw, name).repartition(8).write.mode("overwrite").parquet(os.path.join(root, name))
    lazy = Workspace(read_raw(spark, root))
    bucketed = Workspace(read_raw(spark, root)).materialize(buckets=8)

    print("# Physical plans\n")
    print(f"Final adaptive plans of the central queries over raw Parquet files derived from `{sf_dir}`,")
    print("generated by `tools/dump_plans.py` (expression ids and file locations removed).\n")
    for title, ws, keys in (("Lazy workspace over raw files", lazy, LAZY),
                            ("Bucketed materialised workspace (`materialize(buckets=8)`)", bucketed, BUCKETED)):
        print(f"## {title}\n")
        for key in keys:
            df = QUERIES[key](ws)
            df.collect()  # executes this DataFrame's own plan, so AQE's final plan is recorded
            plan = df._jdf.queryExecution().executedPlan().toString()
            print(f"### `{key}`\n\n```\n{_clean(plan)}\n```\n")
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
