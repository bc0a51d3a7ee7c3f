"""Dashboard refresh job: raw files -> staged and derived tables -> the twelve published views.

The reference runs its preprocessing script, its analysis script (which creates the derived
tables) and its view script in that order, and a BI tool reads the views. The Spark job does the
same in one session:

1. read the raw tables (explicit schemas, any batch format);
2. materialise staged and derived tables once into the shared checkpoint folder (cluster-wide
   storage, so a lost executor never recomputes the chain), in files by range of key and order;
3. compute each ``vw_*`` from the written tables and write it as Parquet under a new version of
   ``out_dir`` (small aggregates; ``coalesce(1)`` keeps one file each), and register it as a temp view.

Both steps replace what the run before wrote for the same folders: one copy is left, and a run that
fails leaves the earlier one (:mod:`clickfold.plans.publish`).

Usage: ``spark-submit --py-files clickfold.zip tools/refresh.py <raw_dir> <out_dir> [format] [key=value ...]``;
``key=value`` are reader options. Master, memory and partition counts are the cluster's: the job sets none.
"""

from __future__ import annotations

import os
import sys
import zlib

from pyspark.sql import SparkSession

from clickfold.plans.catalog import VIEWS
from clickfold.plans.publish import publish
from clickfold.plans.workspace import Workspace
from clickfold.session import BASE_CONF, scratch_path
from clickfold.sources.raw import read_raw


def refresh(spark: SparkSession, raw_dir: str, out_dir: str, fmt: str = "parquet",
            options: dict | None = None, buckets: int | None = None) -> dict[str, str]:
    """Path of every view. ``buckets``: write bucketed tables of so many buckets instead of key ranges, if
    no key is hot (see :meth:`Workspace.materialize`); :func:`bucket_count` suggests a number."""
    of_run = f"{zlib.crc32(raw_dir.rstrip('/').encode()):08x}"
    ws = Workspace(read_raw(spark, raw_dir, fmt, options)).replace(scratch_path(spark, f"refresh-{of_run}"), buckets=buckets)

    def write(folder: str) -> dict[str, str]:
        written = {}
        for name, query in VIEWS.items():
            written[name] = os.path.join(folder, name)
            query(ws).coalesce(1).write.mode("overwrite").parquet(written[name])
        return written

    written = publish(spark, out_dir, write)
    for name, path in written.items():
        spark.read.parquet(path).createOrReplaceTempView(name)
    return written


def bucket_count(spark: SparkSession) -> int:
    """The session's shuffle partitions, at most half of what Spark allows (``spark.sql.sources.bucketing.maxBuckets``)."""
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000"))
    return max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), most // 2))


def main(argv: list[str]) -> int:
    if len(argv) < 3:
        print(__doc__, file=sys.stderr)
        return 2
    plain = [a for a in argv[3:] if "=" not in a]
    options = dict(a.split("=", 1) for a in argv[3:] if "=" in a)
    spark = SparkSession.builder.appName("clickfold-refresh").getOrCreate()
    for key in ("spark.sql.session.timeZone", "spark.sql.ansi.enabled"):  # what results depend on
        spark.conf.set(key, BASE_CONF[key])
    for name, path in refresh(spark, argv[1], argv[2], plain[0] if plain else "parquet", options).items():
        print(name, path)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
