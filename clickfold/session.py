"""Session construction and cluster settings.

The library never hard-codes a machine-local folder: materialised tables go under the shared
folder named by ``spark.checkpoint.dir``. Only when that setting is absent (unit tests, a laptop)
do we fall back to a fresh temporary folder.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job here relies on.
#  * session time zone UTC: all timestamps are TIMESTAMP_NTZ, but the zone must not leak into
#    formatting or epoch arithmetic;
#  * ANSI on (the Spark 4 default) so that bad input surfaces unless we ask for try_cast;
#  * AQE with partition coalescing and skew-join splitting, so shuffle sizes adapt at run time;
#  * broadcast joins are chosen by AQE from measured sizes only (no unchecked hints).
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.exchange.reuse": "true",
    "spark.ui.enabled": "false",
}


def cluster_conf(input_bytes: int, total_cores: int, partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Shuffle and scan sizing for a cluster run over ``input_bytes`` of raw data.

    Initial shuffle partitions ~ one per ``partition_bytes`` of input (at least 2 per core), so a
    reducer's share of the largest shuffle -- the events by session -- stays in memory-friendly
    pieces; AQE then coalesces small partitions to the same advisory size and splits skewed join
    partitions. Scans split files into 128 MB pieces. At 100 TB on 8,000 cores this gives ~400k
    initial partitions, coalesced at run time.
    """
    partitions = max(2 * total_cores, -(-input_bytes // partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        "spark.sql.files.maxPartitionBytes": str(128 << 20),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * partition_bytes),
    }


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "clickfold",
                  extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "8g")
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for materialised tables: the cluster's ``spark.checkpoint.dir``.

    Set a private temporary one only when the session has none and runs in local mode (tests);
    on a cluster a machine-local folder would lose data with its executor, so that is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if configured:
        if not current:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/...) for this cluster")
    local = tempfile.mkdtemp(prefix="clickfold-ckpt-")
    spark.sparkContext.setCheckpointDir(local)
    spark.conf.set("spark.checkpoint.dir", local)
    return local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A table location inside the shared checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), "clickfold", name)
