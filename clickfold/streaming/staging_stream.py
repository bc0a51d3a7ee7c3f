"""Incremental staging of raw files as they land, with Structured Streaming.

The reference has no stream: it stages finished tables. Its staging steps P1-P3 are narrow
projections, so the very same functions of
:mod:`clickfold.operators.staging` run unchanged on a file stream: new raw files in a landing
folder are typed and cleaned and appended to the staged table, exactly once, tracked by the
query's checkpoint in the shared checkpoint folder. P4 (an item may have to wait for its order) and
P5 (one account per e-mail, which needs all rows of it) stay batch steps; the metrics read the staged
tables as batch DataFrames.
"""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from clickfold.operators import staging
from clickfold.session import scratch_path
from clickfold.sources.raw import by_name
from clickfold.sources.schemas import OPTIONAL_SCHEMAS, RAW_SCHEMAS

STREAMABLE = {
    "events": staging.stage_events,
    "inventory_events": staging.stage_inventory_events,
    "orders": staging.stage_orders,
}


def read_landing(spark: SparkSession, table: str, landing_dir: str, fmt: str = "parquet",
                 max_files_per_trigger: int | None = None, options: dict | None = None) -> DataFrame:
    """The landing folder as a stream with the columns that a batch read gives (:func:`raw.by_name`).

    The columns are those of the files there when the stream starts, so that further ones are kept; a folder
    without files yet has the declared schema.
    """
    options = {"header": "true", "inferschema": "false"} | (options or {}) if fmt == "csv" else options or {}
    found = RAW_SCHEMAS[table]
    try:
        found = spark.read.format(fmt).options(**options).load(landing_dir).schema
    except AnalysisException as e:
        if e.getCondition() not in ("UNABLE_TO_INFER_SCHEMA", "PATH_NOT_FOUND"):
            raise
    reader = spark.readStream.format(fmt).options(**options).schema(found)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return by_name(reader.load(landing_dir), RAW_SCHEMAS[table], OPTIONAL_SCHEMAS.get(table))


def stage_stream(spark: SparkSession, table: str, landing_dir: str, staged_dir: str,
                 checkpoint_location: str | None = None, fmt: str = "parquet",
                 available_now: bool = True, processing_time: str | None = None) -> StreamingQuery:
    """Start a stream that stages ``table`` from ``landing_dir`` into Parquet at ``staged_dir``.

    With ``available_now`` the query processes what has landed and stops (a scheduled batch with
    exactly-once bookkeeping); otherwise it runs every ``processing_time``.
    """
    if table not in STREAMABLE:
        raise ValueError(f"{table} cannot be staged incrementally: its rows depend on rows that land later")
    staged = STREAMABLE[table](read_landing(spark, table, landing_dir, fmt))
    checkpoint_location = checkpoint_location or scratch_path(spark, os.path.join("streams", table))
    writer = (staged.writeStream.format("parquet")
              .option("path", staged_dir)
              .option("checkpointLocation", checkpoint_location)
              .outputMode("append"))
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()
