"""Readers for the six raw tables the analytics start from.

``RawTables`` is the hand-off point between a source (files on shared storage, or the test-table
mapping in :mod:`clickfold.sources.testdata`) and staging. Readers are lazy: nothing is scanned
until a metric is executed, and Catalyst prunes the columns and pushes the filters of whatever
metric runs into the scan.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from clickfold.sources.schemas import OPTIONAL_SCHEMAS, RAW_SCHEMAS


@dataclass(frozen=True)
class RawTables:
    events: DataFrame
    orders: DataFrame
    order_items: DataFrame
    users: DataFrame
    products: DataFrame
    inventory_events: DataFrame


class LazyRawTables:
    """The six raw tables, each built on first access (a query touching one table lists one folder)."""

    def __init__(self, loaders: dict[str, Callable[[], DataFrame]]):
        missing = set(RAW_SCHEMAS) - set(loaders)
        if missing:
            raise ValueError(f"no loader for {sorted(missing)}")
        self._loaders = loaders
        self._frames: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        loaders = self.__dict__.get("_loaders", {})
        if name not in loaders:
            raise AttributeError(name)
        if name not in self._frames:
            self._frames[name] = loaders[name]()
        return self._frames[name]


def read_raw(spark: SparkSession, root: str, fmt: str = "parquet", options: dict | None = None) -> LazyRawTables:
    """Read ``<root>/<table>`` for every raw table with its explicit schema.

    ``fmt`` is any Spark batch format (``parquet``, ``csv``, ``json``, ``orc``). Columns go by name in
    all of them: missing ones come back NULL, further ones stay, their order is free. Further columns that
    ``OPTIONAL_SCHEMAS`` knows get its types, others keep those of the files. CSV
    files are taken to have a header line; with ``options={"header": "false"}`` there are no names and
    the files must hold the schema's columns in its order.
    """
    options = {k.lower(): v for k, v in (options or {}).items()}

    def loader(name: str) -> Callable[[], DataFrame]:
        path, schema = os.path.join(root, name), RAW_SCHEMAS[name]
        optional = OPTIONAL_SCHEMAS.get(name)
        if fmt.lower() != "csv":
            return lambda: by_name(spark.read.format(fmt).options(**options).load(path), schema, optional)
        if str(options.get("header", "true")).lower() != "true":
            return lambda: spark.read.format(fmt).schema(schema).options(**options).load(path)
        # The header gives the names and everything is read as text, then cast to the schema.
        return lambda: by_name(spark.read.format(fmt).options(**{**options, "header": "true", "inferschema": "false"})
                               .load(path), schema, optional)

    return LazyRawTables({name: loader(name) for name in RAW_SCHEMAS})


def by_name(df: DataFrame, schema: StructType, optional: StructType | None = None) -> DataFrame:
    """The schema's columns, matched by name without regard to case, then all other columns of ``df``;
    those that ``optional`` names get its names and types.

    A column that already has its name and type is taken as it is: a cast or an alias that changes
    nothing would still keep Spark from seeing that two uses of the table are the same.
    """
    have = {c.lower(): c for c in df.columns}
    known = {f.name.lower(): f for f in (optional.fields if optional else ())}

    def column(field):
        name = have.get(field.name.lower())
        if name is None:
            return F.lit(None).cast(field.dataType).alias(field.name)
        found = F.col(f"`{name}`")
        if df.schema[name].dataType != field.dataType:
            return found.try_cast(field.dataType).alias(field.name)
        return found if name == field.name else found.alias(field.name)

    names = {f.name.lower() for f in schema.fields}
    others = [c for c in df.columns if c.lower() not in names]
    return df.select(*map(column, schema.fields),
                     *(column(known[c.lower()]) if c.lower() in known else F.col(f"`{c}`") for c in others))
