"""Helpers of the tests: raw tables from plain rows, a workspace over them, sorted result rows."""

from __future__ import annotations

from clickfold.plans.workspace import Workspace
from clickfold.sources.raw import RawTables
from clickfold.sources.schemas import RAW_SCHEMAS


def raw_df(spark, name, rows):
    schema = RAW_SCHEMAS[name]
    unknown = {k for r in rows for k in r} - set(schema.fieldNames())
    assert not unknown, f"unknown columns for {name}: {unknown}"
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in rows], schema)


def make_workspace(spark, **tables):
    raw = RawTables(**{name: raw_df(spark, name, tables.get(name, [])) for name in RAW_SCHEMAS})
    return Workspace(raw)


def rows(df, *cols):
    """Collected rows as sorted tuples of the given columns (all columns if none)."""
    cols = cols or tuple(df.columns)
    return sorted((tuple(r[c] for c in cols) for r in df.collect()),
                  key=lambda t: tuple((x is None, str(x)) for x in t))
