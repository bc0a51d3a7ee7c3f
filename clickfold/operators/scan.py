"""Ordered scans per key -- running sum, forward fill, lag -- in one lazy plan for every size.

A plain window would hold a whole key in one task. Here a key is cut into grains of its leading order
column (an hour or day of a time, a stretch of sequence numbers), and the scan has two levels over
*one* exchange of the rows by (key, grain):

1. each (key, grain) is reduced, where its rows lie, to what the next grains need from it -- a sum, its
   last value, its last non-NULL value; a window over a key's grains turns that into the carry with
   which each grain starts;
2. the carry joins its grain as a first row, and the window runs within (key, grain).

Both levels read the same exchanged rows: whatever stands below the scan runs once, however deep scans
are nested. Spark reuses an exchange only between equal subtrees, so both levels ask for the same
columns, by a checksum of the row in a test that every row passes; without that, column pruning
would make two different exchanges of them (``tests/test_plans.py``).

So a key that holds a third of all rows is spread over its grains, nothing is sampled, counted or
collected, building the query runs no job, and no join is needed. The cost for small keys is one
aggregate row per (key, grain). Rows of one grain of one key do meet in a task: choose the grain so
that the densest one fits (rows that tie on the leading column cannot be told apart by order alone).

Tables that are bucketed by the key have all rows of a key in one task as they are read:
``clustered=True`` runs a plain window over them, with no exchange at all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SUM, FILL, LAG = "sum", "fill", "lag"

#: Sequence numbers of one grain.
STRETCH = 4096

_V, _G, _FIRST, _ALL = "__scan_value", "__scan_grain", "__scan_first", "__scan_all"


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence, value, out: str, unit: str = "HOUR",
                clustered: bool = False, keep: Sequence[str] | None = None) -> DataFrame:
    """``SUM(value) OVER (PARTITION BY keys ORDER BY order ROWS UNBOUNDED PRECEDING)``."""
    return keyed_scan(df, keys, order, value, out, SUM, unit, clustered=clustered, keep=keep)


def forward_fill(df: DataFrame, keys: Sequence[str], order: Sequence, value, out: str, unit: str = "HOUR",
                 clustered: bool = False, keep: Sequence[str] | None = None) -> DataFrame:
    """Last non-NULL ``value`` at or before each row, per key, in ``order``."""
    return keyed_scan(df, keys, order, value, out, FILL, unit, clustered=clustered, keep=keep)


def previous_value(df: DataFrame, keys: Sequence[str], order: Sequence, value, out: str, unit: str = "DAY",
                   clustered: bool = False, keep: Sequence[str] | None = None) -> DataFrame:
    """``LAG(value) OVER (PARTITION BY keys ORDER BY order)``."""
    return keyed_scan(df, keys, order, value, out, LAG, unit, clustered=clustered, keep=keep)


def _as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def grain(df: DataFrame, column: str, unit: str, stretch: int) -> Column:
    """A value that never falls as ``column`` rises: its hour or day, or its stretch of numbers."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.date_trunc(unit, F.col(column))
    if isinstance(kind, T.IntegralType):
        return F.floor(F.col(column) / F.lit(stretch))
    raise TypeError(f"cannot cut {column} ({kind.simpleString()}) into grains")


def keyed_scan(df: DataFrame, keys: Sequence[str], order: Sequence, value, out: str, kind: str,
               unit: str = "HOUR", stretch: int = STRETCH, clustered: bool = False,
               keep: Sequence[str] | None = None) -> DataFrame:
    """``df`` with the scan's result as ``out``. ``order`` starts with a column name (ascending); for
    fill and lag all of it must be columns in ascending order. ``clustered``: the rows of a key lie
    together already (a table bucketed by the key). ``keep``: the columns of ``df`` to go on with (all by
    default); they are exchanged with their rows whether the caller uses them or not."""
    if kind not in (SUM, FILL, LAG):
        raise ValueError(f"unknown scan kind {kind!r}")
    keys, columns = list(keys), list(df.columns if keep is None else keep)
    used = [*columns, *(o for o in order if isinstance(o, str) and o not in columns)]
    functions = {SUM: lambda v, rows, so_far: F.sum(v).over(so_far),
                 FILL: lambda v, rows, so_far: F.last(v, ignorenulls=True).over(so_far),
                 LAG: lambda v, rows, so_far: F.lag(v).over(rows)}
    if clustered:
        whole = Window.partitionBy(*keys).orderBy(*(_as_col(o) for o in order))
        result = functions[kind](_as_col(value), whole, whole.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return df.withColumn(out, result).select(*(c for c in columns if c != out), out)
    data = (df.withColumns({_V: _as_col(value), _G: grain(df, order[0], unit, stretch)})
            .repartition(*keys, _G))
    place = F.struct(*(_as_col(o) for o in order)) if kind != SUM else None
    if kind == SUM:
        last = F.sum(_V)
    elif kind == FILL:
        last = F.max_by(_V, F.when(F.col(_V).isNotNull(), place))
    else:
        last = F.max_by(_V, place)
    every = F.pmod(F.xxhash64(*used), F.lit(2)) < 2  # true, but asks for all columns; see above
    ends = (data.groupBy(*keys, _G).agg(last.alias(_V), F.bool_or(every).alias(_ALL))
            .where(_ALL).drop(_ALL))
    grains = Window.partitionBy(*keys).orderBy(_G)
    before = grains.rowsBetween(Window.unboundedPreceding, -1)
    carry = {SUM: lambda: F.sum(_V).over(before),
             FILL: lambda: F.last(_V, ignorenulls=True).over(before),
             LAG: lambda: F.lag(_V).over(grains)}[kind]()
    starts = (ends.withColumns({_V: carry, _FIRST: F.row_number().over(grains)})
              .where(F.col(_FIRST) > 1).withColumn(_FIRST, F.lit(0))
              .repartition(*keys, _G))  # like the rows, so that their union is still dealt by (key, grain)
    rows = data.withColumn(_FIRST, F.lit(1)).unionByName(starts, allowMissingColumns=True)
    within = Window.partitionBy(*keys, _G).orderBy(_FIRST, *(_as_col(o) for o in order))
    result = functions[kind](_V, within, within.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (rows.withColumn(out, F.when(every, result)).where(F.col(_FIRST) == 1)
            .select(*(c for c in columns if c != out), out))
