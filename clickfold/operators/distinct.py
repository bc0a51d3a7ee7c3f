"""Several ``COUNT(DISTINCT ...)`` of one grouping in two levels of plain aggregation.

Spark plans two distinct counts beside each other as an ``Expand``: every row is written once for each
of them and once more for the other aggregates, before any row has been combined. Here the rows are
first reduced to one per (keys, counted columns), which combines map-side, and each count regroups these
reduced rows by its own column. The counts share that first exchange, and a hot key is spread over
as many tasks as its counted columns have values.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_counts(df: DataFrame, keys: Sequence[str], counted: Mapping[str, str],
                    totals: Mapping[str, Column]) -> DataFrame:
    """Per ``keys``: for each ``{name: column}`` of ``counted`` the number of distinct non-NULL values, and the sum
    of each of ``totals``, which are aggregates over the rows that agree in the keys and all counted columns.

    NULL keys form a group; a sum over NULLs only stays NULL.
    """
    def grouped(rows: DataFrame, columns: Sequence[str], aggregates: list[Column]) -> DataFrame:
        return rows.groupBy(*columns).agg(*aggregates) if aggregates else rows.select(*columns).distinct()

    reduced = grouped(df, [*keys, *dict.fromkeys(counted.values())], [c.alias(n) for n, c in totals.items()])
    names = list(counted)

    def side(name: str) -> DataFrame:
        # Every side carries the totals, so all of them read the same exchange; the first side's count.
        per_value = grouped(reduced, [*keys, counted[name]], [F.sum(t).alias(t) for t in totals])
        return per_value.select(*keys, F.lit(name).alias("__side"), F.col(counted[name]).isNotNull().alias("__counts"), *totals)

    at = F.col("__side")
    sides = reduce(DataFrame.unionByName, map(side, names))
    return sides.groupBy(*keys).agg(
        *(F.count(F.when((at == n) & F.col("__counts"), 1)).alias(n) for n in names),
        *(F.sum(F.when(at == names[0], F.col(t))).alias(t) for t in totals))
