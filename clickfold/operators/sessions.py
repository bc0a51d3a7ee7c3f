"""Session rollups: ``MAX(CASE WHEN event_type = ... THEN 1 ELSE 0 END)`` per session key.

Every funnel, traffic and abandonment metric starts from flags per session at some grain. A
rollup is a hash aggregation: partial aggregation runs map-side, so a hot session reaches the
shuffle as one row per task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickfold.functions.semantics import event_flag

FUNNEL_STEPS = {"step_product": "product", "step_cart": "cart", "step_purchase": "purchase"}


def rollup(events_temp: DataFrame, keys: Sequence[str | Column], flags: Mapping[str, str],
           extra: Sequence[Column] = ()) -> DataFrame:
    """Group ``events_temp`` by ``keys``; one 0/1 column per ``{name: event_type}`` in ``flags``."""
    aggs = [F.max(event_flag(event_type)).alias(name) for name, event_type in flags.items()]
    return events_temp.groupBy(*keys).agg(*aggs, *extra)
