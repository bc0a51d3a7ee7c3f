"""Column expressions that pin down the reference's SQL semantics once.

All helpers return ``Column`` objects built from Spark built-ins, so they stay inside
whole-stage codegen; none of them is a Python UDF.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

ColumnOrName = Column | str

# Fixed values from the reference.
UTC_SUFFIX = " UTC"
INVALID_ORDER_STATUSES = ("Cancelled", "Returned")
EPOCH_NTZ = "1970-01-01 00:00:00"

# Gap classes of the order-gap check, upper bounds in seconds (exclusive) and labels.
GAP_BOUNDS = (60, 3600, 86400)
GAP_LABELS = ("< 1 minute", "1 minute - 1 hour", "1 hour - 1 day")
GAP_OTHERWISE = "> 1 day"
# Minimum gap (seconds) between two orders of a user for the later one to count.
MIN_ORDER_GAP_SECONDS = 60

# Retail price tiers: upper bounds (exclusive), analysis labels, view labels, view sort keys.
PRICE_BOUNDS = (25, 50, 100)
PRICE_TIER_LABELS = ("1. < $25", "2. $25 - $50", "3. $50 - $100")
PRICE_TIER_OTHERWISE = "4. >= $100"
VIEW_PRICE_TIER_LABELS = ("< $25", "$25 - $50", "$50 - $100")
VIEW_PRICE_TIER_OTHERWISE = ">= $100"
PRICE_TIER_SORT = (1, 2, 3)
PRICE_TIER_SORT_OTHERWISE = 4

# Stock status labels.
IN_STOCK = "In stock"
OUT_OF_STOCK = "Out of stock"

# Default minimum number of abandoned out-of-stock cart rows for a category to be reported.
REVENUE_AT_RISK_MIN_ROWS = 200

# Spark collation with the comparison rules of SQL Server's default collations (S5, S6): equality,
# IN, GROUP BY, MAX and REPLACE ignore case and trailing blanks.
TSQL_COLLATION = "UTF8_LCASE_RTRIM"


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_utc_ts(text: ColumnOrName) -> Column:
    """``TRY_CAST(REPLACE(x, ' UTC', '') AS DATETIME2)`` -> TIMESTAMP_NTZ, NULL when unparsable.

    Deliberate divergence (S3): an empty string is missing (NULL), not 1900-01-01.
    Sub-microsecond digits are cut, as Spark timestamps hold microseconds.
    """
    return F.replace(_col(text), F.lit(UTC_SUFFIX), F.lit("")).try_cast("timestamp_ntz")


def seconds_between(start: ColumnOrName, end: ColumnOrName) -> Column:
    """``DATEDIFF(SECOND, start, end)``: the number of second *boundaries* crossed.

    00:00:00.9 -> 00:01:00.1 is 60, not 59. Computed as the difference of whole seconds since
    1970, rounded down, on TIMESTAMP_NTZ, so the session zone and DST play no part.
    """
    epoch = F.lit(EPOCH_NTZ).cast("timestamp_ntz")
    whole = lambda t: F.timestamp_diff("SECOND", epoch, F.date_trunc("SECOND", _col(t)))
    return whole(end) - whole(start)


def rate(numerator: ColumnOrName, denominator: ColumnOrName) -> Column:
    """``CAST(num AS FLOAT) / NULLIF(den, 0)``: a double, NULL when the denominator is 0."""
    return _col(numerator).cast("double") / F.nullif(_col(denominator), F.lit(0))


def bucketize(value: ColumnOrName, bounds: Sequence, labels: Sequence, otherwise) -> Column:
    """Searched CASE over ascending exclusive upper bounds; NULL falls to ``otherwise``."""
    v = _col(value)
    expr = None
    for bound, label in zip(bounds, labels, strict=True):
        expr = F.when(v < bound, F.lit(label)) if expr is None else expr.when(v < bound, F.lit(label))
    return expr.otherwise(F.lit(otherwise))


def gap_bucket(gap_seconds: ColumnOrName) -> Column:
    return bucketize(gap_seconds, GAP_BOUNDS, GAP_LABELS, GAP_OTHERWISE)


def price_tier(price: ColumnOrName) -> Column:
    return bucketize(price, PRICE_BOUNDS, PRICE_TIER_LABELS, PRICE_TIER_OTHERWISE)


def view_price_tier(price: ColumnOrName) -> Column:
    return bucketize(price, PRICE_BOUNDS, VIEW_PRICE_TIER_LABELS, VIEW_PRICE_TIER_OTHERWISE)


def view_price_tier_sort(price: ColumnOrName) -> Column:
    return bucketize(price, PRICE_BOUNDS, PRICE_TIER_SORT, PRICE_TIER_SORT_OTHERWISE)


def flag(condition: Column) -> Column:
    """``CASE WHEN cond THEN 1 ELSE 0 END`` as an int (NULL condition -> 0)."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def event_flag(event_type: str, column: str = "event_type") -> Column:
    return flag(F.col(column) == F.lit(event_type))


def valid_order(status: ColumnOrName = "status") -> Column:
    """``status NOT IN ('Cancelled','Returned')``; a NULL status is not valid."""
    return ~_col(status).isin(*INVALID_ORDER_STATUSES)


def money_sum(price: ColumnOrName) -> Column:
    """Exact decimal sum, emitted as double."""
    return F.sum(_col(price)).cast("double")


def money_total(amount: ColumnOrName) -> Column:
    """Re-aggregate money already emitted as double (e.g. revenue per source) exactly.

    Each input is a cent amount rounded once to double, so casting back to DECIMAL(38,2) recovers
    it; the sum is then exact and independent of summation order, and is emitted as double.
    """
    return F.sum(_col(amount).cast("decimal(38,2)")).cast("double")


def money_avg(price: ColumnOrName) -> Column:
    """``AVG(price)`` as double(sum) / count of non-NULL prices."""
    return F.sum(_col(price)).cast("double") / F.nullif(F.count(_col(price)), F.lit(0))


def stock_status(level: ColumnOrName) -> Column:
    """``CASE WHEN ISNULL(level, 0) > 0 THEN 'In stock' ELSE 'Out of stock' END``."""
    return F.when(F.coalesce(_col(level), F.lit(0)) > 0, F.lit(IN_STOCK)).otherwise(F.lit(OUT_OF_STOCK))


def collate_strings(df: DataFrame, collation: str | None) -> DataFrame:
    """Give every string column of a raw table ``collation`` (no-op for ``None``).

    With :data:`TSQL_COLLATION` all later comparisons, groupings and joins on these columns --
    event types, statuses, sources, e-mails, session ids -- behave as under SQL Server's default
    collation, and ``' UTC'`` is stripped whatever its case. Values keep their original text.
    """
    if not collation:
        return df
    return df.select(*[F.collate(F.col(f.name), collation).alias(f.name) if isinstance(f.dataType, StringType)
                       else F.col(f.name) for f in df.schema.fields])
