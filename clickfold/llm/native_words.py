"""Word arrays as built-in column functions: no Python touches the rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickfold.llm.common import fold_ascii

#: Everything that is neither a digit, a letter a-z (after folding) nor beyond ASCII.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text after folding A-Z; no words for NULL."""
    split = F.split(fold_ascii(text), BETWEEN_WORDS)
    return F.coalesce(F.array_remove(split, ""), F.array().cast("array<string>"))


def neighbours(df: DataFrame, name: str, source: str, shift: int, combine: Callable[[Column, Column], Column]) -> DataFrame:
    """Column ``name``: each element of ``source`` combined with the one ``shift`` places on."""
    n = F.greatest(F.size(source) - shift, F.lit(0))
    return df.withColumn(name, F.zip_with(F.slice(source, 1, n), F.slice(source, F.lit(shift + 1), n), combine))
