"""Helpers shared by the operators: written tables, batch slicing, byte tokenising."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickfold.session import scratch_path

#: A-Z and a-z, the only letters that the word rules fold.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet into the shared checkpoint folder and read it back.

    Cuts lineage durably: a lost executor costs a re-read, not the upstream work.
    """
    path = scratch_path(df.sparkSession, f"llm/{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session deals rows to Python in Arrow batches of at most 2,048 rows and about 8 MB.

    Texts are long: batches of Spark's own 10,000 rows take hundreds of MB on both sides of the pipe.
    """
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2048")
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return df


@lru_cache(maxsize=1)
def _trim():
    """glibc's malloc_trim, where there is one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):
        return lambda pad: 0


def give_back() -> None:
    """Return memory that this worker has freed to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    _trim()(0)


_KEPT: list = []


def own_cache(cached):
    """A cached function whose values a worker keeps over the tasks of the function's module only."""
    _KEPT.append(cached)
    return cached


def turn_to(module: str) -> None:
    """Drop what this worker has kept for tasks of other modules."""
    held = [c for c in _KEPT if c.__module__ != module and c.cache_info().currsize]
    for cached in held:
        cached.cache_clear()
    if held:
        give_back()


def tidy(function):
    """A function for mapInArrow that gives memory back when its task ends.

    Spark uses a Python worker again for the next stages; without this it keeps the most that any of its
    tasks had in use and every cache that an operator fills, and the stages of a pipeline add up.
    """
    module = function.__module__

    def run(batches):
        turn_to(module)
        try:
            yield from function(batches)
        finally:
            give_back()

    return run


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that ``df`` does not have, without regard to case: those wanted, with ``_`` added as needed."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def fold_ascii(text: Column) -> Column:
    """Lower-case A-Z only; other letters keep their case."""
    return F.translate(text, UPPER, LOWER)


def crc_share(doc_id: Column, parts: int) -> Column:
    """crc32 of the id's text, modulo ``parts``; NULL for a NULL id."""
    return F.crc32(doc_id.cast("string")) % F.lit(parts)


def runs_of(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Cut a list of text sizes into index ranges of at most ``most`` in total (one item at least)."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


# --- words of many texts at once -------------------------------------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(base: np.uint64, name: str, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        steps[0] = 1
        with np.errstate(over="ignore"):
            have = _POWERS[name] = np.multiply.accumulate(steps)
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xFF51AFD7ED558CCD)
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of data[starts:ends], for many ranges in one pass.

    A prefix sum of byte * base**position gives every range as a difference, which the inverse
    of base**start makes independent of its place.
    """
    n = len(data)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, "up", n), out=sums[1:])
        return mix64((sums[ends] - sums[starts]) * _powers(_INVERSE, "down", n + 1)[starts])


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20


def folded_bytes(text: str) -> bytes:
    """UTF-8 bytes with A-Z lower-cased (bytes.lower touches ASCII only)."""
    return text.encode("utf-8", "surrogatepass").lower()


def space_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` in a byte array."""
    word = np.concatenate(([False], ~_SPACE[data], [False]))
    edges = np.flatnonzero(word[1:] != word[:-1])
    return edges[::2], edges[1::2]
