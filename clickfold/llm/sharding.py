"""Sharding by longest-processing-time scheduling.

Rows of equal text form a group that stays together. Groups go, largest first, to the shard that has
the least so far (the lowest-numbered of equals), which a heap of (load, shard) names. Groups of one
size are interchangeable: in the order of their texts' SHA-256 they fill the places that the heap gives
to their size, lower shards first.

1. Groups are sized by an aggregation that combines before its shuffle, then sorted by range over
   (size, digest) and written; their order in the files gives each its rank among groups of its size.
2. The schedule needs the sizes only: one entry for each *different* group size, with how many groups
   have it. Different positive sizes that sum to at most S bytes are fewer than sqrt(2 S) -- 0.25
   million for 30 GB, 14 million for 100 TB -- which bounds what comes to the driver. Many groups of one
   size are placed at once, with the result that the heap gives one by one.
3. A group's rank among those of its size tells its shard. Rows get it by a join on the digest (a group
   of a third of all rows is a skewed key of a plain join, which Spark splits).
4. Rows are sorted by range over (shard, id, digest) and written; the place in the files gives the
   gapless slot within the shard, so no task holds a shard.

Defined cases: NULL text has size 1 like the empty text and shares its group; repeated rows are rows of
one group with a slot each; NULL ids come last in their shard; other columns are ignored; an empty
table gives no rows. One group larger than an even share leaves its shard larger than the others,
as equal texts must not be parted.
"""

from __future__ import annotations

import heapq
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickfold.llm.common import stored

#: Up to so many groups of one size go through the heap one by one; the rest is placed at once.
ONE_BY_ONE = 256


def _at_once(loads: list[int], size: int, count: int) -> list[int]:
    """How many of ``count`` groups of ``size`` each shard takes, if each goes to the least loaded.

    Shard i is chosen at the loads loads[i], loads[i] + size, ...; the choices made are the ``count``
    smallest of all these, lower shards first among equals.
    """
    def below(load: int) -> list[int]:
        return [max(0, -(-(load - x) // size)) for x in loads]

    low, high = min(loads), max(loads) + size * count + 1  # the largest load with at most ``count`` choices below it
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if sum(below(mid)) <= count else (low, mid)
    taken = below(low)
    left = count - sum(taken)
    for i, x in enumerate(loads):
        if left and x <= low and (low - x) % size == 0:
            taken[i] += 1
            left -= 1
    return taken


def schedule(sizes: list[tuple[int, int]], shards: int) -> list[tuple[int, list[int], list[int]]]:
    """(size, ends, to) for every (size, count), largest first: of the groups of a size, those of rank below
    ``ends[0]`` go to shard ``to[0]``, further ones below ``ends[1]`` to ``to[1]``, and so on."""
    heap = [(0, i) for i in range(shards)]
    out = []
    for size, count in sorted(sizes, reverse=True):
        taken: dict[int, int] = {}
        if count > ONE_BY_ONE:
            loads = [load for _, load in sorted((i, load) for load, i in heap)]
            taken = {i: n for i, n in enumerate(_at_once(loads, size, count)) if n}
            heap = [(load + size * taken.get(i, 0), i) for i, load in enumerate(loads)]
            heapq.heapify(heap)
        else:
            for _ in range(count):
                load, i = heap[0]
                heapq.heapreplace(heap, (load + size, i))
                taken[i] = taken.get(i, 0) + 1
        to = sorted(taken)
        out.append((size, list(accumulate(taken[i] for i in to)), to))
    return out


def _numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """``df`` sorted by range and written, with the task that wrote a row and its place there."""
    return stored(df.repartitionByRange(*order).sortWithinPartitions(*order)
                  .withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id()}), name)


def shard(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard): every row's shard from 0 and its slot there.

    ``size`` is the UTF-8 length of the text plus 1; the law is ``bytes`` (shards of nearly equal size).
    ``grown_shard`` is NULL: one more shard would deal all groups anew.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = stored(docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                              F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("digest"),
                              F.monotonically_increasing_id().alias("row")), "shard-rows")
    groups = _numbered(rows.groupBy("digest").agg(F.sum("size").alias("total")),
                       [F.desc("total"), F.asc("digest")], "shard-groups")
    runs = groups.groupBy("total", "part").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    sizes = runs.groupBy("total").agg(F.sum("n").alias("n")).toArrow()
    found = schedule(list(zip(sizes["total"].to_pylist(), sizes["n"].to_pylist())), shards)
    columns = list(zip(*found)) or [[], [], []]
    spark = docs.sparkSession
    plan = spark.createDataFrame(pa.table({"total": pa.array(columns[0], pa.int64()), "ends": pa.array(columns[1], pa.list_(pa.int64())),
                                           "targets": pa.array(columns[2], pa.list_(pa.int32()))}))
    before = Window.partitionBy("total").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select("total", "part", (F.col("first") - F.coalesce(F.sum("n").over(before), F.lit(0))).alias("start"))
    rank = F.col("place") - F.col("start")
    turn = F.size(F.filter("ends", lambda end: end <= rank))
    placed = (groups.join(starts.join(plan, "total"), ["total", "part"])
              .select("digest", F.element_at("targets", turn + 1).alias("shard")))
    dealt = _numbered(rows.join(placed, "digest"), [F.asc("shard"), F.asc_nulls_last("id"), F.asc("digest"), F.asc("row")], "shard-slots")
    held = dealt.groupBy("shard", "part").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = held.select("shard", "part", (F.col("first") - F.coalesce(F.sum("n").over(before), F.lit(0))).alias("begin"))
    return dealt.join(begins, ["shard", "part"]).select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("place") - F.col("begin")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
