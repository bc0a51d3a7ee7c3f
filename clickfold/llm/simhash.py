"""SimHash near-duplicates through an inverted index of positional bytes.

A fingerprint's eight bytes at their positions are its terms. Two fingerprints that differ in at
most three bits share at least five of the eight, whatever the three bits are. That guaranteed
minimum is the count filter, and the index is built so that the count is met on entry: its posting
lists belong to five positions and their five bytes (56 choices of positions, 40 bits of key), so
each pair with a tally of five or more meets in a list and no other pair does. Inside a list the
members differ in three bytes only; their bits are compared and pairs over the limit go.

A list links its members without writing out pairs: it gives the links of a spanning forest. At
most 2**24 fingerprints can share five bytes, and a list of many members looks up the 2,324 ways
to flip up to three of its 24 free bits, so its work is linear in its members.

Equal fingerprints are one member from the start, so exact copies cost one row per task before
any shuffle. Components come from ``graph.components``.

Defined cases: NULL and empty texts have fingerprint zero and link like any other; a NULL id never
names a component (NULL only if all members' ids are NULL); repeated rows give repeated rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickfold.llm.common import folded_bytes, small_batches, stored, tidy
from clickfold.llm.graph import components

WORDS, BITS, SEED = 3, 3, 42
BYTES = 8
#: Above this many members a posting list looks flips up instead of comparing all with all.
COMPARE = 1024


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """64-bit majority vote over the XXH64 of all word shingles, repeats included."""
    tokens = folded_bytes(text or "").split()
    if not tokens:
        return 0
    shingles = [b" ".join(tokens[i:i + words]) for i in range(max(1, len(tokens) - words + 1))]
    votes = np.zeros(64, dtype=np.int64)
    for start in range(0, len(shingles), 1 << 16):
        part = [xxhash.xxh64_intdigest(s, SEED) for s in shingles[start:start + (1 << 16)]]
        bits = np.unpackbits(np.array(part, dtype=">u8").view(np.uint8)).reshape(-1, 64)
        votes += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(shingles)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(id, text_hash, fp): every row's fingerprint as a signed 64-bit integer."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("text_hash", T.LongType()),
                           T.StructField("fp", T.LongType())])

    def batches(it):
        for batch in it:
            fps = [fingerprint(t, words) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps, pa.int64())], [id_col, "text_hash", "fp"])

    return small_batches(docs.select(id_col, text_col, F.xxhash64(text_col).alias("text_hash"))).mapInArrow(tidy(batches), schema)


def _flips(free_bits: int, most: int) -> np.ndarray:
    """All ways to flip one to ``most`` of the low bits."""
    return np.array([sum(1 << b for b in c) for n in range(1, most + 1) for c in combinations(range(free_bits), n)],
                    dtype=np.uint64)


def _root(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def forest(members: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Index pairs of a spanning forest of the links (at most ``most`` differing bits) in a list."""
    parent, out = list(range(len(members))), []

    def link(left, right):
        for i, j in zip(left.tolist(), right.tolist(), strict=True):
            a, b = _root(parent, i), _root(parent, j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((i, j))

    if len(members) <= COMPARE:
        near = np.bitwise_count(members[:, None] ^ members[None, :]) <= most
        link(*np.nonzero(np.triu(near, 1)))
        return out
    # Pack the bits in which the members differ at all, then look every flip up.
    differ = int(np.bitwise_or.reduce(members ^ members[0]))
    places = [b for b in range(64) if differ >> b & 1]
    packed = np.zeros(len(members), dtype=np.uint64)
    for k, b in enumerate(places):
        packed |= (members >> np.uint64(b) & np.uint64(1)) << np.uint64(k)
    order = np.argsort(packed)
    sorted_ = packed[order]
    for flip in _flips(len(places), most):
        at = np.minimum(np.searchsorted(sorted_, sorted_ ^ flip), len(sorted_) - 1)
        hit = np.flatnonzero((sorted_[at] == sorted_ ^ flip) & (at > np.arange(len(at))))
        link(order[hit], order[at[hit]])
    return out


def near_pairs(distinct: DataFrame, most: int = BITS) -> DataFrame:
    """(a, b): links between different fingerprints of ``distinct`` (column fp) that connect all
    fingerprints reachable over at most ``most`` differing bits."""
    if not 0 <= most <= 3:
        raise ValueError("five equal bytes of eight are only guaranteed up to three differing bits")
    keys = []
    for k, positions in enumerate(combinations(range(BYTES), BYTES - 3)):
        mask = sum(0xFF << 8 * p for p in positions)
        mask -= (mask >> 63) << 64  # as a signed number
        keys.append(F.struct(F.lit(k).alias("at"), F.col("fp").bitwiseAND(F.lit(mask).cast("long")).alias("bytes")))
    # every row becomes 56: spread them first, however few bytes they are now
    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = (distinct.repartition(tasks, "fp").select("fp", F.explode(F.array(*keys)).alias("key"))
             .groupBy("key.at", "key.bytes").agg(F.collect_list("fp").alias("members"))
             .where(F.size("members") > 1).select("members"))
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def link(it):
        for batch in it:
            members = batch.column(0)
            values, offsets = members.flatten().to_numpy(), members.offsets.to_numpy()
            values = values.view(np.uint64)
            offsets = offsets - offsets[0]
            pairs = []
            for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                part = values[s:e]
                if e - s == 2:
                    if (int(part[0]) ^ int(part[1])).bit_count() <= most:
                        pairs.append((s, s + 1))
                else:
                    pairs += [(s + i, s + j) for i, j in forest(part, most)]
            index = np.array(pairs, dtype=np.int64).reshape(-1, 2)
            signed = values.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(signed[index[:, 0]]), pa.array(signed[index[:, 1]])], ["a", "b"])

    return lists.mapInArrow(tidy(link), schema)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    words: int = WORDS, most: int = BITS) -> DataFrame:
    """(id, fingerprint, component_id, text_hash, component) per row: component_id is the smallest id that
    can be reached over fingerprints with at most ``most`` differing bits; component is the smallest
    fingerprint there, which also names components without ids."""
    prints = stored(fingerprints(docs, id_col, text_col, words), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min(id_col).alias("least"))
    linked = components(near_pairs(distinct, most))
    reached = (distinct.join(linked, distinct["fp"] == linked["node"], "left")
               .select("fp", "least", F.coalesce("component", "fp").alias("component")))
    lowest = reached.groupBy("component").agg(F.min("least").alias("component_id"))
    by_print = reached.join(lowest, "component").select("fp", "component_id", "component")
    return (prints.join(by_print, "fp")
            .select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "text_hash", "component"))
