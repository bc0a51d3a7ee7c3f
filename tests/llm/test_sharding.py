from __future__ import annotations

import collections
import hashlib
import heapq
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_helpers import ODD
from pyspark.sql import functions as F

from clickfold.llm import sharding
from clickfold.llm.queries import op12_sharding


def by_heap(sizes, shards):
    """The shards of every size's groups, largest first: one group after the other, then sorted."""
    heap, out = [(0, i) for i in range(shards)], []
    for size, count in sorted(sizes, reverse=True):
        out.append([])
        for _ in range(count):
            load, i = heapq.heappop(heap)
            out[-1].append(i)
            heapq.heappush(heap, (load + size, i))
    return [sorted(x) for x in out]


def loads(sizes, shards, found):
    total = [0] * shards
    for size, ends, to in found:
        for start, end, i in zip([0, *ends], ends, to):
            total[i] += size * (end - start)
    return total


@settings(max_examples=200, deadline=None)
@given(sizes=st.dictionaries(st.integers(1, 400), st.integers(1, 60), max_size=12), shards=st.integers(1, 17))
def test_schedule_is_that_of_a_heap(sizes, shards):
    found = sharding.schedule(list(sizes.items()), shards)
    assert [[i for s, e, i in zip([0, *ends], ends, to) for _ in range(e - s)] for _, ends, to in found] == by_heap(sizes.items(), shards)


@settings(max_examples=200, deadline=None)
@given(start=st.lists(st.integers(0, 500), min_size=1, max_size=9), size=st.integers(1, 90), count=st.integers(0, 300))
def test_many_groups_at_once_are_those_of_a_heap(start, size, count):
    heap, taken = [(x, i) for i, x in enumerate(start)], [0] * len(start)
    heapq.heapify(heap)
    for _ in range(count):
        load, i = heapq.heappop(heap)
        taken[i] += 1
        heapq.heappush(heap, (load + size, i))
    assert sharding._at_once(start, size, count) == taken


def test_large_counts_keep_the_loads():
    sizes = [(7, 100_000), (1_000_000, 1), (3, 1_000), (1, 1)]
    found = sharding.schedule(sizes, 4)
    total = loads(sizes, 4, found)
    assert sum(total) == sum(s * n for s, n in sizes) and total[0] == 1_000_000


def brute(rows, shards):
    """One (id, size, crc, shard, slot) for every row."""
    digest = lambda t: hashlib.sha256((t or "").encode()).digest()
    size = lambda t: len((t or "").encode()) + 1
    groups = collections.Counter()
    for _, t in rows:
        groups[digest(t)] += size(t)
    shard = {}
    sizes = collections.Counter(groups.values())
    for n, places in zip(sorted(sizes, reverse=True), by_heap(sizes.items(), shards)):
        shard |= zip(sorted(d for d, m in groups.items() if m == n), places)
    out, slots = [], collections.Counter()
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, digest(r[1]))):
        k = shard[digest(t)]
        out.append((i, size(t), zlib.crc32((t or "").encode()), "bytes", k, slots[k], None))
        slots[k] += 1
    return sorted(out, key=str)


COLUMNS = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def collected(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def test_whole_table(spark, sf, corpus):
    got = collected(op12_sharding(spark, sf))
    assert got == brute(corpus, 16)
    by_shard = collections.Counter()
    for _, size, _, _, shard, _, _ in got:
        by_shard[shard] += size
    assert max(by_shard.values()) - min(by_shard.values()) < 400


@pytest.mark.parametrize("shards", [1, 3, 16])
def test_odd_rows_hot_groups_and_clashing_columns(docs, shards):
    rows = ODD + [(100 + i, "a text that a third of the rows share") for i in range(40)] + [(9, "same id")] * 30 + [(None, None)] * 3
    table = docs(rows)
    for name in ("size", "shard", "slot", "digest", "total", "part", "place", "row", "id"):
        table = table.withColumn(name, F.lit("x"))
    got = collected(sharding.shard(table, shards))
    assert got == brute(rows, shards)
    for k in range(shards):
        slots = sorted(r[5] for r in got if r[4] == k)
        assert slots == list(range(len(slots)))


def test_many_groups_of_one_size(docs):
    rows = [(i, f"{i:06d}") for i in range(3000)] + [(10_000, "long " * 300)]
    got = collected(sharding.shard(docs(rows), 4))
    assert got == brute(rows, 4)


def test_no_rows(docs):
    assert sharding.shard(docs([]), 16).collect() == []
