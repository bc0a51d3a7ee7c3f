from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from llm_helpers import ODD

from clickfold.llm import graph, simhash


def plain_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, most=3):
    """Smallest id reachable, by comparing all fingerprints with all."""
    distinct = sorted(set(prints.values()))
    parent = {f: f for f in distinct}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for i, f in enumerate(distinct):
        for g in distinct[i + 1:]:
            if (f ^ g).bit_count() <= most:
                parent[root(g)] = root(f)
    least = {}
    for d, f in prints.items():
        least[root(f)] = min(d, least.get(root(f), d))
    return {d: least[root(f)] for d, f in prints.items()}


def test_whole_table_against_brute_force(spark, sf, corpus):
    from clickfold.llm.queries import op2_simhash
    prints = {d: plain_fingerprint(t) for d, t in corpus}
    expected = plain_components(prints)
    got = op2_simhash(spark, sf).collect()
    assert len(got) == len(corpus)
    assert {r.doc_id: r.fingerprint for r in got} == {d: f"{f:016x}" for d, f in prints.items()}
    assert {r.doc_id: r.component_id for r in got} == expected


def test_odd_rows(docs):
    got = simhash.near_duplicates(docs(ODD)).collect()
    assert len(got) == len(ODD)
    blank = [r for r in got if r.fingerprint == "0" * 16]
    assert {r.doc_id for r in blank} == {1, 2, 3} and {r.component_id for r in blank} == {1}
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert simhash.near_duplicates(docs([])).count() == 0


@pytest.mark.parametrize("size", [40, 3000])
def test_forest_connects_like_all_pairs(size):
    rng = random.Random(size)
    base = rng.getrandbits(64)
    members = list({base ^ sum(1 << rng.randrange(24) for _ in range(rng.randrange(9))) for _ in range(size)})
    links = simhash.forest(np.array(members, dtype=np.uint64), 3)
    assert all((members[a] ^ members[b]).bit_count() <= 3 for a, b in links)
    want = plain_components(dict(enumerate(members)))
    got = list(range(len(members)))
    for a, b in links:
        low, high = sorted((simhash._root(got, a), simhash._root(got, b)))
        got[high] = low
    assert {i: simhash._root(got, i) for i in range(len(members))} == want
    assert len(links) < len(members)


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100), (200, 201), (201, 200), (None, 3)]
    got = dict(graph.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {200: 200, 201: 200}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
