from __future__ import annotations

import hashlib
import random

import pytest
from llm_helpers import ODD

from clickfold.llm import suffixes


def plain(rows, length):
    """What is left of each text, by looking every window up in a dictionary."""
    first = {}
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        for s in range(len(text) - length + 1):
            first.setdefault(text[s:s + length], (i, s))
    out = {}
    for i, text in rows:
        gone = bytearray(len(text))
        for s in range(len(text) - length + 1):
            if first[text[s:s + length]] != (i, s):
                gone[s:s + length] = b"\1" * length
        spans = sum(g and (p == 0 or not gone[p - 1]) for p, g in enumerate(gone))
        out[i] = (len(text), sum(gone), spans, bytes(c for c, g in zip(text, gone, strict=True) if not g))
    return out


def test_whole_table_against_brute_force(spark, sf, corpus):
    from clickfold.llm.queries import op4_suffix_dedup
    want = plain([(i, (t or "").encode()) for i, t in corpus], 100)
    got = op4_suffix_dedup(spark, sf).collect()
    assert len(got) == len(corpus) and sum(r.n_removed for r in got) > 0
    for r in got:
        size, gone, spans, kept = want[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (size, gone, spans, hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("hot,letters,seed", [(100_000, "ab", 1), (3, "ab", 2), (1, "abcd\0 ", 3), (100_000, "a", 4), (40, "abé", 5)])
def test_small_alphabets(docs, monkeypatch, hot, letters, seed):
    monkeypatch.setattr(suffixes, "STARTS_AT_ONCE", 700)
    rng = random.Random(seed)
    make = lambda n: "".join(rng.choice(letters) for _ in range(n))
    shared = [make(90), make(25), make(300)]
    rows = []
    for i in range(60):
        text = make(rng.randrange(80)) + rng.choice(shared)[rng.randrange(20):] + make(rng.randrange(9)) + rng.choice(shared)
        rows.append((i, text))
    rows += [(100 + i, shared[2]) for i in range(30)] + [(200, make(3000)), (201, None)]
    want = plain([(i, (t or "").encode()) for i, t in rows], 20)
    got = suffixes.remove_repeats(docs(rows), length=20, gram=6, hot=hot, unit_docs=13).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got} == want


def test_odd_rows(docs):
    got = suffixes.remove_repeats(docs([*ODD, (9, "x" * 150), (9, "x" * 150), (None, "x" * 150)])).collect()
    assert len(got) == len(ODD) + 3
    assert all(r.n_bytes == 0 for r in got if r.doc_id in (1, 2))
    # The first of the equal rows keeps its first 100 bytes: every later window repeats.
    runs = sorted((r.doc_id is None, r.n_removed) for r in got if r.n_bytes == 150)
    assert runs == [(False, 149), (False, 150), (True, 150)]
    assert suffixes.remove_repeats(docs([])).count() == 0


def test_merge_carries_shared_prefixes():
    rng = random.Random(9)
    for k in (1, 2, 3, 7, 8):
        runs, everything = [], []
        for _ in range(k):
            items = sorted(bytes(rng.choice(b"ab\0") for _ in range(rng.randrange(1, 12))) for _ in range(rng.randrange(1, 30)))
            everything += items
            shared = [suffixes.shared_prefix(a, b, 0) for a, b in zip([b"", *items], items)]
            runs.append((items, suffixes.Run(shared, [len(t) - n for t, n in zip(items, shared)],
                                             b"".join(t[n:] for t, n in zip(items, shared)))))
        order, shared = suffixes.merge([r for _, r in runs])
        heads = [iter(items) for items, _ in runs]
        merged = [next(heads[r]) for r in order]
        assert merged == sorted(everything)
        assert shared == [suffixes.shared_prefix(a, b, 0) for a, b in zip([b"", *merged], merged)]
