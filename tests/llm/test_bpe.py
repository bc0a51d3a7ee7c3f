from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from llm_helpers import ODD
from hypothesis import given, settings
from hypothesis import strategies as st

from clickfold.llm import bpe
from clickfold.llm.queries import op7_byte_bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load(PATH, PATTERN).vocabulary.rank,
                             special_tokens={})


def test_whole_table_equals_the_library(spark, sf, corpus, reference):
    got = {r.doc_id: r for r in op7_byte_bpe(spark, sf).collect()}
    assert len(got) == len(corpus)
    for doc_id, text in corpus:
        ids = reference.encode_ordinary(text or "")
        row = got[doc_id]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    encoder = bpe.load(PATH, PATTERN)
    known = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=encoder.vocabulary.rank, special_tokens={})
    ids = encoder.encode(text)
    assert ids == known.encode_ordinary(text) and encoder.decode(ids) == text.encode()


def test_append_and_edit_equal_encoding_anew():
    v, rng = bpe.load(PATH, PATTERN).vocabulary, random.Random(5)
    for _ in range(60):
        data = "".join(rng.choice("athein") for _ in range(rng.randrange(700))).encode()
        cut, stop = sorted(rng.randrange(len(data) + 1) for _ in range(2))
        grown = bpe.Prefixes(v, data[:cut])
        grown.append(data[cut:])
        assert grown.last == bpe.Prefixes(v, data).last
        new = b"xx th"[:rng.randrange(6)]
        grown.replace(cut, stop, new)
        assert grown.last == bpe.Prefixes(v, data[:cut] + new + data[stop:]).last
    long = bpe.Prefixes(v, b"the inner part " * 400)
    assert long.replace(10, 12, b"zz") < 2000


def test_odd_rows_and_separate_decoding(docs):
    table = docs(ODD)
    rows = bpe.round_trip(table, PATH, PATTERN, with_ids=True).collect()
    assert len(rows) == len(ODD)
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2)} == {0}
    back = bpe.decode(bpe.encode(table, PATH, PATTERN), PATH, PATTERN).collect()
    assert sorted(bytes(r.data) for r in back) == sorted((t or "").encode() for _, t in ODD)
    assert bpe.round_trip(docs([]), PATH, PATTERN).count() == 0


def test_an_append_only_looks_at_the_end(monkeypatch):
    """What an append computes and reads does not grow with the text."""
    v = bpe.load(PATH, PATTERN).vocabulary
    seen = []
    extend = bpe.Vocabulary.extend
    monkeypatch.setattr(bpe.Vocabulary, "extend", lambda self, data, last, base=0, until=None: (
        seen.append(len(data)), extend(self, data, last, base, until)))
    for size in (10, 1_000, 100_000):
        grown = bpe.Prefixes(v, b"the inner part " * size)
        seen.clear()
        for piece in (b"a", b"nd", b" so", b" forth"):
            grown.append(piece)
        assert max(seen) <= v.longest + 6
        assert grown.tokens() == v.encode(b"the inner part " * size + b"and so forth")


def test_stores_keep_what_is_used_and_stay_bounded():
    made = []
    store = bpe.Generations(10, lambda key: made.append(key) or -key)
    for i in range(1, 1000):
        assert store[i] == -i and store[7] == -7
        assert len(store) + len(store.old) <= 20
    assert made.count(7) == 1


def test_full_stores_change_nothing(monkeypatch, corpus, reference):
    encoder = bpe.Encoder(bpe.Vocabulary(reference._mergeable_ranks), PATTERN)
    encoder.pieces.size = encoder.vocabulary.follows.size = 50
    for _, text in corpus[:20]:
        assert encoder.encode(text or "") == reference.encode_ordinary(text or "")
