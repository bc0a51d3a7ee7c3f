from __future__ import annotations

import collections
import hashlib

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_helpers import ODD
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from clickfold.llm import alignment
from clickfold.llm.queries import op13_alignment

A, B, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


class Libraries:
    """Both tokenizers as their own libraries run them, and token bytes from their own vocabularies."""

    def __init__(self):
        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        letters = alignment.byte_letters()
        self.a_bytes = {i: bytes(letters[c] for c in t) for t, i in self.a.get_vocab(with_added_tokens=False).items() if all(c in letters for c in t)}

    def b_bytes(self, i):
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def spans(self, text):
        """[(id, first byte, past the last)] of both."""
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        out = []
        for ids, size in ((a, lambda i: self.a_bytes[i]), (b, self.b_bytes)):
            if b"".join(map(size, ids)) != (" " + text).encode():
                return [], []
            at, found = 0, []
            for i in ids:
                found.append((i, at, at := at + len(size(i))))
            out.append(found)
        return out

    def aligned(self, text):
        """(n_a, n_b, n_groups, links, sha256), each pair of tokens compared with each."""
        a, b = self.spans(text) if text else ([], [])
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        groups = [",".join(str(i) for i, _, e in a if s < e <= t) + "|" + ",".join(str(i) for i, _, e in b if s < e <= t)
                  for s, t in zip([0, *ends], ends)]
        links = [(x, y) for x, s, e in a for y, f, g in b if s < g and f < e]
        return len(a), len(b), len(ends), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""


@pytest.fixture(scope="module")
def libraries():
    return Libraries()


def brute(libraries, rows):
    found = [(i, libraries.aligned(t or "")) for i, t in rows]
    count = collections.Counter(link for _, x in found for link in x[3])
    most = collections.Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return sorted(((i, *x[:3], len(x[3]), sum(count[k] == most[k[1]] for k in x[3]), sum(count[k] for k in x[3]), x[4]) for i, x in found),
                  key=str)


def collected(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def test_short_documents_of_the_table(spark, sf, corpus, libraries, docs):
    rows = [(i, t) for i, t in corpus if t is not None and len(t) < 700]
    assert len(rows) > 20
    assert collected(alignment.align(docs(rows), A, B, PATTERN)) == brute(libraries, rows)


def test_whole_table_against_the_libraries(spark, sf, corpus, libraries):
    got = {r.doc_id: r for r in op13_alignment(spark, sf).collect()}
    assert len(got) == len(corpus)
    for doc_id, text in corpus:
        a, b = libraries.spans(text) if text else ([], [])
        row = got[doc_id]
        shared = len({e for *_, e in a} & {e for *_, e in b})
        assert (row.n_a, row.n_b, row.n_groups, row.n_links) == (len(a), len(b), shared, len(a) + len(b) - shared)


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(max_size=40), min_size=1, max_size=4))
def test_any_texts_in_a_unit(texts):
    tokenizers, libraries = alignment.load(A, B, PATTERN), Libraries() if not hasattr(test_any_texts_in_a_unit, "kept") else test_any_texts_in_a_unit.kept
    test_any_texts_in_a_unit.kept = libraries
    unit = alignment.Unit(tokenizers, texts)
    start = 0
    for k, text in enumerate(texts):
        n_a, n_b, n_groups, links, sha = libraries.aligned(text)
        assert (unit.n_a[k], unit.n_b[k], unit.n_groups[k], unit.n_links[k], unit.groups[k]) == (n_a, n_b, n_groups, len(links), sha)
        part, start = unit.links[start:start + len(links)], start + len(links)
        assert sorted(part.tolist()) == sorted(x * len(tokenizers.b_bytes) + y for x, y in links)


def test_odd_rows_copies_and_clashing_columns(spark, docs, libraries):
    special = [(20, "a▁b"), (21, "<|endoftext|> <s></s> <unk>"), (22, "\u0000\u0007"), (23, "日本語 😀 naïve")] + [(30 + i, "the same words again") for i in range(9)]
    rows = [r for r in ODD if r[0] not in (7, 8)] + special
    table = docs(rows)
    for name in ("text_", "key", "id", "unit", "pair", "count", "n_a", "groups_sha256", "multiplicity"):
        table = table.withColumn(name, F.lit("x"))
    assert collected(alignment.align(table, A, B, PATTERN)) == brute(libraries, rows)
    assert collected(alignment.align(docs([(1, "a▁b")]), A, B, PATTERN)) == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_very_long_texts(docs, libraries):
    rows = [r for r in ODD if r[0] in (7, 8)]
    got = {r.doc_id: r for r in alignment.align(docs(rows), A, B, PATTERN).collect()}
    for doc_id, text in rows:
        a, b = libraries.spans(text)
        assert (got[doc_id].n_a, got[doc_id].n_b) == (len(a), len(b)) and got[doc_id].n_links > 0


def test_no_rows(docs):
    assert alignment.align(docs([]), A, B, PATTERN).collect() == []


def test_places_survive_packing():
    import numpy as np
    places = np.array([0, 1, 255, 256, 70_000, 2 ** 31, 3], dtype=np.int64)
    for part in (places, places[:0]):
        assert alignment._unpacked(alignment._packed(part), len(part)).tolist() == part.tolist()
