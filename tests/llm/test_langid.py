from __future__ import annotations

import zlib

from llm_helpers import ODD
from pyspark.sql import functions as F

from clickfold.llm import langid
from clickfold.llm.queries import op1_language_id


def test_held_out_accuracy(spark, sf):
    got = op1_language_id(spark, sf)
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = got.join(truth, "doc_id").collect()
    assert len(rows) == truth.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_bundles_against_one_trigram_at_a_time():
    import numpy as np
    texts = ["ab c", "the the, thé", ""]
    got = langid.bundles(texts, np.arange(3), 3, 64, 1)
    for text, row in zip(texts, got, strict=True):
        marks = [ord(c) if c.isalpha() else 0 for c in f" {text} "]
        marks = [c for i, c in enumerate(marks) if c or i == 0 or marks[i - 1]]
        want = np.zeros(64)
        for a, b, c in zip(marks, marks[1:], marks[2:]):
            if b:
                want += np.roll(langid._letter(a, 64, 1), 2) * np.roll(langid._letter(b, 64, 1), 1) * langid._letter(c, 64, 1)
        assert (row == want).all()


def test_odd_rows_and_extra_columns(docs):
    table = docs(ODD).withColumn("lang_pred", F.lit("mine"))
    got = langid.identify(table, langid.learn(docs([(1, "some words here"), (2, None)])))
    assert got.count() == len(ODD) and got.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    by = {(r.doc_id, r.text[:5] if r.text else r.text): (r.lang_pred, r.score) for r in got.collect()}
    for row in (1, None), (2, ""), (3, " \n\t "), (4, "12 34"):
        assert by[row] == ("und", 0.0)
    assert by[(7, "long ")][0] == "en"
    assert {r.lang_pred for r in langid.identify(docs(ODD), {}).collect()} == {"und"}
    assert langid.identify(docs([]), {}).count() == 0 and langid.learn(docs([])) == {}


def test_long_text_in_pieces(docs, monkeypatch):
    text = "un mot de plus " * 300
    prototypes = langid.learn(docs([(1, text)]))
    whole = langid.identify(docs([(1, text)]), prototypes).first().score
    assert abs(whole - 1) < 1e-5
    assert list(langid._pieces("ab cd ef", 4)) == ["ab ", "cd ", "ef"]
