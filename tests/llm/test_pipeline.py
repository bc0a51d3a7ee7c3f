from __future__ import annotations

from llm_helpers import ODD
from test_lines import plain as plain_lines
from test_native import plain_hits, words
from test_simhash import plain_components, plain_fingerprint

import corpus_pipeline
from clickfold.llm import langid


def test_against_brute_force(spark, sf, corpus):
    """Stages 2 to 5 by brute force over what language ID keeps (it rejects texts without letters)."""
    docs = [(i, t) for i, t in corpus if t and any(c.isalpha() for c in t)]
    cut = plain_lines(docs)
    docs = [(i, cut[i]) for i, t in docs if cut[i] == t or words(cut[i])]
    groups = plain_components({i: plain_fingerprint(t) for i, t in docs})
    docs = [(i, t) for i, t in docs if groups[i] == i]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    hit = plain_hits(docs, items)
    want = {i for i, _ in docs if not hit[i][-1]}
    got = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in got.collect()} == want and 0 < len(want) < len(corpus)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_duplicates", "decontamination", "tokenize"]


def test_stages_on_odd_and_empty_tables(spark, docs, sf):
    for rows in (ODD, []):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, docs(rows), sf)
            assert tuple(kept.columns) == corpus_pipeline.COLUMNS
            kept.collect()
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs(ODD), sf).collect()}
    assert kept == {5, None, 6, 7, 8} and langid.UNDETERMINED == "und"
