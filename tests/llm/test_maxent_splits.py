"""What the language model learns is a matter of the documents, not of how Spark deals them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from clickfold.llm import maxent
from clickfold.llm.common import crc_share, table


@pytest.mark.parametrize("shard_bytes", [maxent.SHARD_BYTES, 1 << 14])
def test_scores_do_not_depend_on_input_splits(spark, sf, shard_bytes):
    docs = table(spark, sf, "documents")
    found = []
    for splits in (1, 16):
        scored = maxent.score_documents(docs.repartition(splits), crc_share(F.col("doc_id"), 7) != 2, shard_bytes=shard_bytes)
        found.append({r.doc_id: r for r in scored.collect()})
    one, many = found
    assert one.keys() == many.keys()
    for i, r in one.items():
        assert abs(r.score - many[i].score) <= 1e-6 * max(1.0, abs(r.score)) and r.base_score == pytest.approx(many[i].base_score)


def test_documents_left_out_score_above_the_base(spark):
    held = crc_share(F.col("doc_id"), 7) == 2
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    scored = maxent.score_documents(docs, ~held, shard_bytes=1 << 18)
    score, base = scored.where(held).agg(F.sum("score"), F.sum("base_score")).first()
    assert score > 0.99 * base


def test_parts_of_a_unit_hold_each_word_once():
    import numpy as np
    words = np.unique(np.random.default_rng(3).integers(0, 1 << 63, 5000).astype(np.uint64))
    for parts in (1, 7, 100_000):
        dealt = maxent._by_part(words, parts)
        assert sorted(np.concatenate([p for _, p in dealt]).tolist()) == list(range(len(words)))
        assert all((words[places] % np.uint64(parts) == part).all() for part, places in dealt)
        assert len({part for part, _ in dealt}) == len(dealt)
    assert maxent._by_part(words[:0], 5) == []
