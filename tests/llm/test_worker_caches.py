from __future__ import annotations

import public_tokenizers

from clickfold.llm import bpe, common, langid, lines


def test_a_worker_keeps_one_operators_caches(spark):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN

    def sizes(it):
        for batch in it:
            yield batch

    sizes.__module__ = bpe.__name__
    bpe.load(path, pattern)
    langid._letter(97, 16, 1)
    list(common.tidy(sizes)(iter(())))
    assert bpe.load.cache_info().currsize == 1  # the next task of the same operator finds it
    assert langid._letter.cache_info().currsize == 0
    sizes.__module__ = lines.__name__
    list(common.tidy(sizes)(iter(())))
    assert bpe.load.cache_info().currsize == 0


def test_workers_drop_the_encoder_for_the_next_operator(spark, docs):
    rows = docs([(i, f"some words and a line of {i}\nand more") for i in range(40)])
    found = bpe.round_trip(rows, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)

    def held(it):
        for batch in it:
            yield batch.from_pylist([{"n": bpe.load.cache_info().currsize}] * batch.num_rows)

    held.__module__ = lines.__name__
    assert found.count() == 40
    many = spark.range(400).repartition(8)
    assert {r.n for r in many.mapInArrow(common.tidy(held), "n long").collect()} == {0}
