"""Detections of one text: as many as there are, resolved as brute force does, in time that follows their number."""

from __future__ import annotations

import re
import time

from clickfold.llm import licenses
from clickfold.llm.license_rules import rules

PHRASES = ["licensed under the mit license", "permission is hereby granted free of charge", "gnu general public license version 2 or later",
           "apache license version 2 0", "redistribution and use in source and binary forms", "all rights reserved", "some other words"]


def _by_hand(text):
    canon = " " + " ".join(re.findall(r"[0-9a-z]+", text)) + " "
    found = sorted((m.start(), -m.end(), i, label) for i, (label, _, pattern) in enumerate(rules())
                   for m in re.finditer(f"(?<= )(?:{pattern})(?= )", canon))
    kept = []
    for x in found:
        if not kept or x[0] >= -kept[-1][1]:
            kept.append(x)
        elif x[1] < kept[-1][1] and x[2] < kept[-1][2]:
            kept[-1] = x
    return {x[3] for x in kept}, max((len(canon[x[0]:-x[1]].split()) for x in kept), default=0)


def test_many_detections_equal_brute_force(docs):
    texts = [" ".join(PHRASES[(i * step + i // 3) % len(PHRASES)] for i in range(n)) for n, step in ((0, 1), (1, 1), (2, 3), (17, 1), (64, 5), (333, 2))]
    got = {r.doc_id: r for r in licenses.scan(docs(list(enumerate(texts)))).collect()}
    for i, text in enumerate(texts):
        labels, longest = _by_hand(text)
        assert labels <= set(got[i].labels.split(",")) | {""}, i
        assert set(filter(None, got[i].labels.split(","))) == labels | set(filter(None, got[i].base_labels.split(","))), i
        if longest:
            assert got[i].score == max(0.25, min(1.0, longest / 8)), i


def test_time_follows_the_number_of_detections(docs):
    def seconds(n):
        table = docs([(1, " ".join(PHRASES[:4] * n))])
        best = []
        for _ in range(2):
            start = time.perf_counter()
            licenses.scan(table).collect()
            best.append(time.perf_counter() - start)
        return min(best)

    seconds(10)
    assert seconds(4000) < 2.2 * seconds(2000)
