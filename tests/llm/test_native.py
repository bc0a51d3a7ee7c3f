from __future__ import annotations

import hashlib
import re

from llm_helpers import ODD
from pyspark.sql import functions as F

from clickfold.llm import decontaminate, licenses
from clickfold.llm.license_rules import BASE, rules

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_hits(rows, items):
    out = {}
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for s in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[s:s + n]), set()).add(item)
    sizes = {len(w) for w in windows}
    for i, text in rows:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if own := windows.get(tuple(w[s:s + n])):
                    hit |= set(range(s, s + n))
                    found |= own
        ids = ",".join(sorted(map(str, found)))
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit))
    return out


def hits(df):
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()}


def test_contamination_of_the_whole_table(spark, sf, corpus):
    from clickfold.llm.queries import op6_decontaminate
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    got = hits(op6_decontaminate(spark, sf))
    assert got == plain_hits(corpus, items) and any(r[-1] for r in got.values())


def test_items_of_every_length(spark, docs):
    items = [(i, " ".join(f"w{(i * 7 + k) % 23}" for k in range(i))) for i in range(14)] + [(20, None), (21, "w1 w2 w3"), (None, "long")]
    rows = [(i, " ".join(f"W{(i + k * (1 + i % 2)) % 23}" for k in range(30))) for i in range(12)] + [(90, None), (91, "w1"), (92, "")]
    table = spark.createDataFrame(items, "item_id long, text string")
    want = plain_hits(rows, [i for i in items if i[0] is not None])
    assert hits(decontaminate.contamination(docs(rows), table)) == want
    extra = docs(rows).withColumn("words", F.lit(1)).withColumn("hash", F.lit(2)).withColumn("item_id", F.lit(3))
    assert hits(decontaminate.contamination(extra, table)) == want


def test_contamination_of_odd_rows(spark, docs):
    items = spark.createDataFrame([(1, "twice the same row"), (2, "some text without an id")], "item_id long, text string")
    got = decontaminate.contamination(docs(ODD), items).collect()
    assert len(got) == len(ODD)
    assert [(r.n_hit, r.n_items) for r in got if r.doc_id == 6] == [(4, 1)] * 2
    assert [r.n_hit for r in got if r.doc_id is None] == [5]
    assert decontaminate.contamination(docs([]), items).count() == 0
    none = decontaminate.contamination(docs(ODD), items.limit(0))
    assert {r.contaminated for r in none.collect()} == {False} and none.count() == len(ODD)


def plain_scan(text):
    w = words(text)
    canon = f" {' '.join(w)} "
    places = [(i, label) for phrase, label in BASE for i in range(len(w)) if w[i:i + len(phrase.split(" "))] == phrase.split(" ")]
    spans = []
    for k, (label, gate, pattern) in enumerate(rules()):
        if set(gate) & set(w):
            spans += [(m.start(), -m.end(), k, label) for m in re.finditer(f"(?<= )(?:{pattern})(?= )", canon)]
    stays = []
    for s in sorted(spans):
        if not stays or s[0] >= -stays[-1][1]:
            stays.append(s)
        elif -s[1] > -stays[-1][1] and s[2] < stays[-1][2]:
            stays[-1] = s
    base = sorted({label for _, label in places})
    sizes = [canon[s[0]:-s[1]].count(" ") + 1 for s in stays]
    score = max(0.25, min(1.0, max(sizes, default=0) / 8)) if places or stays else 0.0
    at = [i for i, _ in places]
    return (len(w), len(places), min(at, default=None), max(at, default=None), ",".join(base),
            ",".join(sorted({*base, *(s[3] for s in stays)})), score)


def scans(df):
    return {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in df.collect()}


def test_licences_of_the_whole_table(spark, sf, corpus):
    from clickfold.llm.queries import op10_licenses
    got = scans(op10_licenses(spark, sf))
    assert got == {i: plain_scan(t) for i, t in corpus}
    assert any(r[1] for r in got.values())


def test_overlapping_licences(docs):
    texts = ["Licensed under CC BY-NC 4.0. cc by cc by",
             "GNU Lesser General Public License, version 2.1 or (at your option) any later version",
             "This work is licensed under the GNU General Public License, version 3.",
             "SPDX-License-Identifier: GPL-2.0-or-later", "SPDX-License-Identifier: Apache-2.0 All rights reserved",
             "Released under the MIT license. Copyright (c) 2019", "mit apache license bsd gnu cc by-sa 3.0 general public license",
             "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "no licence here"]
    rows = list(enumerate(texts)) + [(i + 100, t) for i, t in ODD if i not in (None, 6)]
    got = scans(licenses.scan(docs(rows)))
    assert got == {i: plain_scan(t) for i, t in rows}
    assert got[0][:5] == (11, 3, 2, 9, "cc-by") and "cc-by-nc-4.0" in got[0][5]
    assert got[1][5] == "gpl,lgpl-2.1-or-later" and got[2][5] == "gpl,gpl-3"
    assert got[3][5] == "gpl-2.0-or-later" and got[8][5:] == ("", 0.0)
    assert licenses.scan(docs(ODD)).count() == len(ODD) and licenses.scan(docs([])).count() == 0
    assert len(rules()) >= 300
