from __future__ import annotations

import collections
import html
import math
import re
import zlib

import numpy as np
from llm_helpers import ODD
from pyspark.sql import functions as F

from clickfold.llm import ann, htmltext, maxent


def test_recall_and_exact_scores(spark, sf):
    from clickfold.llm.queries import op3_cross_polytope
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    ids = np.array([r.vec_id for r in rows])
    x = ann.unit(np.array([r.embedding for r in rows], dtype=np.float64))
    got = collections.defaultdict(list)
    for r in op3_cross_polytope(spark, sf).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    hits = 0
    asked = np.flatnonzero(ids % 50 == 0)
    for i in asked:
        cos = x @ x[i]
        cos[i] = -2
        best = set(ids[np.lexsort((ids, -cos))[:5]].tolist())
        mine = sorted(got[ids[i]])
        assert [r for r, _, _ in mine] == [1, 2, 3, 4, 5]
        assert all(abs(cos[np.searchsorted(ids, v)] - s) < 1e-12 for _, v, s in mine)
        hits += len(best & {v for _, v, _ in mine})
    assert set(got) == set(ids[asked].tolist()) and hits >= 0.9 * 5 * len(asked)


def test_search_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]),
            (8, [None, 1.0]), (9, [1.0, 1.0, 1.0]), (10, [0.0, 1e200]), (None, [1.0, 0.0]), (0, [1.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1))
    got = ann.nearest(table, F.col("vec_id") % 10 == 0, k=5).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 10), (10, 1, 0), (10, 2, 1), (10, 3, 2)]
    assert ann.nearest(table.limit(0), F.col("vec_id") == 0).count() == 0


def test_main_text_of_every_page(spark, sf):
    from clickfold.llm.queries import op8_html_text
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in op8_html_text(spark, sf).collect():
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]+>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", article)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_page_parts_that_go_and_stay(spark):
    page = """<body><div id="menu"><a href=x>Home</a></div><form><p>Search, this, site, please</p></form><div class="cookie-notice">
    We use, cookies</div><div id="content"><h1>T&amp;C</h1><p>Some text, long enough to count, yes.<p>Second&nbsp;one
    <b>bold</b><br>next<ul><li><a>a</a></li><li><a>b</a></li></ul></div><aside>More</aside>
    <div id="comments"><p>I, really, really, liked, this, a lot, yes, it, was, good</p></div><script>var a="</p>"</script>"""
    assert htmltext.main_text(page) == "T&C\nSome text, long enough to count, yes.\nSecond one bold next"
    rows = [(1, "u", None), (2, "u", ""), (3, None, "plain <b>text"), (None, "u", "<p>x"), (4, "u", "<" * 2000), (5, "u", "<div>" * 5000 + "deep")]
    got = {r.page_id: r.text for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == got[2] == "" and got[3] == "plain text" and got[None] == "x" and got[5] == "deep"


def test_model_and_base_scores(spark, sf, corpus):
    from clickfold.llm.queries import op9_maxent
    tokens = {i: [*(t or "").encode().lower().split(), None] for i, t in corpus}
    count = collections.Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(count.values()), len(count)
    got = op9_maxent(spark, sf).collect()
    assert len(got) == len(corpus)
    for r in got:
        words = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(w in count for w in words), n)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert abs(r.base_score - sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words)) < 1e-6
        assert r.score < 0


def test_model_is_a_distribution():
    totals = np.arange(maxent.BUCKETS) % 7
    weights = maxent.start_weights(totals) + np.random.default_rng(1).normal(0, 0.3, (maxent.ROWS, maxent.WIDE)).astype(np.float32)
    bucket = np.arange(maxent.BUCKETS, dtype=np.int32)
    p = 10 ** maxent.log10_probability(weights, bucket, np.full(len(bucket), 5), np.full(len(bucket), maxent.START))
    assert abs(p.sum() - 1) < 1e-4


def test_model_of_odd_rows(docs):
    got = maxent.score_documents(docs(ODD), F.col("doc_id") > 2, unit_docs=4).collect()
    assert len(got) == len(ODD)
    assert {r.n_tokens for r in got if r.doc_id in (1, 2, 3)} == {1} and [r.n_tokens for r in got if r.doc_id is None] == [6]
    assert maxent.score_documents(docs([]), F.lit(True)).count() == 0
    nothing = maxent.score_documents(docs(ODD), F.lit(False)).collect()
    assert {(r.n_known, r.train_tokens) for r in nothing} == {(0, 0)}
