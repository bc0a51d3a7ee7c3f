"""The queries ``opN_<name>``: every operator over its whole test table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickfold.llm import alignment, ann, bpe, decontaminate, htmltext, langid, licenses, lines, maxent, sharding, simhash, suffixes, whitening
from clickfold.llm.common import crc_share, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the three quarters that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(crc_share(F.col("doc_id"), 4) == 2, F.lit(False))
    prototypes = langid.learn(docs.where(crc_share(F.col("doc_id"), 4) != 2))
    judged = langid.identify(docs.select("doc_id", "text", held_out.alias("held_out")), prototypes)
    return judged.select("doc_id", "held_out", "lang_pred", "score")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "fingerprint", "component_id")


def op3_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth row, among all rows."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that lie in a 100-byte string that starts earlier, and what is left."""
    rows = suffixes.remove_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that repeat, exactly or nearly, an earlier one."""
    rows = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_removed", "text")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a window of a benchmark item."""
    rows = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.drop("text_hash")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document, encoded and decoded again."""
    return bpe.round_trip(table(spark, sf_dir, "documents"),
                          public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op9_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model log10 probability of every document, learned from six sevenths of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scores = maxent.score_documents(docs, crc_share(F.col("doc_id"), 7) != 2)
    held_out = F.coalesce(crc_share(F.col("doc_id"), 7) == 2, F.lit(False))
    return scores.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and signature labels of every document."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector on the eight strongest principal axes, scaled to unit variance."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=8)


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen shards of nearly equal bytes; equal texts share a shard."""
    return sharding.shard(table(spark, sf_dir, "documents"), shards=16)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How two public tokenizers cut every document, and how usual their links are in the corpus."""
    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                           public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN)


QUERIES = {f.__name__: f for f in (
    op1_language_id, op2_simhash, op3_cross_polytope, op4_suffix_dedup, op5_fuzzy_lines,
    op6_decontaminate, op7_byte_bpe, op8_html_text, op9_maxent, op10_licenses,
    op11_whitening, op12_sharding, op13_alignment)}

_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

#: Every window of every text, compared as it stands.
OP6 = f"""
WITH doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
item AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
item_window AS (
  SELECT DISTINCT item_id, n, array_to_string(w[s + 1:s + n], ' ') AS span
  FROM (SELECT item_id, w, n, unnest(range(0, len(w) - n + 1)) AS s
        FROM (SELECT item_id, w, least(len(w), 10) AS n FROM item WHERE len(w) > 0))),
doc_window AS (
  SELECT doc_id, n, s, array_to_string(w[s + 1:s + n], ' ') AS span
  FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS s
        FROM doc CROSS JOIN (SELECT DISTINCT n FROM item_window) WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, n, s FROM doc_window JOIN item_window USING (n, span)),
word AS (SELECT doc_id, count(DISTINCT p) AS n_hit
         FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
found AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM hit GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN word USING (doc_id) LEFT JOIN found USING (doc_id)
"""

#: Every 100-byte window as hexadecimal digits; the first of equals stays.
OP4 = """
WITH doc AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
spot AS (SELECT doc_id, s, substr(h, 2 * s + 1, 200) AS span
         FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS s FROM doc WHERE len(h) >= 200)),
repeat_ AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY span ORDER BY doc_id, s) AS nth FROM spot) WHERE nth > 1),
edge AS (SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS before FROM repeat_),
island AS (SELECT doc_id, s, sum(CASE WHEN before IS NULL OR s > before + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s) AS g FROM edge),
cut AS (SELECT doc_id, g, min(s) AS a, max(s) + 100 AS b FROM island GROUP BY doc_id, g),
gap AS (SELECT doc_id, b AS x, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS y FROM cut
        UNION ALL SELECT doc_id, 0, min(a) FROM cut GROUP BY doc_id),
rest AS (SELECT doc_id, string_agg(substr(h, 2 * x + 1, 2 * (coalesce(y, len(h) // 2) - x)), '' ORDER BY x) AS kept
         FROM gap JOIN doc USING (doc_id) GROUP BY doc_id),
size_ AS (SELECT doc_id, sum(b - a) AS gone, count(*) AS spans FROM cut GROUP BY doc_id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM doc LEFT JOIN size_ USING (doc_id) LEFT JOIN rest USING (doc_id)
"""

#: Groups one after the other to the least loaded shard, in one recursion; CRC-32 byte by byte.
OP12 = """
WITH RECURSIVE
bit_ AS (SELECT b, list_reduce([b, 1, 2, 3, 4, 5, 6, 7, 8],
          lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM range(256) r(b)),
crc_table AS (SELECT list(v ORDER BY b) AS t FROM bit_),
doc AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS bytes FROM documents),
row_ AS (SELECT doc_id, CAST(len(bytes) + 1 AS BIGINT) AS size, sha256(text) AS digest,
                xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(bytes, lambda x: CAST('0x' || x AS BIGINT))),
                                            lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1]))) AS crc
         FROM doc, crc_table),
group_ AS (SELECT digest, sum(size) AS total, row_number() OVER (ORDER BY sum(size) DESC, digest) AS i FROM row_ GROUP BY digest),
step_ AS (SELECT CAST(0 AS BIGINT) AS i, list_transform(range(16), lambda x: 0::HUGEINT) AS loads, NULL::BIGINT AS spot
          UNION ALL
          SELECT g.i, list_transform(loads, lambda x, j: CASE WHEN j = list_position(loads, list_min(loads)) THEN x + g.total ELSE x END),
                 list_position(loads, list_min(loads)) - 1
          FROM step_ s JOIN group_ g ON g.i = s.i + 1),
place AS (SELECT total, spot, row_number() OVER (PARTITION BY total ORDER BY spot) AS k FROM step_ JOIN group_ USING (i)),
turn AS (SELECT digest, total, row_number() OVER (PARTITION BY total ORDER BY digest) AS k FROM group_)
SELECT doc_id, size, CAST(crc AS BIGINT) AS text_crc32, 'bytes' AS law, CAST(spot AS INTEGER) AS shard,
       row_number() OVER (PARTITION BY spot ORDER BY doc_id NULLS LAST, digest) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM row_ JOIN turn USING (digest) JOIN place USING (total, k)
"""

ORACLES: dict[str, str] = {"op4_suffix_dedup": OP4, "op6_decontaminate": OP6, "op12_sharding": OP12}
