"""Benchmark decontamination by winnowing, in built-in column functions only.

A window is ``WINDOW`` consecutive words of an item (all its words, if it has fewer). Winnowing
keeps, for every window, the smallest hash among its k-grams of ``GRAM`` words. Equal windows keep
equal hashes, so every shared window is found through a hash that both sides kept; no shared
span of a window's length can be missed.

1. One scan hashes every document and writes its kept hashes (each value once per document).
2. They are joined with the items' kept hashes: a document that shares none is clean.
3. In the others, hits are extended: each window whose kept hash was shared is compared, word for
   word, with the items' windows of that hash.
4. Words under a matching window are hit.

Items of different lengths below a full window are handled by the same steps with their own
window length (at most ``WINDOW`` lengths exist).

Defined cases: a NULL text has no words, an item without words has no window; NULL and repeated
ids are told apart by their text (rows that agree in both agree in the result); item_ids that
repeat count once, a NULL item_id is no item; extra columns are ignored.

Scale: documents are never shuffled in step 1; step 2 shuffles one value per kept hash, or nothing
where the items' hashes are under Spark's broadcast threshold; steps 3 and 4 touch only
documents that share a hash. Positions are collected per document only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickfold.llm.common import stored
from clickfold.llm.native_words import neighbours, words

WINDOW, GRAM = 10, 5


def _tiled(df: DataFrame, name: str, source: str, n: int, combine, overlap: bool) -> DataFrame:
    """Column ``name``: ``combine`` over each run of ``n`` elements of ``source``, in log2(n) passes.

    Runs of doubled length are combined until ``n`` is reached; ``overlap`` says that an
    element may count twice (as in a minimum), so that two overlapping runs make the last step.
    """
    have, column, made = 1, source, []
    rest: list[tuple[int, str]] = []
    while have < n:
        if 2 * have <= n:
            step, other, size = have, column, 2 * have
        elif overlap:
            step, other, size = n - have, column, n
        else:
            step, other, size = have, None, have
        if other is None:
            break
        new = f"{name}_{size}"
        df = neighbours(df, new, column, step, combine)
        rest.append((have, column))
        made.append(new)
        have, column = size, new
    while have < n:  # the remaining parts, longest first
        size, part = next((s, c) for s, c in reversed(rest) if s <= n - have)
        new = f"{name}_{have + size}"
        k = F.greatest(F.size(column) - size, F.lit(0))
        df = df.withColumn(new, F.zip_with(F.slice(column, 1, k), F.slice(part, F.lit(have + 1), k), combine))
        made.append(new)
        have, column = have + size, new
    df = df.withColumn(name, F.col(column))
    return df.drop(*made)


def kept_hashes(df: DataFrame, window: int, words_col: str = "words", as_: str = "kept") -> DataFrame:
    """Column ``as_``: for each window of ``window`` words, the smallest hash of its k-grams."""
    gram = min(GRAM, window)
    df = df.withColumn("_word", F.transform(words_col, lambda w: F.xxhash64(w)))
    df = _tiled(df, "_gram", "_word", gram, lambda a, b: F.xxhash64(a, b), overlap=False)
    df = _tiled(df, as_, "_gram", window - gram + 1, lambda a, b: F.least(a, b), overlap=True)
    return df.drop("_word", "_gram")


def _window_text(start: Column, window: int) -> Column:
    return F.concat_ws(" ", F.slice("words", start + 1, window))


def _windows_of(items: DataFrame, lengths: list[int]) -> DataFrame:
    """(length, hash, span, item_id): every window of every item, with the hash it keeps."""
    parts = []
    for n in lengths:
        own = kept_hashes(items, n)
        spans = F.transform("kept", lambda h, i: F.struct(h.alias("hash"), _window_text(i, n).alias("span")))
        if n < WINDOW:  # a short item is one window of all its words
            spans = F.when(F.size("words") == n, spans)
        parts.append(own.select("item_id", F.explode(spans).alias("at")).select(F.lit(n).alias("length"), "at.*", "item_id"))
    return reduce(DataFrame.union, parts).distinct()


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated, text_hash) of every row of ``docs``."""
    items = items.select(F.col(item_col).alias("item_id"), words(F.col(item_text)).alias("words"))
    # Written first: a filter over computed word arrays would be carried through every later step.
    items = stored(items.where(F.col("item_id").isNotNull() & (F.size("words") > 0)), "items")
    lengths = sorted(r[0] for r in items.select(F.least(F.size("words"), F.lit(WINDOW))).distinct().collect())
    docs = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("print"), F.col(text_col).alias("text"))

    hashed = docs.withColumn("words", words(F.col("text")))
    for n in lengths:
        hashed = kept_hashes(hashed, n, as_=f"kept_{n}")
    hashed = stored(hashed.select("id", "print", F.size("words").cast("long").alias("n_words"),
                                  *(F.array_distinct(f"kept_{n}").alias(f"kept_{n}") for n in lengths)), "winnowed")
    every = hashed.select("id", "print", "n_words")
    if lengths:
        windows = stored(_windows_of(items, lengths), "item-windows")
        hashes = windows.select("length", "hash").distinct()
        shared = reduce(DataFrame.union, [
            hashed.select("id", "print", F.explode(f"kept_{n}").alias("hash"))
            .join(hashes.where(F.col("length") == n).select("hash"), "hash", "left_semi")
            .select("id", "print", F.struct(F.lit(n).alias("length"), "hash").alias("match"))
            for n in lengths]).groupBy("id", "print").agg(F.collect_set("match").alias("matches"))
        suspects = (docs.alias("d").join(shared.alias("s"), F.col("d.id").eqNullSafe(F.col("s.id"))
                                         & (F.col("d.print") == F.col("s.print")))
                    .select("d.id", "d.print", words(F.col("text")).alias("words"), "matches"))
        hits = reduce(DataFrame.union, [_hits(suspects, windows, n) for n in lengths])
        found = hits.groupBy("id", "print").agg(
            F.collect_set(F.struct("start", "length")).alias("spans"),
            F.collect_set(F.col("item_id").cast("string")).alias("items"))
        covered = F.array_distinct(F.flatten(F.transform(
            "spans", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1))))
        found = found.select(F.col("id").alias("f_id"), F.col("print").alias("f_print"),
                             F.size(covered).cast("long").alias("n_hit"), "items")
        every = every.join(found, F.col("id").eqNullSafe(F.col("f_id")) & (F.col("print") == F.col("f_print")), "left")
    else:
        every = every.withColumns({"n_hit": F.lit(None).cast("long"), "items": F.lit(None).cast("array<string>")})
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    ids = F.coalesce(F.array_join(F.array_sort("items"), ","), F.lit(""))
    return every.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"),
                        F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
                        F.sha2(ids, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
                        F.col("print").alias("text_hash"))


def _hits(suspects: DataFrame, windows: DataFrame, n: int) -> DataFrame:
    """(id, print, start, length, item_id): windows of suspect documents that equal an item's.

    Only windows whose kept hash was shared leave the row, each with its own words and nothing else.
    """
    own = windows.where(F.col("length") == n).select("hash", "span", "item_id")
    wanted = F.transform(F.filter("matches", lambda m: m["length"] == n), lambda m: m["hash"])
    here = kept_hashes(suspects.withColumn("wanted", wanted), n)
    starts = F.filter(F.transform("kept", lambda h, i: F.struct(i.alias("start"), h.alias("hash"))),
                      lambda x: F.array_contains("wanted", x["hash"]))
    spans = F.transform(starts, lambda x: F.struct(x["start"].alias("start"), x["hash"].alias("hash"),
                                                   _window_text(x["start"], n).alias("span")))
    near = here.select("id", "print", F.explode(spans).alias("at")).select("id", "print", "at.*")
    return near.join(own, ["hash", "span"]).select("id", "print", "start", F.lit(n).alias("length"), "item_id")
