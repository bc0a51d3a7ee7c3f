"""Language identification with hyperdimensional profiles.

Every letter has a fixed random +1/-1 vector, seeded by its code point. A letter trigram is bound
by multiplying the vectors of its letters, each rotated by its place. A document bundles (adds) its
trigrams; a language prototype bundles those of all its training documents. The language is the
prototype with the largest cosine to the document.

Text is lower-cased; every run of other characters counts as one word boundary, which is a
letter of its own in trigrams, so any text with a letter has a trigram.

Defined cases: NULL text, empty text and text without letters get ``und`` and score 0, as does every
text when there is nothing to learn from; ties go to the smaller language; rows with a NULL
language or NULL text teach nothing. Each row is judged by itself, so repeated rows agree.

Scale: training shuffles at most (languages x dimensions) sums per task; prototypes, which
have languages x dimensions numbers whatever the corpus size, are the only thing that is collected.
Prediction is a scan.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickfold.llm.common import own_cache, runs_of, small_batches, tidy

DIMENSIONS = 1024
SEED = 20240
UNDETERMINED = "und"
#: Characters that are worked on at once; trigrams and texts whose vectors and counts are in memory at once.
CHARS_AT_ONCE, GRAMS_AT_ONCE, GROUPS_AT_ONCE = 1 << 20, 8192, 256


@own_cache
@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)


@own_cache
@lru_cache(maxsize=20_000)
def _letter(code: int, dimensions: int, seed: int) -> np.ndarray:
    bits = np.random.Generator(np.random.PCG64([seed, code])).integers(0, 2, dimensions, dtype=np.int8)
    return 2 * bits - 1


def _pieces(text: str, most: int = CHARS_AT_ONCE) -> Iterator[str]:
    """The whole text in parts of about ``most`` characters, cut after a space where there is one."""
    at = 0
    while len(text) - at > most:
        cut = text.rfind(" ", at, at + most) + 1 or at + most
        yield text[at:cut]
        at = cut
    yield text[at:]


def _trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Packed trigram codes of all texts, and the index of each one's text."""
    joined = " " + "".join(t + " " for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    of = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    of = np.concatenate((of[:1], of)) if len(of) else np.zeros(1, dtype=int)
    codes[~_letters()[codes]] = 0
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    codes, of = codes[keep], of[keep]
    grams = codes[:-2] | codes[1:-1] << np.uint64(21) | codes[2:] << np.uint64(42)
    inside = codes[1:-1] != 0
    return grams[inside], of[1:-1][inside]


def _bound(grams: np.ndarray, dimensions: int, seed: int) -> np.ndarray:
    """The bound vector of every trigram."""
    out = None
    mask = np.uint64((1 << 21) - 1)
    for place in range(3):
        letters, index = np.unique(grams >> np.uint64(21 * place) & mask, return_inverse=True)
        rolled = np.stack([np.roll(_letter(int(c), dimensions, seed), 2 - place) for c in letters])[index]
        out = rolled if out is None else out * rolled
    return out.astype(np.float32)


def bundles(texts: list[str], groups: np.ndarray, n_groups: int, dimensions: int, seed: int) -> np.ndarray:
    """The bundle of each group of texts (one group per text, or one per language)."""
    out = np.zeros((n_groups, dimensions), dtype=np.float32)
    grams, of = _trigrams(texts)
    if not len(grams):
        return out
    distinct, index = np.unique(grams, return_inverse=True)
    for start in range(0, len(distinct), GRAMS_AT_ONCE):
        part = distinct[start:start + GRAMS_AT_ONCE]
        here = (index >= start) & (index < start + len(part))
        group, place = groups[of[here]], index[here] - start
        bound = _bound(part, dimensions, seed)
        for low in range(0, n_groups, GROUPS_AT_ONCE):
            n = min(GROUPS_AT_ONCE, n_groups - low)
            own = (group >= low) & (group < low + n)
            counts = np.bincount((group[own] - low) * len(part) + place[own], minlength=n * len(part))
            out[low:low + n] += counts.reshape(n, len(part)).astype(np.float32) @ bound
    return out


def _parts(texts: list[str | None]) -> tuple[list[str], list[int]]:
    """Lower-cased pieces of all texts and the index of each one's text."""
    pieces, owner = [], []
    for i, text in enumerate(texts):
        for piece in _pieces((text or "").lower()):
            pieces.append(piece)
            owner.append(i)
    return pieces, owner


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text",
          dimensions: int = DIMENSIONS, seed: int = SEED) -> dict[str, list[float]]:
    """Prototype of every language in ``docs``: the sum of all its documents' trigram vectors."""
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("bundle", T.ArrayType(T.DoubleType()))])

    def bundle(it):
        sums: dict[str, np.ndarray] = {}
        for batch in it:
            langs = batch.column(0).to_pylist()
            pieces, owner = _parts(batch.column(1).to_pylist())
            for a, b in runs_of([len(p) for p in pieces], CHARS_AT_ONCE):
                names = sorted({langs[o] for o in owner[a:b]})
                groups = np.array([names.index(langs[o]) for o in owner[a:b]])
                for name, row in zip(names, bundles(pieces[a:b], groups, len(names), dimensions, seed), strict=True):
                    sums[name] = sums.get(name, 0) + row.astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()),
                                          pa.array([v for v in sums.values()], pa.list_(pa.float64()))], ["lang", "bundle"])

    # Added up by (language, dimension): sums of whole numbers, so their order does not matter.
    rows = (small_batches(docs).where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
            .select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
            .mapInArrow(tidy(bundle), schema)
            .select("lang", F.posexplode("bundle").alias("at", "value"))
            .groupBy("lang", "at").agg(F.sum("value").alias("value"))
            .collect())
    prototypes: dict[str, list[float]] = {}
    for r in rows:
        prototypes.setdefault(r["lang"], [0.0] * dimensions)[r["at"]] = r["value"]
    return prototypes


def identify(docs: DataFrame, prototypes: dict[str, list[float]], text_col: str = "text",
             lang_as: str = "lang_pred", score_as: str = "score",
             dimensions: int = DIMENSIONS, seed: int = SEED) -> DataFrame:
    """``docs`` with the predicted language and its cosine, cut to 0..1; every other column is kept."""
    names = sorted(n for n, v in prototypes.items() if any(v))
    matrix = np.array([prototypes[n] for n in names], dtype=np.float64).reshape(len(names), dimensions)
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
    matrix = matrix.astype(np.float32)
    schema = T.StructType([*(f for f in docs.schema.fields if f.name not in (lang_as, score_as)),
                           T.StructField(lang_as, T.StringType()), T.StructField(score_as, T.DoubleType())])
    kept = [f.name for f in schema.fields[:-2]]

    def predict(it):
        for batch in it:
            texts = batch.column(kept.index(text_col)).to_pylist()
            pieces, owner = _parts(texts)
            total = np.zeros((len(texts), len(names)))
            best = [UNDETERMINED] * len(texts)
            score = np.zeros(len(texts))
            carried: dict[int, np.ndarray] = {}
            for a, b in runs_of([len(p) for p in pieces], CHARS_AT_ONCE) if names else ():
                first = owner[a]
                n = owner[b - 1] - first + 1
                vectors = bundles(pieces[a:b], np.array(owner[a:b]) - first, n, dimensions, seed)
                if first in carried:  # the pieces of a long text come in several runs
                    vectors[0] += carried.pop(first)
                if b < len(owner) and owner[b] == owner[b - 1]:
                    carried[owner[b - 1]] = vectors[-1]
                norms = np.linalg.norm(vectors, axis=1)
                total[first:first + n] = vectors @ matrix.T / np.maximum(norms, 1e-30)[:, None]
                for i in np.flatnonzero(norms):
                    k = int(np.argmax(total[first + i]))
                    best[first + i] = names[k]
                    score[first + i] = min(1.0, max(0.0, total[first + i, k]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(kept)], pa.array(best, pa.string()), pa.array(score)],
                                             [f.name for f in schema.fields])

    return small_batches(docs).select(*(F.col(f"`{c}`") for c in kept)).mapInArrow(tidy(predict), schema)
