"""Hashed maximum-entropy language model with a class-factored softmax.

Words are known by a 64-bit hash. The hash's bucket splits into a class and a member of the class:

    P(word | history) = P(class | history) * P(member | class, history) * P(word | bucket)

The first two are softmax models over hashed features: the last word, the last two words, the word
before the last (a skip), and for the member the class with the last word. The third is the word's
add-one share of its bucket, with one share left for words never seen, so all words together have
probability one.

Training: the training documents are dealt by a hash of id and text into rounds, and within a round into shards
of about ``SHARD_BYTES``. Each shard is gone through once, in an order of its own, with mini-batch gradient steps
(AdaGrad by weight row, ``STEP`` / sqrt(round)) from the current weights, and reports its change of each weight row with the
number of tokens that used the row. Spark adds these up by row; the weighted mean is the new model, with
which the next round starts. Each training document is used in exactly one round. What is learned depends on the
documents alone, not on input splits or the number of tasks.

Counts: words are counted over all training documents. Documents are dealt into units of bounded size.
A unit asks for the counts of its distinct words, one packed block for each part of the hash range;
a part merges its blocks and answers each. A word, however frequent, is one entry per unit.

Defined cases: NULL text counts as empty and has its end token only; rows with a NULL id are scored
but not learned from; repeated rows count as often as they occur; without training rows every word is
unknown. Extra columns are ignored.

Bounds: the model has ``ROWS`` x ``WIDE`` weights whatever the corpus size; only it and the bucket
totals reach the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickfold.llm.common import folded_bytes, mix64, range_hashes, space_words, stored

WIDE = 32  # classes, and members of a class
BUCKETS = WIDE * WIDE
PAIRS = 8192  # hashed rows for two-word and class-and-word features
START = BUCKETS  # stands for the words before a text
END = np.uint64(0x0E5D0E5D0E5D0E5D)  # the hash of the end token

#: First weight row of each feature family.
_LAST, _SKIP, _TWO = 1, 1 + BUCKETS + 1, 1 + 2 * (BUCKETS + 1)
_OWN = _TWO + PAIRS
_OWN_LAST = _OWN + WIDE
ROWS = _OWN_LAST + PAIRS

#: ``DAMPING`` is what the squares of AdaGrad start from.
ROUNDS, STEP, DAMPING, BATCH = 4, 0.2, 1.0, 4096
#: Bytes of text in a shard of a round.
SHARD_BYTES = 16 << 20
#: Documents of a unit; bytes that are hashed at once; hash entries that one part merges.
UNIT_DOCS, BYTES_AT_ONCE, PART_ENTRIES = 2_000, 1 << 20, 1 << 20
#: Distinct words expected in a unit, which only sets the number of parts.
UNIT_WORDS = 200_000


def _cuts(data: bytes) -> list[bytes]:
    """A text's bytes in pieces of about ``BYTES_AT_ONCE``, cut at white space."""
    out, at = [], 0
    while len(data) - at > BYTES_AT_ONCE:
        cut = at + BYTES_AT_ONCE
        while cut < len(data) and data[cut] not in b" \t\n\r\x0b\x0c":
            cut += 1
        out.append(data[at:cut])
        at = cut
    out.append(data[at:])
    return out


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, each text followed by its end token; and the end tokens' places."""
    hashes: list[np.ndarray] = []
    counts = np.zeros(len(texts), dtype=np.int64)
    waiting: list[bytes] = []
    owners: list[int] = []
    size = 0

    def flush():
        nonlocal size
        data = np.frombuffer(b" ".join(waiting) + b" ", dtype=np.uint8)
        starts, ends = space_words(data)
        hashes.append(range_hashes(data, starts, ends))
        firsts = np.cumsum([0, *(len(w) + 1 for w in waiting)])
        np.add.at(counts, owners, np.diff(np.searchsorted(starts, firsts)))
        waiting.clear()
        owners.clear()
        size = 0

    for i, text in enumerate(texts):
        for piece in _cuts(folded_bytes(text or "")):
            waiting.append(piece)
            owners.append(i)
            size += len(piece)
            if size >= BYTES_AT_ONCE:
                flush()
    if waiting:
        flush()
    stops = np.cumsum(counts + 1) - 1
    out = np.empty(int(counts.sum()) + len(texts), dtype=np.uint64)
    is_end = np.zeros(len(out), dtype=bool)
    is_end[stops] = True
    out[is_end] = END
    out[~is_end] = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    return out, stops


def buckets_of(hashes: np.ndarray) -> np.ndarray:
    return (mix64(hashes) & np.uint64(BUCKETS - 1)).astype(np.int32)


def histories(bucket: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the last word and of the one before it; ``START`` beyond a text's beginning."""
    first = np.zeros(len(bucket), dtype=bool)
    first[0] = True
    first[stops[:-1] + 1] = True
    last = np.concatenate(([START], bucket[:-1]))
    last[first] = START
    skip = np.concatenate(([START], last[:-1]))
    skip[first] = START
    return last, skip


def _hashed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (mix64(a.astype(np.uint64) << np.uint64(16) | b.astype(np.uint64)) & np.uint64(PAIRS - 1)).astype(np.int32)


def features(bucket: np.ndarray, last: np.ndarray, skip: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Weight rows of the class model and of the member model, a list entry for each family."""
    own = bucket // WIDE
    of_class = [np.zeros(len(bucket), np.uint16), _LAST + last, _SKIP + skip, _TWO + _hashed(skip, last)]
    of_member = [_OWN + own, _OWN_LAST + _hashed(own, last)]
    return [f.astype(np.uint16) for f in of_class], [f.astype(np.uint16) for f in of_member]


def softmax(weights: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    logits = weights[rows[0]]
    for r in rows[1:]:
        logits += weights[r]
    logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits


def log10_probability(weights: np.ndarray, bucket: np.ndarray, last: np.ndarray, skip: np.ndarray) -> np.ndarray:
    """log10 of P(class) * P(member) of every token."""
    out = np.empty(len(bucket))
    for s in range(0, len(bucket), 16 * BATCH):
        b = bucket[s:s + 16 * BATCH]
        of_class, of_member = features(b, last[s:s + 16 * BATCH], skip[s:s + 16 * BATCH])
        n = np.arange(len(b))
        p = softmax(weights, of_class)[n, b // WIDE] * softmax(weights, of_member)[n, b % WIDE].astype(np.float64)
        out[s:s + 16 * BATCH] = np.log10(np.maximum(p, 1e-300))
    return out


class Trainer:
    """Mini-batch gradient steps over one shard's tokens."""

    def __init__(self, weights: np.ndarray, size: float):
        self.size = np.float32(size)
        self.weights = weights.copy()
        self.squares = np.full(ROWS, DAMPING, dtype=np.float32)
        self.used = np.zeros(ROWS, dtype=np.int64)

    def step(self, bucket, last, skip):
        of_class, of_member = features(bucket, last, skip)
        n = np.arange(len(bucket))
        moves = []
        for rows, target in ((of_class, bucket // WIDE), (of_member, bucket % WIDE)):
            error = softmax(self.weights, rows)
            error[n, target] -= 1
            for r in rows:
                order = np.argsort(r, kind="stable")
                ordered = r[order]
                at = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
                moves.append((ordered[at], np.add.reduceat(error[order], at, axis=0), np.diff(np.append(at, len(r)))))
        for row, gradient, count in moves:
            self.used[row] += count
            self.squares[row] += (gradient ** 2).mean(axis=1)
            self.weights[row] -= self.size * gradient / np.sqrt(self.squares[row])[:, None]

    def learn(self, texts):
        hashes, stops = tokens(texts)
        if not len(hashes):
            return
        bucket = buckets_of(hashes)
        last, skip = histories(bucket, stops)
        for s in range(0, len(bucket), BATCH):
            self.step(bucket[s:s + BATCH], last[s:s + BATCH], skip[s:s + BATCH])


def start_weights(totals: np.ndarray) -> np.ndarray:
    """Weights of the model without history: the shares of classes and members in the counts."""
    weights = np.zeros((ROWS, WIDE), dtype=np.float32)
    share = (totals + 1.0).reshape(WIDE, WIDE)
    weights[0] = np.log(share.sum(axis=1) / share.sum())
    weights[_OWN:_OWN + WIDE] = np.log(share / share.sum(axis=1, keepdims=True))
    return weights


def train_round(shards: DataFrame, weights: np.ndarray, size: float) -> np.ndarray:
    """Weights after one pass with steps of ``size`` over all shards (shard, place, text): the mean change by row, weighted by use."""
    columns = [f"w{i}" for i in range(WIDE)]
    schema = T.StructType([T.StructField("row", T.IntegerType()), T.StructField("used", T.LongType()),
                           *(T.StructField(c, T.DoubleType()) for c in columns)])

    def learn(shard: pa.Table) -> pa.Table:
        trainer = Trainer(weights, size)
        texts = shard["text"]
        order = shard.select(["place"]).append_column("at", pa.array(range(len(texts)))).sort_by("place")["at"].to_numpy()
        for s in range(0, len(order), 512):
            trainer.learn(texts.take(order[s:s + 512]).to_pylist())
        row = np.flatnonzero(trainer.used)
        moved = (trainer.weights[row] - weights[row]).astype(np.float64) * trainer.used[row][:, None]
        return pa.table([pa.array(row.astype(np.int32)), pa.array(trainer.used[row]),
                         *(pa.array(np.ascontiguousarray(moved[:, i])) for i in range(WIDE))], ["row", "used", *columns])

    moved = (shards.groupBy("shard").applyInArrow(learn, schema).groupBy("row")
             .agg(F.sum("used").alias("used"), *(F.sum(c).alias(c) for c in columns)).collect())
    out = weights.copy()
    for r in moved:
        out[r["row"]] += np.array(r[2:], dtype=np.float64) / r["used"]
    return out


def _unit_words(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    hashes, stops = tokens(frame["text"].tolist())
    words, place = np.unique(hashes, return_inverse=True)
    return hashes, stops, words, place


def _by_part(words: np.ndarray, parts: int) -> list[tuple[int, np.ndarray]]:
    """(part, places of its words) for each part of the hash range that has any: one sort, whatever ``parts``."""
    part = (words % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order])) + 1
    return [(int(part[places[0]]), places) for places in np.split(order, cuts) if len(places)]


def score_documents(docs: DataFrame, learns: Column, id_col: str = "doc_id", text_col: str = "text",
                    rounds: int = ROUNDS, unit_docs: int = UNIT_DOCS,
                    shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of every row; it learns from the
    rows for which ``learns`` holds."""
    learns = F.coalesce(learns, F.lit(False))
    id_type = docs.schema[id_col].dataType
    docs = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), learns.alias("learns"))
    bounds = docs.agg(F.count(F.lit(1)).alias("rows"),
                      F.sum(F.when(F.col("learns"), F.octet_length("text"))).alias("learned")).first()
    units = max(1, -(-bounds["rows"] // unit_docs))
    parts = max(1, -(-units * UNIT_WORDS // PART_ENTRIES))
    dealt = docs.withColumn("unit", F.pmod(F.xxhash64("id", "text"), F.lit(units)).cast("int"))

    def ask(frame: pd.DataFrame) -> pd.DataFrame:
        hashes, stops, words, place = _unit_words(frame)
        taught = np.repeat(frame["learns"].to_numpy(dtype=bool), np.diff(stops, prepend=-1))
        counts = np.bincount(place[taught], minlength=len(words)).astype(np.int64)
        unit = int(frame["unit"].iloc[0])
        rows = [(unit, p, words[places].tobytes(), counts[places].tobytes()) for p, places in _by_part(words, parts)]
        return pd.DataFrame(rows, columns=["unit", "part", "words", "counts"])

    def answer(frame: pd.DataFrame) -> pd.DataFrame:
        words = [np.frombuffer(w, dtype=np.uint64) for w in frame["words"]]
        distinct, place = np.unique(np.concatenate(words), return_inverse=True)
        counts = np.zeros(len(distinct), dtype=np.int64)
        np.add.at(counts, place, np.concatenate([np.frombuffer(c, dtype=np.int64) for c in frame["counts"]]))
        bounds = np.cumsum([len(w) for w in words])[:-1]
        bucket = buckets_of(distinct)
        known = counts > 0
        totals = np.concatenate((np.bincount(bucket, weights=counts, minlength=BUCKETS).astype(np.int64),
                                 np.bincount(bucket[known], minlength=BUCKETS)))
        answers = [c.tobytes() for c in np.split(counts[place], bounds)]
        return pd.DataFrame({"unit": [*frame["unit"], -1], "part": [*frame["part"], frame["part"].iloc[0]],
                             "counts": [*answers, None], "totals": [*([None] * len(answers)), totals]})

    asked = dealt.groupBy("unit").applyInPandas(ask, "unit int, part int, words binary, counts binary")
    answered = stored(asked.groupBy("part").applyInPandas(
        answer, "unit int, part int, counts binary, totals array<long>"), "word-counts")
    sums = (answered.where("unit = -1").select(F.posexplode("totals").alias("at", "n"))
            .groupBy("at").agg(F.sum("n").alias("n")).collect())
    totals = np.zeros(2 * BUCKETS, dtype=np.int64)
    for r in sums:
        totals[r["at"]] = r["n"]
    in_bucket, distinct_in = totals[:BUCKETS], totals[BUCKETS:]
    train_tokens, distinct = int(in_bucket.sum()), int(distinct_in.sum())

    weights = start_weights(in_bucket)
    place = F.xxhash64("text", "id")
    shards = rounds * max(1, -(-(bounds["learned"] or 0) // (rounds * shard_bytes)))
    taught = docs.where("learns").select("text", place.alias("place"), F.pmod(place, F.lit(shards)).alias("shard"))
    for r in range(rounds):
        weights = train_round(taught.where(F.col("shard") % rounds == r), weights, STEP / (r + 1) ** 0.5)

    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("n_tokens", T.LongType()),
                           T.StructField("n_known", T.LongType()), T.StructField("train_tokens", T.LongType()),
                           T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])

    def score(frame: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        hashes, stops, words, place = _unit_words(frame)
        count = np.zeros(len(words), dtype=np.int64)
        places = dict(_by_part(words, parts))
        for p, c in zip(answers["part"], answers["counts"], strict=True):
            count[places[p]] = np.frombuffer(c, dtype=np.int64)
        bucket_of_word = buckets_of(words)
        base = np.log10((count + 1) / (train_tokens + distinct + 1))
        in_own = np.log10((count + 1) / (in_bucket + distinct_in + 1)[bucket_of_word])
        bucket = bucket_of_word[place]
        last, skip = histories(bucket, stops)
        model = log10_probability(weights, bucket, last, skip) + in_own[place]
        begin = np.concatenate(([0], stops[:-1] + 1))
        add = lambda x: np.add.reduceat(x, begin)
        return pd.DataFrame({"id": frame["id"], "n_tokens": np.diff(stops, prepend=-1),
                             "n_known": add((count > 0)[place].astype(np.int64)), "train_tokens": train_tokens,
                             "base_score": add(base[place]), "score": add(model)})

    answers = answered.where("unit >= 0").select("unit", "part", "counts")
    scored = dealt.groupBy("unit").cogroup(answers.groupBy("unit")).applyInPandas(score, schema)
    return scored.select(F.col("id").cast(id_type).alias(id_col), *schema.names[1:])
