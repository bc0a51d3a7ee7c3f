"""Cross-tokenizer alignment over distinct texts.

Two tokenizers cut the same bytes (a space and the text) into tokens A and B. Byte offsets where an
A and a B token both end cut the tokens into groups; an A and a B token are linked if their byte
ranges overlap. How often a pair of ids is linked anywhere in the corpus is the pair's count.

1. One shuffle by the full text makes every distinct text one row with its multiplicity. A text that
   a third of all rows share is one row per task before the shuffle.
2. Every distinct text is tokenised and aligned once. Some texts of a task, bounded in bytes, are a unit: one row with the texts' measures, the unit's id pairs with their links times
   multiplicity, and for every text the pairs of its links as positions in that list.
3. Pair counts are sums over units, combined before the shuffle; the highest count of every B id
   follows from them. Pairs with counts return to the units that hold them, where each text's measures
   over its links are summed.
4. The measures join the rows of the input by the text's SHA-256, so no text moves a second time.

No text, link or count passes through the driver, and what a task holds at a time is one unit. A B id
whose pairs are many, and a pair that every unit holds, are keys of plain joins, which Spark splits.

Defined cases: NULL and empty texts, and texts whose joined A or B bytes differ from space + text (B
knows no U+2581 of its own, for one), have no tokens: zeros and an empty ``groups_sha256``; they
add nothing to the counts. Repeated rows get the same measures each and count each. A NULL id stays
NULL. Other columns of the input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickfold.llm.common import own_cache, runs_of, small_batches, stored, tidy

#: Text of a unit; a longer text is a unit of its own.
UNIT_BYTES = 2 << 20
MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1 characters for
    themselves, all others in order from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Tokenizers:
    """Both encoders, and the bytes of their tokens by id."""

    def __init__(self, a_path: str, b_path: str, pattern: str):
        with open(a_path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        letters, vocab = byte_letters(), model["vocab"]
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        if model["type"] != "BPE" or any(vocab[x] >= vocab[y] for x, y in zip(merged, merged[1:])):
            raise ValueError("A must be a byte-level BPE whose ids follow the order of its merges")
        singles = [t for t in vocab if len(t) == 1]
        ranks = {bytes(letters[c] for c in t): vocab[t] for t in [*singles, *merged]}
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        piece = self.b.id_to_piece
        self.b_bytes = [bytes([int(piece(i)[3:5], 16)]) if self.b.is_byte(i) else piece(i).replace("▁", " ").encode()
                        for i in range(self.b.get_piece_size())]
        self.a_size, self.b_size = (np.array([len(t) for t in x]) for x in (self.a_bytes, self.b_bytes))
        # decimal ids followed by what separates them: another id of the group, or its other half or the next group
        self.written = np.array([b"%d%s" % (i, end) for n, ends in ((len(self.a_bytes), (b",", b"|")), (len(self.b_bytes), (b",", b";")))
                                 for end in ends for i in range(n)], dtype=object)

    def ids(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of both, or none where the bytes do not come back."""
        data = " " + text
        a, b = self.a.encode_ordinary(data), self.b.encode(text)
        raw = data.encode("utf-8")
        if not text or self.a.decode_bytes(a) != raw or b"".join(map(self.b_bytes.__getitem__, b)) != raw:
            return [], []
        return a, b


@own_cache
@lru_cache(maxsize=2)
def load(a_path: str, b_path: str, pattern: str) -> Tokenizers:
    """Once per Python worker."""
    return Tokenizers(a_path, b_path, pattern)


def _cuts(sizes) -> np.ndarray:
    return np.array([0, *accumulate(sizes)])


class Unit:
    """The alignment of some texts: their measures and, in ``links``, the id pair of every link."""

    def __init__(self, tokenizers: Tokenizers, texts: list[str]):
        found = [tuple(np.array(ids, dtype=np.int32) for ids in tokenizers.ids(t)) for t in texts]
        none = np.empty(0, np.int32)
        a, b = (np.concatenate([none, *(ids[side] for ids in found)]).astype(np.int64) for side in (0, 1))
        a_cut, b_cut = (_cuts(len(ids[side]) for ids in found) for side in (0, 1))
        # Both sides cover the same bytes, text after text, so ends can be compared over the whole unit.
        a_end, b_end = np.cumsum(tokenizers.a_size[a]), np.cumsum(tokenizers.b_size[b])
        over = np.searchsorted(b_end, a_end)  # the B token that holds an A token's last byte
        a_shared = b_end[over] == a_end if len(a) else np.empty(0, bool)
        b_shared = np.zeros(len(b), dtype=bool)
        b_shared[over[a_shared]] = True
        inner = np.flatnonzero(~b_shared)  # B tokens that end inside an A token
        a_groups, b_groups = (np.concatenate(([0], np.cumsum(x))) for x in (a_shared, b_shared))
        #: per text
        self.n_a, self.n_b = np.diff(a_cut), np.diff(b_cut)
        self.n_groups = np.diff(a_groups[a_cut])
        inner_cut = np.searchsorted(inner, b_cut)
        self.n_links = self.n_a + np.diff(inner_cut)
        #: every pair of overlapping tokens has one last shared byte, which ends a token of either side
        width = len(tokenizers.b_bytes)
        pairs = np.concatenate((a * width + b[over], a[np.searchsorted(a_end, b_end[inner])] * width + b[inner]))
        text = np.arange(len(texts))
        owner = np.concatenate((np.repeat(text, self.n_a), np.repeat(text, np.diff(inner_cut))))
        self.links = pairs[np.argsort(owner, kind="stable")]
        # every token's place among both sides' tokens in the order of groups, A first
        written, n = np.empty(len(a) + len(b), dtype=np.int64), len(tokenizers.a_bytes)
        written[np.arange(len(a)) + np.searchsorted(b_groups, a_groups[:-1])] = a + n * a_shared
        last = np.flatnonzero(a_shared)
        written[np.arange(len(b)) + (last[b_groups[:-1]] + 1 if len(b) else 0)] = 2 * n + b + width * b_shared
        parts = tokenizers.written[written].tolist()
        self.groups = [hashlib.sha256(b"".join(parts[s:e])[:-1]).hexdigest() if e > s else ""
                       for s, e in zip((a_cut + b_cut).tolist(), (a_cut + b_cut)[1:].tolist())]


_UNIT = T.StructType([
    T.StructField("unit", T.LongType()), T.StructField("key", T.ArrayType(T.BinaryType())),
    *(T.StructField(n, T.ArrayType(T.LongType())) for n in MEASURES[:4]),
    T.StructField("groups_sha256", T.ArrayType(T.StringType())),
    T.StructField("links", T.BinaryType()),  # compressed places in ``pair``, text after text
    T.StructField("pair", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.LongType()))])
_MEASURED = T.StructType([T.StructField("key", T.BinaryType()), *(T.StructField(n, T.LongType()) for n in MEASURES),
                          T.StructField("groups_sha256", T.StringType())])


def _packed(places: np.ndarray) -> bytes:
    """Places as 32-bit numbers, their bytes put together by significance, compressed."""
    return pa.compress(places.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * n, codec="zstd", asbytes=True), dtype=np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def align_units(distinct: DataFrame, a_path: str, b_path: str, pattern: str) -> DataFrame:
    """A row for each unit of the texts in ``distinct`` (key, text, multiplicity)."""

    def batches(it):
        tokenizers, part = load(a_path, b_path, pattern), TaskContext.get().partitionId()
        parts = (batch.slice(s, e - s) for batch in it for s, e in runs_of(pc.binary_length(batch.column(1)).to_pylist(), UNIT_BYTES))
        for k, batch in enumerate(parts):
            unit = Unit(tokenizers, batch.column(1).to_pylist())
            pair, place = np.unique(unit.links, return_inverse=True)
            times = np.zeros(len(pair), dtype=np.int64)
            np.add.at(times, place, np.repeat(batch.column(2).to_numpy(), unit.n_links))
            # often used pairs come first: small places compress well
            order = np.argsort(-times, kind="stable")
            back = np.empty(len(order), dtype=np.int64)
            back[order] = np.arange(len(order))
            row = [(part << 33) + k, batch.column(0).to_pylist(), unit.n_a, unit.n_b, unit.n_groups, unit.n_links, unit.groups,
                   _packed(back[place]), pair[order], times[order]]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa_type) for x, pa_type in zip(row, _ARROW, strict=True)], _UNIT.fieldNames())

    return small_batches(distinct.select("key", "text", "multiplicity")).mapInArrow(tidy(batches), _UNIT)


_LONGS = pa.list_(pa.int64())
_ARROW = [pa.int64(), pa.list_(pa.binary()), *[_LONGS] * 4, pa.list_(pa.string()), pa.binary(), _LONGS, _LONGS]


def pair_counts(units: DataFrame) -> DataFrame:
    """(pair, count): how many links of the corpus hold each id pair. ``pair`` is A's id times the size of
    B's vocabulary plus B's id."""
    return units.select(F.explode(F.arrays_zip("pair", "times")).alias("x")).groupBy(F.col("x.pair").alias("pair")).agg(
        F.sum("x.times").alias("count"))


def _measure(unit: pa.Table, judged: pa.Table) -> pa.Table:
    """The texts of a unit with their sums over links; ``judged`` has its pairs' counts by place."""
    if not len(unit):
        return pa.table({f.name: pa.array([], t) for f, t in zip(_MEASURED, [pa.binary(), *[pa.int64()] * 6, pa.string()])})
    row = {n: unit[n].combine_chunks().flatten() for n in ("key", *MEASURES[:4], "groups_sha256")}
    n_links = row["n_links"].to_numpy()
    count, best = np.zeros(len(judged), dtype=np.int64), np.zeros(len(judged), dtype=np.int64)
    at = judged["place"].to_numpy()
    count[at], best[at] = judged["count"].to_numpy(), judged["best"].to_numpy()
    place = _unpacked(unit["links"][0].as_py(), int(n_links.sum()))
    ends = np.cumsum(n_links)
    total = lambda x: np.diff(np.concatenate(([0], np.concatenate(([0], np.cumsum(x[place])))[ends])))
    return pa.table({**{n: row[n] for n in ("key", *MEASURES[:4])}, "n_best": total(best), "count_sum": total(count),
                     "groups_sha256": row["groups_sha256"]})


def align(docs: DataFrame, a_path: str, b_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    ``a_path``: a byte-level BPE in the JSON form of the tokenizers library, whose pre-tokenizer splits by
    ``pattern``; ``b_path``: a SentencePiece model that puts a space before the text. Every worker must be
    able to open both. ``n_best`` counts the links whose pair has the highest count of its B id (ties
    included), ``count_sum`` sums the counts of all links; ``groups_sha256`` digests ``a1,a2|b1;a3|b2,b3``.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    key = F.unhex(F.sha2("text", 256))
    distinct = rows.groupBy("text").agg(F.count("*").alias("multiplicity")).withColumn("key", key)
    units = stored(align_units(distinct, a_path, b_path, pattern), "aligned-units")
    counts = stored(pair_counts(units), "pair-counts")
    width = F.lit(len(load(a_path, b_path, pattern).b_bytes))
    most = counts.groupBy((F.col("pair") % width).alias("b")).agg(F.max("count").alias("most"))
    judged = counts.join(most, F.col("pair") % width == F.col("b")).select(
        "pair", "count", (F.col("count") == F.col("most")).cast("int").alias("best"))
    held = units.select(F.col("unit").alias("in_unit"), F.posexplode("pair").alias("place", "pair"))
    back = held.join(judged, "pair").select("in_unit", "place", "count", "best")
    parts = units.select("unit", "key", *MEASURES[:4], "groups_sha256", "links")
    measured = parts.groupBy("unit").cogroup(back.groupBy("in_unit")).applyInArrow(_measure, _MEASURED)
    return rows.select("id", key.alias("key")).join(measured, "key").select(
        F.col("id").alias(id_col), *MEASURES, "groups_sha256")
