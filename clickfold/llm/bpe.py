"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece exactly one token can end its merge-order encoding. ``Prefixes`` stores
that last token per byte position, so that

* encoding is linear in the bytes (each position tries the vocabulary's tokens that end there),
* an append only computes the new positions, from the longest token's length before them,
* an edit re-computes from its first byte and stops once the stored tokens agree again over the
  longest token's length, from where both tables must stay equal.

A token may follow a prefix if it and the prefix's last token stay apart when their bytes are
encoded together; ``Vocabulary.stay_apart`` decides that from the merge tree of the two tokens.

NULL text counts as empty: no tokens, empty decoding. Repeated rows give repeated results; extra
columns are ignored. Texts are encoded whole, piece by piece of the splitting pattern.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickfold.llm.common import own_cache, small_batches, tidy

#: Encoded pieces that a worker keeps in each of two generations: what is used again moves to the new one,
#: and the old one goes when the new one is full. Only time depends on it.
PIECE_STORE = 250_000
#: Decided token pairs that a worker keeps, in the same way.
PAIR_STORE = 200_000


class Generations(dict):
    """A bounded store of computed values; a missing one is looked up in the old generation, then made."""

    def __init__(self, size: int, make, keeps=lambda key: True):
        super().__init__()
        self.size, self.make, self.keeps, self.old = size, make, keeps, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if not self.keeps(key):
                return value
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Vocabulary:
    """Token bytes by rank, and the two parts whose merge made each token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.rank = ranks
        self.text = {r: t for t, r in ranks.items()}
        self.size = {r: len(t) for t, r in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.plain: set[int] = set()  # tokens that encoding their own bytes gives back
        self.width = max(ranks.values(), default=0) + 1
        #: by left token * width + right token: whether right can follow left
        self.follows = Generations(PAIR_STORE, lambda pair: (r := pair % self.width) in self.plain
                                   and self.stay_apart(pair // self.width, r))
        for token, r in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                self.plain.add(r)
                continue
            pieces = self._merge_below(token, r)
            if len(pieces) == 2:
                self.parts[r] = pair = (pieces[0], pieces[1])
                self.merged[pair] = r
                self.plain.add(r)

    def walk_back(self, last: list[int]) -> list[int]:
        """The encoding that ends with the last token of the whole."""
        out, end, size = [], len(last), self.size
        while end:
            token = last[end - 1]
            out.append(token)
            end -= size[token]
        return out[::-1]

    def encode(self, data: bytes) -> list[int]:
        """The tokens of ``data``: ``extend`` from nothing, written out as most pieces come this way once."""
        rank, follows, width, plain = self.rank.get, self.follows, self.width, self.plain
        last: list[int] = []
        start = 0  # where the token of the prefix before began
        for end in range(1, len(data) + 1):
            token = rank(data[start:end])
            if token is None or not (follows[last[start - 1] * width + token] if start else token in plain):
                start = end
                while start:
                    start -= 1
                    token = rank(data[start:end])
                    if token is not None and (follows[last[start - 1] * width + token] if start else token in plain):
                        break
                else:
                    raise ValueError("the vocabulary lacks a byte of the text")
            last.append(token)
        return self.walk_back(last)

    def _merge_below(self, token: bytes, limit: int) -> list[int]:
        """Merge the bytes of ``token`` with all merges of a rank under ``limit``."""
        rank = self.rank
        parts = [token[i:i + 1] for i in range(len(token))]
        while len(parts) > 1:
            best, at = limit, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1], limit)
                if r < best:
                    best, at = r, i
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [rank[p] for p in parts]

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether the boundary between two tokens survives encoding their joined bytes.

        Undo the later of the two tokens' merges step by step. While the parts beside the boundary
        are ``left`` and ``right``, a merge across it would happen if it ranks before whatever
        absorbed them; of equal ranks the leftmost goes first, which favours the crossing merge
        over one inside the right token.
        """
        parts, merged = self.parts, self.merged
        left_until = right_until = 1 << 62
        while True:
            across = merged.get((left, right))
            if across is not None and across < left_until and across <= right_until:
                return False
            a, b = parts.get(left), parts.get(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and left > right):
                left_until = min(left_until, left)
                right_until = min(right_until, left - 1)
                left = a[1]
            else:
                left_until = min(left_until, right + 1)
                right_until = min(right_until, right)
                right = b[0]

    def extend(self, data: bytes, last: list[int], base: int = 0, until: int | None = None) -> None:
        """Append to ``last`` the last tokens of the prefixes up to ``until`` bytes. ``data`` holds the bytes
        from ``base`` on, at least the longest token's length before the first new one.

        Only one token fits each prefix, so the order of the tries is free: first the token of the prefix
        before, one byte longer, then from short to long.
        """
        rank, follows, width, size, plain = self.rank.get, self.follows, self.width, self.size, self.plain
        for end in range(len(last) + 1, (base + len(data) if until is None else until) + 1):
            grown = end - 1 - size[last[-1]] if last else 0
            start, token = grown, rank(data[max(0, grown - base):end - base]) if grown >= base else None
            if token is None or not (follows[last[start - 1] * width + token] if start else token in plain):
                for start in range(end - 1, max(base - 1, end - self.longest - 1), -1):
                    token = rank(data[start - base:end - base])
                    if token is not None and (follows[last[start - 1] * width + token] if start else token in plain):
                        break
                else:
                    raise ValueError("the vocabulary lacks a byte of the text")
            last.append(token)


class Prefixes:
    """The unique last token of every byte prefix of a growing, editable byte string."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary = vocabulary
        self.data = bytearray()
        self.last: list[int] = []
        self.append(data)

    def _extend(self, until: int | None = None) -> None:
        base = max(0, len(self.last) - self.vocabulary.longest)
        self.vocabulary.extend(bytes(memoryview(self.data)[base:until]), self.last, base, until)

    def append(self, data: bytes) -> None:
        """Add bytes at the end; what was there before is not touched."""
        self.data += data
        self._extend()

    def replace(self, start: int, stop: int, data: bytes) -> int:
        """Put ``data`` in place of [start, stop); return how many positions were computed anew."""
        old, shift = self.last, len(data) - (stop - start)
        self.data[start:stop] = data
        self.last = old[:start]
        fixed, longest = start + len(data), self.vocabulary.longest
        while len(self.last) < len(self.data):
            done = len(self.last)
            self._extend(min(len(self.data), done + 4 * longest))
            agreed = 0
            for end in range(max(done - longest, fixed), len(self.last)):
                agreed = agreed + 1 if old[end - shift] == self.last[end] else 0
                if agreed >= longest:
                    computed = len(self.last) - start
                    self.last += old[len(self.last) - shift:]
                    return computed
        return len(self.data) - start

    def tokens(self) -> list[int]:
        return self.vocabulary.walk_back(self.last)


class Encoder:
    """Encodes texts piece by piece; pieces that are tokens themselves are taken whole."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary = vocabulary
        self.split = regex.compile(pattern).findall
        #: by piece: its ids packed as 32-bit numbers, in decimals, and decoded again
        self.pieces = Generations(PIECE_STORE, self._piece, lambda piece: len(piece) <= 64)
        self.whole = {r: self._forms([r]) for r in vocabulary.text}

    def _forms(self, ids: list[int]) -> tuple[bytes, bytes, bytes]:
        return struct.pack(f"<{len(ids)}i", *ids), b" ".join([b"%d" % i for i in ids]), self.decode(ids)

    def _piece(self, piece: str) -> tuple[bytes, bytes, bytes]:
        data = piece.encode("utf-8")
        whole = self.vocabulary.rank.get(data)
        return self._forms(self.vocabulary.encode(data)) if whole is None else self.whole[whole]

    def forms(self, text: str) -> list[tuple[bytes, bytes, bytes]]:
        """The three forms of every piece."""
        return [*map(self.pieces.__getitem__, self.split(text))]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(b"".join([f[0] for f in self.forms(text)]), dtype="<i4").tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.vocabulary.text.__getitem__, ids))


@own_cache
@lru_cache(maxsize=4)
def load(path: str, pattern: str) -> Encoder:
    """The encoder of a rank file (lines of base64 token and rank); once per Python worker."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, lines))}
    return Encoder(Vocabulary(ranks), pattern)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the token ids of every text. ``path`` must name a file that every worker can open."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType),
                           T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(path, pattern)
        for batch in it:
            ids = [np.frombuffer(b"".join([f[0] for f in encoder.forms(t or "")]), dtype="<i4") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], [id_col, "ids"])

    return small_batches(docs.select(id_col, text_col)).mapInArrow(tidy(batches), schema)


def decode(tokens: DataFrame, path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """(id, data): the bytes that each row's ``ids`` stand for; NULL ids give no bytes."""
    schema = T.StructType([T.StructField(id_col, tokens.schema[id_col].dataType),
                           T.StructField("data", T.BinaryType())])

    def batches(it):
        encoder = load(path, pattern)
        for batch in it:
            data = [encoder.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], [id_col, "data"])

    return tokens.select(id_col, "ids").mapInArrow(tidy(batches), schema)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
               with_ids: bool = False) -> DataFrame:
    """Encode every text, decode the ids, and digest both: the ids as decimals joined by one space.

    One pass over the text without a shuffle. ``with_ids`` adds the ids themselves.
    """
    fields = [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()),
              T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    names = [f.name for f in fields]

    def batches(it):
        encoder = load(path, pattern)
        for batch in it:
            counts, digests, decoded, kept = [], [], [], []
            for text in batch.column(1).to_pylist():
                forms = encoder.forms(text or "")
                ids = np.frombuffer(b"".join([f[0] for f in forms]), dtype="<i4")
                counts.append(len(ids))
                digests.append(hashlib.sha256(b" ".join([f[1] for f in forms])).hexdigest())
                decoded.append(hashlib.sha256(b"".join([f[2] for f in forms])).hexdigest())
                if with_ids:
                    kept.append(ids)
            arrays = [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            if with_ids:
                arrays.append(pa.array(kept, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names)

    return small_batches(docs.select(F.col(id_col), F.col(text_col))).mapInArrow(tidy(batches), T.StructType(fields))
