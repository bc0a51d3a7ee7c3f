"""Removal of repeated byte strings by a distributed, prefix-aware merge sort of suffixes.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier (smaller id, or the
same document further left). Sorting every suffix would exchange many times the input, so the sort
is sparse: of every window of ``LENGTH`` bytes only the position with the smallest hash of ``GRAM``
bytes is an anchor (the leftmost of equals). Equal windows have their anchor at the same place, so
windows need only be compared where anchors are.

1. Documents are dealt into units. A unit asks, packed by hash range, how often each of its anchors'
   grams occurs anywhere. Windows of a gram that occurs once cannot repeat.
2. For the others the unit sorts the suffixes at the anchors, and writes the sorted run front-coded:
   for each suffix the length it shares with the one before, and the rest. Beside it go the
   bytes left of the anchor. Runs are cut at sampled splitters of the gram, so a gram has one place.
   Anchors whose whole surroundings are the same within a unit are one entry.
3. Each part merges its runs with a loser tree that carries, for every run's head, the prefix known
   to be shared with the last suffix put out: the longer one wins unseen, and only equals are compared,
   from there on. The merge gives the suffixes in order and their shared prefixes.
4. Two windows with their anchor ``o`` bytes in are equal if their suffixes share LENGTH - o bytes
   and the ``o`` bytes to the left are equal. All but the first of equal windows are repeats. They
   go back to their unit, where spans are joined and cut out.

A gram with over ``HOT`` different surroundings is split: its windows are entries of their own (the
suffix at the window, nothing to the left), dealt by their full bytes, so equal windows
meet, at most one per unit, and the rest spreads.

Defined cases: NULL text is empty; ids must be whole numbers; rows with NULL ids come last; rows
that share an id are ordered by their unit, and of wholly equal rows one stays; texts below
``LENGTH`` bytes lose nothing. Removal may cut through a character, so the rest is returned as bytes.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickfold.llm.common import mix64, range_hashes, runs_of

LENGTH, GRAM, HOT = 100, 32, 100_000
UNIT_DOCS, STARTS_AT_ONCE, PART_ENTRIES = 2_000, 1 << 20, 1 << 20
#: Grams expected in a unit (sets the number of parts), and documents from which splitters are drawn.
UNIT_GRAMS, SAMPLE_DOCS = 200_000, 2_000
NO_ID = np.iinfo(np.int64).max


class Anchors:
    """Anchors of many texts: document, place, first and last window start, gram and context hashes."""

    def __init__(self, texts: list[bytes], length: int, gram: int):
        self.length = length
        found = []
        segments = [(d, a) for d, t in enumerate(texts) for a in range(0, len(t) - length + 1, STARTS_AT_ONCE)]
        size = lambda s: min(len(texts[s[0]]) - s[1], STARTS_AT_ONCE + length - 1)
        for x, y in runs_of([size(s) for s in segments], STARTS_AT_ONCE):
            found.append(self._of(texts, segments[x:y], [size(s) for s in segments[x:y]], gram))
        empty = [np.empty(0, np.int64)] * 4 + [np.empty(0, np.uint64)] * 2
        self.doc, self.at, self.low, self.high, self.gram, self.context = (
            np.concatenate([f[i] for f in found]) if found else empty[i] for i in range(6))

    def _of(self, texts, segments, sizes, gram):
        data = np.frombuffer(b"".join(texts[d][a:a + n] for (d, a), n in zip(segments, sizes, strict=True)), dtype=np.uint8)
        first = np.cumsum([0, *sizes])
        span = self.length - gram + 1
        grams = range_hashes(data, np.arange(len(data) - gram + 1), np.arange(gram, len(data) + 1))
        # Smallest hash over `span` grams, its place in the low bits: doubled runs, then two overlapping ones.
        least = grams & ~np.uint64(0xFFFFFF) | np.arange(len(grams), dtype=np.uint64)
        have = 1
        while 2 * have <= span:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        if have < span:
            least = np.minimum(least[:have - span], least[span - have:])
        place = (least & np.uint64(0xFFFFFF)).astype(np.int64)
        starts = np.concatenate([np.arange(f, f + n - self.length + 1) for f, n in zip(first, sizes)])
        segment = np.repeat(np.arange(len(sizes)), [n - self.length + 1 for n in sizes])
        anchor = place[starts]
        new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (segment[1:] != segment[:-1])))
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(starts)) - 1
        low, high, at, segment = starts[begin], starts[end], anchor[begin], segment[begin]
        context = range_hashes(data, low, high + self.length) + mix64((at - low).astype(np.uint64))
        shift = np.array([a for _, a in segments]) - first[:-1]
        doc = np.array([d for d, _ in segments])
        move = shift[segment]
        return doc[segment], at + move, low + move, high + move, grams[at], context


def shared_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of two strings that agree in their first ``known`` bytes."""
    n = min(len(a), len(b))
    while known + 16 <= n and a[known:known + 16] == b[known:known + 16]:
        known += 16
    while known < n and a[known] == b[known]:
        known += 1
    return known


class Run:
    """A sorted, front-coded run, decoded as it is read."""

    __slots__ = ("shared", "sizes", "rest", "next", "offset", "text")

    def __init__(self, shared: list[int], sizes: list[int], rest: bytes):
        self.shared, self.sizes, self.rest = shared, sizes, rest
        self.next, self.offset, self.text = 0, 0, b""

    def advance(self) -> int:
        """Read the next suffix; the prefix it shares with the one before, or -1 at the end."""
        i = self.next
        if i == len(self.shared):
            self.text = None
            return -1
        stop = self.offset + self.sizes[i]
        self.text = self.text[:self.shared[i]] + self.rest[self.offset:stop]
        self.offset, self.next = stop, i + 1
        return self.shared[i]


def merge(runs: list[Run]) -> tuple[list[int], list[int]]:
    """Run of every suffix in sorted order, and the prefix shared with the suffix before it.

    In the tree each inner node keeps the loser of its match with the prefix it shares with the
    winner. A match between two heads is decided by their prefixes shared with the last suffix put
    out, if these differ; otherwise by comparing from there.
    """
    k = len(runs)
    known = [run.advance() for run in runs]
    loser = [-1] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's known prefix becomes the one shared with the winner."""
        x, y = known[a], known[b]
        if x != y:
            return (a, b) if x > y else (b, a)
        if x < 0:
            return a, b
        s, t = runs[a].text, runs[b].text
        n = shared_prefix(s, t, x)
        first = len(s) == n if len(s) == n or len(t) == n else s[n] < t[n]
        if first:
            known[b] = n
            return a, b
        known[a] = n
        return b, a

    for i in range(k):  # first round: nothing is known of any pair
        if known[i] >= 0:
            known[i] = 0
    winner = [-1] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        winner[node], loser[node] = play(winner[2 * node], winner[2 * node + 1])
    top = winner[1] if k > 1 else 0
    order, shared = [], []
    while known[top] >= 0:
        order.append(top)
        shared.append(known[top])
        known[top] = runs[top].advance()
        node = (top + k) // 2
        while node:
            top, loser[node] = play(top, loser[node])
            node //= 2
    return order, shared


def repeats(shared: np.ndarray, left: list[bytes], least: np.ndarray, most: np.ndarray, rank: np.ndarray,
            length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Repeated windows of suffixes given in sorted order, as (suffix, from, to) ranges of the
    anchor's place in the window. ``least`` and ``most`` bound that place; ``rank`` says who is earlier."""
    n = len(left)
    wide = -(-(int(most.max()) + 1) // 8) * 8
    # Left bytes, nearest first, as big-endian words: their order gives the classes of equal left sides.
    sizes = np.array([len(x) for x in left])
    matrix = np.zeros((n, wide), dtype=np.uint8)
    flat = np.frombuffer(b"".join(x[::-1] for x in left), dtype=np.uint8)
    matrix[np.arange(wide) < sizes[:, None]] = flat
    by_left = np.lexsort((sizes, *matrix.view(">u8").T[::-1]))
    same = matrix[by_left[1:]] == matrix[by_left[:-1]]
    shared_left = np.where(same.all(axis=1), wide, np.argmin(same, axis=1))
    shared_left = np.minimum(shared_left, np.minimum(sizes[by_left[1:]], sizes[by_left[:-1]]))
    by_rank = np.argsort(rank, kind="stable")
    found = np.zeros((n, int(most.max()) + 2), dtype=bool)
    right, left_class = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for o in range(int(least.min()), int(most.max()) + 1):
        right[1:] = np.cumsum(shared[1:] < length - o)
        left_class[by_left] = np.concatenate(([0], np.cumsum(shared_left < o)))
        here = by_rank[(least[by_rank] <= o) & (o <= most[by_rank])]
        key = right[here] * n + left_class[here]
        _, first = np.unique(key, return_index=True)
        later = np.ones(len(here), dtype=bool)
        later[first] = False
        found[here[later], o] = True
    edges = np.diff(np.pad(found, ((0, 0), (1, 0))).astype(np.int8), axis=1)
    suffix, begin = np.nonzero(edges == 1)
    _, end = np.nonzero(edges == -1)
    return suffix, begin, end - 1


def _i32(*columns) -> bytes:
    return np.stack(columns, axis=1).astype(np.int32).tobytes() if len(columns[0]) else b""


def _unit(frame: pd.DataFrame) -> tuple[pd.DataFrame, list[bytes]]:
    """A unit's rows in order of their ids, and their bytes."""
    frame = frame.sort_values(["id", "text"], kind="stable", na_position="last").reset_index(drop=True)
    return frame, [(t or "").encode("utf-8", "surrogatepass") for t in frame["text"]]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   gram: int = GRAM, hot: int = HOT, unit_docs: int = UNIT_DOCS) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept) of every row; kept are the remaining bytes."""
    id_type = docs.schema[id_col].dataType
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    n_docs = docs.count()
    units = max(1, -(-n_docs // unit_docs))
    parts = max(1, -(-units * UNIT_GRAMS // PART_ENTRIES))
    # The marked NULL id keeps the column whole-numbered in pandas.
    dealt = docs.select(F.coalesce("id", F.lit(int(NO_ID))).alias("id"), F.col("id").isNull().alias("no_id"), "text",
                        F.pmod(F.xxhash64("id", "text"), F.lit(units)).cast("int").alias("unit"))

    def heads(it):
        for batch in it:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(0).to_pylist()]
            a = Anchors(texts, length, gram)
            yield pa.RecordBatch.from_arrays([pa.array([texts[d][p:p + length] for d, p in zip(a.doc.tolist()[::7], a.at.tolist()[::7])],
                                                       pa.binary())], ["head"])

    share = min(1.0, SAMPLE_DOCS / max(1, n_docs))
    sample = sorted(bytes(r[0]) for r in docs.select("text").sample(share, seed=11).limit(2 * SAMPLE_DOCS)
                    .mapInArrow(heads, "head binary").collect()) if units > 1 else []
    splitters = sorted({sample[i * len(sample) // units] for i in range(1, units)}) if sample else []

    def ask(frame: pd.DataFrame) -> pd.DataFrame:
        unit = int(frame["unit"].iloc[0])
        _, texts = _unit(frame)
        a = Anchors(texts, length, gram)
        grams, place, occurs = np.unique(a.gram, return_inverse=True, return_counts=True)
        _, distinct = np.unique(a.context ^ mix64(a.gram), return_index=True)
        contexts = np.bincount(place[distinct], minlength=len(grams))
        contexts[(contexts == 1) & (occurs > 1)] = 2
        part = (grams % np.uint64(parts)).astype(np.int64)
        rows = [(unit, p, grams[part == p].tobytes(), contexts[part == p].astype(np.int64).tobytes()) for p in np.unique(part).tolist()]
        return pd.DataFrame(rows, columns=["unit", "part", "grams", "counts"])

    def answer(frame: pd.DataFrame) -> pd.DataFrame:
        grams = [np.frombuffer(g, dtype=np.uint64) for g in frame["grams"]]
        distinct, place = np.unique(np.concatenate(grams), return_inverse=True)
        total = np.zeros(len(distinct), dtype=np.int64)
        np.add.at(total, place, np.concatenate([np.frombuffer(c, dtype=np.int64) for c in frame["counts"]]))
        # 0: occurs once; 1: repeated; 2: hot.
        kind = ((total > 1).astype(np.uint8) + (total > hot).astype(np.uint8))[place]
        return pd.DataFrame({"unit": frame["unit"], "part": frame["part"],
                             "kinds": [k.tobytes() for k in np.split(kind, np.cumsum([len(g) for g in grams])[:-1])]})

    columns = ["slice", "unit", "meta", "ids", "rest", "left", "own"]

    def run(frame: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(frame):
            return pd.DataFrame(columns=columns)
        unit = int(frame["unit"].iloc[0])
        frame, texts = _unit(frame)
        ids = frame["id"].to_numpy(dtype=np.int64)
        a = Anchors(texts, length, gram)
        grams, place = np.unique(a.gram, return_inverse=True)
        part = (grams % np.uint64(parts)).astype(np.int64)
        kind = np.zeros(len(grams), dtype=np.uint8)
        for p, k in zip(answers["part"], answers["kinds"], strict=True):
            kind[part == p] = np.frombuffer(k, dtype=np.uint8)
        kind = kind[place]
        seen: set[tuple[bytes, int]] = set()
        own: list[tuple[int, int, int]] = []
        # Slice, suffix, bytes to the left, least place of the anchor in a window, document, anchor.
        entries: list[tuple[int, bytes, bytes, int, int, int]] = []
        chosen = np.flatnonzero(kind)
        for d, p, low, high, k in zip(a.doc[chosen].tolist(), a.at[chosen].tolist(), a.low[chosen].tolist(),
                                      a.high[chosen].tolist(), kind[chosen].tolist(), strict=True):
            text = texts[d]
            around = (text[low:high + length], p - low)
            if around in seen:
                own.append((d, low, high))
                continue
            seen.add(around)
            if k == 1:  # all entries of a gram go to one slice
                suffix = text[p:high + length]
                entries.append((bisect_right(splitters, suffix[:gram]), suffix, text[low:p], p - high, d, p))
                continue
            for s in range(low, high + 1):  # a hot gram's windows are dealt by all their bytes
                window = (text[s:s + length], -1)
                if window in seen:
                    own.append((d, s, s))
                else:
                    seen.add(window)
                    entries.append((bisect_right(splitters, window[0]), window[0], b"", 0, d, s))
        seen.clear()
        entries.sort(key=lambda e: e[:2])
        rows = []
        for w, group in groupby(entries, key=lambda e: e[0]):
            before, meta, rest, left, docs_of, places = b"", [], [], [], [], []
            for _, suffix, beside, least, d, p in group:
                n = shared_prefix(before, suffix, 0)
                meta.append((n, len(suffix) - n, least, len(beside)))
                rest.append(suffix[n:])
                left.append(beside)
                docs_of.append(d)
                places.append(p)
                before = suffix
            rows.append((w, unit, np.array(meta, dtype=np.uint16).tobytes(), ids[docs_of].tobytes() + _i32(docs_of, places),
                         b"".join(rest), b"".join(left), None))
        if own:
            rows.append((unit % (len(splitters) + 1), unit, None, None, None, None, _i32(*np.array(own).T)))
        return pd.DataFrame(rows, columns=columns)

    def merged(frame: pd.DataFrame) -> pd.DataFrame:
        out = [(u, o) for u, o in zip(frame["unit"], frame["own"], strict=True) if o is not None]
        frame = frame[frame["meta"].notna()].sort_values("unit", kind="stable")
        if len(frame):
            runs, metas, ids, places, units_of, lefts = [], [], [], [], [], []
            for u, m, i, rest, left in zip(frame["unit"], frame["meta"], frame["ids"], frame["rest"], frame["left"], strict=True):
                meta = np.frombuffer(m, dtype=np.uint16).reshape(-1, 4)
                n = len(meta)
                runs.append(Run(meta[:, 0].tolist(), meta[:, 1].tolist(), rest))
                metas.append(meta)
                ids.append(np.frombuffer(i, dtype=np.int64, count=n))
                places.append(np.frombuffer(i, dtype=np.int32, offset=8 * n).reshape(n, 2))
                units_of.append(np.full(n, u))
                at = np.concatenate(([0], np.cumsum(meta[:, 3].astype(np.int64)))).tolist()
                lefts += [left[x:y] for x, y in zip(at, at[1:])]
            first = np.cumsum([0, *(len(m) for m in metas)])
            order, shared = merge(runs)
            order = np.array(order)
            index = np.empty(len(order), dtype=np.int64)
            for r in range(len(runs)):
                index[order == r] = np.arange(first[r], first[r + 1])
            meta, place, unit = np.concatenate(metas)[index], np.concatenate(places)[index], np.concatenate(units_of)[index]
            ids = np.concatenate(ids)[index]
            rank = np.empty(len(index), dtype=np.int64)
            rank[np.lexsort((place[:, 1], place[:, 0], unit, ids))] = np.arange(len(index))
            least = meta[:, 2].astype(np.int64)
            # A hot window has nothing to its left, any other anchor all its windows' left bytes.
            suffix, begin, end = repeats(np.array(shared), [lefts[i] for i in index.tolist()], least,
                                         np.maximum(least, meta[:, 3]), rank, length)
            low, high = place[suffix, 1] - end, place[suffix, 1] - begin
            for u in np.unique(unit[suffix]):
                here = unit[suffix] == u
                out.append((int(u), _i32(place[suffix[here], 0], low[here], high[here])))
        return pd.DataFrame(out, columns=["unit", "windows"])

    def cut(frame: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        frame, texts = _unit(frame)
        windows = np.concatenate([np.empty((0, 3), np.int32), *(np.frombuffer(w, dtype=np.int32).reshape(-1, 3) for w in found["windows"])])
        windows = windows[np.lexsort((windows[:, 1], windows[:, 0]))]
        bounds = np.searchsorted(windows[:, 0], np.arange(len(texts) + 1))
        removed, spans, kept = [], [], []
        for d, text in enumerate(texts):
            own = windows[bounds[d]:bounds[d + 1]]
            if not len(own):
                removed.append(0)
                spans.append(0)
                kept.append(text)
                continue
            reach = np.maximum.accumulate(own[:, 2].astype(np.int64) + length)
            new = np.concatenate(([True], own[1:, 1] > reach[:-1]))
            begin = own[new, 1].astype(np.int64)
            end = reach[np.append(np.flatnonzero(new)[1:], len(own)) - 1]
            removed.append(int((end - begin).sum()))
            spans.append(len(begin))
            kept.append(b"".join(text[x:y] for x, y in zip([0, *end.tolist()], [*begin.tolist(), len(text)])))
        return pd.DataFrame({"id": frame["id"], "no_id": frame["no_id"], "n_bytes": [len(t) for t in texts],
                             "n_removed": removed, "n_spans": spans, "kept": kept})

    asked = dealt.groupBy("unit").applyInPandas(ask, "unit int, part int, grams binary, counts binary")
    answered = asked.groupBy("part").applyInPandas(answer, "unit int, part int, kinds binary")
    runs = dealt.groupBy("unit").cogroup(answered.groupBy("unit")).applyInPandas(
        run, "slice int, unit int, meta binary, ids binary, rest binary, left binary, own binary")
    found = runs.groupBy("slice").applyInPandas(merged, "unit int, windows binary")
    rows = dealt.groupBy("unit").cogroup(found.groupBy("unit")).applyInPandas(
        cut, "id long, no_id boolean, n_bytes long, n_removed long, n_spans long, kept binary")
    return rows.select(F.when(~F.col("no_id"), F.col("id")).cast(id_type).alias(id_col), "n_bytes", "n_removed", "n_spans", "kept")
