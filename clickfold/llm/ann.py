"""Approximate nearest neighbours by cosine with cross-polytope hashing.

A table's hash turns a unit vector with a pseudo-rotation (three rounds of random signs and a fast
Hadamard transform, padded to a power of two) and takes the nearest signed axis. Several hashes
per table make finer buckets for larger collections. Queries probe, in each table, the buckets of
the axes they lie nearest to; what they find there is ranked by the exact cosine in double precision.

Vectors that are equal are indexed once, with their k+1 smallest ids: more can never be among
a query's k nearest. A bucket is searched as blocks: its vectors and its queries are dealt into a
grid of cells of bounded size, so no bucket is one task, and a cell returns each query's best only.
Queries that found fewer than k neighbours are searched again through all buckets.

Defined cases: NULL ids, NULL, empty and all-zero vectors and vectors with NULL or non-finite
components take no part; vectors of another length are no candidates; rows that repeat an id
and vector count once; ties go to the smaller id; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickfold.llm.common import stored

TABLES, HASHES, PROBES, SEED = 6, 1, 16, 7
#: Vectors and queries of a bucket that meet in one cell.
CELL_VECTORS, CELL_QUERIES = 16_384, 2_048


def _hadamard(x: np.ndarray) -> np.ndarray:
    h, n = 1, x.shape[1]
    while h < n:
        pairs = x.reshape(len(x), -1, 2, h)
        x = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def rotate(x: np.ndarray, seed: tuple[int, ...]) -> np.ndarray:
    """Pseudo-rotation of the rows of ``x``, padded to a power of two."""
    width = 1 << max(0, x.shape[1] - 1).bit_length()
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    signs = np.random.default_rng(seed).choice((-1.0, 1.0), (3, width))
    for s in signs:
        x = _hadamard(x * s)
    return x


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def probes(x: np.ndarray, table: int, hashes: int, most: int, seed: int) -> np.ndarray:
    """The ``most`` nearest buckets of every row in one table, the own bucket first."""
    bucket = np.zeros((len(x), 1), dtype=np.int64)
    loss = np.zeros((len(x), 1))
    for h in range(hashes):
        turned = rotate(x, (seed, table, h))
        axes = np.concatenate((turned, -turned), axis=1)
        near = np.argsort(-axes, axis=1, kind="stable")[:, :most]
        value = np.take_along_axis(axes, near, 1)
        more = (value[:, :1] - value) ** 2
        loss = (loss[:, :, None] + more[:, None, :]).reshape(len(x), -1)
        bucket = (bucket[:, :, None] * axes.shape[1] + near[:, None, :]).reshape(len(x), -1)
        best = np.argsort(loss, axis=1, kind="stable")[:, :most]
        loss, bucket = np.take_along_axis(loss, best, 1), np.take_along_axis(bucket, best, 1)
    return bucket


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _hashed(df: DataFrame, payload: list[T.StructField], tables: int, hashes: int, most: int, seed: int) -> DataFrame:
    """A row for each table and probed bucket: (tbl, dim, bucket, vec, payload)."""
    schema = T.StructType([T.StructField("tbl", T.IntegerType()), T.StructField("dim", T.IntegerType()),
                           T.StructField("bucket", T.LongType()), T.StructField("vec", T.BinaryType()), *payload])
    names = [f.name for f in payload]

    def batches(it):
        for batch in it:
            vectors = batch.column(0)
            values, offsets = vectors.flatten().to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()
            offsets = offsets - offsets[0]
            sizes = np.diff(offsets)
            for dim in np.unique(sizes):
                rows = np.flatnonzero(sizes == dim)
                x = values[offsets[rows][:, None] + np.arange(dim)]
                raw = pa.array([r.tobytes() for r in x], pa.binary())
                kept = [batch.column(1 + i).take(pa.array(rows)) for i in range(len(names))]
                turned = unit(x)
                for t in range(tables):
                    bucket = probes(turned, t, hashes, most, seed)
                    at = pa.array(np.repeat(np.arange(len(rows)), bucket.shape[1]))
                    n = len(at)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, t, np.int32)), pa.array(np.full(n, dim, np.int32)), pa.array(bucket.ravel()),
                         raw.take(at), *(c.take(at) for c in kept)], [f.name for f in schema.fields])

    return df.select("embedding", *names).mapInArrow(batches, schema)


_KEY = ["tbl", "dim", "bucket"]


def _search(index: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): each query's nearest in the buckets that it probes."""
    per = lambda df, most, name: df.groupBy(*_KEY).agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    grid = per(index, CELL_VECTORS, "rows").join(per(asked, CELL_QUERIES, "cols"), _KEY)
    left = (index.join(grid, _KEY).withColumn("row", F.pmod(F.xxhash64("vec"), "rows").cast("int"))
            .withColumn("col", F.explode(F.sequence(F.lit(0), F.col("cols") - 1))).drop("rows", "cols"))
    right = (asked.join(grid, _KEY).withColumn("col", F.pmod(F.xxhash64("query_id", "vec"), "cols").cast("int"))
             .withColumn("row", F.explode(F.sequence(F.lit(0), F.col("rows") - 1))).drop("rows", "cols"))
    cell = [*_KEY, "row", "col"]

    def best(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if not len(vectors) or not len(queries):
            return none
        matrix = lambda frame: unit(np.frombuffer(b"".join(frame["vec"]), dtype=np.float64).reshape(len(frame), -1))
        x, q = matrix(vectors), matrix(queries)
        ids = vectors["ids"].tolist()
        first = np.array([i[0] for i in ids])
        order = np.argsort(first, kind="stable")  # so that ties are cut in order of ids
        x, ids = x[order], [ids[i] for i in order]
        own = queries["query_id"].to_numpy()
        found_q, found_v, found_s = [], [], []
        # One more than k vectors: one of them may hold nothing but the query itself.
        take = min(k + 1, len(x))
        for s in range(0, len(q), 256):
            part = q[s:s + 256] @ x.T
            near = np.argpartition(-part, take - 1, axis=1)[:, :take] if take < len(x) else np.tile(np.arange(len(x)), (len(part), 1))
            least = np.take_along_axis(part, near, 1).min(axis=1)
            for i, row in enumerate(part):
                hits = np.flatnonzero(row >= least[i] - 1e-12)
                exact = (x[hits] * q[s + i]).sum(axis=1)
                rows = [(-e, v) for h, e in zip(hits.tolist(), exact.tolist(), strict=True) for v in ids[h][:k + 1] if v != own[s + i]]
                rows.sort()
                for e, v in rows[:k]:
                    found_q.append(own[s + i])
                    found_v.append(v)
                    found_s.append(-e)
        return pd.DataFrame({"query_id": found_q, "vec_id": found_v, "score": found_s}) if found_q else none

    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInPandas(best, "query_id long, vec_id long, score double")
    # A pair can meet in several tables.
    pairs = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
            tables: int = TABLES, hashes: int = HASHES, n_probes: int = PROBES, seed: int = SEED) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row that ``is_query`` holds for."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"),
                          F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).dropDuplicates(["vec_id", "embedding"])
    by_id = Window.partitionBy("embedding").orderBy("vec_id")
    distinct = (rows.withColumn("nth", F.row_number().over(by_id)).where(F.col("nth") <= k + 1)
                .groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    index = stored(_hashed(distinct, [T.StructField("ids", T.ArrayType(T.LongType()))], tables, hashes, 1, seed), "ann-index")
    queries = rows.where("asks").select("embedding", F.col("vec_id").alias("query_id"))
    payload = [T.StructField("query_id", T.LongType())]
    found = stored(_search(index, _hashed(queries, payload, tables, hashes, n_probes, seed), k), "ann-found")
    enough = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k)
    short = queries.join(enough, "query_id", "left_anti")
    if not short.isEmpty():
        one = index.where("tbl = 0")
        every = one.select("dim", "bucket").distinct()  # all buckets that hold something
        asked = (short.select("query_id", F.size("embedding").alias("dim"),
                              F.col("embedding")).join(every, "dim"))
        asked = stored(asked.select(F.lit(0).alias("tbl"), "dim", "bucket", _binary(F.col("embedding")).alias("vec"), "query_id"), "ann-asked")
        found = found.join(short.select("query_id").distinct(), "query_id", "left_anti").unionByName(_search(one, asked, k))
    return found.select("query_id", "rank", "vec_id", "score")


@F.pandas_udf(T.BinaryType())
def _binary(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: np.asarray(v, dtype=np.float64).tobytes())
