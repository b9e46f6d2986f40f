"""Nearest neighbours by inner product, searched on randomly rotated one-bit codes.

A vector is rotated at random and kept as the signs of its coordinates, packed into bits, with two numbers: its
length, and the inner product of its direction with the direction that the signs stand for.  From these the inner
product with a query is estimated without bias, with a known error.  The best by estimate are compared exactly and
give each query a bar, the score of its k-th best so far; a second pass compares exactly every vector whose estimate
plus error bound reaches the bar.  Vectors and queries are dealt out in blocks, every two blocks are one group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from replyforest.session import passing_folder, stage

NEAREST = 20
BOUND = 3.0  # the error bound in standard errors
FIRST = 60  # compared exactly per query and block to set the bar
VECTORS, QUERIES = 4096, 1024  # of a block, about
RERANKED = 1 << 15  # pairs compared at once
SEED = 17

FOUND = "query_id bigint, ids array<bigint>, scores array<double>"


def rotation(dimensions: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dimensions, dimensions)))
    return q * np.sign(np.diag(r))


def _matrix(column: pa.ChunkedArray | pa.Array, dimensions: int) -> np.ndarray:
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    return np.concatenate([np.asarray(c.flatten(), np.float64) for c in chunks] or [np.empty(0)]).reshape(-1, dimensions)


def _usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, not zero, all components finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def encode(vectors: DataFrame, dimensions: int, seed: int = SEED) -> DataFrame:
    """``vectors (id, vector)`` with ``bits, length, aligned``."""

    def codes(batches):
        turn, unit = rotation(dimensions, seed), np.sqrt(dimensions)
        for batch in batches:
            v = _matrix(batch.column(1), dimensions)
            scale = np.abs(v).max(axis=1)  # keeps squares of very large and very small numbers in range
            length = scale * np.linalg.norm(v / scale[:, None], axis=1)
            direction = (v / length[:, None]) @ turn
            bits = np.packbits(direction > 0, axis=1)
            aligned = np.abs(direction).sum(axis=1) / unit
            packed = pa.array([b.tobytes() for b in bits], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), packed, pa.array(length), pa.array(aligned)], names=["id", "vector", "bits", "length", "aligned"]
            )

    return vectors.select("id", "vector").mapInArrow(codes, "id bigint, vector array<double>, bits binary, length double, aligned double")


class _Search:
    def __init__(self, dimensions: int, k: int, bound: float, seed: int, exact: bool):
        self.dimensions, self.k, self.bound, self.seed, self.exact = dimensions, k, bound, seed, exact

    def compare(self, vectors: pa.Table, queries: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int64())), "scores": pa.array([], pa.list_(pa.float64()))})
        if not vectors.num_rows or not queries.num_rows:
            return empty
        d = self.dimensions
        ids, v = vectors.column("id").to_numpy(), _matrix(vectors.column("vector"), d)
        q_ids, q = queries.column("query_id").to_numpy(), _matrix(queries.column("query"), d)
        bits = np.frombuffer(b"".join(vectors.column("bits").to_pylist()), np.uint8).reshape(len(ids), -1)
        signs = np.unpackbits(bits, axis=1, count=d).astype(np.float32) * 2 - 1
        length, aligned = vectors.column("length").to_numpy(), vectors.column("aligned").to_numpy()
        scaled = q / np.abs(q).max(axis=1)[:, None]  # no query is zero; squares stay in range
        scaled_length = np.linalg.norm(scaled, axis=1)
        q_length = np.abs(q).max(axis=1) * scaled_length
        turned = ((scaled / scaled_length[:, None]) @ rotation(d, self.seed)).astype(np.float32)
        # Cosines first: what the signs say, corrected by how far they are from the vector.
        cosine = (turned @ signs.T) / (aligned * np.sqrt(d)).astype(np.float32)
        error = self.bound * np.sqrt(np.maximum(0, 1 - aligned**2)) / aligned / np.sqrt(max(1, d - 1))
        if self.exact:
            bar = queries.column("bar").to_numpy()
            # A little is allowed for rounding.
            need = bar / q_length
            need = need - 1e-5 * np.abs(need)
            wanted = (cosine + error.astype(np.float32)) * length >= need[:, None]
        else:
            estimate = cosine * length
            some = min(FIRST, len(ids))
            best = np.argpartition(-estimate, some - 1, axis=1)[:, :some]
            wanted = np.zeros(cosine.shape, bool)
            np.put_along_axis(wanted, best, True, axis=1)
        wanted &= q_ids[:, None] != ids[None, :]
        row, column = np.nonzero(wanted)
        score = np.empty(len(row))
        for i in range(0, len(row), RERANKED):
            part = slice(i, i + RERANKED)
            score[part] = (q[row[part]] * v[column[part]]).sum(axis=1)
        order = np.lexsort((ids[column], -score, row))
        row, column, score = row[order], column[order], score[order]
        first = np.searchsorted(row, np.arange(len(q_ids)))
        kept = np.arange(len(row)) - first[row] < self.k
        if self.exact:
            kept &= score >= bar[row]
        row, column, score = row[kept], column[kept], score[kept]
        counts = np.bincount(row, minlength=len(q_ids))
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        found = pa.table(
            {"query_id": q_ids, "ids": pa.ListArray.from_arrays(offsets, ids[column]), "scores": pa.ListArray.from_arrays(offsets, score)}
        )
        return found.filter(pa.array(counts > 0))


def nearest(
    vectors: DataFrame, queries: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = NEAREST, bound: float = BOUND, seed: int = SEED
) -> DataFrame:
    """``query_id, rank, vec_id, score``: of every row that meets ``queries`` the ``k`` nearest other rows.

    Nearness is the inner product of the vectors as they are, in double precision; ties go to the smaller id.  Rows
    of the query's own id are no candidates.  Null ids, and vectors that are null, zero, or hold null or non-finite
    components, or have another length than most, take no part.  Rows that repeat an id are candidates each; as a query an id
    asks with the smallest of its vectors.  Fewer than
    ``k`` candidates are all returned.  Other columns are not read; an empty table gives no rows.
    """
    own = vectors.where(queries.isNotNull()).select(
        F.col(f"`{vec_id}`").cast("bigint").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("vector"), queries.alias("asks")
    )
    own = own.where(F.col("id").isNotNull() & _usable(F.col("vector")))
    with passing_folder(vectors.sparkSession, "nearest") as steps:
        sizes = own.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("rows"), F.sum(F.col("asks").cast("int")).alias("asking"))
        top = sizes.orderBy(F.desc("rows"), F.desc("size")).first()
        if top is None or not top["asking"]:
            return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
        d = top["size"]
        whole = own.where(F.size("vector") == d)
        of_vectors, of_queries = -(-top["rows"] // VECTORS), -(-top["asking"] // QUERIES)
        deal = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
        index = encode(whole, d, seed).withColumn("row", F.monotonically_increasing_id())
        index = stage(index.withColumn("block", deal(of_vectors)), "index", folder=steps)
        asking = whole.where("asks").groupBy(F.col("id").alias("query_id")).agg(F.min("vector").alias("query"))
        asking = stage(asking.withColumn("row", F.monotonically_increasing_id()).withColumn("q_block", deal(of_queries)), "queries", folder=steps)
        left = index.withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(of_queries - 1))))
        left = left.select("block", "q_block", "id", "vector", "bits", "length", "aligned").groupBy("block", "q_block")

        def search(of: DataFrame, exact: bool) -> DataFrame:
            right = of.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(of_vectors - 1))))
            right = right.groupBy("block", "q_block")
            one = _Search(d, k, bound, seed, exact)
            return left.cogroup(right).applyInArrow(lambda a, b: one.compare(a, b), FOUND)

        return _ranked(search, asking, k, steps)


def _ranked(search, asking: DataFrame, k: int, steps: str) -> DataFrame:
    def best(found: DataFrame) -> DataFrame:
        rows = found.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("x"))
        rows = rows.select("query_id", F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    first = best(search(asking.select("q_block", "query_id", "query"), False))
    bars = first.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).otherwise(float("-inf")).alias("bar"))
    barred = stage(asking.join(bars, "query_id", "left").fillna({"bar": float("-inf")}), "bars", folder=steps)
    second = best(search(barred.select("q_block", "query_id", "query", "bar"), True))
    return stage(second.select("query_id", "rank", "vec_id", "score"), "nearest")
