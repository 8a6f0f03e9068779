"""Nearest vectors by inner product over randomly rotated one-bit codes.

Every vector is rotated by one random orthogonal matrix (from a seed) and keeps the signs of its coordinates, packed into
bits, with two numbers: its length and the inner product of its direction with the direction of its signs. From a query's
rotated coordinates and a code the inner product of the two vectors is estimated without bias; how far off the estimate may
be follows from the second number: ``bound`` standard errors. In a cell the vectors with the best estimates are compared
exactly first; the k-th best of their scores is one that k vectors reach, so of the others only vectors whose upper bound is as
high are reranked by exact inner products.

Queries come in blocks and vectors in parts, both of bounded size; each pair of a block and a part is one cell, dealt by
key, and gives at most k rows per query. The index (codes and both numbers) covers every vector.

Scores are sums of products in double precision, in the order of the components. With the default bound of 3.5 standard
errors about one near vector in several thousand may be missed.

Edge cases: vectors that are null, empty, zero or have a null or non-finite component take no part, neither have queries
of such; vectors of another length than the most common one (ties: the greater) take no part; null ids take no part; rows
that repeat an id count each; fewer than k candidates give them all; equal scores go by id; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.session import materialize

PART_ROWS, BLOCK_QUERIES = 8192, 1024
BOUND, SEED = 3.5, 1
# Vectors of a cell that are compared first, by their estimates.
FIRST = 64


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same wherever it is made from the same seed."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def codes(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, length, and the inner product of direction and code direction, of each row of ``vectors``."""
    turned = vectors @ turn
    length = np.sqrt((vectors * vectors).sum(1))
    signs = turned > 0
    code = np.packbits(signs, axis=1)
    along = np.abs(turned).sum(1) / (length * np.sqrt(vectors.shape[1]))
    return code, length, along


def estimates(queries: np.ndarray, code: np.ndarray, length: np.ndarray, along: np.ndarray, turn: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products (queries x vectors) and how far off each may be."""
    dim = turn.shape[0]
    signs = np.unpackbits(code, axis=1, count=dim).astype(np.float32) * 2 - 1
    turned = queries @ turn
    raw = turned.astype(np.float32) @ signs.T / np.float32(np.sqrt(dim))
    estimate = raw * (length / along).astype(np.float32)
    error = bound * length * np.sqrt(np.maximum(1 - along**2, 0)) / (along * np.sqrt(max(dim - 1, 1)))
    return estimate, np.sqrt((queries * queries).sum(1))[:, None].astype(np.float32) * error.astype(np.float32)


def _exact(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    total = np.zeros(len(vectors))
    for k in range(len(query)):
        total += vectors[:, k] * query[k]
    return total


def _top(values: np.ndarray, n: int) -> np.ndarray:
    """The places of the ``n`` greatest values, in no order; -inf does not count."""
    found = np.argpartition(values, len(values) - n)[len(values) - n :] if len(values) > n else np.arange(len(values))
    return found[values[found] > -np.inf]


def _kth(values: np.ndarray, k: int) -> float:
    """The ``k``-th greatest value; -inf of fewer."""
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else -np.inf


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy() for c in column.chunks] or [np.zeros(0)]).reshape(-1, dim).astype(np.float64)


def valid(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    """(vec_id, embedding) of the vectors that take part."""
    numbers = F.col(column).cast("array<double>")
    fine = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(numbers, lambda x: x != 0)
    return vectors.filter(F.col(id_column).isNotNull() & fine).select(F.col(id_column).cast("long").alias("vec_id"), numbers.alias("embedding"))


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_column: str = "vec_id", column: str = "embedding", bound: float = BOUND) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for each row of ``vectors`` for which ``is_query`` holds
    (an expression over ``vec_id``), itself left out."""
    spark = vectors.sparkSession
    fine = valid(vectors, id_column, column)
    sizes = fine.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q"))
    top = sizes.orderBy(F.desc("n"), F.desc("dim")).first()
    if top is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dim = top["dim"]
    fine = fine.filter(F.size("embedding") == dim)
    parts, blocks = -(-top["n"] // PART_ROWS), max(1, -(-top["q"] // BLOCK_QUERIES))
    turn = rotation(dim)

    # The index: codes and correction numbers beside the vectors they will be reranked by.
    coded = "vec_id bigint, embedding array<double>, code binary, length double, along double"
    kinds = pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float64())), ("code", pa.binary()), ("length", pa.float64()), ("along", pa.float64())])

    def index(batches):
        for batch in batches:
            if batch.num_rows:
                code, length, along = codes(_matrix(pa.chunked_array([batch.column(1)]), dim), turn)
                made = [pa.array([c.tobytes() for c in code], pa.binary()), pa.array(length), pa.array(along)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], schema=kinds)

    stored = materialize(fine.mapInArrow(index, coded), "codes")
    side = stored.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = stored.filter(is_query).withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int"))
    asked = asked.select("vec_id", "embedding", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"))

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        ids, own = right["vec_id"].to_numpy(), _matrix(right["embedding"], dim)
        code = np.frombuffer(b"".join(right["code"].to_pylist()), np.uint8).reshape(len(ids), -1)
        length, along = right["length"].to_numpy(), right["along"].to_numpy()
        query_ids, queries = left["vec_id"].to_numpy(), _matrix(left["embedding"], dim)
        out = []
        for a in range(0, len(queries), 64):
            guess, error = estimates(queries[a : a + 64], code, length, along, turn, bound)
            for i, q in enumerate(query_ids[a : a + 64]):
                others = ids != q
                first = _top(np.where(others, guess[i], -np.inf), FIRST)
                floor = _kth(own[first] @ queries[a + i], k)  # a score that k vectors reach
                some = np.flatnonzero(others & (guess[i] + error[i] >= floor))
                near = own[some] @ queries[a + i]
                slack = 1e-12 * np.sqrt((queries[a + i] ** 2).sum()) * length.max(initial=0.0)
                some = some[near >= _kth(near, k) - slack]  # the product's own rounding is no reason to lose one
                score = _exact(queries[a + i], own[some])
                best = np.lexsort((ids[some], -score))[:k]
                out.append((np.full(len(best), q), ids[some[best]], score[best]))
        q, v, s = (np.concatenate(c) for c in zip(*out))
        return pa.table({"query_id": q, "vec_id": v, "score": s})

    found = asked.groupBy("block", "part").cogroup(side.groupBy("block", "part")).applyInArrow(cell, "query_id bigint, vec_id bigint, score double")
    near = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(near)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
