"""Exact cosine top-k of queries over a vector table, and explanation records."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog import fixed_values as V
from tidelog.functions.prompts import explain_prompt
from tidelog.functions.text import cut, round_even
from tidelog.session import materialize

QUERY_BLOCK, VECTOR_PART = 8192, 8192
_QUERIES_AT_ONCE = 64
# Scores that one maximum stands for when the best of many are looked for, and numbers gathered at once for exact products.
_FOLDED, _GATHERED = 16, 1 << 22
# Vectors that pivots are chosen from (the least hashes of ids), pivots at most, and the width of a ring in radians.
PIVOT_SAMPLE, PIVOTS, RING = 4_096, 64, 0.05
# What angles and cosines in floating point may be off by.
SLACK = 1e-6


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


def _matrix(vectors) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=float) for v in vectors])


def _near_best(scores: np.ndarray, k: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of every score that is less than ``slack`` below a lower bound of its row's ``k``-th best, or not below.

    The bound is the k-th best of the maxima of folds of ``_FOLDED`` columns; of most folds nothing but the maximum is looked at."""
    n, columns = scores.shape
    width = columns // _FOLDED
    if width < k:
        row, column = np.divmod(np.arange(scores.size), columns)
        return row, column
    best = scores[:, : width * _FOLDED].reshape(n, _FOLDED, width).max(axis=1)
    bound = np.partition(best, width - k, axis=1)[:, width - k] - slack
    row, fold = np.divmod(np.flatnonzero(best >= bound[:, None]), width)
    rest = np.arange(width * _FOLDED, columns)
    row = np.concatenate([np.repeat(row, _FOLDED), np.repeat(np.arange(n), len(rest))])
    column = np.concatenate([(fold[:, None] + width * np.arange(_FOLDED)).ravel(), np.tile(rest, n)])
    kept = scores[row, column] >= bound[row]
    return row[kept], column[kept]


def _products(a: np.ndarray, b: np.ndarray, row: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows; equal rows have equal ones."""
    step = max(1, _GATHERED // max(1, a.shape[1]))
    parts = [np.einsum("ij,ij->i", a[row[at : at + step]], b[column[at : at + step]]) for at in range(0, len(row), step)]
    return np.concatenate([np.zeros(0), *parts])


def _best_of(asked: pd.DataFrame, held: pd.DataFrame, k: int) -> pd.DataFrame:
    """The ``k`` best of ``held`` (id, vector) for each of ``asked`` (query_id, vector), slice by slice, exact.

    Products in single precision tell which pairs may be among the best; those are multiplied in double precision and put in
    order. A sum of products of two unit vectors is off by (dimensions + 8) * 2**-24 at most in single precision."""
    if not len(asked) or not len(held):
        return pd.DataFrame({"query_id": asked["query_id"].iloc[:0], "id": held["id"].iloc[:0], "score": np.zeros(0)})
    vectors, ids = _unit(_matrix(held["vector"])), held["id"].to_numpy()
    queries, names = _unit(_matrix(asked["vector"])), asked["query_id"].to_numpy()
    finite = np.isfinite(vectors).all() and np.isfinite(queries).all()
    vectors_32, queries_32 = vectors.astype(np.float32).T, queries.astype(np.float32)
    slack = (vectors.shape[1] + 8) * 2.0**-23
    found = []
    for at in range(0, len(asked), _QUERIES_AT_ONCE):
        scores = queries_32[at : at + _QUERIES_AT_ONCE] @ vectors_32
        if not finite:
            scores = np.where(np.isnan(scores), -np.inf, scores)
        row, column = _near_best(scores, k, slack)
        score = _products(queries, vectors, at + row, column)
        order = np.lexsort((ids[column], -score, row))  # what is no number comes last
        row, column, score = row[order], column[order], score[order]
        kept = np.arange(len(row)) - np.searchsorted(row, row) < k
        found.append(pd.DataFrame({"query_id": names[at + row[kept]], "id": ids[column[kept]], "score": score[kept]}))
    return pd.concat(found)


def top_passages(
    queries: DataFrame, vectors: DataFrame, k: int = V.TOP_PASSAGES, block: int = QUERY_BLOCK, part: int = VECTOR_PART
) -> DataFrame:
    """(query_id, id, score, rank): the ``k`` nearest by cosine, exact, lower id first on ties.

    ``queries`` is (query_id, vector), ``vectors`` is (id, vector). Queries are dealt to blocks and vectors to parts of
    about those sizes, by hash; each pair of a block and a part is one group of a task, which multiplies slices of the two
    and keeps k rows per query. So neither side passes through the driver, and the plan is the same for any number of both.
    """
    id_type = vectors.schema["id"].dataType.simpleString()
    query_type = queries.schema["query_id"].dataType.simpleString()
    blocks, parts = (max(1, -(-df.count() // size)) for df, size in ((queries, block), (vectors, part)))

    def deal(df: DataFrame, key: str, own: str, n: int, other: str, n_other: int) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.lit(n_other - 1)))
        return df.select(key, "vector", F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias(own), every.alias(other))

    def cell(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        return _best_of(asked, held, k)

    left = deal(queries, "query_id", "_block", blocks, "_part", parts).groupBy("_block", "_part")
    right = deal(vectors, "id", "_part", parts, "_block", blocks).groupBy("_block", "_part")
    hits = left.cogroup(right).applyInPandas(cell, f"query_id {query_type}, id {id_type}, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id")))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k)


def pivots_of(vectors: DataFrame, sample: int = PIVOT_SAMPLE, most: int = PIVOTS) -> np.ndarray:
    """Unit vectors that lie apart: of a sample of at most ``sample`` rows (least hashes of ids), farthest first.

    The sample only decides how well parts can be told apart, not what is searched.
    """
    rows = vectors.filter(_usable("vector")).orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").collect()
    if not rows:
        return np.zeros((0, 0))
    unit = _unit(_matrix([r["vector"] for r in rows]))
    unit = unit[np.any(unit != 0, axis=1)]
    chosen, nearest = [], np.full(len(unit), -2.0)
    while len(unit) and len(chosen) < min(most, max(1, int(len(unit) ** 0.5))):
        at = int(np.argmin(nearest)) if chosen else 0
        if chosen and nearest[at] > 1 - 1e-9:
            break
        chosen.append(unit[at])
        nearest = np.maximum(nearest, unit @ unit[at])
    return np.array(chosen)


def _usable(vector: str):
    return F.col(vector).isNotNull() & (F.size(vector) > 0)


def _angles(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(_unit(rows) @ pivots.T, -1.0, 1.0))


def _placed(vectors: DataFrame, pivots: np.ndarray, ring: float) -> DataFrame:
    """``vectors`` with the nearest pivot, the angle to it and its ring; a vector of zeros has pivot -1."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _matrix(batch.column("vector").to_pylist())
            angles = _angles(rows, pivots)
            near = angles.argmin(axis=1)
            angle = angles[np.arange(len(rows)), near]
            zero = ~rows.any(axis=1)
            near, angle = np.where(zero, -1, near), np.where(zero, 0.0, angle)
            made = [pa.array(near, pa.int32()), pa.array((angle / ring).astype(np.int32)), pa.array(angle, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "pivot", "ring", "angle"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema)
    return vectors.mapInArrow(place, f"{fields}, pivot int, ring int, angle double")


@dataclass
class PrunedSearch:
    """The hits, and how many pairs of a query and a vector there are and were compared."""

    hits: DataFrame
    pairs: int
    compared: int


def search_by_pivots(
    queries: DataFrame,
    vectors: DataFrame,
    k: int = V.TOP_PASSAGES,
    ring: float = RING,
    part: int = VECTOR_PART,
    block: int = QUERY_BLOCK,
    sample: int = PIVOT_SAMPLE,
    most: int = PIVOTS,
) -> PrunedSearch:
    """The rows of ``top_passages``, found without comparing a query with parts that the triangle inequality rules out.

    A vector belongs to its nearest pivot and to a ring of angles around it; a part is some rings, or a slice of one, of about ``part``
    vectors. The angle between a query and any vector of a part is at least the distance of the query's own angle to the
    pivot from the part's angles, so the cosine is at most that angle's cosine. First, each query meets the parts with the
    best bounds that together hold ``k`` vectors; its k-th score is then a lower bound of the true one, and it meets
    only those parts whose bound reaches it. Where nothing can be ruled out, it meets all, and the result is the same.

    Neighbouring parts make up a bundle of about ``VECTOR_PART`` vectors: a query goes once to each bundle that holds parts it
    meets, in blocks of about ``block`` queries, and gives k hits there, so rows grow with queries times bundles and not
    with queries times parts. Inside, queries that meet half of a bundle or more are multiplied with all of it, others with
    the parts that they meet. Parts are described by five numbers each, about as many as vectors / ``part``. Equal vectors share a bound: a query that is near them meets all of them. Null and empty vectors take no part; a vector of zeros
    has cosine 0 with everything.
    """
    spark = vectors.sparkSession
    id_type = vectors.schema["id"].dataType.simpleString()
    query_type = queries.schema["query_id"].dataType.simpleString()
    vectors = vectors.filter(_usable("vector")).select("id", "vector")
    queries = queries.filter(_usable("vector")).select("query_id", "vector")
    hit_schema = f"query_id {query_type}, id {id_type}, score double"
    total = vectors.count()
    if not total:
        return PrunedSearch(spark.createDataFrame([], f"{hit_schema}, rank int"), 0, 0)
    # A pivot is worth it from an eighth of a part on: a small table is one part, and the search the plain one.
    pivots = pivots_of(vectors, sample, min(most, max(1, 8 * total // part)))
    if not len(pivots):  # vectors of zeros only
        pivots = np.eye(1, len(vectors.first()["vector"]))
    placed = _placed(vectors, pivots, ring)
    counts = placed.groupBy("pivot", "ring").agg(F.count("*").alias("n"))
    # Thin neighbouring rings become one part, thick ones are sliced: a row for each of a pivot's pi / ring rings at most.
    inner = F.sum("n").over(Window.partitionBy("pivot").orderBy("ring")) - F.col("n")
    slices = counts.select("pivot", "ring", F.floor(inner / part).alias("merged"), F.ceil(F.col("n") / part).cast("int").alias("slices"))
    sliced = placed.join(F.broadcast(slices), ["pivot", "ring"]).withColumn("slice", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int"))
    sliced = sliced.withColumn("ring", F.col("merged").cast("int"))
    index = materialize(sliced.select("pivot", "ring", "slice", "id", "vector", "angle"), "pivot-parts")
    parts = index.groupBy("pivot", "ring", "slice").agg(F.count("*").alias("n"), F.min("angle").alias("lo"), F.max("angle").alias("hi"))
    parts = parts.orderBy("pivot", "ring", "slice").toPandas()
    pivot, n, lo, hi = (parts[c].to_numpy() for c in ("pivot", "n", "lo", "hi"))
    sent = spark.sparkContext.broadcast((pivots, pivot, n, lo, hi))

    def bounds(rows: np.ndarray) -> np.ndarray:
        """The greatest cosine that each row may reach in each part, a little too great rather than too small."""
        pivots, pivot, _, lo, hi = sent.value
        angles = _angles(rows, pivots)[:, np.maximum(pivot, 0)]
        gap = np.maximum(np.maximum(lo - angles, angles - hi) - SLACK, 0.0)
        best = np.cos(np.minimum(gap, np.pi)) + SLACK
        best[:, pivot < 0] = SLACK
        best[~rows.any(axis=1)] = SLACK
        return best

    # Parts next to each other in order: a bundle is full once its parts before the last hold fewer than VECTOR_PART vectors.
    bundle = (np.cumsum(n) - n) // max(VECTOR_PART, part)
    bundle = np.unique(bundle, return_inverse=True)[1].reshape(-1)
    starts = np.flatnonzero(np.diff(bundle, prepend=-1))
    held_in = np.add.reduceat(n, starts)

    def asked_of(some: pa.RecordBatch) -> np.ndarray:
        """Which parts each query must meet: those that reach its k-th score, and those it was given that score by."""
        n = sent.value[2]
        best = bounds(_matrix(some.column("vector").to_pylist()))
        order = np.argsort(-best, axis=1, kind="stable")
        met = np.zeros(best.shape, bool)
        np.put_along_axis(met, order, np.cumsum(n[order], axis=1) - n[order] < k, axis=1)
        if "reached" not in some.schema.names:
            return met
        reached = np.nan_to_num(some.column("reached").to_numpy(zero_copy_only=False).astype(float), nan=-2.0)
        return met | (best >= reached[:, None])

    def meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each query and bundle with parts it meets: which they are, and how many vectors it is multiplied with."""
        n = sent.value[2]
        for batch in batches:
            for a in range(0, batch.num_rows, _QUERIES_AT_ONCE):
                some = batch.slice(a, _QUERIES_AT_ONCE)
                asked = asked_of(some)
                work = np.add.reduceat(asked * n, starts, axis=1)
                whole = 2 * work >= held_in
                at, of = np.nonzero(work)
                ends = np.append(starts[1:], len(n))
                which = [None if whole[i, j] else (starts[j] + np.flatnonzero(asked[i, starts[j] : ends[j]])).tolist() for i, j in zip(at, of)]
                rows = some.select(["query_id", "vector"]).take(pa.array(at))
                made = [pa.array(of, pa.int32()), pa.array(which, pa.list_(pa.int32())), pa.array(np.where(whole, held_in, work)[at, of], pa.int64())]
                yield pa.RecordBatch.from_arrays([*rows.columns, *made], names=["query_id", "vector", "bundle", "parts", "work"])

    def compare(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(held):
            return _best_of(asked, held, k)
        found = []
        every = asked["parts"].isna().to_numpy()
        if every.any():
            found.append(_best_of(asked[every], held, k))
        if not every.all():
            some = asked[~every].reset_index(drop=True)
            lengths = some["parts"].map(len).to_numpy()
            at, of = np.repeat(np.arange(len(some)), lengths), np.concatenate([np.asarray(p) for p in some["parts"]])
            by_part = held.groupby("part").indices
            for number in np.unique(of):
                if number in by_part:
                    found.append(_best_of(some.iloc[at[of == number]], held.iloc[by_part[number]], k))
        hits = pd.concat(found)[["query_id", "id", "score"]]
        return hits.sort_values(["query_id", "score", "id"], ascending=[True, False, True], kind="stable").groupby("query_id", sort=False).head(k)

    number = {key: i for i, key in enumerate(zip(parts["pivot"], parts["ring"], parts["slice"]))}
    names = spark.createDataFrame([(int(a), int(b), int(c), i, int(bundle[i])) for (a, b, c), i in number.items()], "pivot int, ring int, slice int, part int, bundle int")
    numbered = index.join(F.broadcast(names), ["pivot", "ring", "slice"]).select("bundle", "part", "id", "vector")
    pair_schema = f"query_id {query_type}, vector {queries.schema['vector'].dataType.simpleString()}, bundle int, parts array<int>, work bigint"

    def met(pairs: DataFrame) -> DataFrame:
        """The k best of each query within each bundle that it meets."""
        many = pairs.groupBy("bundle").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
        left = pairs.join(F.broadcast(many), "bundle").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int"))
        right = numbered.join(F.broadcast(many), "bundle").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        grouped = left.select("bundle", "block", "query_id", "vector", "parts").groupBy("bundle", "block")
        return grouped.cogroup(right.select("bundle", "block", "part", "id", "vector").groupBy("bundle", "block")).applyInPandas(compare, hit_schema)

    def compared(pairs: DataFrame) -> int:
        return pairs.agg(F.coalesce(F.sum("work"), F.lit(0))).first()[0]

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id")))

    def best(hits: DataFrame) -> DataFrame:
        return hits.withColumn("rank", rank).filter(F.col("rank") <= k)

    # The first meeting only tells how good a hit must be; the second finds all, so no hit is there twice.
    one = materialize(queries.mapInArrow(meetings, pair_schema), "first-pairs")
    early = materialize(met(one), "first-hits")
    reached = best(early).filter(F.col("rank") == k).select("query_id", F.col("score").alias("reached"))
    two = materialize(queries.join(reached, "query_id", "left").select("query_id", "vector", "reached").mapInArrow(meetings, pair_schema), "pairs")
    return PrunedSearch(best(met(two)), queries.count() * int(n.sum()), compared(two))


def with_payload(hits: DataFrame, passages: DataFrame) -> DataFrame:
    """Add text, source and platform of the passage; the score is shown with three digits."""
    shown = hits.withColumn("score", round_even(F.col("score"), 3))
    return shown.join(passages.select("id", "text", "source", "platform"), "id")


def top_context(hits: DataFrame, chars: int = 300) -> DataFrame:
    """(query_id, context): the first characters of the best passage only. Hits are k rows per query."""
    best = hits.groupBy("query_id").agg(F.min_by("text", "rank").alias("text"))
    return best.select("query_id", cut(F.col("text"), chars).alias("context"))


def explanations(anomalies: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, anomaly, prompt, sources, chunks) per anomaly; the fixed text where nothing was found.

    ``anomalies`` is (query_id, anomaly). ``explanation`` is null until a model has answered the prompt.
    """
    chunk = F.struct("rank", "text", "source", "platform", "score")
    listed = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(chunk)).alias("chunks"))  # k per query
    joined = anomalies.join(listed, "query_id", "left")
    none = F.col("chunks").isNull()
    context = cut(F.get("chunks", F.lit(0))["text"], 300)
    return joined.select(
        "query_id",
        "anomaly",
        F.when(none, V.NO_PASSAGE_TEXT).alias("explanation"),
        F.when(~none, explain_prompt(F.col("anomaly"), context)).alias("prompt"),
        F.when(none, F.array().cast("array<string>"))
        .otherwise(F.transform("chunks", lambda c: c["source"]))
        .alias("sources"),
        F.coalesce("chunks", F.array().cast("array<struct<rank:int,text:string,source:string,platform:string,score:double>>")).alias("chunks"),
    )
