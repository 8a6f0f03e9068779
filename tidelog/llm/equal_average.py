"""Vectors as codes of small codebooks, one for each part of a vector, whose nearest entries are found by equal-average search.

Components become integers (256-fold, floor), vectors are cut into equal consecutive parts, and each part position has its own
codebook, which starts as that part of the vectors with the smallest ids and is refitted in a few rounds: every part goes to
its nearest entry, every entry becomes the floored mean of its parts.

Equal-average search: the entries of a codebook lie in order of their component sums. From a part's own sum the search goes
outward in both directions. The squared gap of two sums over the number of components is never more than the squared distance
(Cauchy-Schwarz), so a direction ends at the first entry whose gap is strictly beyond the best distance; equal ones are still
looked at, as the smaller index wins a tie. All arithmetic is in integers.

A round is one pass over the vectors: a task adds up its parts by (position, entry, component), Spark adds up the tasks, and
the driver gets ``entries`` x (components of a vector) sums, whatever the number of vectors. Sums of errors by label are
pre-aggregated, and labels are looked up by measured size, so a label may hold any share of the rows.

Edge cases: vectors that are null, empty, or hold a null or non-finite component take no part, neither do those of another
length than the most common one (ties: the greater). Where the length is no multiple of ``parts``, zeros are added at the
end. Components beyond 2**40 in 256ths are cut to it; errors beyond a long to the greatest long. Fewer vectors than entries
give a smaller codebook. Null ids go last, rows that repeat an id each have their row and start the codebook in order of
their components. Null labels are one label. Other columns are left out, so their names do not matter. An empty table gives
no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.operators.joins import lookup_join
from tidelog.session import materialize

PARTS, ENTRIES, ROUNDS = 16, 64, 2
_LARGEST = 1 << 40
_LONG = (1 << 63) - 1
# Rows whose sums a task holds before it hands them on.
_FLUSH_ROWS = 1 << 20

Codebooks = list[list[list[int]]]


def integers(vectors: np.ndarray, parts: int) -> np.ndarray:
    """Rows of doubles as integer parts: (rows, parts, components of a part)."""
    with np.errstate(over="ignore"):
        whole = np.clip(np.floor(vectors * 256.0), -_LARGEST, _LARGEST).astype(np.int64)
    width = -(-vectors.shape[1] // parts)
    padded = np.zeros((len(vectors), parts * width), np.int64)
    padded[:, : vectors.shape[1]] = whole
    return padded.reshape(len(vectors), parts, width)


def nearest(values: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``values`` the index of its nearest row of ``entries`` (ties: the smaller index) and its squared
    distance, by equal-average search."""
    width = values.shape[1]
    reach = max(int(np.abs(values).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if width * reach >= 1 << 30:  # squares of sums would leave 64 bits
        values, entries, far = values.astype(object), entries.astype(object), 1 << 200
    else:
        far = _LONG // width
    sums, own = entries.sum(1), values.sum(1)
    order = np.lexsort((np.arange(len(sums)), sums)) if sums.dtype != object else np.array(sorted(range(len(sums)), key=lambda i: (sums[i], i)))
    sums, entries = sums[order], entries[order]
    index, best = np.zeros(len(values), np.int64), np.full(len(values), far, values.dtype)
    right = np.searchsorted(sums, own)
    left = right - 1
    sides = [(np.arange(len(values)), right, 1), (np.arange(len(values)), left, -1)]
    while sides:
        going = []
        for rows, at, step in sides:
            inside = (at >= 0) & (at < len(sums))
            rows, at = rows[inside], at[inside]
            gap = sums[at] - own[rows]
            reached = (gap * gap <= best[rows] * width).astype(bool)
            rows, at = rows[reached], at[reached]
            if not len(rows):
                continue
            difference = values[rows] - entries[at]
            distance, entry = (difference * difference).sum(1), order[at]
            better = (distance < best[rows]).astype(bool) | ((distance == best[rows]).astype(bool) & (entry < index[rows]))
            index[rows[better]], best[rows[better]] = entry[better], distance[better]
            going.append((rows, at + step, step))
        sides = going
    return index, best


def _rows(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _update(fine: DataFrame, books: Codebooks, parts: int, size: int) -> Codebooks:
    """The codebooks after one round: floored means of the parts of each entry."""
    arrays = [np.array(b, np.int64) for b in books]
    shape = (parts, len(books[0]), len(books[0][0]))
    schema = pa.schema([("cell", pa.int32()), ("n", pa.int64()), ("total", pa.int64())])

    def sums(batches):
        n, total, held = np.zeros(shape[:2], np.int64), np.zeros(shape, np.int64), 0

        def cells():
            used = np.flatnonzero(np.repeat(n.reshape(-1), shape[2]))
            counts = np.repeat(n.reshape(-1), shape[2])[used]
            return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts), pa.array(total.reshape(-1)[used])], schema=schema)

        for batch in batches:
            values = integers(_rows(batch.column(0), size), parts)
            for p in range(parts):
                index, _ = nearest(values[:, p], arrays[p])
                n[p] += np.bincount(index, minlength=shape[1])
                np.add.at(total[p], index, values[:, p])
            held += len(values)
            if held >= _FLUSH_ROWS:
                yield cells()
                n[:], total[:], held = 0, 0, 0
        if held:
            yield cells()

    added = fine.select("embedding").mapInArrow(sums, "cell int, n bigint, total bigint")
    found = added.groupBy("cell").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    made = [[list(e) for e in b] for b in books]
    for r in found:
        position, rest = divmod(r["cell"], shape[1] * shape[2])
        made[position][rest // shape[2]][rest % shape[2]] = int(r["total"]) // r["n"]
    return made


def digest(books: Codebooks) -> str:
    """SHA-256 of all entries' components in decimal, by part, entry and place, with commas between."""
    return hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()


def compress(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
    id_column: str = "vec_id", column: str = "embedding", label_column: str = "label",
) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256): two hex digits a part, the squared distance to the entries
    named, that error summed over all rows of the same label, and the digest of the codebooks."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    spark = vectors.sparkSession
    numbers = F.col(column).cast("array<double>")
    finite = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    fine = vectors.filter(finite & (F.size(numbers) > 0)).select(
        F.col(id_column).cast("long").alias("vec_id"), F.col(label_column).alias("label"), numbers.alias("embedding")
    )
    top = fine.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if top is None:
        return spark.createDataFrame([], "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string")
    size = top["size"]
    fine = fine.filter(F.size("embedding") == size)
    first = fine.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).select("embedding").collect()
    books = integers(np.array([r["embedding"] for r in first], np.float64), parts).transpose(1, 0, 2).tolist()
    for _ in range(rounds):
        books = _update(fine, books, parts, size)
    arrays = [np.array(b, np.int64) for b in books]

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                values = integers(_rows(batch.column("embedding"), size), parts)
                found = [nearest(values[:, p], arrays[p]) for p in range(parts)]
                codes = np.stack([index for index, _ in found], 1).astype(np.uint8)
                total = sum(best.astype(object) for _, best in found)
                made = [pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array([min(e, _LONG) for e in total.tolist()], pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), *made], names=["vec_id", "label", "code", "error"])

    kind = fine.schema["label"].dataType.simpleString()
    coded = materialize(fine.mapInArrow(assign, f"vec_id bigint, label {kind}, code string, error bigint"), "part-codes")
    shown = F.col("label").cast("string") if kind not in ("float", "double") else (F.col("label") + F.lit(0.0)).cast("string")
    keyed = coded.withColumn("_label", F.coalesce(F.concat(F.lit("="), shown), F.lit("null")))
    most = F.lit(_LONG).cast("decimal(38,0)")
    sums = keyed.groupBy("_label").agg(
        F.count("*").alias("_n"), F.least(F.sum(F.col("error").cast("decimal(20,0)")).cast("decimal(38,0)"), most).cast("long").alias("label_error")
    )
    both = lookup_join(keyed, materialize(sums, "label-errors"), "_label", ["vec_id", "code"], "_n")
    return both.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
