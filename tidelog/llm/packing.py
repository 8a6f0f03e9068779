"""Best-two-fit packing of documents into sequences of a fixed number of tokens.

What decides a packing is how many pieces there are of each length, and there are at most as many lengths as a
sequence has tokens. So the plan is made once, on those counts: a bin is filled greedily with the longest piece that
still fits; then its smallest piece is taken out again and replaced by the two unpacked pieces that fill the widened gap
most tightly, if they fill it better. The resulting pattern is used as often as the counts allow. Every plan has less
than ``capacity * (1 + ln(capacity))`` patterns, as each use ends the supply of one of its lengths, so it may be sent to
all tasks. The pieces themselves stay distributed: each gets its rank among those of its length (counted in salted
slices, as one length may hold a third of all pieces) and looks up the slot of that rank.

Only documents longer than the capacity are cut: their first piece takes the remainder, all others are full.

Edge cases: a null text is empty, so its document is the end id alone; rows that repeat a ``doc_id`` are documents of
their own; a null ``doc_id`` stays null; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.memory import released
from tidelog.llm.tokens import Encoder, tokenizer_path
from tidelog.session import materialize

CAPACITY = 2048


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """The pieces to pack: doc_id, piece, start, length, ids_crc32 and, if asked for, ids (array<int>)."""
    file = tokenizer or tokenizer_path()
    kinds = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    kinds += [("ids", pa.list_(pa.int32()))] * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(file)
        for batch in batches:
            out = []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode_each(texts)):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                start = 0
                for k in range(-(-len(ids) // capacity)):
                    end = start + ((len(ids) - 1) % capacity + 1 if k == 0 else capacity)
                    part = ids[start:end]
                    out.append((doc_id, k, start, end - start, zlib.crc32(part.tobytes()), *[part.astype(np.int32)] * with_ids))
                    start = end
            columns = list(zip(*out)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds)], names=[n for n, _ in kinds])

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(released(cut), schema)


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Patterns (lengths in a sequence) and how often each is used; ``counts[n]`` pieces have length ``n``."""
    left = np.array(counts, np.int64)
    patterns: list[tuple[list[int], int]] = []
    while left.any():
        have = np.flatnonzero(left)
        chosen, gap = [], capacity
        while True:  # greedily the longest that fits
            k = np.searchsorted(have, gap, "right") - 1
            while k >= 0 and chosen.count(have[k]) >= left[have[k]]:
                k -= 1
            if k < 0:
                break
            chosen.append(int(have[k]))
            gap -= chosen[-1]
        if gap and len(chosen) > 0:
            smallest = chosen[-1]
            pair = _best_pair(left, chosen[:-1], gap + smallest)
            if pair and sum(pair) > smallest:
                chosen[-1:] = pair
        times = int(min(left[n] // chosen.count(n) for n in set(chosen)))
        for n in chosen:
            left[n] -= times
        patterns.append((chosen, times))
    return patterns


def _best_pair(left: np.ndarray, used: list[int], gap: int) -> list[int] | None:
    """The two pieces, of those left beside ``used``, whose lengths together come nearest to ``gap`` from below."""
    free = left.copy()
    for n in used:
        free[n] -= 1
    have = np.flatnonzero(free[:gap])
    if not len(have):
        return None
    k = np.searchsorted(have, np.minimum(gap - have, have), "right") - 1  # the shorter partner of each
    same = (k >= 0) & (have[k] == have) & (free[have] < 2)
    k -= same
    total = np.where(k >= 0, have + have[k], -1)
    best = int(np.argmax(total))
    return [int(have[best]), int(have[k[best]])] if total[best] > 0 else None


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``parts`` (with ``length`` from 1 to ``capacity``) with ``sequence_id`` and ``offset`` (both bigint).

    ``parts`` is stored once, as the counts and the assignment read the same rows.
    """
    spark = parts.sparkSession
    if {"sequence_id", "offset"} & set(parts.columns):
        raise ValueError("the input already has a sequence_id or an offset")
    stored = materialize(parts, "pieces")
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = stored.withColumn("_salt", F.pmod(F.xxhash64(*[c for c in ("doc_id", "piece", "start", "ids_crc32") if c in stored.columns]), F.lit(salts)))
    sizes = materialize(salted.groupBy("length", "_salt").agg(F.count("*").alias("_n")), "piece-counts")
    counts = np.zeros(capacity + 1, np.int64)
    for r in sizes.groupBy("length").agg(F.sum("_n").alias("n")).collect():  # at most one row for each possible length
        counts[r["length"]] = r["n"]
    slots = _slots(plan(counts, capacity))
    sent = spark.sparkContext.broadcast(slots)

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        keys, low, base, offset = sent.value
        k = np.searchsorted(keys, (length.to_numpy() << 44) + rank.to_numpy(), "right") - 1
        return pd.DataFrame({"sequence_id": base[k] + rank.to_numpy() - low[k], "offset": offset[k]})

    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("length", "_salt").orderBy(*[c for c in ("doc_id", "piece", "ids_crc32") if c in stored.columns])
    ranked = salted.withColumn("_rank", F.row_number().over(inside) - 1).join(bases, ["length", "_salt"])
    placed = ranked.withColumn("_at", place("length", F.col("_base") + F.col("_rank")))
    return placed.select(*stored.columns, "_at.sequence_id", "_at.offset")


def _slots(patterns: list[tuple[list[int], int]]) -> tuple[np.ndarray, ...]:
    """For each length, ranges of ranks: key (length, first rank), first rank, first sequence, offset in the sequence."""
    rows, next_rank, sequence = [], {}, 0
    for lengths, times in patterns:
        offset = 0
        for n in lengths:
            low = next_rank.get(n, 0)
            rows.append(((n << 44) + low, low, sequence, offset))
            next_rank[n] = low + times
            offset += n
        sequence += times
    table = np.array(sorted(rows) or np.zeros((0, 4)), np.int64).reshape(-1, 4)
    return tuple(np.ascontiguousarray(table[:, k]) for k in range(4))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their sequences: doc_id, piece, start, length, ids_crc32, [ids], sequence_id, offset."""
    return pack(pieces(docs, capacity, tokenizer, end_id, with_ids), capacity)
