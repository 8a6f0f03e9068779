"""Token ids on disk as bit or byte planes.

Ids are cut into blocks of a fixed number of ids. A block is transposed: plane ``p`` holds bit (or byte) ``p``
of every id, so that the high planes, which hardly vary, shrink to almost nothing; each plane is compressed with
zstandard on its own. A folder written here has three tables:

* ``blocks``: ``part``, ``block``, ``first`` (place of its first id in the part), ``n_ids``, ``planes`` (array of
  binary, lowest plane first) and ``docs``, the pieces of documents in it: ``(doc_no, doc_id, at, skip, n_ids, last)``;
* ``index``: ``part``, ``block``, ``n_ids`` and ``start``, the number of ids in all blocks before it;
* ``format``: one row with the number of bits in a plane element, the block size and the end id.

Documents are dealt into parts by ranges of ``doc_id``, so parts in order hold them in ascending order, and the
offset of a part is the sum of the parts before it: one row each. No task holds more than one batch of texts and one
block. A lost task is run again from its range; the writer's commit keeps its rows once.

Edge cases: a null text is an empty one; a null ``doc_id`` sorts first and stays null; rows that repeat a
``doc_id`` are documents of their own, ordered by text; an empty table gives empty tables; columns other than
``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.llm.memory import released
from tidelog.llm.tokens import Encoder, tokenizer_path

BLOCK_IDS = 1 << 16
_DOC = "struct<doc_no:bigint,doc_id:bigint,at:int,skip:bigint,n_ids:int,last:boolean>"
BLOCKS = f"part int, block int, first bigint, n_ids int, planes array<binary>, docs array<{_DOC}>"


def to_planes(ids: np.ndarray, bits: int) -> list[bytes]:
    """The planes of one block of uint32 ids: 4 of one byte each (bits=8) or 32 of one bit each (bits=1)."""
    import zstandard

    octets = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if bits == 8:
        planes = [np.ascontiguousarray(octets[:, k]) for k in range(4)]
    elif bits == 1:
        planes = [np.packbits(octets[:, k // 8] >> (k % 8) & 1, bitorder="little") for k in range(32)]
    else:
        raise ValueError("a plane holds 1 or 8 bits of each id")
    pack = zstandard.ZstdCompressor(level=1)
    return [pack.compress(p.tobytes()) for p in planes]


def from_planes(planes: list[bytes], n_ids: int) -> np.ndarray:
    """The ids of one block; the inverse of ``to_planes`` for either width."""
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    raw = [np.frombuffer(unpack.decompress(p), np.uint8) for p in planes]
    octets = np.zeros((n_ids, 4), np.uint8)
    for k, plane in enumerate(raw):
        if len(raw) == 4:
            octets[:, k] = plane
        else:
            octets[:, k // 8] |= np.unpackbits(plane, count=n_ids, bitorder="little") << (k % 8)
    return octets.view("<u4").reshape(-1)


def write_planes(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2, bits: int = 8, block_ids: int = BLOCK_IDS) -> None:
    """Encode ``docs`` (doc_id, text), append ``end_id`` to each and write the tables below ``path``."""
    spark = docs.sparkSession
    file = tokenizer or tokenizer_path()
    ordered = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = ordered.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, first, doc_no = TaskContext.get().partitionId(), 0, 0, 0
        encoder, held, size, pieces = Encoder.of(file), [], 0, []

        def row() -> dict:
            ids = np.concatenate(held)
            return {"part": part, "block": number, "first": first, "n_ids": size, "planes": to_planes(ids, bits), "docs": pieces}

        for batch in batches:
            done = []
            texts = batch.column(1).to_pylist()
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode_each(texts)):
                ids = np.append(ids, np.uint32(end_id))
                skip = 0
                while skip < len(ids):
                    piece = ids[skip : skip + block_ids - size]
                    last = skip + len(piece) == len(ids)
                    pieces.append({"doc_no": doc_no, "doc_id": doc_id, "at": size, "skip": skip, "n_ids": len(piece), "last": last})
                    held.append(piece)
                    skip, size = skip + len(piece), size + len(piece)
                    if size == block_ids:
                        done.append(row())
                        number, first, held, size, pieces = number + 1, first + size, [], 0, []
                doc_no += 1
            if done:
                yield pa.RecordBatch.from_pylist(done, _arrow_blocks())
        if size:
            yield pa.RecordBatch.from_pylist([row()], _arrow_blocks())

    ordered.mapInArrow(released(blocks), BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    sizes = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").select("part", "block", "first", "n_ids")
    sizes.join(_part_starts(sizes), "part").select(
        "part", "block", "n_ids", (F.col("part_start") + F.col("first")).alias("start")
    ).write.parquet(f"{path}/index")
    spark.createDataFrame([(bits, block_ids, end_id)], "plane_bits int, block_ids int, end_id int").write.parquet(f"{path}/format")


def _part_starts(sizes: DataFrame) -> DataFrame:
    """The number of ids before each part: one row per part, so the one ordered window sees no more than those."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    return totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))


def _arrow_blocks() -> pa.Schema:
    doc = pa.struct([("doc_no", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int32()), ("skip", pa.int64()), ("n_ids", pa.int32()), ("last", pa.bool_())])
    return pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int32()), ("planes", pa.list_(pa.binary())), ("docs", pa.list_(doc))])


def read_pieces(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """The pieces of documents in the blocks below ``path``: part, doc_no, doc_id, start_in_part, skip, n_ids and
    ``ids`` (array<bigint>), or with ``digest`` their ``crc32`` as little-endian 32-bit integers instead.

    A document that lies in one block is one piece; ``skip`` is the number of its ids before the piece.
    """
    value = ("crc32", pa.int64()) if digest else ("ids", pa.list_(pa.int64()))
    kinds = [("part", pa.int32()), ("doc_no", pa.int64()), ("doc_id", pa.int64()), ("start_in_part", pa.int64()), ("skip", pa.int64()), ("n_ids", pa.int64()), value]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # a block at a time
                row = batch.slice(k, 1).to_pylist()[0]
                ids = from_planes(row["planes"], row["n_ids"])
                out = []
                for d in row["docs"]:
                    piece = ids[d["at"] : d["at"] + d["n_ids"]]
                    out.append((row["part"], d["doc_no"], d["doc_id"], row["first"] + d["at"], d["skip"], d["n_ids"], zlib.crc32(piece.astype("<u4").tobytes()) if digest else piece.astype(np.int64)))
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds)], names=[n for n, _ in kinds])

    last = "crc32 bigint" if digest else "ids array<bigint>"
    schema = f"part int, doc_no bigint, doc_id bigint, start_in_part bigint, skip bigint, n_ids bigint, {last}"
    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks").mapInArrow(released(decode), schema)


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document, read back from the blocks: doc_id, start, n_tokens and ids_crc32 of all its ids."""
    pieces = read_pieces(spark, path, digest=True)
    starts = _part_starts(spark.read.schema(BLOCKS).parquet(f"{path}/blocks").select("part", "n_ids"))
    found = pieces.groupBy("part", "doc_no").agg(
        F.first("doc_id").alias("doc_id"),
        F.min("start_in_part").alias("start_in_part"),
        F.sum("n_ids").alias("n_tokens"),
        F.sort_array(F.collect_list(F.struct("skip", "n_ids", "crc32"))).alias("parts"),
    )
    joined = found.join(starts, "part")
    return joined.select(
        "doc_id",
        (F.col("part_start") + F.col("start_in_part")).alias("start"),
        "n_tokens",
        F.when(F.size("parts") == 1, F.col("parts")[0]["crc32"]).otherwise(F.pandas_udf(_joined_crc, "long")("parts.n_ids", "parts.crc32")).alias("ids_crc32"),
    )


def _joined_crc(sizes: pd.Series, sums: pd.Series) -> pd.Series:
    out = []
    for n, c in zip(sizes, sums):
        total = int(c[0])
        for k in range(1, len(c)):
            total = crc32_join(total, int(c[k]), 4 * int(n[k]))
        out.append(total)
    return pd.Series(out, dtype="int64")


def crc32_join(first: int, second: int, length: int) -> int:
    """The crc32 of two byte strings end to end, from theirs and the length of the second.

    Appending ``length`` zero bytes to the first is a linear map on its 32 bits (over the field of two elements);
    it is built by repeated squaring of the map for one zero byte.
    """
    columns = [_zero_byte(1 << k) for k in range(32)]
    while length:
        if length & 1:
            first = _times(columns, first)
        columns = [_times(columns, c) for c in columns]
        length >>= 1
    return first ^ second


def _zero_byte(value: int) -> int:
    for _ in range(8):
        value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
    return value


def _times(columns: list[int], vector: int) -> int:
    total, k = 0, 0
    while vector:
        if vector & 1:
            total ^= columns[k]
        vector, k = vector >> 1, k + 1
    return total
