"""Model replies kept by (model, digest of the prompt), so that no prompt is paid for twice.

The rows' prompts are reduced to distinct digests, those with a stored reply fall out by an anti join, and the rest is dealt
to buckets, each a folder of the store. A task asks in small groups and writes each group's replies as a file before it
asks on. So what a lost task was told is on shared storage: its second attempt reads the names of its bucket first and asks
only for what is missing, and a later run starts where an ended one stopped.

Files are written under another name and then renamed; a reader never meets half a file. Two attempts that run at once
(speculation) may both ask; ``stored`` keeps one reply for each digest, the least file name's, whichever ended first.

Edge cases: a null prompt is not asked and has a null reply; a call that raises, or returns None, is not stored, has a null
reply and is asked again by the next run; an empty reply is a reply; rows that repeat a prompt share its reply and seconds;
columns of the rows named like a result raise an error.
"""

import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUCKETS, GROUP = 64, 32
STORED = "digest string, raw string, seconds double, model string, bucket int"
_FILE = pa.schema([("digest", pa.string()), ("raw", pa.string()), ("seconds", pa.float64())])


def _filesystem(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a shared folder and the folder's path in it."""
    if path.startswith("file:"):
        return arrow_fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return arrow_fs.FileSystem.from_uri(path) if "://" in path else (arrow_fs.LocalFileSystem(), path)


def _known(fs: arrow_fs.FileSystem, folder: str) -> set[str]:
    """Digests that a bucket's files hold."""
    found = fs.get_file_info(arrow_fs.FileSelector(folder, allow_not_found=True))
    names = [f.path for f in found if f.is_file and f.path.endswith(".parquet")]
    return {d for name in names for d in pq.read_table(name, columns=["digest"], filesystem=fs, partitioning=None)["digest"].to_pylist()}


def _put(fs: arrow_fs.FileSystem, folder: str, rows: list[tuple]) -> None:
    name = uuid.uuid4().hex
    fs.create_dir(folder, recursive=True)
    # Names that begin with an underscore are passed over by Spark's readers.
    pq.write_table(pa.Table.from_pylist([dict(zip(_FILE.names, r)) for r in rows], schema=_FILE), f"{folder}/_{name}", filesystem=fs)
    fs.move(f"{folder}/_{name}", f"{folder}/{name}.parquet")


def digest(prompt: str):
    return F.sha2(F.col(prompt), 256)


def stored(spark: SparkSession, store: str, model: str) -> DataFrame:
    """(digest, raw, seconds): one reply for each prompt that ``model`` has answered."""
    fs, folder = _filesystem(store)
    if fs.get_file_info(folder).type == arrow_fs.FileType.NotFound:
        return spark.createDataFrame([], "digest string, raw string, seconds double")
    rows = spark.read.schema(STORED).option("basePath", store).parquet(store).filter(F.col("model") == model)
    first = F.row_number().over(Window.partitionBy("digest").orderBy("name"))
    named = rows.withColumn("name", F.col("_metadata.file_name"))
    return named.withColumn("first", first).filter("first = 1").select("digest", "raw", "seconds")


def ask(
    rows: DataFrame, call: Callable[[str], str | None], store: str, model: str, prompt: str = "prompt", buckets: int = BUCKETS, group: int = GROUP
) -> None:
    """Ask ``call`` for the distinct prompts of ``rows`` that ``store`` lacks and keep its replies there.

    A task holds a bucket's known digests (64 bytes each), so ``buckets`` grows with the number of prompts.
    """
    if not model or "/" in model or "=" in model:
        raise ValueError("a model's name is part of a folder: not empty, no '/' and no '='")
    spark = rows.sparkSession
    asked = rows.filter(F.col(prompt).isNotNull()).select(digest(prompt).alias("digest"), F.col(prompt).alias("prompt"))
    asked = asked.groupBy("digest").agg(F.first("prompt").alias("prompt"))
    missing = asked.join(stored(spark, store, model).select("digest"), "digest", "left_anti")
    bucket = F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int")
    dealt = missing.select("digest", "prompt", bucket.alias("bucket")).repartition(buckets, "bucket").sortWithinPartitions("bucket", "digest")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(store)
        at, known, held, folder = None, set(), [], ""
        n = 0
        for batch in batches:
            for key, text, b in zip(*(c.to_pylist() for c in batch.columns)):
                if b != at:
                    if held:
                        _put(fs, folder, held)
                    at, held, folder = b, [], f"{root}/model={model}/bucket={b}"
                    known = _known(fs, folder)
                if key in known:
                    continue
                started = time.time()
                try:
                    raw = call(text)
                except Exception:
                    continue
                if raw is None:
                    continue
                held.append((key, raw, time.time() - started))
                n += 1
                if len(held) >= group:
                    _put(fs, folder, held)
                    held = []
        if held:
            _put(fs, folder, held)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    dealt.mapInArrow(answer, "n bigint").agg(F.sum("n")).collect()


def answered(
    rows: DataFrame, call: Callable[[str], str | None], store: str, model: str, prompt: str = "prompt", buckets: int = BUCKETS, group: int = GROUP
) -> DataFrame:
    """``rows`` with ``raw`` and ``seconds`` (of the first time it was asked), after ``ask`` for what the store lacks.

    A prompt may be that of a third of all rows: replies are joined by digest, which Spark's skew join splits.
    """
    if clash := [c for c in ("raw", "seconds", "digest") if c in rows.columns]:
        raise ValueError(f"columns {clash} are made here")
    ask(rows, call, store, model, prompt, buckets, group)
    return rows.withColumn("digest", digest(prompt)).join(stored(rows.sparkSession, store, model), "digest", "left").drop("digest")
