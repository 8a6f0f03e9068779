"""The values before each event of its group, over a stream: state is the last few values of a group, and it ends.

``start_context`` runs micro-batch by micro-batch on tables and bears groups of any size; ``context_stream`` is a keyed state
operator that can stand inside a longer stream.
"""

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidelog.operators.inference import with_context

KEEP_HOURS = 12
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def lists_in_state(spark: SparkSession):
    """Streams started inside keep their state in RocksDB, which lists and timers need."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


class LastValues(StatefulProcessor):
    """Keeps a group's last ``n`` values as a list, until the watermark is past its last event."""

    def __init__(self, value: str, ts: str, tie: str, n: int):
        self.value, self.ts, self.tie, self.n = value, ts, tie, n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getListState("last", "value string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = [r[0] for r in self.last.get()] if self.last.exists() else []
        ordered = pd.concat(list(rows)).sort_values([self.ts, self.tie], kind="stable", na_position="first")
        found = []
        for text in ordered[self.value]:
            found.append(list(last))
            last = [*last, text][-self.n :]
        self.last.put([(v,) for v in last])
        newest = ordered[self.ts].max()
        if not pd.isna(newest):
            ends = max([int(newest.timestamp() * 1000) + 1, timerValues.getCurrentWatermarkInMs() + 1, *(timers := list(self.handle.listTimers()))])
            for t in timers:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(ends)
        yield ordered.assign(context=found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter([])

    def close(self) -> None:
        pass


def context_stream(
    events: DataFrame, key: str, value: str = "template", ts: str = "ts", tie: str = "id", n: int = 5, keep_hours: int = KEEP_HOURS
) -> DataFrame:
    """Add ``context``: the ``n`` values before each event of its ``key``, oldest first.

    Inside a micro-batch events are taken by (``ts``, ``tie``); an event that comes later than that follows what has been
    seen, and one that comes ``keep_hours`` late is left out, as the state of its key may have ended. State holds ``n`` texts for
    each key with an event in that time. A key's rows of one micro-batch meet in one task: where a key may be hot, use
    ``start_context``. Start it inside ``lists_in_state``.
    """
    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema]
    return events.withWatermark(ts, f"{keep_hours} hours").groupBy(key).transformWithStateInPandas(
        LastValues(value, ts, tie, n), ", ".join([*columns, "context array<string>"]), "Append", "EventTime"
    )


def start_context(
    events: DataFrame, out: str, checkpoint: str, keys: list[str], value: str = "template", ts: str = "ts", tie: str = "id",
    n: int = 5, keep_hours: float = KEEP_HOURS, block: int = 1000, trigger: dict = {"availableNow": True},
) -> StreamingQuery:
    """Writes the rows with ``context`` below ``out``/rows by ``batch_id``.

    Inside a micro-batch a group is cut into blocks of consecutive rows that exchange only their last ``n``
    (``inference.with_context``), so a group may hold any share of a batch. Between batches one row a group is carried: its
    last ``n`` values, for ``keep_hours`` of event time after its last event. Only the first ``n`` rows of a group in a batch
    meet that row. The carried rows lie in two tables that batches overwrite in turn: batch n reads what batch n - 1 wrote, and
    a batch that is repeated leaves the same rows. Groups without an event that has a time are carried on.
    """
    carried = [f"`{c}` {events.schema[c].dataType.simpleString()}" for c in keys]
    schema = ", ".join([*carried, "last array<string>", "seen timestamp"])

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = spark.createDataFrame([], schema)
        if batch_id > 0:
            before = spark.read.schema(schema).parquet(f"{out}/last/{(batch_id - 1) % 2}")
        placed = with_context(batch, keys, value, n, block, place="_pos").persist()
        try:
            same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]
            known = before.select(*[F.col(c).alias(f"_{c}") for c in keys], "last")
            heads = placed.filter(F.size("context") < n).join(known, same, "left")
            joined = F.concat(F.coalesce("last", F.array().cast("array<string>")), F.col("context"))
            heads = heads.withColumn("context", _last(joined, n)).select(*placed.columns)
            rows = placed.filter(F.size("context") >= n).unionByName(heads)
            rows.drop("_pos").write.mode("overwrite").parquet(f"{out}/rows/batch_id={batch_id}")
            written = heads.unionByName(placed.filter(F.size("context") >= n))
            after = _last(F.concat("context", F.array(F.col(value).cast("string"))), n)
            newest = written.groupBy(*keys).agg(F.max_by(after, "_pos").alias("last"), F.max(F.col(ts).cast("timestamp")).alias("seen"))
            merged = before.withColumn("_new", F.lit(0)).unionByName(newest.withColumn("_new", F.lit(1)))
            merged = merged.groupBy(*keys).agg(F.max_by("last", "_new").alias("last"), F.max("seen").alias("seen")).persist()
            end = merged.agg(F.max("seen")).scalar() - F.make_dt_interval(secs=F.lit(keep_hours * 3600))
            kept = merged.filter(F.col("seen").isNull() | F.coalesce(F.col("seen") >= end, F.lit(True)))
            kept.write.mode("overwrite").parquet(f"{out}/last/{batch_id % 2}")
            merged.unpersist()
        finally:
            placed.unpersist()

    return events.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def _last(values, n: int):
    """The last ``n`` entries of an array."""
    return F.slice(values, F.greatest(F.size(values) - n + 1, F.lit(1)), F.lit(n))
