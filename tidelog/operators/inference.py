"""Batch calls of a text model, and the context rows such a model is shown."""

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.sessions import positions


def call_model(
    rows: DataFrame, call: Callable[[str], str], prompt: str = "prompt", limit: int | None = None, order: str | None = None
) -> DataFrame:
    """Add ``raw`` (the reply, null where the call failed) and ``seconds``. ``limit`` keeps the first rows."""
    if limit is not None:
        rows = rows.orderBy(order or prompt).limit(limit)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            replies, seconds = [], []
            for text in batch[prompt]:
                started = time.time()
                try:
                    replies.append(call(text))
                except Exception:
                    replies.append(None)
                seconds.append(time.time() - started)
            yield batch.assign(raw=replies, seconds=seconds)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{schema}, raw string, seconds double")


def with_context(
    events: DataFrame, keys: list[str], value: str = "template", n: int = 5, block: int = 1000, place: str | None = None
) -> DataFrame:
    """Add ``context``: the ``n`` values before each row of its group by (ts, id), oldest first.

    Groups are cut into blocks of consecutive rows; the last ``n`` rows of a block are copied to the
    next one, so every row finds its context in its block and no group is held in one task. ``place``
    names a column for the 0-based place of a row in its group.
    """
    placed = positions(events, keys, slice_seconds=1)
    here = F.floor(F.col("pos") / block)
    is_tail = F.col("pos") % block >= block - n
    homes = F.when(is_tail, F.array(here, here + 1)).otherwise(F.array(here))
    blocks = placed.withColumn("_block", F.explode(homes))
    earlier = Window.partitionBy(*keys, "_block").orderBy("pos").rowsBetween(-n, -1)
    return (
        blocks.withColumn("context", F.collect_list(value).over(earlier))
        .filter(F.col("_block") == here)
        .select(*events.columns, *([F.col("pos").alias(place)] if place else []), "context")
    )
