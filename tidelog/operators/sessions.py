"""Event sequences per session: positions, traces, text, labels.

A session may hold a third of all rows, so a session is never gathered whole. Positions are counted
in time slices, and traces come in segments of bounded length.
"""

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_LITERAL_DICTIONARY = 1000


def positions(
    events: DataFrame, keys: list[str], ts: str = "ts", tie: str = "id", slice_seconds: int = 60
) -> DataFrame:
    """Add ``pos``: the 0-based place of each row in its group by (ts, tie).

    Rows are ranked inside (group, time slice), which is what the big shuffle partitions by; the start
    of each slice comes from the counts per slice. Shorter slices spread bursts more.
    """
    # window() drops rows without a time, so those get an early one: nulls sort first anyway.
    timed = F.coalesce(F.col(ts), F.lit("0001-01-01 00:00:00").cast(events.schema[ts].dataType))
    sliced = events.withColumn("_slice", F.window(timed, f"{slice_seconds} seconds")["start"])
    sizes = sliced.groupBy(*keys, "_slice").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    marks = [*keys, "_slice"]
    starts = sizes.select(
        *[F.col(c).alias(f"_at_{c}") for c in marks], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_at_{c}")) for c in marks])
    rank = F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy(ts, tie))
    placed = sliced.withColumn("_r", rank).join(starts, same)
    return placed.select(*events.columns, (F.col("_start") + F.col("_r") - 1).alias("pos"))


def trace_segments(placed: DataFrame, keys: list[str], event: str, size: int = 1000) -> DataFrame:
    """Traces as "[a,b,c]" text, one row per group and run of ``size`` positions."""
    segment = F.floor(F.col("pos") / size).cast("int").alias("segment")
    pairs = F.array_sort(F.collect_list(F.struct("pos", F.col(event).alias("e"))))
    text = F.concat(F.lit("["), F.array_join(F.transform(pairs, lambda x: x["e"]), ","), F.lit("]"))
    return placed.select(*keys, "pos", event, segment).groupBy(*keys, "segment").agg(text.alias("features"))


def whole_traces(segments: DataFrame, keys: list[str]) -> DataFrame:
    """One row per group with its whole trace, from its segments (each counted and joined before)."""
    pairs = F.array_sort(F.collect_list(F.struct("segment", "features")))
    bare = F.transform(pairs, lambda p: F.regexp_replace(p["features"], r"^\[|\]$", ""))
    return segments.groupBy(*keys).agg(F.concat(F.lit("["), F.array_join(bare, ","), F.lit("]")).alias("features"))


def parse_trace(features: Column) -> Column:
    """"[E5, E22]" to an array; blank entries drop out."""
    bare = F.regexp_replace(features, r"^[\[\]]+|[\[\]]+$", "")
    return F.filter(F.transform(F.split(bare, ","), lambda e: F.trim(e)), lambda e: e != "")


def fail_label(label: Column) -> Column:
    return F.coalesce((F.trim(label) == "Fail").cast("int"), F.lit(0))


def trace_text(traces: DataFrame, dictionary: DataFrame, max_literal: int = MAX_LITERAL_DICTIONARY) -> DataFrame:
    """Add ``document``: the trace with each event id replaced by its template, unknown ids kept.

    ``traces`` needs a unique ``trace_id`` and ``features``; ``dictionary`` is (event_id, template), of a repeated id the
    greatest template counts, as rows have no order. Null features give a null document.
    A dictionary of at most ``max_literal`` ids becomes a literal map, so nothing is shuffled; a larger one is joined by
    event id, spread over salts because few ids make up most rows. Both ways give the same rows and columns.
    """
    dictionary = dictionary.filter("event_id is not null").groupBy("event_id").agg(F.max("template").alias("template"))
    entries = dictionary.limit(max_literal + 1).collect()
    if len(entries) <= max_literal:
        pairs = [F.lit(x) for row in entries for x in (row["event_id"], row["template"])]
        lookup = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
        words = F.transform(
            parse_trace(F.col("features")), lambda e: F.coalesce(F.try_element_at(lookup, e), e)
        )
        return traces.withColumn("document", F.array_join(words, " "))
    return _trace_text_joined(traces, dictionary)


def _trace_text_joined(traces: DataFrame, dictionary: DataFrame, salts: int = 32) -> DataFrame:
    long = traces.select("trace_id", F.posexplode(parse_trace(F.col("features"))).alias("pos", "event_id"))
    salted = long.withColumn("_salt", F.pmod(F.hash("trace_id", "pos"), F.lit(salts)))
    copies = dictionary.select(
        "event_id", "template", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt")
    )
    joined = salted.join(copies, ["event_id", "_salt"], "left")
    word = F.coalesce("template", "event_id").alias("w")
    # One trace was one input row, so its words fit one row again.
    words = F.transform(F.array_sort(F.collect_list(F.struct("pos", word))), lambda x: x["w"])
    texts = joined.groupBy("trace_id").agg(F.array_join(words, " ").alias("document"))
    document = F.when(F.col("features").isNotNull(), F.coalesce("document", F.lit(""))).alias("document")
    return traces.join(texts, "trace_id", "left").select(*traces.columns, document)
