"""Repeated passages by compaction of a de Bruijn graph of words, and their removal from all but the first document.

Edges of the graph are runs of ``k`` words. A window (50 words) is a path over its edges and is kept by its least edge, by
hash: so equal windows are kept by equal edges at equal distance, and an edge stands for the windows around it, about
twenty, that it keeps. One row per kept edge and place goes to Spark: the edge, a digest of all words of its windows
(``path``), and its source coordinates (document, words).

* An edge that occurs in one document only is dropped.
* An edge whose occurrences all have the same path does not branch: its windows are compacted to that one path, and all
  of them repeat the document with the least id.
* Where an edge branches, each distinct path is represented by its least document. All other documents on the path repeat
  that one. Only the representatives' windows are written out one by one, from the words at their coordinates, and
  compared by a 128-bit digest of these words.

Both kinds are joined back by edge and path to all coordinates, and the spans of a document are merged. A passage that a
third of all documents have is reduced before each shuffle and meets the places of one edge in a join, never in a group.

Edge cases: null text has no words; a null ``doc_id`` counts as greater than all; documents of less than a window lose
nothing; rows that repeat a ``doc_id`` do not count as repeats of each other; an empty table gives an empty one; extra
columns are kept by ``remove_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import words
from tidelog.llm.memory import released
from tidelog.session import materialize

WINDOW, K = 50, 12
_LAST = (1 << 63) - 1
_INDEX_BITS = np.uint64(24)
_SPAN = "array<struct<start:bigint,end:bigint>>"


def _keys(docs: DataFrame) -> list:
    """What names a row: the id and a hash of the text, as ids may repeat."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("_doc"), F.xxhash64("text").alias("_text")]


def _kept_edges(hashes: np.ndarray, first: np.ndarray, window: int, k: int):
    """For each kept edge: its text, edge hash, place, the first and last start of its windows, and the path's digest."""
    edges = words.runs(hashes, k)
    empty = np.zeros(0, np.int64)
    if len(hashes) < window:
        return empty, np.zeros(0, np.uint64), empty, empty, empty, np.zeros(0, np.uint64)
    index = np.arange(len(edges), dtype=np.uint64) & np.uint64((1 << 24) - 1)
    least = (edges >> _INDEX_BITS << _INDEX_BITS) | index  # the leftmost of equal edges
    span, width = window - k + 1, 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    starts = np.arange(len(least), dtype=np.int64)
    place = starts + ((least - starts.astype(np.uint64)) & np.uint64((1 << 24) - 1)).astype(np.int64)
    text = np.searchsorted(first, starts, "right") - 1
    inside = starts + window <= first[text + 1]
    starts, place, text = starts[inside], place[inside], text[inside]
    if not len(starts):
        return empty, np.zeros(0, np.uint64), empty, empty, empty, np.zeros(0, np.uint64)
    new = np.concatenate([[True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])])
    at = np.flatnonzero(new)
    low, high = starts[at], starts[np.append(at[1:], len(starts)) - 1]
    place, text = place[at], text[at]
    up, down = words.powers(words._RUN_BASE, len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[:-1], out=total[1:])
    shape = ((place - low) * 4096 + (high - low)).astype(np.uint64)
    path = words.mix(words.mix((total[high + window] - total[low]) * down[low]) + shape)
    return text, edges[place], place, low, high, path


def _edges(docs: DataFrame, window: int, k: int) -> DataFrame:
    """(edge, path, _doc, _text, low, high): kept edges with the first and last start of their windows, in words."""
    kinds = pa.schema([("edge", pa.int64()), ("path", pa.int64()), ("_doc", pa.int64()), ("_text", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in words.chunks(texts):
                found = words.cut(texts[a:b])
                text, edge, _, low, high, path = _kept_edges(found.hashes, found.first, window, k)
                ids = [batch.column(c).to_numpy(zero_copy_only=False)[a:b][text] for c in (0, 1)]
                columns = [edge.view(np.int64), path.view(np.int64), *ids, low - found.first[text], high - found.first[text]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=kinds)

    schema = "edge bigint, path bigint, _doc bigint, _text bigint, low bigint, high bigint"
    return docs.filter("text is not null").select(*_keys(docs), "text").mapInArrow(released(cut), schema)


def _windows(chosen: DataFrame, window: int) -> DataFrame:
    """(edge, path, at, w1, w2, _doc): digests of the windows of each chosen place; ``at`` counts from its first window."""
    kinds = pa.schema([("edge", pa.int64()), ("path", pa.int64()), ("at", pa.int32()), ("w1", pa.int64()), ("w2", pa.int64()), ("_doc", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, places = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for a, b in words.chunks(texts):
                found = words.cut(texts[a:b])
                w1 = words.runs(found.hashes, window)
                w2 = words.runs(words.mix(found.hashes + np.uint64(0x632BE59BD9B4E019)), window)
                base = np.repeat(found.first[:-1], [len(p) for p in places[a:b]])
                flat = [p for ps in places[a:b] for p in ps]
                low = base + np.array([p["low"] for p in flat], np.int64)
                many = np.array([p["high"] - p["low"] + 1 for p in flat], np.int64)
                which = np.repeat(np.arange(len(flat)), many)
                at = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
                owner = np.repeat(np.array(ids[a:b], np.int64), [len(p) for p in places[a:b]])
                columns = [np.array([p["edge"] for p in flat], np.int64)[which], np.array([p["path"] for p in flat], np.int64)[which], at.astype(np.int32), w1[low[which] + at].view(np.int64), w2[low[which] + at].view(np.int64), owner[which]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, kinds)], schema=kinds)

    schema = "edge bigint, path bigint, at int, w1 bigint, w2 bigint, _doc bigint"
    return chosen.select("_doc", "text", "places").mapInArrow(released(cut), schema)


def repeated_spans(docs: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """(_doc, _text, spans): the spans of words (start, end) to remove from each document that loses any."""
    edges = _edges(docs, window, k)
    seen = edges.groupBy("edge").agg(F.min("_doc").alias("least"), F.max("_doc").alias("most"), F.min("path").alias("p"), F.max("path").alias("q"))
    # Sums are stored before they are joined back: only then can Spark split the rows of a frequent key in the join. And no
    # side is broadcast, as none has a bound.
    several = materialize(seen.filter("least < most").select("edge", "least", (F.col("p") != F.col("q")).alias("branches")), "several")
    places = materialize(edges.join(several.hint("merge"), "edge"), "places")
    alike = places.filter("not branches and _doc > least").select("_doc", "_text", F.col("low").alias("start"), (F.col("high") + window).alias("end"))
    branching = places.filter("branches")
    paths = branching.groupBy("edge", "path").agg(F.min(F.struct("_doc", "_text", "low", "high")).alias("rep"))
    paths = materialize(paths.select("edge", "path", "rep.*"), "paths")
    wanted = paths.groupBy("_doc", "_text").agg(F.collect_list(F.struct("edge", "path", "low", "high")).alias("places"))
    texts = docs.filter("text is not null").select(*_keys(docs), "text")
    chosen = texts.join(wanted.hint("merge"), ["_doc", "_text"]).dropDuplicates(["_doc", "_text"])
    each = materialize(_windows(chosen, window), "windows")
    firsts = each.groupBy("w1", "w2").agg(F.min("_doc").alias("least"), F.max("_doc").alias("most")).filter("least < most").drop("most")
    firsts = materialize(firsts, "firsts")
    again = each.join(firsts.hint("merge"), ["w1", "w2"]).filter("_doc > least").groupBy("edge", "path").agg(F.collect_set("at").alias("again"))
    firsts_of = paths.select("edge", "path", F.col("_doc").alias("first")).join(again, ["edge", "path"], "left")
    placed = branching.join(materialize(firsts_of, "firsts-of-paths").hint("merge"), ["edge", "path"])
    whole = placed.filter("_doc > first").select("_doc", "_text", F.col("low").alias("start"), (F.col("high") + window).alias("end"))
    some = placed.filter("_doc = first and again is not null").withColumn("at", F.explode("again"))
    some = some.select("_doc", "_text", (F.col("low") + F.col("at")).alias("start"), (F.col("low") + F.col("at") + window).alias("end"))
    spans = alike.union(whole).union(some).groupBy("_doc", "_text").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))
    return spans.select("_doc", "_text", _merged("spans").alias("spans"))


def _merged(name: str):
    """Spans in order, joined where they touch or overlap."""
    def add(done, s):
        last = F.element_at(done, -1)
        joins = (F.size(done) > 0) & (s["start"] <= last["end"])
        grown = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when(joins, grown).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(name, F.array().cast(_SPAN), add)


def _with_spans(docs: DataFrame, window: int, k: int) -> DataFrame:
    spans = materialize(repeated_spans(docs, window, k), "spans")
    return docs.withColumns(dict(zip(("_doc", "_text"), _keys(docs)))).join(spans.hint("merge"), ["_doc", "_text"], "left")


def removal_digests(docs: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed and kept_sha256, of the kept words with single spaces between."""
    kinds = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
                found = _words(text or "")
                kept, at = [], 0
                for s in spans or []:
                    kept += found[at : s["start"]]
                    at = s["end"]
                kept += found[at:]
                out.append((doc_id, len(found), len(found) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 4, kinds)], schema=kinds)

    rows = _with_spans(docs.select(F.col("doc_id").cast("long"), "text"), window, k)
    return rows.select("doc_id", "text", "spans").mapInArrow(released(digest), "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


def _words(text: str) -> list[bytes]:
    """Words between the six ASCII white-space characters (what ``bytes.split`` takes for such)."""
    return text.encode().split()


def cut_text(text: str | None, spans: list | None) -> str | None:
    """``text`` without the words of ``spans``: each goes with what stands between it and the next word kept."""
    if not text or not spans:
        return text
    found = words.cut([text])
    out, at = [], 0
    for s in spans:
        out.append(found.data[at : found.start[s["start"]]])
        at = found.start[s["end"]] if s["end"] < len(found.start) else len(found.data)
    return b"".join([*out, found.data[at:]]).decode()


def remove_repeats(docs: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """``docs`` with the repeated words cut from ``text``, same columns; documents with nothing left keep an empty text.

    Whole rows are carried as one value, so other columns may have any names."""
    cut = F.udf(lambda text, spans: cut_text(text, spans), "string", useArrow=True)
    packed = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = _with_spans(packed, window, k)
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(cut("text", "spans"))
    return rows.select(*[text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])
