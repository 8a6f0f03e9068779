"""Benchmark passages in training text, found in an FM-index of each training shard.

A task turns its documents into shards of a bounded number of words. A shard's words become symbols: the words of the test
phrases have one each, any run of other words (and the end of a document) is one separator, as no phrase contains it. Of
this sequence the shard gets a suffix array, the Burrows-Wheeler transform, a wavelet matrix that answers "how many of symbol
c are before place i" and samples of the suffix array. All phrases are searched backward at once, one symbol a step; the
interval that is left is the list of occurrences. Each is located by walking back to the nearest sample. Their spans of
words are merged per document.

A phrase is ``window`` consecutive words of an item, or the whole item if it has fewer (but any) words.

Phrases reach the tasks in blocks of about ``block_words`` words and ``SENT_IDS`` ids, both counted first. Items of one text are
one phrase source with a list of ids, split where the list is long; an item longer than an eighth of a block is cut into pieces
that overlap by all but one word of a window. A test set of several blocks takes several passes over the documents, each adding
to the spans; no limit cuts it off.

Edge cases: null or empty text has no words; null items and items without words have no phrase; a null ``item_id`` is left
out of the list of items but its phrases are hit; rows that repeat an item are one item; an empty table of either kind
gives no hits; extra columns are kept, and an input column named like a result raises an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import words
from tidelog.llm.memory import released
from tidelog.session import materialize

WINDOW = 10
# Words of test phrases sent to the tasks at once (about 100 bytes each), ids sent with them, and words of one shard.
BLOCK_WORDS, SENT_IDS, SHARD_WORDS = 500_000, 500_000, 250_000
# Passes over the documents in one job; after them the documents are stored with what was found.
PASSES = 8
# What stands between words once A-Z are in lower case.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SAMPLE = 8
ADDED = ["n_words", "spans", "item_ids"]


def suffix_array(symbols: np.ndarray, n_separators: int) -> np.ndarray:
    """Suffixes of ``symbols`` in order. The separators (zeros) differ from each other: the earlier is the smaller.

    Prefix doubling: three symbols are packed into the first key, then only suffixes with equals are sorted again.
    """
    n = len(symbols)
    base = symbols.astype(np.int64) + n_separators
    base[symbols == 0] = np.arange(n_separators)
    top = int(base.max()) + 2
    padded = np.concatenate([base + 1, [0, 0]])
    if top < 1 << 21:
        known = 3
        key = (padded[:n] * top + padded[1 : n + 1]) * top + padded[2:]
    else:
        known = 1
        key = padded[:n]
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    sorted_key = key[order]
    new = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = group
    slots = np.flatnonzero(~new | ~np.append(new[1:], True))  # places of suffixes with equals
    while len(slots):
        some = order[slots]
        follow = some + known
        key = rank[some] * (n + 1) + np.where(follow < n, rank[np.minimum(follow, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        some, key = some[by], key[by]
        order[slots] = some
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[some] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        slots = slots[~new | ~np.append(new[1:], True)]
        known *= 2
    return order


class WaveletMatrix:
    """Ranks in a sequence of small numbers: a bit vector with counts for each bit, highest first."""

    def __init__(self, values: np.ndarray, n_bits: int):
        self.levels = []
        for bit in reversed(range(n_bits)):
            ones = (values >> bit & 1).astype(bool)
            packed = np.packbits(ones, bitorder="little")
            packed = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view(np.uint64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])
            self.levels.append((bit, packed, before, len(values) - int(ones.sum())))
            values = np.concatenate([values[~ones], values[ones]])

    @staticmethod
    def _ones(packed: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return before[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many of each symbol are before each place."""
        low = np.zeros(len(at), np.int64)
        for bit, packed, before, zeros in self.levels:
            a, b = self._ones(packed, before, low), self._ones(packed, before, at)
            one = (symbol >> bit & 1).astype(bool)
            low = np.where(one, zeros + a, low - a)
            at = np.where(one, zeros + b, at - b)
        return at - low


class FMIndex:
    def __init__(self, symbols: np.ndarray, n_symbols: int):
        """``symbols`` from 0 (separator) to ``n_symbols``; the first is a separator."""
        n_separators = int((symbols == 0).sum())
        suffixes = suffix_array(symbols, n_separators)
        self.last = symbols[suffixes - 1]  # of the first suffix: the last symbol, which is a separator or never walked to
        self.counts = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=n_symbols + 1))])
        self.ranks = WaveletMatrix(self.last, max(1, int(n_symbols).bit_length()))
        # Samples: every eighth suffix of the text, and those after a separator, as a walk cannot pass one.
        follows = np.concatenate([[True], symbols[:-1] == 0])
        sampled = ((suffixes % SAMPLE) == 0) | follows[suffixes]
        self.sampled = sampled
        self.samples = suffixes[sampled]
        self.sample_at = np.cumsum(sampled) - 1

    def _step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.counts[symbol] + self.ranks.rank(symbol, at)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of suffixes that begin with each row of ``phrases`` (of one length)."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), len(self.last), np.int64)
        alive = np.arange(len(phrases))
        for k in reversed(range(phrases.shape[1])):
            symbol = phrases[alive, k]
            low[alive], high[alive] = self._step(symbol, low[alive]), self._step(symbol, high[alive])
            alive = alive[low[alive] < high[alive]]
            if not len(alive):
                break
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The places in the text of suffixes given by their rows."""
        at, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.empty(len(rows), np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            done = self.sampled[at[open_]]
            out[open_[done]] = self.samples[self.sample_at[at[open_[done]]]] + steps[open_[done]]
            open_ = open_[~done]
            at[open_] = self._step(self.last[at[open_]], at[open_])
            steps[open_] += 1
        return out


@dataclass
class Phrases:
    """Test phrases as symbols: hashes of their words in order (symbol = place + 1), and per phrase length the phrases (rows
    of symbols) with the numbers of their items: of phrase ``i`` ``items[first[i]:first[i + 1]]``."""

    vocabulary: np.ndarray
    by_length: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    names: list[list[str]]


def phrases_of(items: list[tuple[list[str], str]], window: int = WINDOW) -> Phrases:
    cut = words.cut([t for _, t in items], lower=True, alnum=True)
    vocabulary, symbols = np.unique(cut.hashes, return_inverse=True)
    symbols = symbols.astype(np.int64) + 1
    found: dict[int, dict[tuple, set[int]]] = {}
    for k, (a, b) in enumerate(zip(cut.first[:-1].tolist(), cut.first[1:].tolist())):
        size = min(window, b - a)
        for s in range(a, b - size + 1) if size else ():
            found.setdefault(size, {}).setdefault(tuple(symbols[s : s + size].tolist()), set()).add(k)
    by_length = []
    for size, rows in sorted(found.items()):
        lists = [sorted(x) for x in rows.values()]
        by_length.append((np.array(list(rows), np.int64), np.cumsum([0] + [len(x) for x in lists]), np.array([i for x in lists for i in x], np.int64)))
    return Phrases(vocabulary, by_length, [n for n, _ in items])


def search_shard(texts: list[str], phrases: Phrases) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Per text: its number of words, spans (start, end) of hit words, merged and in order, and the numbers of hit items."""
    cut = words.cut(texts, lower=True, alnum=True)
    first = cut.first
    none = [np.zeros((0, 2), np.int64)] * len(texts), [np.zeros(0, np.int64)] * len(texts)
    if not len(phrases.vocabulary) or not len(cut.hashes):
        return np.diff(first), *none
    place = np.minimum(np.searchsorted(phrases.vocabulary, cut.hashes), len(phrases.vocabulary) - 1)
    symbols = np.where(phrases.vocabulary[place] == cut.hashes, place + 1, 0)
    # A separator before each text; of separators in a row one stays.
    heads = first[:-1][np.diff(first) > 0]
    symbols = np.insert(symbols, heads, 0)
    word = np.insert(np.arange(len(cut.hashes)), heads, -1)
    stays = (symbols != 0) | np.concatenate([[True], symbols[:-1] != 0])
    symbols, word = symbols[stays], word[stays]
    index = FMIndex(symbols, len(phrases.vocabulary))
    starts, ends, items = [], [], []
    for rows, begin, owners in phrases.by_length:
        low, high = index.search(rows)
        many = np.maximum(high - low, 0)
        which = np.repeat(np.arange(len(rows)), many)
        at = word[index.locate(np.repeat(low, many) + np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many))]
        # One row per occurrence for the spans, one per occurrence and item for the items.
        starts.append(at)
        ends.append(at + rows.shape[1])
        per = np.diff(begin)[which]
        flat = np.repeat(begin[which], per) + np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
        pairs = np.unique(np.stack([np.repeat(np.searchsorted(first, at, "right") - 1, per), owners[flat]], 1), axis=0)
        items.append(pairs)
    start, end = np.concatenate(starts), np.concatenate(ends)
    by = np.argsort(start, kind="stable")
    start, end = start[by], end[by]
    text = np.searchsorted(first, start, "right") - 1
    reach = np.maximum.accumulate(end)  # spans never leave their text, so this holds across texts as well
    new = np.concatenate([[True], (start[1:] > reach[:-1]) | (text[1:] != text[:-1])]) if len(start) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    spans = np.stack([start[at], reach[np.append(at[1:], len(start)) - 1] if len(at) else reach[:0]], 1) - first[text[at]][:, None]
    pairs = np.unique(np.concatenate(items), axis=0)
    cuts = np.arange(1, len(texts))
    return np.diff(first), np.split(spans, np.searchsorted(text[at], cuts)), np.split(pairs[:, 1], np.searchsorted(pairs[:, 0], cuts))


def _merge(a: list, b: np.ndarray) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted([(x["start"], x["end"]) for x in a] + [tuple(x) for x in b.tolist()]):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def find_phrases(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` (with ``text``) with n_words, spans (array of (start, end) in words) and item_ids (distinct, as strings,
    sorted); ``items`` has item_id and text."""
    if clash := [c for c in ADDED if c in docs.columns]:
        raise ValueError(f"columns {clash} are made here")
    pieces = _pieces(items, window, block_words)
    total = pieces.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("ids")).first()
    blocks = max(total["n"] // block_words, total["ids"] // SENT_IDS) + 1
    if blocks > 1:
        pieces = materialize(pieces.withColumn("block", F.pmod(F.xxhash64("ids", "text"), F.lit(blocks))), "phrases")
    out = docs.withColumns({
        "n_words": F.lit(0).cast("long"), "spans": F.array().cast("array<struct<start:bigint,end:bigint>>"), "item_ids": F.array().cast("array<string>"),
    })
    for k in range(blocks):
        block = pieces if blocks == 1 else pieces.filter(F.col("block") == k)
        rows = [(r["ids"], r["text"]) for r in block.select("ids", "text").collect()]  # about block_words words and SENT_IDS ids
        out = _pass(out, docs.sparkSession.sparkContext.broadcast(phrases_of(rows, window)))
        if k % PASSES == PASSES - 1 and k + 1 < blocks:
            out = materialize(out, "found")
    return out


def _pieces(items: DataFrame, window: int, block_words: int) -> DataFrame:
    """(ids, text, n): each distinct text of ``items``, or its pieces, with its number of words and the ids of the items that have
    it; more than about ``SENT_IDS`` ids are dealt to several rows."""
    sized = items.filter("text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    parts = sized.count() // SENT_IDS + 1
    part = F.pmod(F.xxhash64("item_id"), F.lit(parts))
    texts = sized.groupBy(F.sha2("text", 256).alias("digest"), part.alias("part")).agg(F.first("text").alias("text"), F.sort_array(F.collect_set("item_id")).alias("ids"))
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut = texts.withColumn("words", F.filter(F.split(lower, _BETWEEN), lambda w: w != "")).withColumn("n", F.size("words"))
    most = max(block_words // 8, 2 * window)
    step = most - window + 1
    some = F.transform(F.sequence(F.lit(0), F.col("n") - window, F.lit(step)), lambda i: F.array_join(F.slice("words", i + 1, most), " "))
    long = cut.withColumn("text", F.explode(F.when(F.col("n") > most, some).otherwise(F.array("text"))))
    return long.filter("n > 0").select("ids", "text", F.least("n", F.lit(most)).cast("long").alias("n"))


def _pass(docs: DataFrame, sent) -> DataFrame:
    at = docs.columns.index("text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = sent.value
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            for a, b in words.chunks(texts, SHARD_WORDS * 6):
                part = batch.slice(a, b - a)
                n_words, spans, items = search_shard(texts[a:b], phrases)
                were = [part.column(part.schema.get_field_index(c)).to_pylist() for c in ("spans", "item_ids")]
                merged = [_merge(w, s) if len(w) or len(s) else [] for w, s in zip(were[0], spans)]
                named = [sorted({*w, *(n for i in x for n in phrases.names[i])}) if len(w) or len(x) else [] for w, x in zip(were[1], items)]
                made = {
                    "n_words": pa.array(n_words, pa.int64()),
                    "spans": pa.array([[{"start": s, "end": e} for s, e in m] for m in merged], part.schema.field("spans").type),
                    "item_ids": pa.array(named, part.schema.field("item_ids").type),
                }
                yield pa.RecordBatch.from_arrays([made.get(f.name, part.column(i)) for i, f in enumerate(part.schema)], schema=part.schema)

    return docs.mapInArrow(released(scan), docs.schema)


def hit_counts(found: DataFrame) -> list:
    """Columns over ``find_phrases``: n_hit, n_items, items_sha256 and contaminated."""
    hits = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return [
        hits.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (hits > 0).alias("contaminated"),
    ]


def cut_text(text: str | None, spans: list | None) -> str | None:
    """``text`` without the words of ``spans``: each goes with what stands between it and the next word kept."""
    if not text or not spans:
        return text
    found = words.cut([text], lower=True, alnum=True)
    out, at = [], 0
    for s in spans:
        out.append(found.data[at : found.start[s["start"]]])
        at = found.start[s["end"]] if s["end"] < len(found.start) else len(found.data)
    return b"".join([*out, found.data[at:]]).decode()


def remove_phrases(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with hit words cut from ``text``, same columns; a document with nothing left keeps what stands between words."""
    cut = F.udf(lambda text, spans: cut_text(text, spans), "string", useArrow=True)
    found = find_phrases(docs, items, window)
    return found.withColumn("text", F.when(F.size("spans") > 0, cut("text", "spans")).otherwise(F.col("text"))).select(*docs.columns)
