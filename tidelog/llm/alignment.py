"""Two tokenizers' tokens of the same text, aligned by the bytes they cover.

Tokenizer A (byte-level BPE) encodes a space and the text, tokenizer B (pieces, which adds the space itself) the text; both
cover the same bytes. Where a token of A and one of B end at the same byte, a group ends.

Diagonal run skipping: both end arrays grow, and at the current shift of their indexes long stretches are equal, one token to
one. From each place the stretch is probed exponentially (1, 2, 4, ... ends compared at once), and its end found by halving.
The irregular group behind it is resolved locally: the side that is behind takes tokens until both end at the same byte; then
the shift is updated and probing goes on.

Tokens of a text are put together from those of its segments, cut before a single space between two other characters: neither
tokenizer has a token over such a place (checked for B's vocabulary when it is loaded), so it ends a group, and a worker encodes
and aligns each distinct segment once, all new ones of a batch in one run. Ids and groups are those of whole texts.

Corpus-wide counts: documents are dealt into chunks of bounded text as they are read; a chunk's row holds its distinct id pairs
with the number of its documents that hold them, a document's row its distinct pairs and how often they occur. Pairs are
summed over chunks, the highest count of each A id is joined to them, and each chunk gets back only its own pairs. Neither
pairs of single documents nor the table of all pairs pass through a shuffle row by row or through the driver.

Edge cases: texts that are null, empty, or whose joined tokens of A or B are not the space and the text (as where a text
already holds the piece marker U+2581) have no tokens: zeros and an empty digest. Strings of special tokens are plain text.
Repeated rows and ids each count as a document; null ids are kept. Other columns are left out, so their names do not matter. An
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.memory import release
from tidelog.llm.tokens import tokenizer_path
from tidelog.session import materialize

TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
# Characters of the documents of a chunk (one document at least).
CHUNK_CHARS = 4_000_000
# Segments, and characters of them, that a worker keeps: a fuller store is emptied and filled anew.
CACHED_SEGMENTS, CACHED_CHARS = 400_000, 16_000_000
# Segments encoded in one call.
LINE_SEGMENTS = 500

_CUT = re.compile(r"(?<=\S)(?=\x20\S)")
# Segments that may stand next to each other in one call: both edges are such places.
_PLAIN = re.compile(r"\x20\S(?s:.*\S)?\Z")
_MARK = "▁"


def byte_of_sign() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printable bytes stand for themselves, the others are
    numbered from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(rest)}


def align(ends_a: np.ndarray, ends_b: np.ndarray) -> list[tuple[int, int, int]]:
    """Stretches and groups that cover both arrays of ends (int32, strictly growing, with the same last end).

    (i, j, n) with n > 0: from A's token i and B's token j on, n groups of one token each; (i, j, -1): one irregular group,
    which lasts to the next entry's places.
    """
    raw_a, raw_b = ends_a.astype(np.int32).tobytes(), ends_b.astype(np.int32).tobytes()
    list_a, list_b = ends_a.tolist(), ends_b.tolist()
    size_a, size_b = len(list_a), len(list_b)
    made, i, j = [], 0, 0
    while i < size_a:
        # One to one at this shift: probe 1, 2, 4, ... ends, then halve back to the first difference.
        most, n, step = min(size_a - i, size_b - j), 0, 1
        while n < most:
            step = min(step, most - n)
            a, b = 4 * (i + n), 4 * (j + n)
            if raw_a[a : a + 4 * step] == raw_b[b : b + 4 * step]:
                n += step
                step *= 2
            elif step == 1:
                break
            else:
                step //= 2
                while step >= 1:
                    a, b = 4 * (i + n), 4 * (j + n)
                    if raw_a[a : a + 4 * step] == raw_b[b : b + 4 * step]:
                        n += step
                    step //= 2
                break
        if n:
            made.append((i, j, n))
            i, j = i + n, j + n
            if i == size_a:
                break
        made.append((i, j, -1))
        end_a, end_b = list_a[i], list_b[j]
        while end_a != end_b:
            if end_a < end_b:
                i += 1
                end_a = list_a[i]
            else:
                j += 1
                end_b = list_b[j]
        i, j = i + 1, j + 1
    return made


@dataclass
class Aligned:
    """A text's tokens: how many of A and B, the code a * size_b + b of every link in order, and its groups as text."""

    n_a: int
    n_b: int
    n_groups: int
    codes: np.ndarray
    groups: str


class Pair:
    """Both tokenizers, with the aligned tokens of segments met; one per worker process and pair of files."""

    _made: dict[tuple[str, str], Pair] = {}

    @classmethod
    def of(cls, path_a: str, path_b: str) -> Pair:
        if (path_a, path_b) not in cls._made:
            cls._made[path_a, path_b] = cls(path_a, path_b)
        return cls._made[path_a, path_b]

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte = byte_of_sign()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for piece, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(byte[c] for c in piece) if all(c in byte for c in piece) else piece.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_MARK, " ").encode() for i, p in enumerate(pieces)]
        self.sizes_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.sizes_b = np.array([len(x) for x in self.bytes_b], np.int64)
        self.mark = self.b.piece_to_id(_MARK)
        # Segments are independent where no piece of B goes on past a marker.
        self.by_segment = not any(_MARK in p.lstrip(_MARK) for p in pieces)
        self.names_a, self.names_b = [str(i) for i in range(len(self.bytes_a))], [str(i) for i in range(len(pieces))]
        self.size_b = len(pieces)
        self._empty()

    def _empty(self) -> None:
        """An empty store: a segment's number, by number its group text and counts, and where its link codes lie."""
        self.known: dict[str, int] = {}
        self.chars = 0
        self.groups: list[str] = []
        self.counts = np.zeros((4, 0), np.int64)  # tokens of A, of B, groups, first link code
        self.codes = np.zeros(0, np.int64)

    def _ids(self, line: list[str]) -> tuple[list[int], list[int], np.ndarray, np.ndarray] | None:
        """Ids of segments in a row by A and B, and by segment the places after its tokens; None where the joined tokens are
        not the segments."""
        text = "".join(line)
        ids_a = self.a.encode(text, add_special_tokens=False).ids
        ids_b = self.b.encode(text[1:], num_threads=1) or [self.mark]
        whole = text.encode("utf-8", "surrogatepass")
        if b"".join([self.bytes_a[i] for i in ids_a]) != whole or b"".join([self.bytes_b[i] for i in ids_b]) != whole:
            return None
        ends = np.cumsum([len(s.encode("utf-8", "surrogatepass")) for s in line])
        places = []
        for ids, sizes in ((ids_a, self.sizes_a), (ids_b, self.sizes_b)):
            token_ends = np.cumsum(sizes[ids])
            place = np.searchsorted(token_ends, ends)
            if (token_ends[place] != ends).any():
                return None
            places.append(place + 1)
        return ids_a, ids_b, *places

    def _learn(self, segments: list[str], keep: bool = True) -> None:
        """Aligns segments that are not in the store and adds them; number -1 marks those without tokens."""
        plain = [s for s in segments if _PLAIN.match(s)]
        lines = [plain[i : i + LINE_SEGMENTS] for i in range(0, len(plain), LINE_SEGMENTS)]
        lines += [[s] for s in segments if not _PLAIN.match(s)]
        flat_a: list[int] = []
        flat_b: list[int] = []
        after_a, after_b, order = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], []
        while lines:
            line = lines.pop()
            found = self._ids(line)
            if found is None:
                if len(line) > 1:
                    lines += [[s] for s in line]
                else:
                    self.known[line[0]] = -1
                continue
            after_a.append(found[2] + len(flat_a))
            after_b.append(found[3] + len(flat_b))
            flat_a += found[0]
            flat_b += found[1]
            order += line
        if not order:
            return
        # Segments end in both token rows, so one pass over all of them aligns each.
        ids_a, ids_b = np.array(flat_a, np.int64), np.array(flat_b, np.int64)
        groups, links = self._groups(flat_a, flat_b, np.cumsum(self.sizes_a[ids_a]), np.cumsum(self.sizes_b[ids_b]))
        after_a, after_b = np.concatenate(after_a), np.concatenate(after_b)
        group_a = np.array([i for _, i, _ in groups], np.int64)  # places in A after each group
        after_group, after_link = np.searchsorted(group_a, after_a[1:]) + 1, np.array([n for _, _, n in groups], np.int64)
        texts = [g for g, _, _ in groups]
        first = len(self.groups)
        begin = 0
        for end in after_group.tolist():
            self.groups.append(";".join(texts[begin:end]))
            begin = end
        self.known.update(zip(order, range(first, first + len(order))))
        self.chars += sum(map(len, order))
        last_link = after_link[after_group - 1]
        first_link = len(self.codes) + np.concatenate([[0], last_link[:-1]])
        rows = np.stack([np.diff(after_a), np.diff(after_b), np.diff(after_group, prepend=0), first_link])
        self.counts = np.concatenate([self.counts, rows], axis=1)
        self.codes = np.concatenate([self.codes, ids_a[links[0]] * self.size_b + ids_b[links[1]]])

    def _groups(self, ids_a: list[int], ids_b: list[int], ends_a: np.ndarray, ends_b: np.ndarray):
        """(text, place in A after it, links up to its end) of each group, and the links as places in A and in B."""
        runs = align(ends_a, ends_b)
        runs.append((len(ids_a), len(ids_b), 0))
        list_a, list_b = ends_a.tolist(), ends_b.tolist()
        names_a, names_b = self.names_a, self.names_b
        groups: list[tuple[str, int, int]] = []
        link_a: list[int] = []
        link_b: list[int] = []
        for (i, j, n), (next_i, next_j, _) in zip(runs, runs[1:]):
            if n > 0:
                links = len(link_a)
                link_a += range(i, i + n)
                link_b += range(j, j + n)
                for k in range(n):
                    groups.append((f"{names_a[ids_a[i + k]]}|{names_b[ids_b[j + k]]}", i + k + 1, links + k + 1))
                continue
            text = f"{','.join([names_a[x] for x in ids_a[i:next_i]])}|{','.join([names_b[x] for x in ids_b[j:next_j]])}"
            # Inside a group no ends meet: the token that ends first gives way to its next one.
            while True:
                link_a.append(i)
                link_b.append(j)
                if list_a[i] < list_b[j]:
                    i += 1
                elif list_a[i] > list_b[j]:
                    j += 1
                else:
                    break
            groups.append((text, next_i, len(link_a)))
        return groups, (link_a, link_b)

    def align_texts(self, texts: list[str | None]) -> list[Aligned | None]:
        """The aligned tokens of each text; None for texts without tokens."""
        cut = [_CUT.split(" " + t) if self.by_segment else [" " + t] for t in map(lambda t: t or "", texts)]
        if len(self.known) > CACHED_SEGMENTS or self.chars > CACHED_CHARS:
            self._empty()
        self._learn(list({s for segments in cut for s in segments if s not in self.known}))
        known = self.known
        numbers = [[known[s] for s in segments] if t else [-1] for t, segments in zip(texts, cut)]
        for k, (t, found) in enumerate(zip(texts, numbers)):
            if t and len(found) > 1 and -1 in found:  # whether the whole text's tokens are its bytes is asked of the whole
                if " " + t not in known:
                    self._learn([" " + t])
                numbers[k] = [known[" " + t]]
        fine = [n for n in numbers if n[0] != -1]
        if not fine:
            return [None] * len(texts)
        sizes = np.array([len(n) for n in fine])
        flat = np.fromiter((k for n in fine for k in n), np.int64, sizes.sum())
        first = np.cumsum(sizes) - sizes
        n_a, n_b, n_groups = (np.add.reduceat(self.counts[k][flat], first).tolist() for k in range(3))
        links = self.counts[0][flat] + self.counts[1][flat] - self.counts[2][flat]  # a group of m and n tokens has m + n - 1
        after = np.cumsum(links)
        codes = self.codes[np.repeat(self.counts[3][flat] - (after - links), links) + np.arange(after[-1])]
        ends = after[first + sizes - 1]
        made = iter(
            Aligned(n_a[k], n_b[k], n_groups[k], c, ";".join([self.groups[x] for x in n]))
            for k, (n, c) in enumerate(zip(fine, np.split(codes, ends[:-1])))
        )
        return [next(made) if n[0] != -1 else None for n in numbers]


def packed(codes: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Growing codes (as differences) and their counts, both compressed."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    return squeeze(np.diff(codes, prepend=0).astype(np.int64).tobytes()), squeeze(counts.astype(np.uint32).tobytes())


def unpacked(codes: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    expand = zstandard.ZstdDecompressor().decompress
    return np.cumsum(np.frombuffer(expand(codes), np.int64)), np.frombuffer(expand(counts), np.uint32).astype(np.int64)


_COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
_STORED = ["doc_id", "chunk", *_COUNTS, "groups_sha256", "pairs", "times"]


def _tokens(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row per document with its distinct pairs and how often each occurs; after each chunk a row (``n_a`` null) with the
    distinct pairs of its documents and how many of them hold each. Both are packed bytes."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def each(batches):
        from pyspark import TaskContext

        pair, part, chunk = Pair.of(path_a, path_b), TaskContext.get().partitionId(), 0
        rows: list[tuple] = []
        held: list[np.ndarray] = []
        chars = 0
        schema = None
        nothing = packed(np.zeros(0, np.int64), np.zeros(0, np.int64))

        def flush():
            nonlocal rows, held, chunk, chars
            codes, counts = np.unique(np.concatenate(held or [np.zeros(0, np.int64)]), return_counts=True)
            rows.append((None, (part << 32) | chunk, None, None, None, None, None, *packed(codes, counts)))
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
            rows, held, chunk, chars = [], [], chunk + 1, 0
            return out

        for batch in batches:
            if schema is None:
                types = [batch.schema[0].type, pa.int64(), *[pa.int64()] * 4, pa.string(), pa.binary(), pa.binary()]
                schema = pa.schema(list(zip(_STORED, types)))
            sizes = [n or 0 for n in pc.utf8_length(batch.column(1)).to_pylist()]
            at = 0
            while at < batch.num_rows:
                end, size = at, 0
                while end < batch.num_rows and (end == at or size + sizes[end] <= CHUNK_CHARS // 8):
                    size += sizes[end]
                    end += 1
                ids = batch.column(0).slice(at, end - at).to_pylist()
                for doc, found in zip(ids, pair.align_texts(batch.column(1).slice(at, end - at).to_pylist())):
                    number = (part << 32) | chunk
                    if found is None:
                        rows.append((doc, number, 0, 0, 0, 0, "", *nothing))
                        continue
                    distinct, times = np.unique(found.codes, return_counts=True)
                    held.append(distinct)
                    digest = hashlib.sha256(found.groups.encode()).hexdigest()
                    rows.append((doc, number, found.n_a, found.n_b, found.n_groups, len(found.codes), digest, *packed(distinct, times)))
                chars += size
                at = end
                if chars >= CHUNK_CHARS:
                    yield flush()
                    release()
        if rows:
            yield flush()
        release()

    counts = ", ".join(f"{c} bigint" for c in _COUNTS)
    return docs.mapInArrow(each, f"doc_id {kind}, chunk bigint, {counts}, groups_sha256 string, pairs binary, times binary")


def align_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", file_a: str = TOKENIZER_A, file_b: str = TOKENIZER_B) -> DataFrame:
    """A row per document: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose count is the highest of their A id),
    count_sum (over links), groups_sha256. A pair's count is the number of documents that hold it linked."""
    path_a, path_b = tokenizer_path(file_a), tokenizer_path(file_b)
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    stored = materialize(_tokens(rows, path_a, path_b), "token-links")
    size_b = _size_of(path_b)

    def unpack(batches):
        for batch in batches:
            for chunk, pairs, times in zip(*(batch.column(c).to_pylist() for c in ("chunk", "pairs", "times"))):
                codes, n = unpacked(pairs, times)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), chunk)), pa.array(codes), pa.array(n)], names=["chunk", "pair", "n"])

    held = stored.filter("n_a is null").select("chunk", "pairs", "times").mapInArrow(unpack, "chunk bigint, pair bigint, n bigint")
    counts = held.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("a", F.expr(f"pair div {size_b}"))
    best = counts.groupBy("a").agg(F.max("count").alias("most"))
    known = materialize(counts.join(best, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best")), "pair-counts")
    asked = held.select("chunk", "pair").join(known, "pair")

    kind = stored.schema["doc_id"].dataType.simpleString()
    shown = ["doc_id", *_COUNTS, "n_best", "count_sum", "groups_sha256"]

    def sums(left: pa.Table, right: pa.Table) -> pa.Table:
        pairs = right["pair"].to_numpy()
        order = np.argsort(pairs)
        pairs, count, top = pairs[order], right["count"].to_numpy()[order], right["best"].to_numpy().astype(np.int64)[order]
        n_best, count_sum = [], []
        for codes, times in zip(left["pairs"].to_pylist(), left["times"].to_pylist()):
            own, n = unpacked(codes, times)
            place = np.searchsorted(pairs, own)
            n_best.append(int((top[place] * n).sum()))
            count_sum.append(int((count[place] * n).sum()))
        made = left.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))
        return made.select(shown)

    texts = stored.filter("n_a is not null")
    both = texts.groupBy("chunk").cogroup(asked.groupBy("chunk"))
    numbers = ", ".join(f"{c} bigint" for c in [*_COUNTS, "n_best", "count_sum"])
    return both.applyInArrow(sums, f"doc_id {kind}, {numbers}, groups_sha256 string")


def _size_of(path_b: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
