"""Token ids of whole texts by the ``tokenizers`` library, with each distinct piece encoded once.

A byte-level BPE first cuts a text into pieces (a run of letters, digits or other signs with at most one
space before it, or white space) and encodes every piece by itself. Pieces repeat, so a batch of texts is
cut at once on arrays of characters, equal pieces are found by two 64-bit hashes (of long pieces by a digest, as
long ones can be built to collide under both), and only pieces that the worker has not met yet reach the tokenizer. Texts with an apostrophe (contractions) or characters past
Latin Extended-B go to the tokenizer whole, and so do texts with the content of a token added to the
tokenizer, which is one id wherever it stands. Both ways give the ids of ``Tokenizer.encode``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd

TOKENIZER_FILE = "byte_bpe_50k.json"
# Pieces a worker keeps (about 45 bytes each); a full store is emptied and filled anew.
CACHED_PIECES = 600_000
# Characters cut at once: bounds the arrays of a batch.
BATCH_CHARS = 500_000
# Characters up to which a piece's hashes are polynomials.
LONG_PIECE = 64

_SEPARATOR = "￿"
_LETTER, _NUMBER, _OTHER, _SPACE, _WHITE, _END, _HARD = range(7)


def tokenizer_path(name: str = TOKENIZER_FILE) -> str:
    """The place of a public tokenizer file; a full path stays as it is."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _kinds() -> np.ndarray:
    import unicodedata

    kinds = np.full(0x10000, _HARD, np.uint8)
    for c in range(0x250):
        category = unicodedata.category(chr(c))[0]
        kinds[c] = _LETTER if category == "L" else _NUMBER if category == "N" else _OTHER
    for c in (9, 10, 11, 12, 13, 0x85, 0xA0):
        kinds[c] = _WHITE
    kinds[32] = _SPACE
    kinds[ord("'")] = _HARD
    kinds[0xFFFF] = _END
    return kinds


def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    up = np.full(n, base, np.uint64)
    up[0] = 1
    down = np.full(n, pow(base, -1, 1 << 64), np.uint64)
    down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


class Encoder:
    """Encodes batches of texts; one per worker process and tokenizer file."""

    _made: dict[tuple[str, bool], Encoder] = {}

    @classmethod
    def of(cls, path: str, literal: bool = False) -> Encoder:
        if (path, literal) not in cls._made:
            cls._made[path, literal] = cls(path, literal)
        return cls._made[path, literal]

    def __init__(self, path: str, literal: bool = False):
        """With ``literal``, special tokens are not looked for in texts: what users write stays text."""
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = literal
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.kinds = _kinds()
        random = np.random.default_rng(20240101)
        self.tables = [random.integers(0, 1 << 63, 0x10000, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2)]
        self.bases = [0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93]
        self.powers: list[tuple[np.ndarray, np.ndarray]] = []
        self._empty()

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids (uint32) of each text, in order."""
        return list(self.encode_each(texts))

    def encode_each(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The same one by one: a task holds the ids of no more than one batch of characters."""
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) < BATCH_CHARS):
                size += len(texts[end])
                end += 1
            yield from self._encode(texts[at:end])
            at = end

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _has_added(self, text: str) -> bool:
        return any(content in text for content in self.added)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        joined = _SEPARATOR.join(texts) + _SEPARATOR
        if self._has_added(joined) and any(whole := [self._has_added(t) for t in texts]):
            some = iter(self._encode([t for t, w in zip(texts, whole) if not w]) if not all(whole) else [])
            return [self._whole(t) if w else next(some) for t, w in zip(texts, whole)]
        chars = np.frombuffer(joined.encode("utf-16-le", "surrogatepass"), np.uint16)
        kinds = self.kinds[chars]
        hard = np.flatnonzero(kinds == _HARD)
        ends = np.flatnonzero(kinds == _END)
        if len(hard) or len(ends) != len(texts):
            if len(ends) != len(texts):  # the separator itself occurs in a text
                easy = [not any(ord(c) >= 0x250 or c == "'" for c in t) for t in texts]
            else:
                easy = np.ones(len(texts), bool)
                easy[np.searchsorted(ends, hard)] = False
            some = iter(self._encode([t for t, e in zip(texts, easy) if e]) if any(easy) else [])
            return [next(some) if e else self._whole(t) for t, e in zip(texts, easy)]
        first = self._starts(kinds)
        last = np.append(first[1:], len(chars))
        code = self._codes(joined, chars, first, last)
        if code is None:
            return [self._whole(t) for t in texts]
        which, place = code
        # The separator's piece has no ids; the ids of a text are those of the pieces up to its separator.
        begin, sizes = self.begin[place][which], self.length[place][which]
        after = np.cumsum(sizes)
        flat = self.flat[np.repeat(begin - (after - sizes), sizes) + np.arange(after[-1])]
        return np.split(flat, after[np.searchsorted(first, ends)])[:-1]

    @staticmethod
    def _starts(kinds: np.ndarray) -> np.ndarray:
        """Where pieces start."""
        before = np.empty_like(kinds)
        before[0] = _END
        before[1:] = kinds[:-1]
        after = np.empty_like(kinds)
        after[-1] = _END
        after[:-1] = kinds[1:]
        white = (kinds == _SPACE) | (kinds == _WHITE)
        body = kinds <= _OTHER
        starts = body & (before != kinds) & (before != _SPACE)
        starts |= kinds == _END
        # White space: a run is one piece, but its last character goes to the word after it (a space) or stands alone.
        was_white = (before == _SPACE) | (before == _WHITE)
        starts |= white & (~was_white | (after <= _OTHER))
        return np.flatnonzero(starts)

    def _codes(self, joined: str, chars: np.ndarray, first: np.ndarray, last: np.ndarray):
        """For each piece the number of its distinct piece, and the place of each distinct piece in the store."""
        hashes = []
        for k in range(2):
            if len(self.powers) <= k or len(self.powers[k][0]) <= len(chars):
                made = _powers(max(len(chars) + 1, BATCH_CHARS + 4096), self.bases[k])
                self.powers[k:] = [made]
            up, down = self.powers[k]
            total = np.empty(len(chars) + 1, np.uint64)
            total[0] = 0
            np.cumsum(self.tables[k][chars] * up[: len(chars)], out=total[1:])
            hashes.append((total[last] - total[first]) * down[first])
        for i in np.flatnonzero(last - first > LONG_PIECE).tolist():
            digest = hashlib.blake2b(chars[first[i] : last[i]].tobytes(), digest_size=16).digest()
            hashes[0][i], hashes[1][i] = np.frombuffer(digest, np.uint64)
        which, seen = pd.factorize(hashes[0])
        distinct = np.empty(len(seen), np.int64)
        distinct[which[::-1]] = np.arange(len(which) - 1, -1, -1)
        check = hashes[1][distinct]
        if (hashes[1] != check[which]).any():
            return None
        if len(self.keys) > CACHED_PIECES:
            self._empty()
        place = np.searchsorted(self.keys, seen)
        new = self.keys[np.minimum(place, len(self.keys) - 1)] != seen
        if new.any():
            some = np.flatnonzero(new)
            self._store(joined, seen[some], check[some], first[distinct[some]], last[distinct[some]])
            place = np.searchsorted(self.keys, seen)
        if (self.checks[place] != check).any():
            return None
        return which, place

    def _empty(self) -> None:
        """An empty store: hashes in order, and where the ids of each piece lie in one flat array."""
        self.keys = np.array([np.iinfo(np.uint64).max])
        self.checks = np.zeros(1, np.uint64)
        self.begin = np.zeros(1, np.int64)
        self.length = np.zeros(1, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _store(self, joined: str, keys: np.ndarray, checks: np.ndarray, first: np.ndarray, last: np.ndarray) -> None:
        pieces = [joined[a:b] for a, b in zip(first.tolist(), last.tolist())]
        # Pieces that begin with a space and a letter are cut out of a line of such pieces as they are, so that many
        # of them share a call; others are encoded one by one.
        alone = np.fromiter((len(p) < 2 or p[0] != " " or not p[1].isalpha() for p in pieces), bool, len(pieces))
        order = np.concatenate([np.flatnonzero(~alone), np.flatnonzero(alone)])
        shared = [pieces[i] for i in order[: len(pieces) - alone.sum()].tolist()]
        lines = [shared[i : i + 200] for i in range(0, len(shared), 200)]
        # Pieces of different texts do not make an added token together.
        lines = [part for line in lines for part in ([[p] for p in line] if self._has_added("".join(line)) else [line])]
        ids, counts = [], []
        for line, found in zip(lines, self.tokenizer.encode_batch(["".join(x) for x in lines], add_special_tokens=False)):
            ids.append(np.array(found.ids, np.uint32))
            counts.append(np.bincount(np.array(found.word_ids, np.int64), minlength=len(line)))
        rest = [pieces[i] for i in np.flatnonzero(alone).tolist()]
        for piece, found in zip(rest, self.tokenizer.encode_batch(rest, add_special_tokens=False)):
            ids.append(np.array(found.ids if piece != _SEPARATOR else [], np.uint32))
            counts.append(np.array([len(ids[-1])]))
        length = np.empty(len(pieces), np.int64)
        length[order] = np.concatenate(counts)
        begin = np.empty(len(pieces), np.int64)
        begin[order] = len(self.flat) + np.cumsum(length[order]) - length[order]
        self.flat = np.concatenate([self.flat, *ids])
        keys, checks, begin, length = (np.append(a, b) for a, b in ((self.keys, keys), (self.checks, checks), (self.begin, begin), (self.length, length)))
        by = np.argsort(keys, kind="stable")
        self.keys, self.checks, self.begin, self.length = keys[by], checks[by], begin[by], length[by]
