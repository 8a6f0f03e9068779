"""Words of whole texts as 64-bit hashes, cut and hashed on arrays of bytes.

A word's hash is a polynomial over its UTF-8 bytes with random byte values, modulo 2**64, then mixed; runs of words are
hashed the same way over the words' hashes. Long sequences can be built to collide under such a polynomial whatever its base
(from about a thousand members on), so words of more than ``LONG`` bytes are hashed by BLAKE2b; runs are short. Everything is
the same in every process.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

# Bytes hashed at once: bounds the arrays of a chunk (about 60 bytes for each) and the powers that a worker keeps (32 for each).
CHUNK_BYTES = 300_000
# Bytes up to which a word's hash is the polynomial.
LONG = 128
_BASE = 0x9E3779B97F4A7C15 | 1
_RUN_BASE = 0xC2B2AE3D27D4EB4F | 1
_VALUES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_WORD_SPACE = np.ones(256, bool)
_WORD_SPACE[[9, 10, 11, 12, 13, 32]] = False
# Letters, digits and everything past ASCII, once A-Z are in lower case.
_WORD_ALNUM = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd ``base`` and of its inverse, modulo 2**64."""
    if base not in _powers or len(_powers[base][0]) < n:
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(max(n, CHUNK_BYTES + 1024), b, np.uint64)
            p[0] = 1
            made.append(np.cumprod(p, dtype=np.uint64))
        _powers[base] = (made[0], made[1])
    return _powers[base][0][:n], _powers[base][1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """The words of some texts, end to end: ``hashes``, where each text's words begin (``first``, one more than texts), and
    the bytes of word ``i``: ``data[start[i]:end[i]]``."""

    hashes: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: bytes


def cut(texts: list[str], lower: bool = False, alnum: bool = False) -> Words:
    """Words between white space (or, with ``alnum``, runs of letters, digits and non-ASCII); ``lower`` folds A-Z."""
    encoded = [t.encode() for t in texts]
    data = b" ".join(encoded)
    octets = np.frombuffer(data, np.uint8)
    inside = (_WORD_ALNUM if alnum else _WORD_SPACE)[octets]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    start, end = edges[::2], edges[1::2]
    values = _VALUES
    if lower:
        values = values.copy()
        values[65:91] = values[97:123]
    up, down = powers(_BASE, len(octets) + 1)
    total = np.zeros(len(octets) + 1, np.uint64)
    np.cumsum(values[octets] * up[:-1], out=total[1:])
    hashes = mix((total[end] - total[start]) * down[start])
    for i in np.flatnonzero(end - start > LONG).tolist():
        word = data[start[i] : end[i]]
        hashes[i] = int.from_bytes(hashlib.blake2b(word.lower() if lower else word, digest_size=8).digest(), "little")
    text_ends = np.cumsum([len(e) + 1 for e in encoded])
    return Words(hashes, np.concatenate([[0], np.searchsorted(start, text_ends)]), start, end, data)


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of ``n`` words (also those across the ends of texts: the caller leaves them out)."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    up, down = powers(_RUN_BASE, len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[:-1], out=total[1:])
    return mix((total[n:] - total[:-n]) * down[: len(hashes) - n + 1] + np.uint64(n))


def chunks(texts: list[str], size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of at most ``size`` characters (one text at least)."""
    at = 0
    while at < len(texts):
        end, chars = at, 0
        while end < len(texts) and (end == at or chars + len(texts[end]) <= size):
            chars += len(texts[end])
            end += 1
        yield at, end
        at = end
