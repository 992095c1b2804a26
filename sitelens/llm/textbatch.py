"""Vectorised word splitting and hashing of whole texts inside Arrow batches.

Texts of a batch are joined to one byte buffer.  Word boundaries come from a
256-entry table of separator bytes, word hashes from prefix sums of a
polynomial over the bytes, so no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

U64 = np.uint64
CHUNK_BYTES = 500_000


def _table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**64 - 1, 256, dtype=U64) | U64(1)


BYTE_VALUE = _table(20240229)
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 2**64)

#: ASCII white space: space and \x09-\x0D.
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: Everything in ASCII but digits and letters.
NON_WORD = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
#: A-Z to a-z, all other bytes as they are.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


@lru_cache(2)
def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, dtype=U64)
    p[0] = 1
    return np.multiply.accumulate(p)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche (public-domain splitmix64 constants)."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


@dataclass
class Words:
    buf: np.ndarray        # bytes of all texts, each followed by a line feed
    text_start: np.ndarray  # first byte of each text, and the end
    start: np.ndarray      # first byte of each word
    end: np.ndarray
    text: np.ndarray       # text of each word
    first: np.ndarray      # first word of each text, and the end
    hash: np.ndarray


def split_words(texts: list[bytes], sep: np.ndarray, lower: bool) -> Words:
    buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    if lower:
        buf = LOWER[buf]
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    text_start = np.concatenate(([0], np.cumsum(lengths)))
    gap = sep[buf]
    edge = np.flatnonzero(np.diff(gap, prepend=True))  # every word has a start and, as a separator ends the buffer, an end
    start, end = edge[0::2], edge[1::2]
    n = 1 << max(12, int(len(buf)).bit_length())
    total = np.concatenate((np.zeros(1, U64), np.cumsum(BYTE_VALUE[buf] * _powers(BASE, n)[: len(buf)], dtype=U64)))
    h = mix((total[end] - total[start]) * _powers(BASE_INV, n)[start])
    text = np.searchsorted(text_start, start, side="right") - 1
    return Words(buf, text_start, start, end, text, np.searchsorted(text, np.arange(len(texts) + 1)), h)


def word_hash(word: str) -> np.uint64:
    return split_words([word.encode()], SPACE, False).hash[0]


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``limit`` bytes; memory depends on the longest text, not on the batch."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > limit:
            yield at, i
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


def utf8(column) -> list[bytes]:
    """Arrow string column to UTF-8 bytes; null counts as the empty text."""
    return [b"" if t is None else t for t in column.cast("binary").to_pylist()]
