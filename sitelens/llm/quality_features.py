"""Hashed n-gram features of whole texts, computed per Arrow batch.

A text's features are the relative frequencies of its hashed n-grams, one
block of buckets per kind: lower-case words, pairs of words, and runs of three
characters (code points of the text as it is).  A linear score is then the
mean of the n-grams' weights, kind by kind, and needs no sparse vector.
"""

from __future__ import annotations

import numpy as np

from .textbatch import SPACE, U64, split_words

KINDS = ("word", "pair", "char")


def ngrams(texts: list[bytes], bits: int, kinds: tuple[str, ...] = KINDS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per kind: bucket of every n-gram, and text of every n-gram (ascending)."""
    out, shift = [], U64(64 - bits)
    if "word" in kinds or "pair" in kinds:
        w = split_words(texts, SPACE, lower=True)
        if "word" in kinds:
            out.append(((w.hash >> shift).astype(np.int32), w.text))
        if "pair" in kinds:
            same = w.text[1:] == w.text[:-1]
            pair = (w.hash[:-1] * U64(0x9E3779B97F4A7C15) ^ w.hash[1:])[same] * U64(0xD6E8FEB86659FD93)
            out.append(((pair >> shift).astype(np.int32), w.text[1:][same]))
    if "char" in kinds:
        points = np.frombuffer("".join(t.decode("utf-8", "replace") + "\n" for t in texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        lengths = np.fromiter((len(t.decode("utf-8", "replace")) + 1 for t in texts), dtype=np.int64, count=len(texts))
        owner = np.repeat(np.arange(len(texts)), lengths)
        h = (points[:-2] * np.uint32(0x9E3779B1) + points[1:-1] * np.uint32(0x85EBCA77)) ^ (points[2:] * np.uint32(0xC2B2AE3D))
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        inside = owner[:-2] == owner[2:]
        out.append(((h >> np.uint32(32 - bits)).astype(np.int32)[inside], owner[:-2][inside]))
    return out


def mean_by_text(values: np.ndarray, owner: np.ndarray, n_texts: int) -> np.ndarray:
    """Mean of the values of each text, 0 for a text without any."""
    count = np.bincount(owner, minlength=n_texts)
    return np.bincount(owner, weights=values, minlength=n_texts) / np.maximum(count, 1)


def frequencies(texts: list[bytes], bits: int, kinds: tuple[str, ...] = KINDS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text: sorted feature numbers (kind block and bucket) and relative frequencies."""
    parts = []
    for k, (bucket, owner) in enumerate(ngrams(texts, bits, kinds)):
        key, n = np.unique(owner.astype(np.int64) << 32 | bucket.astype(np.int64) + (k << bits), return_counts=True)
        total = np.maximum(np.bincount(owner, minlength=len(texts)), 1)
        text = key >> 32
        parts.append((text, (key & 0xFFFFFFFF).astype(np.int32), (n / total[text]).astype(np.float32)))
    text, feature, value = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.argsort(text, kind="stable")
    text, feature, value = text[order], feature[order], value[order]
    cuts = np.searchsorted(text, np.arange(len(texts) + 1))
    return [(feature[a:b], value[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
