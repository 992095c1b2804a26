"""Token ids of whole texts by a public word-level BPE file, many words at a time.

Texts are normalised and split as the tokenizer file says; each distinct word
of a batch is encoded once, and the merges of all distinct words run side by
side as array operations (one merge per word and round).  Texts with characters
outside the plain Latin range, or with special tokens, go to the ``tokenizers``
library whole; both ways give the library's ids, which a test checks.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pandas as pd

#: Characters for which lower-casing, composition and white space are the same in every library.
PLAIN = re.compile("[^\t-\r -~¡-¬®-įı-ňŊ-ž‐-‧]")
#: The split pattern of the public tokenizer file, with the letters and numbers that lower-cased plain texts can hold.
LETTER, NUMBER = "a-zªµºß-öø-ž", "0-9²³¹¼-¾"
SPLIT = f"[{LETTER}]+|'s|'t|'re|'ve|'m|'ll|'d|[{NUMBER}]|[^\\s{LETTER}{NUMBER}]+"
END = "</w>"
NONE = np.int64(1) << 62


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(256 + rest.index(b)) for b in range(256)]


class WordBpe:
    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, letters = model["vocab"], byte_letters()
        self.inner = np.array([vocab[c] for c in letters], dtype=np.int64)
        self.last = np.array([vocab[c + END] for c in letters], dtype=np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        pair = np.array([vocab[a] << 16 | vocab[b] for a, b in merges], dtype=np.int64)
        self.pair, self.merged = pair, np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        # rank of a pair by two hash tables: the second has the pairs that lost their place in the first
        self.first, self.second = np.zeros(1 << 20, np.int32), np.zeros(1 << 18, np.int32)
        self.first[self._slot(pair, 20)[::-1]] = np.arange(len(pair))[::-1]
        lost = np.flatnonzero(self.first[self._slot(pair, 20)] != np.arange(len(pair)))
        self.second[self._slot(pair[lost], 18)] = lost
        self.slow = {int(pair[i]): int(i) for i in lost if self.second[self._slot(pair[i:i + 1], 18)][0] != i}
        self.split = re.compile(SPLIT)

    @staticmethod
    def _slot(pair: np.ndarray, bits: int) -> np.ndarray:
        return ((pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15 if bits == 20 else 0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - bits)).astype(np.int64)

    @property
    def library(self):
        from tokenizers import Tokenizer

        if not hasattr(self, "_library"):
            self._library = Tokenizer.from_file(self.path)
        return self._library

    def ranks(self, pair: np.ndarray) -> np.ndarray:
        """Rank of each pair, or -1."""
        r = self.first[self._slot(pair, 20)]
        miss = np.flatnonzero(self.pair[r] != pair)
        r[miss] = self.second[self._slot(pair[miss], 18)]
        miss = miss[self.pair[r[miss]] != pair[miss]]
        r[miss] = -1
        for lost, rank in self.slow.items():
            r[miss[pair[miss] == lost]] = rank
        return r

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and where each word's begin (and the end)."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        symbol = self.inner[flat]
        symbol[np.cumsum(lengths) - 1] = self.last[flat[np.cumsum(lengths) - 1]]
        owner = np.repeat(np.arange(len(words)), lengths)
        done_symbols, done_owners = [], []
        while len(symbol):
            inside = owner[1:] == owner[:-1]
            value = np.full(len(symbol), NONE)
            at = np.flatnonzero(inside)
            rank = self.ranks(symbol[at] << 16 | symbol[at + 1])
            some = rank >= 0
            value[at[some]] = rank[some].astype(np.int64) << 32 | at[some]
            starts = np.flatnonzero(np.concatenate(([True], ~inside)))
            best = np.minimum.reduceat(value, starts)  # lowest rank, then leftmost
            goes_on = best < NONE
            place = best[goes_on] & 0xFFFFFFFF
            symbol[place] = self.merged[best[goes_on] >> 32]
            keep = np.ones(len(symbol), dtype=bool)
            keep[place + 1] = False
            active = np.repeat(goes_on, np.diff(np.append(starts, len(symbol))))
            done_symbols.append(symbol[~active])
            done_owners.append(owner[~active])
            symbol, owner = symbol[active & keep], owner[active & keep]
        symbol, owner = np.concatenate([*done_symbols, symbol]), np.concatenate([*done_owners, owner])
        order = np.argsort(owner, kind="stable")
        return symbol[order].astype(np.uint16), np.searchsorted(owner[order], np.arange(len(words) + 1))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids (uint16) of each text."""
        plain = [PLAIN.search(t) is None and "<|" not in t for t in texts]
        out: list[np.ndarray] = [np.array(self.library.encode(t, add_special_tokens=False).ids, dtype=np.uint16) if not p else None
                                 for t, p in zip(texts, plain)]
        split = [self.split.findall(t.lower()) if p else [] for t, p in zip(texts, plain)]
        code, distinct = pd.factorize(np.array([w for words in split for w in words], dtype=object))
        if len(code):
            ids, starts = self.encode_words([w.encode() for w in distinct])
            n = np.diff(starts)[code]
            ends = np.cumsum(n)
            flat = ids[np.repeat(starts[code] - (ends - n), n) + np.arange(ends[-1])]
            text_ends = np.concatenate(([0], ends))[np.cumsum([len(words) for words in split])]
        else:
            flat, text_ends = np.empty(0, np.uint16), np.zeros(len(texts), np.int64)
        begin = 0
        for i, end in enumerate(text_ends):
            if out[i] is None:
                out[i] = flat[begin:end]
            begin = end
        return out


@lru_cache(1)
def tokenizer(path: str) -> WordBpe:
    return WordBpe(path)
