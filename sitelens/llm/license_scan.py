"""License scans as an exact set-similarity join of text blocks with templates.

A block is a line, or a run of words over consecutive lines (none of them blank)
that is as wide as the template and ``SLACK`` words, so hard-wrapped notices are
found; such a run counts where no line of it meets the template by itself.
Blocks and templates are sets of words.  A block meets a
template when it contains at least ``threshold`` of the template's words:
|block & template| >= need = ceil(threshold * |template|).  Words are put in one
global order, rarest first by the number of blocks in the whole corpus that
hold them.  Then three exact filters leave few pairs to verify:

* prefix: any need-subset of a template meets its first |template| - need + 1
  words, so a block without one of these is out;
* length: a block with fewer than ``need`` words of the templates' vocabulary
  is out (other words cannot add to an overlap);
* position: the words left after the first shared one bound the overlap.

Templates and their vocabulary are fixed and small, so their index is
broadcast; the frequency pass returns one number per vocabulary word and task.
Fixed phrases are looked up as runs of consecutive words beside that.

Defined results: null text counts as empty; a text without finds has no spans
and score 0; rows that share a doc_id are scanned one by one; several templates
may meet one block; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .textbatch import NON_WORD, Words, chunks, split_words, utf8

THRESHOLD = 0.9
#: Words that a run may hold beside a template's: marks of comments at the start of lines.
SLACK = 4

#: Phrase and label.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Label and notice, in the usual public wordings.
TEMPLATES = [
    ("all-rights-reserved", "all rights reserved"),
    ("apache", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "gnu lesser general public license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("public-domain", "released into the public domain"),
]

SPAN = "array<struct<label:string,kind:string,first:long,last:long,containment:double>>"


class Vocabulary:
    """The templates' words: hash and number."""

    def __init__(self, templates):
        self.words = sorted({w for _, t in templates for w in t.split()})
        hashes = split_words([" ".join(self.words).encode()], NON_WORD, True).hash
        self.order = np.argsort(hashes)
        self.hash = hashes[self.order]

    def codes(self, w: Words) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hash, w.hash), len(self.hash) - 1)
        return np.where(self.hash[at] == w.hash, self.order[at], -1)


def _block_words(w: Words, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (block, vocabulary word) pairs; blocks are numbered through the batch."""
    known = np.flatnonzero(code >= 0)
    block = np.cumsum(w.buf == 10)[w.start[known]]
    pair = np.unique(block.astype(np.int64) << 16 | code[known])
    return pair >> 16, pair & 0xFFFF


def word_frequencies(docs: DataFrame, vocabulary: Vocabulary) -> dict[str, int]:
    """Blocks that hold each word of the vocabulary, over all documents."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(vocabulary.words), dtype=np.int64)
        for batch in slices(batches):
            texts = utf8(batch.column("text"))
            for a, b in chunks(texts):
                w = split_words(texts[a:b], NON_WORD, lower=True)
                n += np.bincount(_block_words(w, vocabulary.codes(w))[1], minlength=len(n))
        yield pa.RecordBatch.from_pydict({"word": vocabulary.words, "n": n})

    found = docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r.word: r.n for r in found.collect()}


class TemplateIndex:
    """Templates as words in the global order, and the prefix words that lead to them."""

    def __init__(self, templates, vocabulary: Vocabulary, frequency: dict[str, int], threshold: float):
        ranked = sorted(range(len(vocabulary.words)), key=lambda c: (frequency.get(vocabulary.words[c], 0), vocabulary.words[c]))
        self.rank = np.empty(len(ranked), dtype=np.int64)
        self.rank[ranked] = np.arange(len(ranked))
        number = {w: int(self.rank[c]) for c, w in enumerate(vocabulary.words)}
        self.templates, self.prefix = [], defaultdict(list)
        for label, text in templates:
            words = sorted({number[w] for w in text.split()})
            need = math.ceil(threshold * len(words) - 1e-9)
            for i, word in enumerate(words[:len(words) - need + 1]):
                self.prefix[word].append((len(self.templates), i))
            self.templates.append((label, frozenset(words), need))
        self.width = [len(text.split()) + SLACK for _, text in templates]
        self.leads = np.isin(np.arange(len(ranked)), list(self.prefix))

    def matches(self, block: list[int]) -> Iterator[tuple[int, float]]:
        """Templates that the block (ascending ranks) meets, with their containment."""
        seen = set()
        for j, word in enumerate(block):
            for t, i in self.prefix.get(word, ()):
                _, words, need = self.templates[t]
                if t in seen or len(block) < need:
                    continue
                seen.add(t)  # the first shared word: i words of the template and j of the block are before it
                if 1 + min(len(words) - i - 1, len(block) - j - 1) < need:
                    continue
                shared = len(words.intersection(block))
                if shared >= need:
                    yield t, shared / len(words)

    def runs(self, rank: np.ndarray, line: np.ndarray, paragraph: np.ndarray, met: dict[int, set[int]]) -> Iterator[tuple[int, int, int, float]]:
        """Template, first and last word and containment of runs over several lines; ``met``: lines that meet a template alone."""
        found = defaultdict(set)
        for p in np.flatnonzero((rank >= 0) & self.leads[rank]).tolist():
            for t, _ in self.prefix.get(int(rank[p]), ()):
                _, words, need = self.templates[t]
                width, lo = self.width[t], max(0, p - self.width[t] + 1)
                near = [(lo + k, r) for k, r in enumerate(rank[lo:p + width].tolist()) if r in words and paragraph[lo + k] == paragraph[p]]
                if line[near[0][0]] == line[near[-1][0]] or len({r for _, r in near}) < need:
                    continue
                for k, (first, _) in enumerate(near):
                    if first > p:
                        break
                    seen, last = set(), first
                    for q, r in near[k:]:
                        if q < first + width and r not in seen:
                            seen.add(r)
                            last = q
                    if len(seen) >= need and line[first] != line[last]:
                        found[t].add((-len(seen), last - first, first, last))
        for t, runs in found.items():
            taken = []
            for shared, _, first, last in sorted(runs):
                if any(x in met[t] for x in range(line[first], line[last] + 1)) or any(first <= b and a <= last for a, b in taken):
                    continue
                taken.append((first, last))
                yield t, first, last, -shared / len(self.templates[t][1])


def scan_licenses(docs: DataFrame, threshold: float = THRESHOLD, phrases: dict[str, str] = PHRASES, templates=TEMPLATES) -> DataFrame:
    """doc_id, n_words, spans (phrases and blocks: label, kind, first and last word, containment)."""
    vocabulary = Vocabulary(templates)
    index = TemplateIndex(templates, vocabulary, word_frequencies(docs, vocabulary), threshold)
    runs = [(label, split_words([phrase.encode()], NON_WORD, True).hash) for phrase, label in phrases.items()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = utf8(batch.column("text"))
            for a, b in chunks(texts):
                w = split_words(texts[a:b], NON_WORD, lower=True)
                spans: dict[int, list] = defaultdict(list)
                for label, run in runs:
                    n = len(run)
                    at = np.flatnonzero(w.hash[: len(w.hash) - n + 1] == run[0]) if len(w.hash) >= n else np.empty(0, int)
                    for k in range(1, n):
                        at = at[w.hash[at + k] == run[k]]
                    for i in at[w.text[at] == w.text[at + n - 1]]:
                        first = int(i - w.first[w.text[i]])
                        spans[int(w.text[i])].append((label, "phrase", first, first + n - 1, 1.0))
                code = vocabulary.codes(w)
                block, word = _block_words(w, code)
                rank = index.rank[word]
                line = np.cumsum(w.buf == 10)[w.start] if len(w.start) else np.empty(0, np.int64)
                met = defaultdict(set)
                for lead in np.unique(block[index.leads[rank]]):
                    lo, hi = np.searchsorted(block, [lead, lead + 1])
                    for t, share in index.matches(sorted(rank[lo:hi].tolist())):
                        met[t].add(int(lead))
                        first, last = np.searchsorted(line, [lead, lead + 1])
                        text = int(w.text[first])
                        spans[text].append((index.templates[t][0], "block", int(first - w.first[text]), int(last - 1 - w.first[text]), share))
                paragraph = np.cumsum((np.diff(line, prepend=line[:1]) > 1) | (np.diff(w.text, prepend=w.text[:1]) != 0))
                for t, first, last, share in index.runs(np.where(code >= 0, index.rank[code], -1), line, paragraph, met):
                    text = int(w.text[first])
                    spans[text].append((index.templates[t][0], "block", int(first - w.first[text]), int(last - w.first[text]), share))
                keys = ("label", "kind", "first", "last", "containment")
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(a, b - a), pa.array(np.bincount(w.text, minlength=b - a).astype(np.int64)),
                    pa.array([[dict(zip(keys, s)) for s in sorted(spans.get(i, []))] for i in range(b - a)],
                             pa.list_(pa.struct([("label", pa.string()), ("kind", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("containment", pa.float64())])))],
                    names=["doc_id", "n_words", "spans"])

    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, spans {SPAN}")


def digest(scanned: DataFrame) -> DataFrame:
    """Counts, labels and score of each row of ``scan_licenses``."""
    base = F.filter("spans", lambda s: s["kind"] == "phrase")
    starts = F.transform(base, lambda s: s["first"])
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    return scanned.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), labels(base).alias("base_labels"), labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["containment"])), F.lit(0.0)).alias("score"))
