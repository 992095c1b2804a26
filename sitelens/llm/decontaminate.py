"""Benchmark decontamination with an Aho-Corasick automaton.

Item texts (questions, answers) are lower-cased and cut into words; a window is
``size`` consecutive words of one item text, or the whole sequence where it has
fewer words.  All distinct windows go into one Aho-Corasick automaton, and every
document is normalised the same way and scanned once.  Windows and documents are
words with one space between and around them, so a window is only ever found at
word borders.  The normalised bytes keep the place they come from, so hits are
given both as word numbers and as code points of the original text.

The automaton is what each task holds, so its size is bounded: windows of more
than ``block_bytes`` together are dealt by hash to several automata, the texts
are scanned once for each, and the hits of a document are merged.  A benchmark
that fits one block takes one narrow pass without a shuffle.

Defined results: null, empty and blank texts have no words, and are clean;
items without words have no window; rows that share an item_id count as one
item, a null item_id marks words but is not counted; rows of documents that
share a doc_id are scanned one by one; without any window every document is
clean; other columns of both tables are ignored (``clean_documents`` returns
all columns as they are).
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_key, slices, stored
from .textbatch import LOWER, NON_WORD, chunks, utf8

WINDOW = 10
#: Bytes of windows in one automaton, which takes some 50 bytes for each.
BLOCK_BYTES = 4_000_000
#: Stands between texts: no byte of UTF-8, so in no window either.
BORDER = 0xFF

WORD_OR_SPACE = np.where(NON_WORD, 0x20, LOWER).astype(np.uint8)
SPANS = "array<struct<first:long,last:long,start:long,end:long>>"
_SPAN_TYPE = pa.list_(pa.struct([(c, pa.int64()) for c in ("first", "last", "start", "end")]))


def item_windows(benchmark: DataFrame, size: int = WINDOW, columns: tuple[str, ...] = ("text",)) -> DataFrame:
    """window (words joined by one space), n_words, item (the id as text): distinct."""
    words = F.split(F.trim(F.regexp_replace(F.translate(F.col("t"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
                                            r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")), " ")
    texts = benchmark.select(F.col("item_id").cast("string").alias("item"), F.explode(F.array(*columns)).alias("t")).where("t is not null")
    texts = texts.select("item", words.alias("w")).where(F.col("w")[0] != "")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    return (texts.select("item", "w", F.explode(starts).alias("k"))
            .select(F.array_join(F.slice("w", F.col("k"), size), " ").alias("window"), F.least(F.size("w"), F.lit(size)).alias("n_words"), "item")
            .distinct())


class Windows:
    """The windows of one block; every worker process builds its automaton once."""

    def __init__(self, rows):
        grouped: dict[str, tuple[int, list[str]]] = {}
        for r in rows:
            grouped.setdefault(r.window, (r.n_words, []))[1].append(r.item)
        self.windows = list(grouped)
        self.words = [n for n, _ in grouped.values()]
        self.items = [[i for i in items if i is not None] for _, items in grouped.values()]

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for k, w in enumerate(self.windows):
            found.add_word(f" {w} ".encode().decode("latin-1"), k)
        found.make_automaton()
        return found


class Scanned:
    """Hits in a run of texts, in one pass over their normalised bytes."""

    def __init__(self, texts: list[bytes], windows: Windows, automaton: ahocorasick.Automaton | None):
        raw = np.frombuffer(b"\xff " + b" \xff ".join(texts) + b" \xff", dtype=np.uint8)
        mapped = WORD_OR_SPACE[raw]
        space = mapped == 0x20
        keep = ~space
        keep[1:] |= ~space[:-1]
        self.origin = np.flatnonzero(keep)
        norm = mapped[self.origin]
        gap = norm == 0x20
        start = np.flatnonzero(~gap & np.concatenate(([True], gap[:-1])))
        end = np.flatnonzero(~gap & np.concatenate((gap[1:], [True])))
        border = norm[start] == BORDER
        self.text = np.cumsum(border) - 1  # of each word; borders count as words here
        self.borders = np.flatnonzero(border)
        self.n_words = np.diff(self.borders) - 1
        self.items: dict[int, set[int]] = {}
        mark = np.zeros(len(start) + 1, dtype=np.int64)
        if automaton is not None:
            found = list(automaton.iter(norm.tobytes().decode("latin-1")))
            if found:
                at, window = np.array(found, dtype=np.int64).T
                last = np.searchsorted(start, at) - 1
                np.add.at(mark, last - np.array(windows.words)[window] + 1, 1)
                np.add.at(mark, last + 1, -1)
                for t, w in set(zip(self.text[last].tolist(), window.tolist())):
                    self.items.setdefault(t, set()).add(w)
        hit = np.cumsum(mark[:-1]) > 0
        edge = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0, append=0))
        code_points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
        self.spans: dict[int, list[dict]] = {}
        for a, b in zip(edge[0::2].tolist(), (edge[1::2] - 1).tolist()):
            t = int(self.text[a])
            base = code_points[self.origin[start[self.borders[t]]] + 2]  # the border and one space stand before a text
            self.spans.setdefault(t, []).append({
                "first": int(a - self.borders[t] - 1), "last": int(b - self.borders[t] - 1),
                "start": int(code_points[self.origin[start[a]]] - base), "end": int(code_points[self.origin[end[b]] + 1] - base)})


def _scan(rows: DataFrame, kept: list[str], windows: Windows) -> DataFrame:
    """``kept`` columns, n_words, spans and items of every row, by one automaton."""
    shared = rows.sparkSession.sparkContext.broadcast(windows)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        automaton = block.automaton() if block.windows else None
        for batch in slices(batches):
            texts = utf8(batch.column("text"))
            for a, b in chunks(texts):
                s = Scanned(texts[a:b], block, automaton)
                items = [sorted({i for w in s.items.get(t, ()) for i in block.items[w]}) for t in range(b - a)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(a, b - a) for c in kept), pa.array(s.n_words.astype(np.int64)),
                     pa.array([s.spans.get(t, []) for t in range(b - a)], _SPAN_TYPE), pa.array(items, pa.list_(pa.string()))],
                    names=[*kept, "n_words", "spans", "items"])

    kinds = dict(rows.dtypes)
    return rows.select(*kept, "text").mapInArrow(scan, ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), f"n_words long, spans {SPANS}, items array<string>"]))


def _merged(spans):
    """Overlapping and adjoining spans of several automata as one, in order."""
    empty = F.array().cast(SPANS)
    last = lambda done: F.element_at(done, -1)
    joined = lambda done, s: F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(
        last(done)["first"].alias("first"), F.greatest(last(done)["last"], s["last"]).alias("last"),
        last(done)["start"].alias("start"), F.greatest(last(done)["end"], s["end"]).alias("end"))))
    return F.aggregate(F.array_sort(spans), empty, lambda done, s: F.when(
        (F.size(done) > 0) & (s["first"] <= F.try_element_at(done, F.lit(-1))["last"] + 1), joined(done, s)).otherwise(F.concat(done, F.array(s))))


def scan_documents(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, columns: tuple[str, ...] = ("text",),
                   block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, spans (runs of hit words: first and last word, start and end in the text), items (ids as text, sorted)."""
    windows = stored(item_windows(benchmark, size, columns), "item-windows")
    total = windows.agg(F.sum(F.octet_length("window") + 2)).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    part = F.pmod(F.xxhash64("window"), F.lit(blocks))
    if blocks == 1:
        return _scan(docs, ["doc_id"], Windows(windows.collect()))
    rows = stored(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")), "scan-rows")
    found = None
    for b in range(blocks):
        one = _scan(rows, ["row", "doc_id"], Windows(windows.where(part == b).collect()))
        # documents without a hit are told by the first pass alone
        found = one if found is None else found.unionAll(one.where("size(spans) > 0"))
    merged = found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
                                      F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return merged.select("doc_id", "n_words", _merged(F.col("spans")).alias("spans"), "items")


def digest(scanned: DataFrame) -> DataFrame:
    """Counts and verdict of each row of ``scan_documents``."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["last"] - x["first"] + 1)
    return scanned.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                          F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, columns: tuple[str, ...] = ("text",)) -> DataFrame:
    """The rows of ``docs`` without any hit, all columns as they are."""
    keyed = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("doc_id"), "text")
    hit = scan_documents(keyed, benchmark, size, columns).where("size(spans) > 0").select(F.col("doc_id").alias("_hit")).distinct()
    return docs.withColumn("_row", row_key(F.col("doc_id"), F.col("text"))).join(hit, F.col("_row") == F.col("_hit"), "left_anti").drop("_row")
