"""Source divergence audit by one-hot level products.

How far the word use of each source is from the other sources of its language.
A group is a (lang, source); a language keeps the V terms that are in at least
``MIN_DOCS`` of its documents.  A group gives each kept term the share
p = 1 + floor(SCALE * (count + 1) / (N + V)), and two shares of a term differ
by f(p, q) = floor((p - q)^2 / q).

The pair values sum f over all kept terms, counts of zero included.  Terms
enter as rows of an indicator matrix: one column for every (group, count
level).  The matrix times its transpose holds, for every two groups, the joint
table of their levels - how many terms have count c here and d there - and a
table is priced cell by cell, with exact integers.  The product is cut into
blocks, each an independent task input: blocks of terms that have similar
totals (few levels each) and, where a language has many sources, tiles of
``SIDE`` by ``SIDE`` groups.  Inside a block, runs of terms with many levels
are halved until the product is narrow.  Only one number per pair of groups and
block leaves a task, so nothing grows with the size of a group; a source with a
third of all rows is pre-aggregated to its term counts like any other.

The term part is each group's terms over the share of the whole language,
largest f first, to rank ``TOP_TERMS``.

Defined results: null text, lang and source count as ''; rows are documents,
also where they share a doc_id or are equal; groups without terms and languages
without kept terms (V = 0) have their pairs, with the value 0 where V = 0; a
language with one source has no pairs; an empty table gives an empty result;
other columns are ignored.  Ties are in the order of the items' UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrow_runs import key_runs
from .common import slices, stored
from .textbatch import SPACE, U64, chunks, split_words, utf8

MIN_DOCS = 3
SCALE = 1_000_000_000
TOP_TERMS = 200
#: Groups on one side of a block, and terms in one (both as expected sizes of hash parts).
SIDE = 32
TERMS = 1_024
#: A product wider than this is cut by terms, down to so many.
WIDE, FEW_TERMS = 1_024, 32

#: ASCII but letters: what stands between terms.
NON_TERM = np.array([b < 0x80 and not chr(b).isalpha() for b in range(256)])
assert SPACE.shape == NON_TERM.shape


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that hold it); counted per batch before the shuffle."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = utf8(batch.column("text"))
            lang, source = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
            group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
            for a, b in chunks(texts):
                yield _counted(texts[a:b], group[a:b], lang.dictionary, source.dictionary)

    known = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")), "text")
    found = known.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _counted(texts: list[bytes], group: np.ndarray, langs: pa.Array, sources: pa.Array) -> pa.RecordBatch:
    """Counts of a run of texts; ``group`` numbers each text's language and source."""
    w = split_words(texts, NON_TERM, lower=True)
    order = np.lexsort((w.text, w.hash, group[w.text]))
    g, h, t = group[w.text][order], w.hash[order], w.text[order]
    new = np.concatenate(([True], (g[1:] != g[:-1]) | (h[1:] != h[:-1])))[:len(h)]
    new_doc = new | np.concatenate(([True], t[1:] != t[:-1]))[:len(h)]
    first = np.flatnonzero(new)
    n = np.diff(first, append=len(h))
    docs = np.add.reduceat(new_doc.astype(np.int64), first) if len(first) else np.empty(0, np.int64)
    buf = w.buf.tobytes()
    terms = [buf[a:b] for a, b in zip(w.start[order[first]].tolist(), w.end[order[first]].tolist())]
    lang, source = langs.take(pa.array(g[first] // len(sources))), sources.take(pa.array(g[first] % len(sources)))
    return pa.RecordBatch.from_arrays([lang, source, pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n.astype(np.int64)), pa.array(docs)],
                                      names=["lang", "source", "term", "n", "docs"])


def _share(n: Column, total: Column, v: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + v)) in exact integers of any size a corpus has."""
    big = lambda c: c.cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * big(n + 1), big(total + v))


def _difference(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


class Audit:
    """The tables that both parts read, each written once: groups, langs, terms and cells."""

    def __init__(self, docs: DataFrame):
        spark = docs.sparkSession
        counts = stored(term_counts(docs), "term-counts")
        terms = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= MIN_DOCS)
        self.terms = stored(terms.select("lang", "term", "total", F.monotonically_increasing_id().alias("term_id")), "kept-terms")
        kept = self.terms.select(F.col("lang").alias("k_lang"), F.col("term").alias("k_term"), "total", "term_id")
        cells = counts.join(kept, (F.col("lang") == F.col("k_lang")) & (F.col("term") == F.col("k_term")))
        cells = stored(cells.select("lang", "source", "term", "term_id", "total", "n"), "term-cells")
        sizes = cells.groupBy("lang", "source").agg(F.sum("n").alias("size"))
        groups = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
        langs = groups.groupBy("lang").agg(F.count("*").alias("groups"))
        v = self.terms.groupBy(F.col("lang").alias("v_lang")).agg(F.count("*").alias("v"), F.sum("total").alias("lang_size"))
        langs = langs.join(v, F.col("lang") == F.col("v_lang"), "left").select(
            "lang", "groups", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("lang_size", F.lit(0)).alias("lang_size"),
            F.monotonically_increasing_id().alias("lang_id"))
        self.langs = stored(langs, "langs")
        groups = groups.join(sizes.withColumnsRenamed({"lang": "s_lang", "source": "s_source"}), (F.col("lang") == F.col("s_lang")) & (F.col("source") == F.col("s_source")), "left")
        groups = groups.select("lang", "source", F.coalesce("size", F.lit(0)).alias("size")).join(self.langs.withColumnRenamed("lang", "l_lang"), F.col("lang") == F.col("l_lang"))
        tiles = F.ceil(F.col("groups") / SIDE).cast("int")
        self.groups = stored(groups.select("lang", "source", "size", "lang_id", "v", "lang_size", F.monotonically_increasing_id().alias("group_id"),
                                           tiles.alias("tiles"), F.pmod(F.xxhash64("source"), tiles).cast("int").alias("tile")), "groups")
        of = self.groups.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), "size", "lang_id", "v", "lang_size", "group_id", "tile", "tiles")
        self.cells = cells.join(of, (F.col("lang") == F.col("g_lang")) & (F.col("source") == F.col("g_source")))
        self.spark = spark

    def over_used_terms(self, top: int = TOP_TERMS) -> DataFrame:
        """lang, source, item, value, rank: kept terms of each group above the share of the language."""
        p, q = _share(F.col("n"), F.col("size"), F.col("v")), _share(F.col("total"), F.col("lang_size"), F.col("v"))
        shares = self.cells.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
        ranked = shares.select("lang", "source", "item", _difference(F.col("p"), F.col("q")).alias("value"))
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    def blocks(self) -> tuple[DataFrame, DataFrame]:
        """band: band_id and term blocks of every (lang, total) band; a band without terms (-1) stands for each language's list of groups."""
        band = F.floor(F.log2(F.col("total")) * 4).cast("int")
        bands = self.terms.groupBy("lang", band.alias("band")).agg(F.ceil(F.count("*") / TERMS).cast("int").alias("blocks"))
        bands = bands.unionAll(self.langs.select("lang", F.lit(-1).alias("band"), F.lit(1).alias("blocks")))
        return band, stored(bands.select(F.col("lang").alias("b_lang"), F.col("band").alias("b_band"), "blocks", F.monotonically_increasing_id().alias("band_id")), "bands")

    def pair_values(self) -> DataFrame:
        """g, h, value, seen: f of group g against group h, over the terms seen (all but those that no group of either tile holds); ids of groups."""
        band, bands = self.blocks()
        other = F.sequence(F.lit(0), F.col("tiles") - 1)
        tiled = ["band_id", "block", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "group_id", "size", "v", "term_id", "n"]
        heads = (self.groups.join(bands, F.col("lang") == F.col("b_lang"))
                 .select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(None).cast("long").alias("term_id"), F.lit(None).cast("long").alias("n")))
        cells = (self.cells.withColumn("band", band).join(bands, (F.col("lang") == F.col("b_lang")) & (F.col("band") == F.col("b_band")))
                 .withColumn("block", F.pmod(F.xxhash64("term_id"), F.col("blocks")).cast("int")))
        rows = heads.withColumn("other", F.explode(other)).select(*tiled).unionAll(cells.withColumn("other", F.explode(other)).select(*tiled))

        def price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in key_runs(batches, ("band_id", "block", "low", "high")):
                yield from _block_values(block)

        rows = rows.repartition("band_id", "block", "low", "high").sortWithinPartitions("band_id", "block", "low", "high", F.col("term_id").asc_nulls_first())
        parts = rows.mapInArrow(price, "g long, h long, value long, seen long")
        return parts.groupBy("g", "h").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))

    def source_pairs(self) -> DataFrame:
        """lang, source, item (another source of the language), value, rank."""
        none = F.when(F.col("v") > 0, _share(F.lit(0), F.col("size"), F.col("v")))
        g = self.groups.select(F.col("group_id").alias("g_id"), "lang", "source", "v", none.alias("p"))
        h = self.groups.select(F.col("group_id").alias("h_id"), F.col("source").alias("item"), none.alias("q"))
        pairs = self.pair_values().join(g, F.col("g") == F.col("g_id")).join(h, F.col("h") == F.col("h_id"))
        unseen = F.when(F.col("v") > F.col("seen"), (F.col("v") - F.col("seen")) * _difference(F.col("p"), F.col("q"))).otherwise(0)
        pairs = pairs.withColumn("value", F.col("value") + unseen)
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        return pairs.select("lang", "source", "item", "value").withColumn("rank", F.row_number().over(order))


def _block_values(block: pa.Table) -> Iterator[pa.RecordBatch]:
    """Pair values of one (term block, tile pair): every group of both tiles, whether it holds a term of the block or not."""
    col = {c: block.column(c).to_numpy() for c in ("tile", "low", "high", "group_id", "size", "v")}
    head = block.column("term_id").is_null().to_numpy()
    tile, ids, sizes = col["tile"][head], col["group_id"][head], col["size"][head]
    v, low, high = int(col["v"][0]), col["low"][0], col["high"][0]
    order = np.argsort(ids)
    ids, sizes, tile = ids[order], sizes[order], tile[order]
    cell = np.flatnonzero(~head)
    terms, row = np.unique(block.column("term_id").combine_chunks().take(pa.array(cell)).to_numpy(), return_inverse=True)
    count = np.zeros((len(terms), len(ids)), dtype=np.int64)
    count[row, np.searchsorted(ids, col["group_id"][cell])] = block.column("n").combine_chunks().take(pa.array(cell)).to_numpy()
    left, right = np.flatnonzero(tile == low), np.flatnonzero(tile == high)
    if not len(left) or not len(right):
        return
    forth, back = np.zeros((len(ids), len(ids)), dtype=np.int64), np.zeros((len(ids), len(ids)), dtype=np.int64)
    count = count[np.argsort(count.sum(axis=1), kind="stable")]
    if len(terms):
        _add_products(count, sizes, v, left, right, forth, back)
    i, j = (x.ravel() for x in np.meshgrid(left, right, indexing="ij"))
    if low == high:
        g, h, value = ids[i], ids[j], forth[i, j]
    else:
        g, h, value = np.concatenate((ids[i], ids[j])), np.concatenate((ids[j], ids[i])), np.concatenate((forth[i, j], back[j, i]))
    other = g != h
    yield pa.RecordBatch.from_arrays([pa.array(g[other]), pa.array(h[other]), pa.array(value[other]), pa.array(np.full(other.sum(), len(terms)))],
                                     names=["g", "h", "value", "seen"])


def _levels(count: np.ndarray, groups: np.ndarray, sizes: np.ndarray, v: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One-hot columns of the groups' count levels (terms x columns), with group and share of each column."""
    hot, owner, share = [], [], []
    for g in groups.tolist():
        level, at = np.unique(count[:, g], return_inverse=True)
        hot.append(at[:, None] == np.arange(len(level))[None, :])
        owner.append(np.full(len(level), g))
        share.extend(1 + SCALE * (c + 1) // (int(sizes[g]) + v) for c in level.tolist())
    return np.concatenate(hot, axis=1).astype(np.float32), np.concatenate(owner), np.array(share, dtype=np.int64)


def _add_products(count: np.ndarray, sizes: np.ndarray, v: int, left: np.ndarray, right: np.ndarray, forth: np.ndarray, back: np.ndarray) -> None:
    """Adds the priced joint tables of ``left`` x ``right``: f(left against right) to forth[left, right], the other way to back[right, left]."""
    x, own_x, p = _levels(count, left, sizes, v)
    y, own_y, q = (x, own_x, p) if left is right or np.array_equal(left, right) else _levels(count, right, sizes, v)
    if max(x.shape[1], y.shape[1]) > WIDE and len(count) > FEW_TERMS:
        half = len(count) // 2
        _add_products(count[:half], sizes, v, left, right, forth, back)
        _add_products(count[half:], sizes, v, left, right, forth, back)
        return
    table = x.T @ y  # exact: cells are counts of at most len(count) terms
    i, j = np.nonzero(table)
    cells = table[i, j].astype(np.int64)
    square = (p[i] - q[j]) ** 2
    np.add.at(forth, (own_x[i], own_y[j]), cells * (square // q[j]))
    if y is not x:
        np.add.at(back, (own_y[j], own_x[i]), cells * (square // p[i]))


def audit_sources(docs: DataFrame, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank."""
    audit = Audit(docs)
    pairs = audit.source_pairs().select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    return pairs.unionAll(audit.over_used_terms(top).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
