"""Exact n-gram Jaccard join: size-banded tiles, bitmap signatures, array intersection.

A document's set holds the hashes of its distinct three-word shingles.  Equal
sets are one class.  Classes are banded by set size so that linked classes are
in the same or in neighbouring bands.  Within a band, a pair that reaches the
threshold t differs in at most d = (1-t)/(1+t) * (|A|+|B|) elements; the hash
space is cut into d + 1 + m parts, of which at least m + 1 are then equal in
both sets.  So a tile is the classes of a band that agree in one part, and all
linked pairs meet in some tile, whatever words are frequent.  Parts without
elements are equal in unrelated sets: a set with at most m of them does not
emit them, since one of the equal parts has elements; only the rare set with
more does, so that no link is lost.

Pairs of a tile are bounded by parity signatures of some 16 d bits: bits that
differ stem from elements that differ, so the count of unequal bits bounds the
overlap from above.  What passes is verified by exact intersection of the
sorted shingle arrays.  To give no square of a group of near copies:

1. every member of a tile is verified against the tile's smallest member only,
   and these links give first components;
2. only pairs of different components are then formed, in tiles that hold
   several; large tiles are cut into blocks, each pair of blocks a task's work.
   Of two components in a tile, each member of the smaller one meets the other's
   members in the order of their bound, most promising first: two of them,
   then the next thirty, and so on in ``ROUNDS``.  Components that have
   grown together need no further pairs, so a group of near copies isn't
   multiplied out, and what stays apart is compared to the end.

Both steps lose nothing for connectivity: a pair that is left out is connected
already.  Shingles are computed again from the text for verification, which is
less to move than the arrays of all documents.

Defined results: null or blank text has no shingles, is linked with nothing and
is its own component; one or two words are one shingle; rows that share a
doc_id are separate rows with the same id; a null doc_id gets the smallest
doc_id it reaches, or null; empty tables give empty results; other columns are
ignored.  Shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrow_runs import key_runs
from .common import row_key, slices, stored
from .components import connected_components
from .textbatch import SPACE, U64, chunks, mix, split_words, utf8

WORDS = 3
PERCENT = 90
BLOCK = 2_048
#: Places in a member's list of another component's members that each round verifies.
ROUNDS = ((0, 2), (2, 32), (32, None))
#: Words of signatures compared at once.
COMPARED = 1 << 22
#: One part more for every so many elements that may differ, so that sets rarely have as many empty parts.
SURPLUS = 16
#: Rows that may be broadcast to pick out texts or sets (8 bytes each); beyond, these are shuffled.
FEW_ROWS = 300_000
#: Bits of a signature for each element that may differ (half of them, by folding, for the pairs with a tile's smallest member).
SIGNATURE_BITS = 16
PAIRS_PER_TASK_GROUP = 500


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; with fewer words, the whole sequence is the one shingle."""
    w = split_words(texts, SPACE, lower=True)
    out = []
    h = w.hash
    if len(h) >= words:
        s = np.zeros(len(h) - words + 1, dtype=U64)
        for k in range(words):
            s = s * U64(0x9E3779B97F4A7C15) + mix(h[k:len(h) - words + 1 + k] + U64(k))
        s = mix(s)
    else:
        s = np.empty(0, U64)
    for a, b in zip(w.first[:-1], w.first[1:]):
        if b - a >= words:
            x = np.sort(s[a:b - words + 1])
            out.append(x[np.concatenate(([True], x[1:] != x[:-1]))])
        elif b > a:
            whole = np.array([b - a], dtype=U64)
            for k in range(a, b):
                whole = mix(whole * U64(0xD6E8FEB86659FD93) + h[k:k + 1])
            out.append(whole)
        else:
            out.append(np.empty(0, U64))
    return out


@lru_cache(4)
def band_starts(percent: int, limit: int = 1 << 40) -> np.ndarray:
    """Smallest size of each band; sizes in ratio of the threshold are at most one band apart."""
    starts = [1]
    while starts[-1] < limit:
        starts.append(max(starts[-1] + 1, starts[-1] * 100 // percent + 1))
    return np.array(starts, dtype=np.int64)


def _most_different(n: np.ndarray, other: np.ndarray, percent: int) -> np.ndarray:
    """Elements in which sets of these sizes may differ at most and still reach the threshold."""
    return (n + other) * (100 - percent) // (100 + percent)


def tile_keys(sets: list[np.ndarray], percent: int) -> list[np.ndarray]:
    """The tiles of each set: one per part that has elements, in its own band and (as the smaller of a pair) in the next.

    A set with so many empty parts that the equal parts of a pair might all be among them emits these too.
    """
    starts = band_starts(percent)
    out = [[] for _ in sets]
    n = np.array([len(s) for s in sets], dtype=np.int64)
    some = np.flatnonzero(n)
    if not len(some):
        return [np.empty(0, np.int64) for _ in sets]
    n = n[some]
    flat, owner = np.concatenate([sets[i] for i in some]), np.repeat(np.arange(len(some)), n)
    content = mix(flat ^ U64(0x5851F42D4C957F2D))
    band = np.searchsorted(starts, n, side="right") - 1
    for step in (0, 1):
        largest = starts[band + step + 1] - 1
        most = _most_different(largest, largest, percent)
        parts = most + 2 + most // SURPLUS
        base = np.concatenate(([0], np.cumsum(parts)))
        of = base[owner] + (flat % parts[owner].astype(U64)).astype(np.int64)
        total = np.zeros(base[-1], dtype=U64)
        np.add.at(total, of, content)
        full = np.bincount(of, minlength=base[-1]) > 0
        empty = parts - np.add.reduceat(full, base[:-1], dtype=np.int64)
        # parts equal to a partner's at least: all but one for each element that may differ
        equal = parts - _most_different(n, np.minimum(largest, n * 100 // percent), percent)
        emit = full | np.repeat(empty >= equal, parts)
        part = np.arange(base[-1]) - np.repeat(base[:-1], parts)
        place = np.repeat(band + step, parts).astype(U64) * U64(0x9E3779B97F4A7C15) + part.astype(U64)
        key = mix(mix(place) + total * U64(0xD6E8FEB86659FD93)).view(np.int64)
        for j, i in enumerate(some):
            out[i].append(key[base[j]:base[j + 1]][emit[base[j]:base[j + 1]]])
    return [np.concatenate(k) if k else np.empty(0, np.int64) for k in out]


def signature(s: np.ndarray, percent: int) -> np.ndarray:
    """Parity of the elements that hash to each bit; the bits, a power of two, are ``SIGNATURE_BITS`` for each element that may differ.

    Sets of neighbouring bands have as many bits or twice as many; the halves of the longer one, combined, are its
    parities in the shorter width.
    """
    starts = band_starts(percent)
    largest = starts[np.searchsorted(starts, max(len(s), 1), side="right")] - 1
    width = max(128, 1 << int(SIGNATURE_BITS * _most_different(largest, largest, percent) - 1).bit_length()) if percent < 100 else 128
    ones = np.bincount((s >> U64(7)).astype(np.int64) & (width - 1), minlength=width) & 1
    return np.packbits(ones.astype(np.uint8), bitorder="little").view(np.int64)


def signed_sets(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """place (unique), row, doc_id, n_shingles, a and b (hashes of the set), bits, tiles; written once."""
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = utf8(batch.column("text"))
            for at, to in chunks(texts):
                sets = shingle_sets(texts[at:to], words)
                tiles = tile_keys(sets, percent)
                ends = np.concatenate(([0], np.cumsum([len(t) for t in tiles])))
                bits = [signature(s, percent) for s in sets]
                words_end = np.concatenate(([0], np.cumsum([len(x) for x in bits])))
                yield pa.RecordBatch.from_arrays([
                    batch.column("row").slice(at, to - at), batch.column("doc_id").slice(at, to - at), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(np.array([mix(s).sum(dtype=U64) for s in sets], dtype=U64).view(np.int64)),
                    pa.array(np.array([np.bitwise_xor.reduce(mix(s + U64(1))) for s in sets], dtype=U64).view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(words_end, pa.int32()), pa.array(np.concatenate(bits))),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(tiles)))],
                    names=["row", "doc_id", "n_shingles", "a", "b", "bits", "tiles"])

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("row"), "doc_id", "text")
    sets = rows.mapInArrow(extract, f"row long, doc_id {kind}, n_shingles long, a long, b long, bits array<long>, tiles array<long>")
    return stored(sets.select(F.monotonically_increasing_id().alias("place"), "*"), "jaccard-sets")


def _folded(bits: Column, width: Column) -> Column:
    """A signature in ``width`` words, half of its own or all."""
    return F.when(F.size(bits) > width, F.zip_with(F.slice(bits, F.lit(1), width), F.slice(bits, width + 1, width), lambda x, y: x.bitwiseXOR(y))).otherwise(bits)


def _possible(n1: Column, n2: Column, bits1: Column, bits2: Column, percent: int) -> Column:
    """Size ratio and the bound that the signatures' unequal bits put on the overlap."""
    width = F.least(F.size(bits1), F.size(bits2))
    unequal = F.aggregate(F.zip_with(_folded(bits1, width), _folded(bits2, width), lambda x, y: x.bitwiseXOR(y)), F.lit(0), lambda s, x: s + F.bit_count(x))
    most = F.floor((n1 + n2 - unequal) / 2)
    return (F.least(n1, n2) * 100 >= F.greatest(n1, n2) * percent) & (100 * most >= percent * (n1 + n2 - most))


def _linked(docs: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (x, y) of rows whose sets reach the threshold, by exact intersection of sorted arrays."""
    needed = stored(pairs.select(F.col("x").alias("need")).unionAll(pairs.select(F.col("y").alias("need"))).distinct(), "jaccard-needed")
    needed = F.broadcast(needed) if needed.count() <= FEW_ROWS else needed.hint("shuffle_hash")
    texts = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("row"), "text")
    texts = texts.join(needed, F.col("row") == F.col("need")).select("row", "text")

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = utf8(batch.column("text"))
            for at, to in chunks(found):
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(at, to - at), pa.array([s.tobytes() for s in shingle_sets(found[at:to], words)], pa.binary())], names=["row", "shingles"])

    arrays = stored(texts.mapInArrow(shingle, "row long, shingles binary").dropDuplicates(["row"]), "jaccard-shingles")
    # the pairs of one y are dealt to groups of bounded size, each with its own copy of y's array
    groups = pairs.groupBy(F.col("y").alias("g_y")).agg(F.ceil(F.count("*") / PAIRS_PER_TASK_GROUP).cast("int").alias("groups"))
    left = (pairs.join(groups, F.col("y") == F.col("g_y")).withColumn("g", F.pmod(F.xxhash64("x"), F.col("groups")).cast("int"))
            .join(arrays, F.col("x") == F.col("row")).select("y", "g", "x", "shingles"))
    right = (groups.join(arrays, F.col("g_y") == F.col("row"))
             .select(F.col("g_y").alias("y"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("g"), F.lit(None).cast("long").alias("x"), "shingles"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, mine = None, np.empty(0, U64)
        for batch in slices(batches, 500):
            xs, ys = [], []
            for y, x, packed in zip(*(batch.column(c).to_pylist() for c in ("y", "x", "shingles"))):
                s = np.frombuffer(packed, dtype=U64)
                if x is None:
                    current, mine = y, s
                    continue
                assert y == current
                shared = len(np.intersect1d(s, mine, assume_unique=True))
                if 100 * shared >= percent * (len(s) + len(mine) - shared):
                    xs.append(x)
                    ys.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.int64()), pa.array(ys, pa.int64())], names=["x", "y"])

    return (left.unionAll(right).repartition("y", "g").sortWithinPartitions("y", "g", F.col("x").asc_nulls_first())
            .mapInArrow(verify, "x long, y long"))


def _mixed_pairs(members: DataFrame, percent: int, places: tuple[int, int | None]) -> DataFrame:
    """Pairs of different components within each (tile, block pair), as far as size and signature allow: those at ``places`` of their lists."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in key_runs(batches, ("tile", "low", "high")):
            yield from _tile_pairs(tile, percent, places)

    return (members.repartition("tile", "low", "high").sortWithinPartitions("tile", "low", "high")
            .mapInArrow(compare, "x long, y long").distinct())


def _same_width(lists: pa.ListArray) -> np.ndarray:
    """Signatures of one tile as a matrix: those of twice the bits are folded."""
    ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
    size = np.diff(ends)
    width = int(size.min())
    at = ends[:-1, None] + np.arange(width)
    bits = flat[at]
    wide = size > width
    bits[wide] ^= flat[at[wide] + width]
    return bits


def _tile_pairs(table: pa.Table, percent: int, places: tuple[int, int | None]) -> Iterator[pa.RecordBatch]:
    col = {c: table.column(c).to_numpy() for c in ("row", "n", "first_root", "root", "block", "low", "high")}
    bits = _same_width(table.column("bits").combine_chunks())
    side = np.flatnonzero(col["block"] == col["low"]), np.flatnonzero(col["block"] == col["high"])
    same = col["low"][0] == col["high"][0]
    _, group, members = np.unique(col["first_root"], return_inverse=True, return_counts=True)
    step = max(1, COMPARED // max(1, len(side[1]) * bits.shape[1]))
    pairs = []
    for start in range(0, len(side[0]), step):
        i, j = side[0][start:start + step, None], side[1][None, :]
        n1, n2 = col["n"][i], col["n"][j]
        ok = (group[i] != group[j]) & (np.minimum(n1, n2) * 100 >= np.maximum(n1, n2) * percent)
        if same:
            ok &= i < j
        a, b = (np.broadcast_to(v, ok.shape)[ok] for v in (i, j))
        unequal = np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1).astype(np.int64)
        size = col["n"][a] + col["n"][b]
        most = (size - unequal) // 2
        keep = 100 * most >= percent * (size - most)
        pairs.append(np.stack([a[keep], b[keep], unequal[keep]]))
    a, b, unequal = np.concatenate(pairs, axis=1) if pairs else np.empty((3, 0), np.int64)
    # the list of a member of the smaller component holds the larger one's members; the lists are the same in every round
    swap = (members[group[a]] > members[group[b]]) | ((members[group[a]] == members[group[b]]) & (group[a] > group[b]))
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    order = np.lexsort((col["row"][b], unequal, group[b], a))
    a, b = a[order], b[order]
    new = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (group[b][1:] != group[b][:-1])))[:len(a)])
    place = np.arange(len(a)) - np.repeat(new, np.diff(new, append=len(a)))
    chosen = (place >= places[0]) & (place < (len(a) + 1 if places[1] is None else places[1])) & (col["root"][a] != col["root"][b])
    x, y = col["row"][a[chosen]], col["row"][b[chosen]]
    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], names=["x", "y"])


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """doc_id, row (hash of doc_id and text), n_shingles, class_row (of an equal set), root (of the component), component_id."""
    signed = signed_sets(docs, words, percent)
    # the class's smallest row stands for it; `place` tells apart rows that are equal
    classes = signed.where("n_shingles > 0").groupBy("a", "b", "n_shingles").agg(
        F.min(F.struct("row", "place")).alias("least"), F.min("doc_id").alias("least_id"), F.first("bits").alias("bits"))
    classes = stored(classes.select("a", "b", F.col("n_shingles").alias("n"), "least.row", "least.place", "least_id", "bits"), "jaccard-classes")

    places = classes.select(F.col("place").alias("c_place"))
    places = F.broadcast(places) if classes.count() <= FEW_ROWS else places.hint("shuffle_hash")
    in_tile = Window.partitionBy("tile").orderBy("row")
    members = signed.select("place", "row", "tiles").join(places, F.col("place") == F.col("c_place")).select(F.explode("tiles").alias("tile"), "row")
    members = stored(members.withColumn("pivot", F.first("row").over(in_tile)).where("row != pivot"), "jaccard-tiles")

    slim = classes.select("row", "n", "bits")
    half = slim.withColumn("bits", _folded(F.col("bits"), (F.size("bits") / 2).cast("int")))
    p, q = half.select(*(F.col(c).alias(f"x_{c}") for c in slim.columns)), half.select(*(F.col(c).alias(f"y_{c}") for c in slim.columns))
    stars = (members.select(F.col("row").alias("x"), F.col("pivot").alias("y")).distinct()
             .join(p, F.col("x") == F.col("x_row")).join(q, F.col("y") == F.col("y_row"))
             .where(_possible(F.col("x_n"), F.col("y_n"), F.col("x_bits"), F.col("y_bits"), percent)).select("x", "y"))
    links = stored(_linked(docs, stored(stars, "jaccard-stars"), words, percent), "jaccard-links")
    roots = stored(connected_components(links, "x", "y").select("node", "root"), "jaccard-roots")

    # tiles that still hold several components, without their pivots (these have met every member)
    first = stored(members.join(roots, F.col("row") == F.col("node"), "left").select("tile", "row", F.coalesce("root", "row").alias("first_root")), "jaccard-members")
    for places in ROUNDS:
        now = first.join(roots, F.col("row") == F.col("node"), "left").select("tile", "row", "first_root", F.coalesce("root", "row").alias("root"))
        several = now.groupBy(F.col("tile").alias("s_tile")).agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("members")).where("lo != hi")
        several = stored(several.where(F.col("members") > places[0]), "jaccard-mixed")
        rest = (now.join(several, F.col("tile") == F.col("s_tile")).withColumn("blocks", F.ceil(F.col("members") / block).cast("int"))
                .withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
                .join(slim.withColumnRenamed("row", "c_row"), F.col("row") == F.col("c_row"))
                .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
                .select("tile", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "row", "n", "first_root", "root", "bits"))
        if several.isEmpty():
            break
        more = stored(_mixed_pairs(rest, percent, places), "jaccard-rest")
        if more.isEmpty():
            continue
        found = stored(_linked(docs, more, words, percent), "jaccard-links")
        if not found.isEmpty():
            links = links.unionAll(found)
            roots = stored(connected_components(links, "x", "y").select("node", "root"), "jaccard-roots")
    roots = roots.withColumnRenamed("root", "c_root")

    named = classes.select("a", "b", F.col("n").alias("n_shingles"), F.col("row").alias("class_row"), "least_id").join(roots, F.col("class_row") == F.col("node"), "left")
    named = named.select("a", "b", "n_shingles", "class_row", "least_id", F.coalesce("c_root", "class_row").alias("root"))
    ids = named.groupBy(F.col("root").alias("i_root")).agg(F.min("least_id").alias("component_id"))
    named = named.join(ids, F.col("root") == F.col("i_root")).select(F.col("a").alias("k_a"), F.col("b").alias("k_b"), F.col("n_shingles").alias("k_n"), "class_row", "root", "component_id")
    out = signed.select("doc_id", "row", "n_shingles", "a", "b").join(named, (F.col("a") == F.col("k_a")) & (F.col("b") == F.col("k_b")) & (F.col("n_shingles") == F.col("k_n")), "left")
    return out.select("doc_id", "row", "n_shingles", F.coalesce("class_row", "row").alias("class_row"), F.coalesce("root", "row").alias("root"),
                      F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of each component of ``docs``, all columns as they are: the smallest by doc_id (null last) and row hash.

    Rows without shingles are components of their own; of rows equal in doc_id
    and text one stays.
    """
    found = jaccard_components(docs, words, percent)
    place = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))
    best = found.groupBy("root").agg(F.min(place).alias("best")).select(F.col("best.row").alias("_best"))
    rows = docs.withColumn("_row", row_key(F.col("doc_id"), F.col("text")))
    rows = rows.join(best.hint("shuffle_hash"), F.col("_row") == F.col("_best"), "left_semi")
    return rows.dropDuplicates(["_row"]).select(*docs.columns)
