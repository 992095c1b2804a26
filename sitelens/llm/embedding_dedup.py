"""Embedding near-dedup through an inverted multi-index.

Vectors are scaled to unit length and cut in halves; each half has a codebook
of its own, and the product of the two is a grid of cells.  Every vector is
filed under its nearest cell.  Read as a query, it visits cells in the order of
summed half distances (multi-sequence order), as many as it takes to reach the
target recall; the vectors of visited cells are verified by exact cosines in
double precision.

* Equal vectors are one class with a count, so copies are compared once.
* Codebooks are fitted on the ``sample`` classes with the smallest hash; their
  size follows the number of classes, up to ``MAX_CODES``.
* The number of visits is measured: ``sample_queries`` classes by hash (those
  that hold an id divisible by 50 first) are compared with all vectors in blocks,
  more of them until they have ``LEAST_LINKS`` true links, a class's match with
  itself left out.  The visits are those that find ``target`` of these links;
  where ``MAX_QUERIES`` show fewer, twice those that find every one, and
  ``FEW_VISITS`` at least.  ``recall`` measures a finished result.
* Cells are cut into blocks of residents and visitors, so a cell that holds a
  third of all vectors is worked on by many tasks.  Links are counted, not
  listed: a block returns counts and one spanning edge per linked vector.

A link is counted for both ends also where only one of them visits the other's
cell.  Defined results: vectors that are null, zero, hold null or non-finite
components, or differ in length from most (smallest length on ties) are linked
with nothing; rows that share a vec_id are separate rows; component_id is the
smallest vec_id reachable and kept is vec_id = component_id; an empty table
gives an empty result; other columns, label included, are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_runs import key_runs, matrix
from .common import stored
from .components import connected_components

LINK = 0.95
TARGET_RECALL = 0.995
SAMPLE = 16_384
SAMPLE_QUERIES = 512
MAX_CODES = 1_024
CELL_VECTORS = 8
MIN_VISITS = 4
LEAST_LINKS = 400
MAX_QUERIES = 8_192
FEW_VISITS = 64
RESIDENTS, VISITORS = 2_048, 8_192


@dataclass
class MultiIndex:
    first: np.ndarray   # codes x half dimension
    second: np.ndarray

    @property
    def codes(self) -> int:
        return len(self.first)

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.first.shape[1]
        return squared(x[:, :half], self.first), squared(x[:, half:], self.second)

    def home(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return a.argmin(axis=1) * len(self.second) + b.argmin(axis=1)

    def visits(self, x: np.ndarray, count: int) -> np.ndarray:
        """The ``count`` cells with the smallest summed half distances, nearest first.

        The cell of the i-th and j-th nearest half codes has (i+1)(j+1)-1 cells
        before it, so only those with (i+1)(j+1) <= count can be among them.
        """
        a, b = self.distances(x)
        count = min(count, a.shape[1] * b.shape[1])
        near_a, near_b = (np.argsort(d, axis=1, kind="stable")[:, :count] for d in (a, b))
        i, j = np.meshgrid(np.arange(near_a.shape[1]), np.arange(near_b.shape[1]), indexing="ij")
        stairs = (i + 1) * (j + 1) <= count
        i, j = i[stairs], j[stairs]
        total = np.take_along_axis(a, near_a, axis=1)[:, i] + np.take_along_axis(b, near_b, axis=1)[:, j]
        best = np.argsort(total, axis=1, kind="stable")[:, :count]
        return (np.take_along_axis(near_a, i[best], axis=1) * b.shape[1] + np.take_along_axis(near_b, j[best], axis=1)).astype(np.int64)


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)


def codebook(x: np.ndarray, codes: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Lloyd's k-means from random distinct starts; an empty cell keeps its centre."""
    x = np.unique(x, axis=0)
    centres = x[np.random.default_rng(seed).permutation(len(x))[:codes]].copy()
    for _ in range(rounds):
        own = np.concatenate([squared(x[i:i + 4096], centres).argmin(axis=1) for i in range(0, len(x), 4096)])
        n = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres[n > 0] = total[n > 0] / n[n > 0, None]
    return centres


def classes_of(embeddings: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Rows with their class hashes, usable classes (node, least_id, copies, vector), and the dimension."""
    rows = embeddings.select("vec_id", "embedding")
    usable = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall(
        "embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    rows = rows.select("vec_id", F.when(usable, F.transform("embedding", lambda v: v.cast("double") + F.lit(0.0))).alias("vector"))
    common = rows.where("vector is not null").groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dimension = common["d"] if common else 0
    rows = rows.withColumn("vector", F.when(F.size("vector") == dimension, F.col("vector")))
    rows = rows.withColumn("a", F.xxhash64("vector")).withColumn("b", F.xxhash64(F.lit(1), F.reverse("vector")))
    classes = (rows.where("vector is not null").groupBy("a", "b")
               .agg(F.min("vec_id").alias("least_id"), F.max((F.col("vec_id") % 50 == 0).cast("int")).alias("is_query"), F.count("*").alias("copies"), F.first("vector").alias("vector")))
    classes = stored(classes.withColumn("node", F.xxhash64("a", "b")), "vectors")
    return rows.select("vec_id", "a", "b", F.col("vector").isNotNull().alias("usable")), classes, dimension


def unit(table, column: str = "vector") -> np.ndarray:
    x = matrix(pa.table(table) if not isinstance(table, pa.Table) else table, column).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def as_table(batch: pa.RecordBatch) -> pa.Table:
    return pa.Table.from_batches([batch])


def _gather(rows: list, dimension: int) -> np.ndarray:
    x = np.array([r.vector for r in rows], dtype=np.float64).reshape(len(rows), dimension)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_index(classes: DataFrame, dimension: int, sample: int = SAMPLE) -> MultiIndex:
    bounded = min(sample, max(256, (1 << 24) // max(1, 8 * dimension)))
    rows = classes.orderBy(F.xxhash64(F.lit(7), F.col("node"))).limit(bounded).select("vector").collect()
    codes = 1
    while codes < MAX_CODES and (2 * codes) ** 2 * CELL_VECTORS <= classes.count():
        codes *= 2
    x = _gather(rows, dimension)
    half = (dimension + 1) // 2
    return MultiIndex(codebook(x[:, :half], codes), codebook(x[:, half:], codes) if dimension > 1 else np.zeros((1, 0)))


def _sampled(classes: DataFrame) -> DataFrame:
    return classes.orderBy(F.desc("is_query"), F.xxhash64(F.lit(8), F.col("node")), "node")


def _most_queries(dimension: int) -> int:
    return min(MAX_QUERIES, max(256, (1 << 24) // max(1, 8 * dimension)))


def _true_links(classes: DataFrame, rows: list, index: MultiIndex, dimension: int, link: float) -> DataFrame:
    """query (node), rank (visits before the cell of the linked class), n (linked classes there), copies (their rows), by blocks of all classes.

    A query's match with itself is no link.
    """
    sent = classes.sparkSession.sparkContext.broadcast((np.array([r.node for r in rows], dtype=np.int64), _gather(rows, dimension), index))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, queries, own = sent.value
        for batch in batches:
            x, x_node, x_copies = unit(as_table(batch)), batch.column("node").to_numpy(), batch.column("copies").to_numpy()
            home = own.home(x)
            for at in range(0, len(nodes), 512):
                q, q_node = queries[at:at + 512], nodes[at:at + 512]
                query, row = np.nonzero((q @ x.T >= link) & (q_node[:, None] != x_node[None, :]))
                cell, place, n = np.unique(np.stack([query, home[row]]), axis=1, return_inverse=True, return_counts=True)
                rank = []
                if len(query):
                    a, b = own.distances(q)
                    b_sorted = np.sort(b, axis=1)
                    total = a[cell[0], cell[1] // b.shape[1]] + b[cell[0], cell[1] % b.shape[1]]
                    rank = [int(sum(np.searchsorted(b_sorted[k], t - a[k], side="left"))) for k, t in zip(cell[0], total)]
                copies = np.bincount(place.ravel(), weights=x_copies[row], minlength=len(n)).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"query": pa.array(q_node[cell[0]], pa.int64()), "rank": pa.array(rank, pa.int64()), "n": pa.array(n, pa.int64()), "copies": pa.array(copies)})

    return classes.select("node", "copies", "vector").mapInArrow(compare, "query long, rank long, n long, copies long")


def visits_needed(classes: DataFrame, index: MultiIndex, dimension: int, target: float, link: float, sample_queries: int) -> int:
    """Visits that find ``target`` of the true links of sampled queries, by comparing these with all vectors in blocks."""
    every, most = classes.count(), max(sample_queries, _most_queries(dimension))
    done, upto, found = 0, sample_queries, {}
    while True:
        rows = _sampled(classes).limit(upto).select("node", "vector").collect()[done:]
        for r in _true_links(classes, rows, index, dimension, link).groupBy("rank").agg(F.sum("n").alias("n")).collect():
            found[r["rank"]] = found.get(r["rank"], 0) + r.n
        done, total = done + len(rows), sum(found.values())
        if total >= LEAST_LINKS or done >= min(every, most):
            break
        upto = min(most, 4 * upto)
    if total < LEAST_LINKS and done < every:  # too few to tell the share that is missed
        return max(FEW_VISITS, 2 * (max(found, default=0) + 1))
    seen = 0
    for rank in sorted(found):
        seen += found[rank]
        if seen >= target * total:
            return max(MIN_VISITS, rank + 1)
    return MIN_VISITS


def recall(embeddings: DataFrame, linked: DataFrame, link: float = LINK, queries: int = SAMPLE_QUERIES) -> tuple[int, int]:
    """Links that ``linked`` counts for sampled classes, and their true links by comparison with all vectors; copies are left out of both."""
    _, classes, dimension = classes_of(embeddings)
    rows = _sampled(classes.where("least_id is not null")).limit(min(queries, _most_queries(dimension))).select("node", "least_id", "copies", "vector").collect()
    if not rows:
        return 0, 0
    flat = MultiIndex(np.zeros((1, (dimension + 1) // 2)), np.zeros((1, dimension // 2)))
    true = {r["query"]: r.copies for r in _true_links(classes, rows, flat, dimension, link).groupBy("query").agg(F.sum("copies").alias("copies")).collect()}
    counted = {}
    for r in linked.where(F.col("vec_id").isin([r.least_id for r in rows])).select("vec_id", "n_links").distinct().collect():
        counted.setdefault(r.vec_id, []).append(r.n_links)
    sure = [r for r in rows if len(counted.get(r.least_id, ())) == 1]  # an id of rows with different vectors tells nothing
    return sum(counted[r.least_id][0] - r.copies + 1 for r in sure), sum(true.get(r.node, 0) for r in sure)


def _block_links(table: pa.Table, link: float) -> Iterator[pa.RecordBatch]:
    """Counts and spanning edges of one block of residents and the visitors of their cell."""
    visitor = table.column("visitor").to_numpy(zero_copy_only=False).astype(bool)
    res, vis = table.filter(pa.array(~visitor)), table.filter(pa.array(visitor))
    if not res.num_rows or not vis.num_rows:
        return
    y, y_node, y_copies = unit(res), res.column("node").to_numpy(), res.column("copies").to_numpy()
    y_visits, cell = matrix(res, "cells"), table.column("cell")[0].as_py()
    x_node, x_copies, x_home = vis.column("node").to_numpy(), vis.column("copies").to_numpy(), vis.column("home").to_numpy()
    y_links = np.zeros(len(y), dtype=np.int64)
    label = np.arange(len(y))  # of each resident: smallest resident linked through visitors
    for at in range(0, len(x_node), 512):
        part = slice(at, at + 512)
        hit = unit(vis.slice(at, 512)) @ y.T >= link
        hit &= x_node[part, None] != y_node[None, :]
        i, j = np.nonzero(hit)
        if not len(i):
            continue
        links = np.bincount(i, weights=y_copies[j], minlength=hit.shape[0]).astype(np.int64)
        one_way = x_home[part][i] != cell  # a resident of this cell is met as a visitor too
        for k in range(y_visits.shape[1]):
            one_way &= y_visits[j, k] != x_home[part][i]
        np.add.at(y_links, j[one_way], x_copies[at + i[one_way]])
        before = label
        while True:  # residents that share a visitor get the smallest label among them
            low = np.full(hit.shape[0], len(y))
            np.minimum.at(low, i, label[j])
            new = label.copy()
            np.minimum.at(new, j, low[i])
            if (new == label).all():
                break
            label = new
        some = np.flatnonzero(links)
        yield _found(x_node[at + some], links[some], y_node[low[some]])
        moved = label != before
        if moved.any():  # residents and visitors that were given the old label go with the new one
            old, now = np.unique(np.stack([before[moved], label[moved]]), axis=1)
            yield _found(y_node[old], np.zeros(len(old), dtype=np.int64), y_node[now])
    touched = np.flatnonzero((y_links > 0) | (label != np.arange(len(y))))
    if len(touched):
        yield _found(y_node[touched], y_links[touched], y_node[label[touched]])


def _found(node, links, other) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(node), pa.array(links), pa.array(other)], names=["node", "links", "other"])


def link_vectors(embeddings: DataFrame, link: float = LINK, target: float = TARGET_RECALL, sample: int = SAMPLE,
                 sample_queries: int = SAMPLE_QUERIES) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    spark = embeddings.sparkSession
    rows, classes, dimension = classes_of(embeddings)
    if not dimension:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    index = fit_index(classes, dimension, sample)
    count = visits_needed(classes, index, dimension, target, link, sample_queries)
    sent = spark.sparkContext.broadcast(index)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                cells = sent.value.visits(unit(as_table(part)), count)
                ends = pa.array(np.arange(len(cells) + 1) * cells.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cells[:, 0]), pa.ListArray.from_arrays(ends, pa.array(cells.ravel()))], names=[*part.schema.names, "home", "cells"])

    filed = stored(classes.select("node", "copies", "vector").mapInArrow(file, "node long, copies long, vector array<double>, home long, cells array<long>"), "vector-cells")
    sizes = filed.select("home", F.explode("cells").alias("cell")).groupBy("cell").agg(
        F.count("*").alias("n_visitors"), F.sum((F.col("home") == F.col("cell")).cast("long")).alias("n_residents")).where("n_residents > 0")
    sizes = stored(sizes.select(F.col("cell").alias("s_cell"), F.ceil(F.col("n_residents") / RESIDENTS).cast("int").alias("r_blocks"),
                                F.ceil(F.col("n_visitors") / VISITORS).cast("int").alias("v_blocks")), "cell-sizes")
    place = lambda blocks: F.pmod(F.xxhash64("node"), F.col(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    residents = (filed.join(sizes, F.col("home") == F.col("s_cell"))
                 .select(F.col("home").alias("cell"), place("r_blocks").alias("r"), every("v_blocks").alias("v"), F.lit(0).alias("visitor"), "node", "copies", "home", "vector", "cells"))
    visitors = (filed.select("node", "copies", "home", "vector", F.explode("cells").alias("cell")).join(sizes, F.col("cell") == F.col("s_cell"))
                .select("cell", every("r_blocks").alias("r"), place("v_blocks").alias("v"), F.lit(1).alias("visitor"), "node", "copies", "home", "vector",
                        F.array().cast("array<long>").alias("cells")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in key_runs(batches, ("cell", "r", "v")):
            yield from _block_links(block, link)

    found = stored(residents.unionAll(visitors).repartition("cell", "r", "v").sortWithinPartitions("cell", "r", "v")
                   .mapInArrow(compare, "node long, links long, other long"), "vector-links")
    links = found.groupBy(F.col("node").alias("l_node")).agg(F.sum("links").alias("links"))
    roots = connected_components(found, "node", "other").select(F.col("node").alias("c_node"), "root")
    named = (classes.select("a", "b", "node", "least_id", "copies").join(links, F.col("node") == F.col("l_node"), "left")
             .join(roots, F.col("node") == F.col("c_node"), "left").withColumn("root", F.coalesce("root", "node")))
    ids = named.groupBy(F.col("root").alias("i_root")).agg(F.min("least_id").alias("c_id"))
    named = (named.join(ids, F.col("root") == F.col("i_root"))
             .select(F.col("a").alias("k_a"), F.col("b").alias("k_b"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), "c_id"))
    out = rows.join(named, F.col("usable") & (F.col("a") == F.col("k_a")) & (F.col("b") == F.col("k_b")), "left")
    component = F.when(F.col("usable"), F.col("c_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.col("vec_id").eqNullSafe(component).alias("kept"))
