"""Quality classifier by nearest-neighbour voting among latent-semantic vectors.

Texts become vectors of hashed terms (lower-case words and three-character
runs, damped counts, unit length).  A truncated singular value decomposition of
the labelled sample's vectors gives the latent space; the labelled rows'
latent vectors are broadcast.  Every document is projected and compared with
every labelled vector by blocked matrix products (exact cosines, no index); its
nearest neighbours vote, weighted by similarity.

The labelled rows are the ``max_labelled`` ones with the smallest hash of
doc_id among those whose crc32(doc_id as text) mod 5 is not 0: the bound on the
sample bounds the broadcast (2**bits * rank + max_labelled * rank numbers).
Scoring reads whole texts of all rows.

Defined results: null text counts as empty; texts without terms, and all texts
when no row is labelled, get the sample's share of label 1 (1/2 without
labels); ties among neighbours are broken by the order of doc_id; rows that
share a doc_id are scored one by one; a row without doc_id is not held out;
ids may be of any type; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices
from .quality_features import ngrams
from .quality_rules import labelled_sample
from .textbatch import chunks, utf8

BITS = 13
RANK = 48
NEIGHBOURS = 25
MAX_LABELLED = 2_000
THRESHOLD = 0.3
SHARPNESS = 8
KINDS = ("word", "char")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def term_vectors(texts: list[bytes], bits: int) -> np.ndarray:
    """Dense rows of damped hashed counts: one block of unit length per kind of term."""
    width, blocks = 1 << bits, []
    for bucket, owner in ngrams(texts, bits, KINDS):
        x = np.bincount(owner.astype(np.int64) * width + bucket, minlength=len(texts) * width).reshape(len(texts), width)
        x = np.log1p(x.astype(np.float32))
        blocks.append(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9))
    return np.hstack(blocks)


def pieces(texts: list[bytes], rows: int = 128) -> Iterator[tuple[int, int]]:
    for a, b in chunks(texts):
        yield from ((i, min(i + rows, b)) for i in range(a, b, rows))


@dataclass
class LatentVotes:
    mean: np.ndarray
    basis: np.ndarray      # terms x rank
    vectors: np.ndarray    # labelled rows x rank, unit length
    label: np.ndarray
    prior: float
    bits: int

    def latent(self, x: np.ndarray) -> np.ndarray:
        v = (x - self.mean) @ self.basis
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def score(self, texts: list[bytes], neighbours: int) -> np.ndarray:
        if not len(self.label):
            return np.full(len(texts), self.prior)
        x = term_vectors(texts, self.bits)
        cosine = self.latent(x) @ self.vectors.T
        k = min(neighbours, len(self.label))
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        # each class has the same weight in all, so that the rarer label isn't outvoted by its rarity
        share = np.where(self.label > 0, max(self.prior, 1e-9), max(1 - self.prior, 1e-9))
        weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0).astype(float) ** SHARPNESS / share[near]
        total = weight.sum(axis=1)
        vote = (weight * self.label[near]).sum(axis=1) / np.maximum(total, 1e-12)
        return np.where((total > 1e-12) & x.any(axis=1), vote, self.prior)


def fit(rows: list[tuple[int, int, np.ndarray]], bits: int, rank: int, seed: int = 5) -> LatentVotes:
    """Randomised truncated SVD (range finder with power iterations) of the centred sample."""
    label = np.array([r[1] > 0 for r in rows], dtype=float)
    width = len(KINDS) << bits
    if not rows:
        return LatentVotes(np.zeros(width, np.float32), np.zeros((width, 1), np.float32), np.zeros((0, 1), np.float32), label, 0.5, bits)
    x = np.vstack([r[2] for r in rows])
    mean = x.mean(axis=0)
    x -= mean
    q = np.random.default_rng(seed).standard_normal((width, min(rank + 8, len(rows)))).astype(np.float32)
    for _ in range(3):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    basis = (q @ vt.T)[:, :rank].astype(np.float32)
    v = x @ basis
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    return LatentVotes(mean, basis, v, label, float(label.mean()), bits)


def score_documents(docs: DataFrame, labels: DataFrame, neighbours: int = NEIGHBOURS, rank: int = RANK, bits: int = BITS,
                    max_labelled: int = MAX_LABELLED, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score (higher: label 1 likelier), predicted."""
    spark = docs.sparkSession

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = utf8(batch.column("text"))
            for a, b in pieces(texts):
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(a, b - a), batch.column("target").slice(a, b - a).cast(pa.int32()),
                    pa.array([v.astype(np.float16).tobytes() for v in term_vectors(texts[a:b], bits)], pa.binary())], names=["doc_id", "target", "x"])

    sample = labelled_sample(docs, labels.where(~held_out(F.col("doc_id"))), "quality", max_labelled)
    rows = sample.mapInArrow(extract, f"doc_id {dict(docs.dtypes)['doc_id']}, target int, x binary").collect()
    rows = sorted(((r.doc_id, r.target, np.frombuffer(r.x, np.float16).astype(np.float32)) for r in rows), key=lambda r: (r[0], r[1], r[2].tobytes()))
    sent = spark.sparkContext.broadcast(fit(rows, bits, rank))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = utf8(batch.column("text"))
            for a, b in pieces(texts):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(sent.value.score(texts[a:b], neighbours))], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(score, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
