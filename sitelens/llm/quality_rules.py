"""Quality rules by a hashed n-gram logistic regression.

Fixed base rules (few words, repeated three-word windows) reject outright; what
they leave is judged by a logistic regression on hashed word and character
n-grams, trained on labelled rows, its scores calibrated to probabilities on
labelled rows that it was not trained on, and compared with a fixed threshold.

The model is fitted on a bounded sample: the ``max_labelled`` labelled rows
with the smallest hash of doc_id, whole texts.  That bounds what reaches the
driver and what is broadcast (3 * 2**bits weights).  Everything else covers
every row, in Arrow batches cut into pieces of about half a MB of text.

Defined results: null text counts as empty (no words, base rules fail); without
labelled rows of both classes the verdict is the base rules' alone
(probability = share of label 1, or 1 without labels); labels with null in
doc_id or quality are left out, and of several labels of a doc_id the smallest
holds; rows that share a doc_id are scored one by one, and one of them is
learned from; ids may be of any type; other columns of the tables are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .quality_features import frequencies, mean_by_text, ngrams
from .textbatch import SPACE, U64, chunks, split_words, utf8

BITS = 17
MAX_LABELLED = 3_000
THRESHOLD = 0.5
MIN_WORDS = 50
#: Symbols that count as such: # * $ % & | < >
SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, limit: int) -> DataFrame:
    """doc_id, text, target of the ``limit`` labelled doc_ids with the smallest hash (a bounded broadcast).

    Of rows that share a doc_id one counts, that with the smallest hash of its text, so the sample's rows are bounded too.
    """
    known = (labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull()).groupBy("doc_id").agg(F.min(target).alias("target"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit))
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    one = F.min(F.struct(F.xxhash64("text").alias("hash"), "text", "target")).alias("one")
    return rows.groupBy("doc_id").agg(one).select("doc_id", "one.text", "one.target")


@dataclass
class Model:
    bits: int
    weights: np.ndarray  # float32, one block of 2**bits per kind of n-gram
    bias: float
    slope: float         # calibration: p = 1 / (1 + exp(-(slope * z + shift)))
    shift: float

    def probability(self, texts: list[bytes]) -> np.ndarray:
        z = np.full(len(texts), self.bias)
        for k, (bucket, owner) in enumerate(ngrams(texts, self.bits)):
            z += mean_by_text(self.weights[k << self.bits:][bucket], owner, len(texts))
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -35, 35)))


def collect_features(sample: DataFrame, bits: int) -> list:
    """The sample's hashed features on the driver (bounded by the sample's size)."""
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 200):
            texts = utf8(batch.column("text"))
            for a, b in chunks(texts):
                found = frequencies(texts[a:b], bits)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").slice(a, b - a),
                    "target": batch.column("target").slice(a, b - a).cast(pa.int32()),
                    "feature": pa.array([f.tobytes() for f, _ in found], pa.binary()),
                    "value": pa.array([v.tobytes() for _, v in found], pa.binary())})

    rows = sample.mapInArrow(extract, f"doc_id {dict(sample.dtypes)['doc_id']}, target int, feature binary, value binary").collect()
    return sorted(((r.doc_id, r.target, np.frombuffer(r.feature, np.int32), np.frombuffer(r.value, np.float32)) for r in rows),
                  key=lambda r: (r[0], r[1], r[2].tobytes()))


def fit(rows: list, bits: int, epochs: int = 40, rate: float = 8.0) -> Model:
    """Full-batch Adagrad on four fifths of the rows, Platt scaling on the rest."""
    width = len(("word", "pair", "char")) << bits
    y = np.array([r[1] > 0 for r in rows], dtype=float)
    if len(rows) == 0 or y.min() == y.max():
        share = float(y.mean()) if len(rows) else 1.0
        return Model(bits, np.zeros(width, np.float32), 0.0, 0.0, 35.0 if share == 1 else -35.0 if share == 0 else float(np.log(share / (1 - share))))
    train = np.arange(len(rows)) % 5 != 0
    parts = _parts(rows)
    weights, bias = np.zeros(width), float(np.log(y.mean() / (1 - y.mean())))
    square, square_bias = np.full(width, 1e-8), 1e-8
    importance = np.where(train, np.where(y > 0, 0.5 / max(1, (y * train).sum()), 0.5 / max(1, ((1 - y) * train).sum())), 0)
    for _ in range(epochs):
        z = _margins(parts, weights, len(rows)) + bias
        error = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y) * importance
        grad = 1e-9 * weights
        for owner, feature, value in parts:
            grad += np.bincount(feature, weights=error[owner] * value, minlength=width)
        square += grad * grad
        weights -= rate * grad / np.sqrt(square)
        square_bias += error.sum() ** 2
        bias -= 0.5 * error.sum() / np.sqrt(square_bias)
    z = _margins(parts, weights, len(rows)) + bias
    slope, shift = platt(z[~train], y[~train]) if 0 < y[~train].mean() < 1 else (1.0, 0.0)
    return Model(bits, weights.astype(np.float32), bias, slope, shift)


def _parts(rows: list, features: int = 500_000) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row number, feature and value of the sample's features, in runs of about so many: the driver's work arrays stay small."""
    ends = np.cumsum([len(r[2]) for r in rows])
    cuts = np.searchsorted(ends, np.arange(0, ends[-1] + features, features))
    return [(np.repeat(np.arange(a, b, dtype=np.int32), [len(r[2]) for r in rows[a:b]]), np.concatenate([r[2] for r in rows[a:b]]), np.concatenate([r[3] for r in rows[a:b]]))
            for a, b in zip([0, *cuts[1:]], [*cuts[1:], len(rows)]) if a < b]


def _margins(parts: list, weights: np.ndarray, n: int) -> np.ndarray:
    z = np.zeros(n)
    for owner, feature, value in parts:
        z += np.bincount(owner, weights=weights[feature] * value, minlength=n)
    return z


def platt(z: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift of the logistic calibration, by Newton's method on Platt's smoothed targets."""
    up, down = y.sum(), (1 - y).sum()
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    spread = max(float(np.std(z)), 1e-9)
    x, a, b = z / spread, 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -35, 35)))
        g, h = p - t, np.maximum(p * (1 - p), 1e-6)
        haa, hab, hbb = (h * x * x).sum() + 1e-3, (h * x).sum(), h.sum() + 1e-3
        ga, gb = (g * x).sum(), g.sum()
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - np.clip(da, -2, 2), b - np.clip(db, -2, 2)
        if abs(da) + abs(db) < 1e-9:
            break
    return (a / spread, b) if a > 0 else (1.0, 0.0)


def base_counts(texts: list[bytes]) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    n = len(texts)
    w = split_words(texts, SPACE, lower=False)
    owner = np.searchsorted(w.text_start, np.arange(len(w.buf)), side="right") - 1
    leads = (w.buf & 0xC0) != 0x80  # bytes that begin a code point
    out = {"n_words": np.bincount(w.text, minlength=n),
           "word_chars": np.bincount(owner[leads & ~SPACE[w.buf]], minlength=n),
           "n_symbols": np.bincount(owner[SYMBOL[w.buf]], minlength=n)}
    dup = np.zeros(n, dtype=np.int64)
    for i, t in enumerate(texts):
        lines = [x for x in t.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
        dup[i] = len(lines) - len(set(lines))
    out["n_dup_lines"] = dup
    repeat = np.zeros(n, dtype=np.int64)
    at = np.flatnonzero(w.text[2:] == w.text[:-2])
    if len(at):
        h = (w.hash[at] * U64(0x9E3779B97F4A7C15) + w.hash[at + 1]) * U64(0xD6E8FEB86659FD93) + w.hash[at + 2] + w.text[at].astype(U64) * U64(0xA0761D6478BD642F)
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        twice = at[order[np.concatenate((same, [False])) | np.concatenate(([False], same))]]
        hit = np.zeros(len(w.text), dtype=bool)
        for k in range(3):
            hit[twice + k] = True
        repeat = np.bincount(w.text[hit], minlength=n)
    out["n_repeat_words"] = repeat
    return out


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, bits: int = BITS,
                  max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, the base counts, base_failed, probability, kept - one row per row of ``docs``, by its doc_id and text."""
    spark = docs.sparkSession
    model = fit(collect_features(labelled_sample(docs, labels, "quality", max_labelled), bits), bits)
    sent = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = utf8(batch.column("text"))
            for a, b in chunks(texts):
                c = base_counts(texts[a:b])
                failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > 50 * c["n_words"])
                p = sent.value.probability(texts[a:b])
                rest = batch.drop_columns(["text"]) if "text" in batch.schema.names else batch
                cols = {name: rest.column(name).slice(a, b - a) for name in rest.schema.names}
                cols |= {k: pa.array(v.astype(np.int64)) for k, v in c.items()}
                cols |= {"base_failed": pa.array(failed), "probability": pa.array(p), "kept": pa.array(~failed & (p >= threshold))}
                yield pa.RecordBatch.from_pydict(cols)

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(
        score, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
               "base_failed boolean, probability double, kept boolean")


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, bits: int = BITS, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns as they are: the texts stay in the batch that judged them."""
    model = fit(collect_features(labelled_sample(docs, labels, "quality", max_labelled), bits), bits)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = utf8(batch.column("text"))
            for a, b in chunks(texts):
                c = base_counts(texts[a:b])
                stays = (c["n_words"] >= MIN_WORDS) & (100 * c["n_repeat_words"] <= 50 * c["n_words"])
                stays &= sent.value.probability(texts[a:b]) >= threshold
                yield batch.slice(a, b - a).filter(pa.array(stays))

    return docs.mapInArrow(keep, docs.schema)
