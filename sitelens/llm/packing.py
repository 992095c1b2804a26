"""Packing along a space-filling curve.

Each document's token ids are hashed and projected to three dimensions (a fixed
pseudo-random projection, mean over its tokens); the point's place on a Hilbert
curve is its key.  Documents are range-sorted by key, laid end to end, and the
line is cut every 2048 tokens: neighbours on the curve share sequences, and
only the last sequence is padded.

Token ids are made once and written to the shared folder.  The sort and the
running totals move narrow rows (key and length); range partitions are told
apart by partition number in a written table, so that totals and order can't
disagree, and documents with equal points are spread by a hash of the row.
Then each document's start on the line is joined back to its ids.

Defined results: null text counts as empty; an empty text is its end token
alone; rows that share a doc_id are packed one by one (equal rows too); an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import row_key, slices, stored
from .word_bpe import tokenizer

SEQUENCE = 2_048
END_ID = 1
DIMENSIONS, CURVE_BITS = 3, 10
SPREAD = 12.0
PIECE_BYTES = 2_000_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def projection(seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((1 << 16, DIMENSIONS)).astype(np.float32)


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of whole coordinates below 2**bits."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):  # undo the curve's rotations and reflections, from the coarsest cell down
        side = np.int64(1) << level
        low = side - 1
        for axis in range(n):
            high = (x[axis] & side) != 0
            swap = np.where(high, 0, (x[0] ^ x[axis]) & low)
            x[0] ^= np.where(high, low, swap)
            x[axis] ^= swap if axis else 0
    for axis in range(1, n):  # Gray code across the axes
        x[axis] ^= x[axis - 1]
    carry = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        carry ^= np.where(x[n - 1] & (np.int64(1) << level), (np.int64(1) << level) - 1, 0)
    x ^= carry
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):  # interleave, the first axis first
        for axis in range(n):
            key = key << 1 | (x[axis] >> level) & 1
    return key


def curve_places(ids: list[np.ndarray], table: np.ndarray) -> np.ndarray:
    point = np.array([table[i].mean(axis=0) if len(i) else np.zeros(DIMENSIONS) for i in ids])
    cells = np.clip((0.5 + 0.5 * np.tanh(point * SPREAD / 2)) * (1 << CURVE_BITS), 0, (1 << CURVE_BITS) - 1).astype(np.int64)
    return hilbert_key(cells, CURVE_BITS)


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, key, place (on the curve), tokens, ids (zstd of uint16): written once."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, table, pack = tokenizer(path), projection(), zstandard.ZstdCompressor(level=1)
        for batch in slices(batches, 2_000):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) <= PIECE_BYTES):
                    size += len(texts[to])
                    to += 1
                ids = bpe.encode(texts[at:to])
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(at, to - at), batch.column("key").slice(at, to - at), pa.array(curve_places(ids, table)),
                    pa.array([len(i) + 1 for i in ids], pa.int64()),
                    pa.array([pack.compress(np.append(i, np.uint16(END_ID)).tobytes()) for i in ids], pa.binary())],
                    names=["doc_id", "key", "place", "tokens", "ids"])
                at = to

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", "text", row_key(F.col("doc_id"), F.col("text")).alias("key"))
    return stored(rows.mapInArrow(encode, f"doc_id {kind}, key long, place long, tokens long, ids binary")
                  .withColumn("row", F.monotonically_increasing_id()), "pack-tokens")


def line_starts(rows: DataFrame) -> DataFrame:
    """row, begin: where each document begins on the line of all tokens."""
    order = ["place", "key", "row"]
    ordered = stored(rows.select(*order, "tokens").repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "pack-order")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (ordered.groupBy("part").agg(F.sum("tokens").alias("n"))
             .select(F.col("part").alias("p_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_begin")))
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (ordered.withColumn("upto", F.sum("tokens").over(inside)).join(parts, F.col("part") == F.col("p_part"))
            .select(F.col("row").alias("l_row"), (F.col("part_begin") + F.col("upto") - F.col("tokens")).alias("begin")))


def pack(docs: DataFrame, tokenizer_path: str | None = None, sequence: int = SEQUENCE) -> DataFrame:
    """Pieces: doc_id, start, length, ids (uint16), ids_crc32, doc_tokens, sequence_id, offset, place."""
    rows = tokenized(docs, tokenizer_path or default_tokenizer())
    placed = rows.join(line_starts(rows).hint("shuffle_hash"), F.col("row") == F.col("l_row")).select("doc_id", "place", "tokens", "begin", "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in slices(batches, 2_000):
            source, out, size = [], [], 0
            for i, (begin, n, packed) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("begin", "tokens", "ids")))):
                ids = np.frombuffer(unpack.decompress(packed), dtype=np.uint16)
                at = 0
                while at < n:
                    place = begin + at
                    length = min(n - at, sequence - place % sequence)
                    piece = ids[at:at + length]
                    source.append(i)
                    out.append((at, length, piece.tobytes(), zlib.crc32(piece.astype("<u4").tobytes()), n, place // sequence, place % sequence))
                    at += length
                    size += 2 * length
                if size > PIECE_BYTES:
                    yield _pieces(batch, source, out)
                    source, out, size = [], [], 0
            if out:
                yield _pieces(batch, source, out)

    kind = dict(docs.dtypes)["doc_id"]
    return placed.mapInArrow(cut, f"doc_id {kind}, place long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def _pieces(batch: pa.RecordBatch, source: list[int], out: list[tuple]) -> pa.RecordBatch:
    rows = pa.array(source, pa.int64())
    columns = list(zip(*out))
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), batch.column("place").take(rows)] + [pa.array(c, k) for c, k in zip(columns, kinds)],
                                      names=["doc_id", "place", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
