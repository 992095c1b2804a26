"""Sharding by proportional stratified interleaving.

Rows of each source are put in a seeded random order; the row of rank r among
n rows of its source gets the fractional rank (r - u) / n, with a seeded offset
u between 0 and 1 for each source, so that very many small sources are spread
over the line instead of meeting in its middle.  Sorting all rows by it
interleaves the sources in proportion, so any contiguous cut holds the mixture
of the whole corpus to within a row or so per source.  The sorted
order is cut into shards whose row counts differ by at most one.

Ranks are taken in buckets (a source may hold a third of all rows): the seeded
order is uniform, so its value range splits every source evenly, and rank =
rows of the source in lower buckets + place in the own bucket.  The same is
done for the global order.  Only narrow rows (no text) are shuffled.

Defined results: null source is a source of its own; a text's size is its UTF-8 bytes plus 1 (null: 1);
rows that share a doc_id are ordered by checksum and size; an empty table
gives an empty result; columns that are not named in the signature are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc32_utf8, stored

BUCKET_ROWS = 2_000
MAX_BUCKETS = 65_536
OFFSETS = 1 << 20


def assign_shards(docs: DataFrame, n_shards: int = 8, seed: int = 17) -> DataFrame:
    """doc_id, source, size, text_crc32, frac (fractional rank), position, shard, slot."""
    rows = docs.select(
        "doc_id", "source",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        crc32_utf8(F.col("text")).alias("text_crc32"),
        F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")).alias("shuffled"))
    total = docs.count()
    buckets = min(MAX_BUCKETS, max(16, total // BUCKET_ROWS))
    # the shuffled order is a uniform signed 64-bit value: its high part names the bucket
    rows = rows.withColumn("bucket", F.floor((F.shiftright("shuffled", 32) + F.lit(2**31)) * buckets / F.lit(2**32)))
    order = ["shuffled", "doc_id", "text_crc32", "size"]

    by_source = Window.partitionBy("source")
    counts = (rows.groupBy("source", "bucket").agg(F.count("*").alias("n"))
              .withColumn("before", F.coalesce(F.sum("n").over(by_source.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
              .withColumn("n_source", F.sum("n").over(by_source))
              .select(F.col("source").alias("c_source"), F.col("bucket").alias("c_bucket"), "before", "n_source"))
    offset = (F.pmod(F.xxhash64(F.lit(seed), F.lit("offset"), F.col("source")), F.lit(OFFSETS)) + 0.5) / OFFSETS
    ranked = (rows.withColumn("place", F.row_number().over(Window.partitionBy("source", "bucket").orderBy(*order)))
              .join(counts, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("bucket") == F.col("c_bucket")))
              .withColumn("frac", (F.col("before") + F.col("place") - offset) / F.col("n_source")))
    ranked = stored(ranked.select("doc_id", "source", "size", "text_crc32", "shuffled", "frac"), "shard-ranks")

    ranked = ranked.withColumn("bucket", F.floor(F.col("frac") * buckets))
    ends = (ranked.groupBy("bucket").agg(F.count("*").alias("n"))
            .select(F.col("bucket").alias("c_bucket"),
                    F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")))
    placed = (ranked.withColumn("place", F.row_number().over(Window.partitionBy("bucket").orderBy("frac", *order)))
              .join(ends, F.col("bucket") == F.col("c_bucket"))
              .withColumn("position", F.col("before") + F.col("place") - 1))
    shard = F.expr(f"cast((position * {n_shards}) div {max(total, 1)} as int)")
    return (placed.withColumn("shard", shard)
            .withColumn("slot", F.col("position") - F.expr(f"(cast(shard as bigint) * {total} + {n_shards - 1}) div {n_shards}"))
            .select("doc_id", "source", "size", "text_crc32", "frac", "position", "shard", "slot"))
