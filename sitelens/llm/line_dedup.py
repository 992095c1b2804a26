"""Line dedup by overlapping three-line windows.

Every run of three consecutive lines (lines without a word are left out of the
count and always stay) is hashed.  A window that occurs more than once keeps
its first occurrence, by (doc_id, line); every line covered by a later
occurrence goes, also where occurrences overlap.  The first occurrence of a
line in the corpus is never covered by a later one, so no line content is lost
from the corpus as a whole.

Only hashes move to find repeats: one grouped minimum per window hash
(pre-aggregated before the shuffle, so a passage shared by a third of all
documents costs one row per task) and a join back to the window rows.  Texts
move once, to the positions that were found.

Defined results: null text stays null, with 0 lines; texts of fewer than three
lines with a word have no window and stay as they are; equal rows (same doc_id
and text) count as one document and do not remove each other's lines, rows that
share a doc_id only are ordered by a hash of the row; other columns pass
through, and those with the names of added columns are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_key, stored

WINDOW = 3
WORD = r"[^\x20\x09-\x0D]"
ADDED = ["n_lines", "n_removed", "removed"]


def _numbered(hashed: bool) -> Column:
    """Lines with a word: their number in the text and their hash."""
    line = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("i"), F.when(x.rlike(WORD), F.md5(x.cast("binary")) if hashed else F.lit("")).alias("h")))
    return F.filter(line, lambda x: x["h"].isNotNull())


def line_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, key, at (window number in the document, from 0), covers (numbers of its lines), hash (16 bytes)."""
    rows = docs.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("key"), _numbered(True).alias("lines"))
    # `lines` stands more than once below, so that it stays a column of its own and is not computed for every window
    windows = F.when(F.size("lines") >= window, F.transform(
        F.sequence(F.lit(1), F.size("lines") - window + 1), lambda k: F.struct(
            F.transform(F.slice("lines", k, window), lambda x: x["i"]).alias("covers"),
            F.unhex(F.md5(F.array_join(F.transform(F.slice("lines", k, window), lambda x: x["h"]), "").cast("binary"))).alias("hash"))))
    return (rows.select("doc_id", "key", F.posexplode_outer(windows).alias("at", "w")).where(F.col("w").isNotNull())
            .select("doc_id", "key", "at", "w.covers", "w.hash"))


def covered_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, key, removed: the numbers of the lines that later occurrences cover, per document that has any."""
    found = stored(line_windows(docs, window), "line-windows")
    place = F.struct("doc_id", "key", "at")
    firsts = (found.groupBy(F.col("hash").alias("w_hash")).agg(F.count("*").alias("n"), F.min(place).alias("first"))
              .where("n > 1").select("w_hash", "first"))
    later = found.join(firsts, F.col("hash") == F.col("w_hash")).where(~place.eqNullSafe(F.col("first")))
    return later.groupBy("doc_id", "key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("covers")))).alias("removed"))


def dedup_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """All columns of ``docs``, the text rid of later occurrences, plus n_lines, n_removed, removed (line numbers)."""
    names = [c for c in docs.columns if c not in ADDED]
    covered = covered_lines(docs, window).select(F.col("doc_id").alias("_c_id"), F.col("key").alias("_c_key"), F.col("removed").alias("_removed"))
    rows = docs.select(*names, row_key(F.col("doc_id"), F.col("text")).alias("_key"))
    rows = rows.join(covered.hint("shuffle_hash"), (F.col("_key") == F.col("_c_key")) & F.col("doc_id").eqNullSafe(F.col("_c_id")), "left")
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(_numbered(False))).cast("long")
    # lines and removed numbers in one sorted array, the removed ones first: a line goes if the entry before has its number
    marks = F.transform("_removed", lambda i: F.struct(i.alias("i"), F.lit(0).alias("is_line"), F.lit("").alias("line")))
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("i"), F.lit(1).alias("is_line"), x.alias("line")))
    rows = rows.withColumn("_merged", F.when(F.col("_removed").isNotNull(), F.array_sort(F.concat(marks, lines))))
    stay = F.filter("_merged", lambda x, k: (x["is_line"] == 1) & ((k == 0) | (F.col("_merged")[k - 1]["i"] != x["i"])))
    text = F.when(F.col("_removed").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda x: x["line"]), "\n"))
    return rows.select(*[text.alias(c) if c == "text" else F.col(c) for c in names], n_lines.alias("n_lines"),
                       F.coalesce(F.size("_removed"), F.lit(0)).cast("long").alias("n_removed"),
                       F.coalesce("_removed", F.array().cast("array<int>")).alias("removed"))
