"""Analysis history: previous analysis (W2), comparison (J5), trend (W4),
top percent (W5), dashboard (A13), query pass counts (A14), progress stage
(X20), cancellation (F11), durations (X19).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .ranking import with_previous

# FIXED VALUES — progress stages of a running analysis
PROGRESS_STAGES = ["crawling", "analyzing", "scoring", "generating recommendations"]


def previous_analysis(analyses: DataFrame) -> DataFrame:
    """For every analysis, the latest *other* completed and scored analysis
    of the same site (by completed_at, then id) — possibly newer than itself.

    Computed with one window over completed analyses: the site's best and
    second-best (completed_at, id).  Every analysis takes the best unless it
    is the best itself, in which case it takes the second.
    """
    done = analyses.where((F.col("status") == "COMPLETED") & F.col("overall_score").isNotNull())
    top2 = (done.withColumn("_rn", F.row_number().over(
                Window.partitionBy("site_id").orderBy(F.col("completed_at").desc(), F.col("id").desc())))
            .where(F.col("_rn") <= 2))
    best = top2.groupBy("site_id").agg(
        F.max(F.when(F.col("_rn") == 1, F.col("id"))).alias("best_id"),
        F.max(F.when(F.col("_rn") == 2, F.col("id"))).alias("second_id"))
    out = analyses.select("id", "site_id").join(best, "site_id", "left")
    prev = F.when(F.col("id") == F.col("best_id"), F.col("second_id")).otherwise(F.col("best_id"))
    return out.select("id", "site_id", prev.alias("previous_id"))


def compare_analyses(analyses: DataFrame) -> DataFrame:
    """Overall delta and per-component deltas over the current analysis'
    component keys (missing previous component = 0); no previous gives nulls.

    The two latest scored analyses of each site (a bounded aggregate) carry
    their score and components along, so one join compares every analysis.
    """
    done = analyses.where((F.col("status") == "COMPLETED") & F.col("overall_score").isNotNull())
    w = Window.partitionBy("site_id").orderBy(F.col("completed_at").desc(), F.col("id").desc())
    row = F.struct("id", F.col("overall_score").alias("score"), "components")
    top2 = done.select("site_id", row.alias("row"), F.row_number().over(w).alias("_rn")).where(F.col("_rn") <= 2)
    best = top2.groupBy("site_id").agg(F.first(F.when(F.col("_rn") == 1, F.col("row")), ignorenulls=True).alias("one"),
                                       F.first(F.when(F.col("_rn") == 2, F.col("row")), ignorenulls=True).alias("two"))
    j = analyses.select("id", "site_id", "overall_score", "components").join(best, "site_id", "left")
    j = j.withColumn("previous", F.when(F.col("id") == F.col("one.id"), F.col("two")).otherwise(F.col("one")))
    has_prev = F.col("previous.id").isNotNull()
    delta = F.when(has_prev, F.col("overall_score") - F.col("previous.score"))
    comp_delta = F.when(has_prev & F.col("components").isNotNull(), F.transform_values(
        "components", lambda k, v: v - F.coalesce(F.col("previous.components")[k], F.lit(0))))
    return j.select("id", "site_id", F.col("previous.id").alias("previous_id"), "overall_score", F.col("previous.score").alias("previous_score"),
                    delta.alias("delta"), comp_delta.alias("component_deltas"))


def score_trend(history: DataFrame) -> DataFrame:
    """W4 per row: change from the previous score of the same site by (date,
    event_id); 0 when the previous is missing or 0.  A site may hold any share of the rows."""
    rows = with_previous(history.select("site", "date", "event_id", "score"), "site", [F.col("date"), F.col("event_id")], "score", "_prev")
    change = F.when(F.col("_prev").isNull() | (F.col("_prev") == 0), F.lit(0)).otherwise(F.col("score") - F.col("_prev"))
    return rows.select("site", "date", "event_id", "score", change.alias("change"))


def score_trend_summary(history: DataFrame) -> DataFrame:
    """W4 as the site card shows it: current = last score (0 when missing or 0),
    previous = second-to-last score, or the current one when missing or 0;
    trend = current - previous.

    Only the last two scores per site are needed: ``row_number() <= 2`` is cut
    map-side (WindowGroupLimit), so a site with a third of all history rows
    moves at most two rows per map partition.
    """
    w = Window.partitionBy("site").orderBy(F.col("date").desc(), F.col("event_id").desc())
    top2 = history.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= 2)
    agg = top2.groupBy("site").agg(F.max(F.when(F.col("_rn") == 1, F.col("score"))).alias("_last"),
                                   F.max(F.when(F.col("_rn") == 2, F.col("score"))).alias("_prev"))
    current = F.coalesce(F.when(F.col("_last") != 0, F.col("_last")), F.lit(0))
    out = agg.select("site", current.alias("current_score"), "_prev")
    previous = F.when(F.col("_prev").isNotNull() & (F.col("_prev") != 0), F.col("_prev")).otherwise(F.col("current_score"))
    return out.select("site", "current_score", previous.alias("previous_score"),
                      (F.col("current_score") - previous).alias("trend"))


def top_percent(scores: DataFrame, score_col: str = "overall_score") -> DataFrame:
    """W5: 'Top N%' from the percentile rank of the score among all rows (null without a score).

    ``percent_rank`` over the whole table would put every row in one task.
    The rank comes from a histogram: one row per distinct score, ranked over
    these rows and joined back; Spark picks the join by their number.
    """
    hist = scores.where(F.col(score_col).isNotNull()).groupBy(score_col).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy(score_col).rowsBetween(Window.unboundedPreceding, -1)
    ranks = hist.select(F.col(score_col).alias("_score"), F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_below"),
                        F.sum("_n").over(Window.partitionBy()).alias("_total"))
    pr = F.when(F.col("_total") <= 1, F.lit(0.0)).otherwise(F.col("_below") / (F.col("_total") - 1))
    top = F.greatest(F.lit(1), F.ceil((1 - pr) * 100)).cast("int")
    return scores.join(ranks.select("_score", top.alias("top_percent")), F.col(score_col) == F.col("_score"), "left").drop("_score")


def dashboard(sites: DataFrame, scores: DataFrame) -> DataFrame:
    """Mean score (JS rounding: half up), its grade, total pages (null → 0).

    One aggregate over the union of both inputs (no join)."""
    both = scores.select(F.col("overall_score").cast("double").alias("_s"), F.lit(None).cast("long").alias("_p")) \
        .unionByName(sites.select(F.lit(None).cast("double").alias("_s"),
                                  F.coalesce(F.col("page_count"), F.lit(0)).cast("long").alias("_p")))
    agg = both.agg(F.avg("_s").alias("m"), F.coalesce(F.sum("_p"), F.lit(0)).alias("total_pages"))
    mean = F.floor(F.round(F.col("m"), 9) + 0.5).cast("int")
    return agg.select(mean.alias("average_score"), T.grade(mean).alias("grade"), "total_pages")


def query_pass_counts(results: DataFrame, key: str = "analysis_id") -> DataFrame:
    """Passed / failed counts per analysis."""
    return results.groupBy(key).agg(F.count_if(F.col("passed")).alias("passed"),
                                    F.count_if(~F.col("passed")).alias("failed"))


def progress_stage(progress: Column, status: Column) -> Column:
    """Stage name of a RUNNING analysis: stages[min(progress // 25, 3)]."""
    idx = F.least(F.floor(progress / 25), F.lit(3)).cast("int") + 1
    return F.when(status == "RUNNING", F.element_at(F.array(*[F.lit(s) for s in PROGRESS_STAGES]), idx))


def duration_seconds(start: Column, end: Column) -> Column:
    """Rounded seconds between two timestamps; 0 when either is missing."""
    d = F.unix_micros(end) - F.unix_micros(start)
    return F.when(start.isNull() | end.isNull(), F.lit(0)).otherwise(F.round(d / 1e6).cast("long"))


def cancel(analyses: DataFrame) -> DataFrame:
    """QUEUED or RUNNING analyses become CANCELLED."""
    return analyses.withColumn("status", F.when(F.col("status").isin("QUEUED", "RUNNING"), "CANCELLED")
                               .otherwise(F.col("status")))
