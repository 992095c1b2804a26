"""Plan-shape guards for the flagship: pruned scan, one hash shuffle on site,
signals fused into whole-stage codegen with the partial aggregate."""

from sitelens.operators import rules
from sitelens.sources import fixtures


def _plan(spark, df):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_rule_results_plan_shape(spark, sf_small):
    plan = _plan(spark, rules.rule_results(fixtures.site_pages(spark, sf_small)))
    scan = [line for line in plan.splitlines() if "FileScan parquet" in line]
    assert len(scan) == 1 and "[doc_id" in scan[0] and "lang" not in scan[0] and "n_chars" not in scan[0]
    assert plan.count("hashpartitioning(site") == 1          # the only data shuffle of the report
    lines = plan.splitlines()
    partial = [i for i, line in enumerate(lines) if "HashAggregate" in line and "partial_" in line]
    assert partial and lines[partial[0] + 1].strip().startswith("+- *(")   # signals fused (codegen) under it


def test_only_a_one_split_table_is_spread(spark):
    from sitelens.session import spread
    wide = spark.range(0, 1000, numPartitions=2)
    assert spread(wide) is wide                                  # several splits: unchanged, no shuffle, on any cluster
    assert spread(spark.range(0, 1000, numPartitions=1)).rdd.getNumPartitions() > 1


def _exchanges(df):
    from sitelens.operators import rules  # noqa: F401
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("Join"), plan


def test_requests_and_rewrites_join_once(spark, sf_small):
    from sitelens.operators import diagnose, rewrites
    from sitelens.sources import fixtures
    pages = fixtures.site_pages(spark, sf_small)
    assert _exchanges(diagnose.page_type(pages))[0] == 0
    assert _exchanges(diagnose.rewrite_requests(pages))[0] == 1            # the site's terminology row
    accepted = rewrites.accept_rewrites(fixtures.rewrites(spark, sf_small), pages, "2026-01-15")
    joins, plan = _exchanges(accepted)
    assert joins == 1                                                       # flags of the originals, without their text
