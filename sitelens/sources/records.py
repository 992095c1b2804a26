"""Application record tables derived from the driver's TPC-H-like tables.

The reference keeps organizations, sites, analyses, query results and score
history in a relational store.  Here they are DataFrames derived from all
rows of the driver tables (mapping of FIXTURES §4), so their size grows
with the scale factor:

* organizations ← nation, sites ← customer, analyses ← orders,
  query_results ← lineitem, score history ← events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import table_path


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def enforced(rows: DataFrame, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """The rows that fit ``schema`` in its columns and types, and the others (``row`` as JSON, ``reasons``).

    A value that can't be cast and a missing value of a column that may not be
    null are reasons to set a row aside; neither fails the job.  Columns that the
    rows lack count as null, columns that the schema lacks are dropped.
    """
    cells, reasons = [], []
    for f in schema.fields:
        have = f.name in rows.columns
        raw = F.col(f"`{f.name}`") if have else F.lit(None).cast(f.dataType)
        cell = raw.try_cast(f.dataType) if have else raw
        cells.append(cell.alias(f.name))
        if have:
            reasons.append(F.when(raw.isNotNull() & cell.isNull(), F.lit(f"{f.name}: not a {f.dataType.simpleString()}")))
        if not f.nullable:
            reasons.append(F.when(raw.isNull(), F.lit(f"{f.name}: missing")))
    why = F.filter(F.array(*reasons) if reasons else F.array().cast("array<string>"), lambda r: r.isNotNull())
    fits = F.size(why) == 0
    return rows.where(fits).select(*cells), rows.where(~fits).select(F.to_json(F.struct(*rows.columns)).alias("row"), why.alias("reasons"))


def organizations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"),
                    F.when(F.col("n_regionkey") % 2 == 0, "free").otherwise("report").alias("tier"))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per site; ``site`` is the key used by page tables (``src<custkey>``)."""
    c = read(spark, sf_dir, "customer")
    return c.select(
        F.concat(F.lit("src"), F.col("c_custkey").cast("string")).alias("site"),
        F.col("c_custkey").alias("id"),
        F.col("c_nationkey").cast("long").alias("organization_id"),
        F.col("c_name").alias("name"),
        F.concat(F.lit("https://"), F.lower(F.regexp_replace("c_name", "[^A-Za-z0-9]", "")),
                 F.lit(".example.com/")).alias("url"),
        F.col("c_acctbal").cast("long").alias("page_count"),
        F.col("c_mktsegment").alias("segment"))


ANALYSIS_STATUS = {"F": "COMPLETED", "O": "RUNNING", "P": "FAILED"}
COMPONENT_MULT = {"accuracy": 41, "context_utilization": 43, "citation_quality": 47, "code_executability": 53,
                  "structure": 59}


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """analyses ← orders: one analysis per order, site = o_custkey % 200."""
    o = read(spark, sf_dir, "orders")
    status = F.coalesce(F.create_map(*[x for kv in ANALYSIS_STATUS.items() for x in map(F.lit, kv)])[F.col("o_orderstatus")],
                        F.lit("QUEUED"))
    comps = F.create_map(*[x for name, m in COMPONENT_MULT.items()
                           for x in (F.lit(name), ((F.col("o_orderkey") * m) % 101).cast("int"))])
    return o.select(
        F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 200).alias("site_id"), status.alias("status"),
        (F.col("o_orderkey") % 101).cast("int").alias("progress"),
        F.when(status == "COMPLETED", ((F.col("o_orderkey") * 37) % 101).cast("int")).alias("overall_score"),
        F.when(status == "COMPLETED", comps).alias("components"),
        F.col("o_orderdate").alias("created_at"),
        F.when(status == "COMPLETED", F.col("o_orderdate")).alias("completed_at"))


def query_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_results ← lineitem (one row per line item, all rows)."""
    li = read(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("analysis_id"), F.col("l_linenumber").alias("line"),
        F.concat(F.lit("Query about: part "), F.col("l_partkey").cast("string")).alias("query_text"),
        F.element_at(F.array(F.lit("api"), F.lit("concept"), F.lit("howto")), (F.col("l_partkey") % 3 + 1).cast("int")).alias("category"),
        F.element_at(F.array(F.lit("easy"), F.lit("medium"), F.lit("hard")), (F.col("l_suppkey") % 3 + 1).cast("int")).alias("difficulty"),
        (F.col("l_returnflag") != "R").alias("passed"),
        (F.col("l_discount") * 10).alias("confidence"),
        (F.col("l_quantity") * 120).cast("int").alias("latency_ms"),
        (1 - F.col("l_discount")).alias("accuracy_score"),
        (1 - F.col("l_tax") * 5).alias("retrieval_precision"),
        (F.lit(0.7) + F.col("l_tax") * 2).alias("citation_accuracy"),
        F.when((F.col("l_linestatus") == "F") & (F.col("l_linenumber") == 1), F.lit(None).cast("boolean"))
         .otherwise(F.col("l_linenumber") % 3 != 0).alias("code_valid"))


def score_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score history ← events: site = user_id % 50, date = ts, score = value % 101."""
    e = read(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("site"), (F.col("user_id") % 50).cast("string")).alias("site"),
                    F.col("ts").alias("date"), F.col("event_id"),
                    (F.abs(F.col("value")).cast("long") % 101).cast("int").alias("score"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """users ← supplier."""
    s = read(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("id"),
                    F.concat(F.lower(F.regexp_replace("s_name", "[^A-Za-z0-9]", "")), F.lit("@example.com")).alias("email"),
                    F.col("s_name").alias("name"), F.col("s_nationkey").cast("long").alias("organization_id"),
                    (F.col("s_acctbal") > 0).alias("is_active"))


RECOMMENDATION_STATUS = ["pending", "in_progress", "completed", "dismissed"]
LEVELS = ["high", "medium", "low"]


def recommendations_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recommendations ← part (site = p_partkey % 200)."""
    p = read(spark, sf_dir, "part")
    pick = lambda arr, idx: F.element_at(F.array(*[F.lit(x) for x in arr]), (idx % len(arr) + 1).cast("int"))
    return p.select(
        F.col("p_partkey").alias("id"), (F.col("p_partkey") % 200).alias("site_id"),
        (F.col("p_size") % 5 + 1).cast("int").alias("priority"), pick(LEVELS, F.col("p_partkey")).alias("impact"),
        pick(LEVELS, F.col("p_size")).alias("effort"),
        F.lower(F.split(F.col("p_type"), " ")[0]).alias("category"),
        pick(RECOMMENDATION_STATUS, F.col("p_partkey")).alias("implementation_status"),
        F.round(F.col("p_retailprice") % 10, 2).alias("estimated_score_improvement"))


OPTIMIZATION_STATES = ["complete", "failed", None, "running"]


def assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """assessments ← customer (one per site)."""
    c = read(spark, sf_dir, "customer")
    state = F.element_at(F.array(*[F.lit(x).cast("string") for x in OPTIMIZATION_STATES]),
                         (F.col("c_custkey") % 4 + 1).cast("int"))
    score = ((F.col("c_custkey") * 37) % 101).cast("int")
    from ..functions.text import grade
    return c.select(
        F.col("c_custkey").alias("id"), F.concat(F.lit("src"), F.col("c_custkey").cast("string")).alias("site"),
        F.col("c_name").alias("site_name"), score.alias("score"), grade(score).alias("grade"),
        F.when(F.col("c_acctbal") > 0, "paid").otherwise("pending").alias("payment_status"),
        state.alias("optimization_status"),
        F.timestamp_seconds(F.lit(1700000000) + F.col("c_custkey") * 3600).alias("created_at"),
        F.array_repeat(F.lit("doc"), (F.col("c_custkey") % 4).cast("int")).alias("optimization_docs"))


PACKAGE_STATES = ["planning", "preview_ready", "full_ready", "failed", "submitted"]


def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc packages ← part: slug from the brand, page map from the type words."""
    p = read(spark, sf_dir, "part")
    from ..functions.text import slugify
    words = F.split(F.lower(F.col("p_type")), " ")
    page_map = F.transform(words, lambda w, i: F.struct(
        w.alias("page_type"), F.initcap(w).alias("title"), w.alias("slug"),
        F.when(i < 2, F.lit("preview")).otherwise(F.lit("full")).alias("tier")))
    preview = F.map_from_entries(F.transform(F.filter(page_map, lambda e: e["tier"] == "preview"),
                                             lambda e: F.struct(e["slug"], F.struct(e["title"].alias("title"), e["tier"].alias("tier")))))
    full = F.map_from_entries(F.transform(page_map, lambda e: F.struct(e["slug"], F.struct(e["title"].alias("title"), e["tier"].alias("tier")))))
    status = F.element_at(F.array(*[F.lit(x) for x in PACKAGE_STATES]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return p.select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("name"), slugify(F.col("p_brand")).alias("slug"),
        F.concat(F.lit("owner"), (F.col("p_partkey") % 7).cast("string"), F.lit("@example.com")).alias("email"),
        F.timestamp_seconds(F.lit(1700000000) + F.col("p_partkey") * 60).alias("created_at"),
        status.alias("status"), F.when(F.col("p_size") % 2 == 0, "paid").otherwise("pending").alias("payment_status"),
        page_map.alias("page_map"), preview.alias("preview_pages"),
        F.when(status == "full_ready", full).alias("full_pages"))


AGENT_PAGE_STATES = ["submitted", "crawling", "generating", "draft_ready", "full_generating", "full_ready", "failed"]


def agent_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """agent pages <- part (one job per part)."""
    p = read(spark, sf_dir, "part")
    from ..functions.text import slugify
    status = F.element_at(F.array(*[F.lit(x) for x in AGENT_PAGE_STATES]), (F.col("p_partkey") % len(AGENT_PAGE_STATES) + 1).cast("int"))
    return p.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("product_name"),
        F.concat(slugify(F.col("p_brand")), F.lit("-"), F.col("p_partkey").cast("string")).alias("slug"),
        F.concat(F.lit("https://docs.example.com/"), F.col("p_partkey").cast("string")).alias("docs_url"),
        F.concat(F.lit("owner"), (F.col("p_partkey") % 7).cast("string"), F.lit("@example.com")).alias("email"),
        status.alias("status"), F.when(F.col("p_size") % 2 == 0, "paid").otherwise("pending").alias("payment_status"),
        F.when(status == "failed", F.lit("timed out")).alias("error_message"),
        F.timestamp_seconds(F.lit(1700000000) + (F.col("p_partkey") * 7919 % 100000) * 60).alias("created_at"))
