"""Incremental site scores over a stream of page versions.

``readStream`` of page versions (the page schema plus ``fetched_at``) into
``foreachBatch``.  The state is narrow: the newest version's rule signals of
every page, never its text, in buckets by hash of the site and of the URL, the
signal sums of each (bucket, site), and the scores of each site.

A batch never changes what is there.  It writes the buckets that it touches to
the folder of a new version, and then a manifest that names, for every bucket of
every table, the version that holds it:

1. the batch's newest version per (site, url) becomes signal rows;
2. the touched buckets (a bounded list of numbers) are read, merged with the new
   rows and written;
3. the sums of these buckets are written;
4. the scores of the touched sites come from the sums of all their buckets;
5. the manifest is written beside and renamed, which makes signals, sums and
   scores valid at one stroke; a batch that dies before leaves the old state
   readable, and its folder is deleted when the batch comes again;
6. what only manifests older than the last ``KEPT`` name is deleted.

A batch whose number the manifest already has is not applied again.  A site with
a third of all pages is spread over the page buckets, and a changed page rewrites
one of them; the numbers of buckets belong to the state (``start`` sets them for
a new one).  Everything lives under one shared folder (default
``<spark.checkpoint.dir>/incremental``), with one writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rollups, rules
from ..session import checkpoint_dir
from ..versions import KEPT, State  # noqa: F401

PAGE_VERSION_SCHEMA = (
    "site string, ord long, url string, title string, description string, content string, "
    "headings array<struct<level:int,text:string>>, code_blocks array<struct<language:string,code:string>>, "
    "links array<string>, has_tables boolean, fetched_at timestamp")
SITE_BUCKETS, PAGE_BUCKETS = 16, 16


def default_state_dir(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/incremental"


def newest_versions(df: DataFrame) -> DataFrame:
    """Newest version per (site, url): a partial-aggregated max_by, no window."""
    cols = [c for c in df.columns if c not in ("site", "url")]
    agg = df.groupBy("site", "url").agg(F.max_by(F.struct(*cols), F.col("fetched_at")).alias("v"))
    return agg.select("site", "url", "v.*")


def process_batch(batch: DataFrame, batch_id: int, state_dir: str, site_buckets: int = SITE_BUCKETS, page_buckets: int = PAGE_BUCKETS) -> None:
    spark = batch.sparkSession
    state = State(spark, state_dir)
    before = state.current() or {"version": 0, "batch_id": -1, "site_buckets": site_buckets, "page_buckets": page_buckets, "tables": {}}
    if batch_id <= before["batch_id"]:
        return  # committed already, before the stream could note it
    version = before["version"] + 1
    state.delete(f"data/v{version:012d}")  # of a batch that died
    tables = {t: dict(held) for t, held in before["tables"].items()}
    number = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    page_bucket, site_bucket = F.concat_ws("-", "s", "u"), F.col("s").cast("string")

    fresh = rules.page_signals(newest_versions(batch), keep=("site", "url", "fetched_at"))
    fresh = fresh.withColumn("s", number("site", before["site_buckets"])).withColumn("u", number("url", before["page_buckets"]))
    schema = fresh.schema
    state.write(fresh, version, "fresh", page_bucket)
    touched = [n[7:] for n in state._names(f"data/v{version:012d}/fresh") if n.startswith("bucket=")]
    if not touched:
        state.delete(f"data/v{version:012d}")
        return
    now = {"version": version, "batch_id": batch_id, "site_buckets": before["site_buckets"], "page_buckets": before["page_buckets"],
           "tables": tables | {"fresh": dict.fromkeys(touched, version)}}
    fresh = state.read(now, "fresh", schema)

    def wrote(table: str, buckets) -> None:
        tables[table] = tables.get(table, {}) | dict.fromkeys(buckets, version)
        now["tables"] = now["tables"] | {table: tables[table]}

    state.write(newest_versions(state.read(before, "signals", schema, set(touched)).unionByName(fresh)), version, "signals", page_bucket)
    wrote("signals", touched)

    sums = [F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in rules.signal_names()]]
    partial = state.read(now, "signals", schema, set(touched)).groupBy("s", "u", "site").agg(*sums)
    state.write(partial, version, "sums", page_bucket)
    wrote("sums", touched)

    sites = fresh.select(F.col("site").alias("t_site"), F.col("s").alias("t_s")).distinct()
    same = (F.col("s") == F.col("t_s")) & F.col("site").eqNullSafe(F.col("t_site"))
    site_numbers = {b.split("-")[0] for b in touched}
    mine = state.read(now, "sums", partial.schema, {b for b in tables["sums"] if b.split("-")[0] in site_numbers}).join(sites, same, "left_semi")
    total = mine.groupBy("site").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in rules.signal_names()])
    scores = rollups.scores_of_rules(rules.rules_of_sums(total)).withColumn("batch_id", F.lit(batch_id)).withColumn("s", number("site", before["site_buckets"]))
    kept = state.read(before, "scores", scores.schema, site_numbers).join(sites, same, "left_anti")
    state.write(kept.unionByName(scores), version, "scores", site_bucket)
    wrote("scores", site_numbers)

    state.commit(now | {"tables": tables})
    state.clean()


def start(spark: SparkSession, source_dir: str, state_dir: str | None = None, trigger: dict | None = None,
          max_files_per_trigger: int | None = None, site_buckets: int = SITE_BUCKETS, page_buckets: int = PAGE_BUCKETS):
    """Start the incremental scoring query on parquet page versions in ``source_dir``."""
    state_dir = state_dir or default_state_dir(spark)
    reader = spark.readStream.schema(PAGE_VERSION_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(source_dir)
    writer = (stream.writeStream
              .foreachBatch(lambda df, bid: process_batch(df, bid, state_dir, site_buckets, page_buckets))
              .option("checkpointLocation", f"{state_dir}/_stream_checkpoint"))
    writer = writer.trigger(**(trigger or {"availableNow": True}))
    return writer.start()


def read_scores(spark: SparkSession, state_dir: str | None = None) -> DataFrame:
    """The scores of the current version; an error where no batch has been committed yet."""
    state = State(spark, state_dir or default_state_dir(spark))
    manifest = state.current()
    if manifest is None:
        raise ValueError(f"no scores in {state.root} yet")
    paths = [f"{state.folder(v, 'scores')}/bucket={b}" for b, v in sorted(manifest["tables"]["scores"].items())]
    return spark.read.option("recursiveFileLookup", "true").parquet(*paths).drop("s")
