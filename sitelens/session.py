"""Spark session helpers.

The library never creates a session behind the caller's back: every
operator takes DataFrames.  These helpers exist for scripts, tests and the
benchmark, and for the few operators that need a checkpoint directory.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def get_spark(master: str | None = None, app: str = "sitelens", shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster, from ``spark.checkpoint.dir``.

    Only a local master without the setting (tests, a laptop) gets a temporary
    folder; elsewhere a missing setting is an error, because a folder of one
    machine is none that executors share.
    """
    sc = spark.sparkContext
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf_dir = "file://" + tempfile.mkdtemp(prefix="sitelens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(conf_dir)
    return conf_dir.rstrip("/")


class Scratch:
    """The scratch tables of one result, deleted by ``release`` once it is written.

    ``with scratch.open():`` around the calls that build a result puts their
    tables here; results made outside keep theirs in the shared folder.
    """

    def __init__(self):
        self.paths: list[str] = []

    @contextmanager
    def open(self):
        token = _SCRATCH.set(self)
        try:
            yield self
        finally:
            _SCRATCH.reset(token)

    def release(self, spark: SparkSession) -> None:
        while self.paths:
            delete(spark, self.paths.pop())


_SCRATCH: ContextVar[Scratch | None] = ContextVar("scratch", default=None)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def replaced(spark: SparkSession, out_dir: str):
    """A draft folder that takes the place of ``out_dir`` when the block ends well, and is deleted when it does not.

    All that a bundle consists of is written to the draft, so readers see the
    whole of the old bundle or the whole of the new one, but for the moment
    between two renames, in which there is none.
    """
    path = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    fs = path(out_dir).getFileSystem(spark._jsc.hadoopConfiguration())
    draft, old = (f"{out_dir.rstrip('/')}.{kind}-{uuid.uuid4().hex}" for kind in ("draft", "old"))
    try:
        yield draft
    except BaseException:
        fs.delete(path(draft), True)
        raise
    if fs.exists(path(out_dir)):
        fs.rename(path(out_dir), path(old))
    if not fs.rename(path(draft), path(out_dir)):
        raise RuntimeError(f"could not put {draft} in the place of {out_dir}")
    fs.delete(path(old), True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder's name under the shared folder, noted by the scratch at hand."""
    path = f"{checkpoint_dir(spark)}/sitelens/{name}-{uuid.uuid4().hex}"
    scratch = _SCRATCH.get()
    if scratch is not None:
        scratch.paths.append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later plans scan it instead of computing it again."""
    path = scratch_path(df.sparkSession, name)
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir}/{name}.parquet"


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a one-split table to the default parallelism.

    A table that Spark reads as one split (at most ``maxPartitionBytes``) would
    keep its per-row work on one core.  Tables of several splits are left as
    they are, on a cluster of any size.
    """
    if df.rdd.getNumPartitions() > 1:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism * 4)
