"""Helpers shared by the training-data operators.

Scratch tables live under the cluster's shared folder (``spark.checkpoint.dir``).
They cut lineage the durable way: a written table survives any executor, so a
lost task reads it again instead of recomputing (or losing) what came before.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Scratch:
    """The scratch tables of one result, to be deleted once it is written.

    Operators called inside ``open()`` put their tables here.  Results that are
    not made inside any scratch keep theirs, in the shared folder.
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
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        while self.paths:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop())
            path.getFileSystem(conf).delete(path, True)


_SCRATCH: ContextVar[Scratch | None] = ContextVar("scratch", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the session; a temporary one only for a local master with none set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    import tempfile

    base = "file://" + tempfile.mkdtemp(prefix="sitelens-llm-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back (lineage is cut, executors may be lost)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sitelens-llm/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    scratch = _SCRATCH.get()
    if scratch is not None:
        scratch.paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to so many rows: whole texts become Python objects a slice at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def row_key(doc_id: Column, text: Column) -> Column:
    """Tells rows apart that share a doc_id; rows equal in both are interchangeable."""
    return F.xxhash64(doc_id, text)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def crc32_utf8(text: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes; null counts as the empty text."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))
