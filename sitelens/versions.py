"""Bucketed tables that change by whole versions.

Data files are never replaced.  A change writes the buckets that it touches to
the folder of a new version and then a manifest that names, for every bucket of
every table, the version that holds it; the manifest gets its name by a rename,
so readers see the old state or the new one.  One writer at a time.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

#: Versions that stay readable: the current one, and those that a reader may still be at.
KEPT = 2


class State:
    """The versioned folders and manifests of one state, through the file system that Spark uses."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def versions(self) -> list[int]:
        """Numbers of the manifests, oldest first."""
        return [int(n[1:-5]) for n in self._names("manifests") if n.startswith("v") and n.endswith(".json")]

    def manifest(self, version: int) -> dict:
        stream = self.fs.open(self._path(f"manifests/v{version:012d}.json"))
        try:
            return json.loads(bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def current(self) -> dict | None:
        versions = self.versions()
        return self.manifest(versions[-1]) if versions else None

    def commit(self, manifest: dict) -> None:
        """Write the manifest under another name, then rename it to the one that readers look for."""
        name = f"v{manifest['version']:012d}.json"
        draft = self._path(f"manifests/draft-{name}")
        stream = self.fs.create(draft, True)
        stream.write(json.dumps(manifest).encode())
        stream.close()
        if not self.fs.rename(draft, self._path(f"manifests/{name}")):
            raise RuntimeError(f"another writer has made {name}")

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)

    def folder(self, version: int, table: str) -> str:
        return f"{self.root}/data/v{version:012d}/{table}"

    def read(self, manifest: dict, table: str, schema, buckets=None) -> DataFrame:
        """The rows of a table, or of those of its ``buckets`` (names) that exist."""
        held = manifest["tables"].get(table, {})
        paths = [f"{self.folder(v, table)}/bucket={b}" for b, v in sorted(held.items()) if buckets is None or b in buckets]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*paths)

    def write(self, df: DataFrame, version: int, table: str, bucket) -> None:
        df.withColumn("bucket", bucket).write.partitionBy("bucket").parquet(self.folder(version, table))

    def clean(self) -> None:
        """Delete manifests before the last ``KEPT``, and every bucket that none of these names."""
        versions = self.versions()
        for old in versions[:-KEPT]:
            self.delete(f"manifests/v{old:012d}.json")
        live = {(t, b, v) for n in versions[-KEPT:] for t, held in self.manifest(n)["tables"].items() for b, v in held.items()}
        last = versions[-1] if versions else 0
        for name in self._names("data"):
            version = int(name[1:])
            if version > last:
                continue  # a batch at work
            tables = self._names(f"data/{name}")
            for table in tables:
                for bucket in self._names(f"data/{name}/{table}"):
                    if bucket.startswith("bucket=") and (table, bucket[7:], version) not in live:
                        self.delete(f"data/{name}/{table}/{bucket}")
                if not any((t, v) == (table, version) for t, _, v in live):
                    self.delete(f"data/{name}/{table}")
            if not any(v == version for _, _, v in live):
                self.delete(f"data/{name}")
