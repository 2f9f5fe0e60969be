"""A batched map over files that goes on where it stopped.

The reference's batched map keeps its finished shards in a cache.  Here the
input's files are mapped a few at a time; each group's rows go to a folder of
their own, and then a manifest that names the group's files and that folder.
The manifest is the commit: a folder without one (a job that was killed) is
never read, and a file with one is never mapped again, unless a file of its
group has changed or gone (its length or time differs); then the group is
mapped anew.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .features import map_batches

_MANIFEST = T.StructType([T.StructField("path", T.StringType()), T.StructField("length", T.LongType()),
                          T.StructField("modified", T.LongType()), T.StructField("folder", T.StringType())])


class Folder:
    """The few calls of Spark's file system that listing and committing need."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.path = path.rstrip("/")
        self.fs = self._path(self.path).getFileSystem(self.conf)

    def _path(self, text: str):
        return self.jvm.org.apache.hadoop.fs.Path(text)

    def children(self, name: str) -> list[str]:
        at = self._path(f"{self.path}/{name}")
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(f"{self.path}/{name}"))

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(f"{self.path}/{name}"), True)

    def stamp(self, file: str) -> tuple[str, int, int]:
        at = self._path(file)
        status = at.getFileSystem(self.conf).getFileStatus(at)
        return file, status.getLen(), status.getModificationTime()


def committed(spark: SparkSession, out: str) -> list[tuple[tuple[str, int, int], str]]:
    """Finished files (path, length, time) with the folder of their rows."""
    folder = Folder(spark, out)
    done = [f"{folder.path}/manifest/{m}" for m in folder.children("manifest") if folder.exists(f"manifest/{m}/_SUCCESS")]
    if not done:
        return []
    return [((r.path, r.length, r.modified), r.folder)
            for r in spark.read.schema(_MANIFEST).parquet(*done).collect()]      # one row a file


def map_files(spark: SparkSession, source: str | Sequence[str], fn: Callable[..., pa.RecordBatch], schema, out: str,
              files_per_commit: int | None = None, columns: Sequence[str] | None = None, **params) -> DataFrame:
    """``map_batches`` over the Parquet files of ``source`` with its rows under
    ``out``, a commit every ``files_per_commit`` files (one round of the
    cluster's task slots by default).  Run again after a failure, it maps only
    files without a commit.  The rows of all files of ``source`` come back."""
    table = spark.read.parquet(*([source] if isinstance(source, str) else source))
    folder = Folder(spark, out)
    files = [folder.stamp(f) for f in sorted(table.inputFiles())]
    done, current = dict(committed(spark, out)), set(files)
    stale = {name for f, name in done.items() if f not in current}
    done = {f: name for f, name in done.items() if name not in stale}
    live = set(done.values())
    for kind in ("manifest", "rows"):            # of changed files, and of jobs that did not come to their commit
        for name in folder.children(kind):
            if name not in live:
                folder.delete(f"{kind}/{name}")
    left = [f for f in files if f not in done]
    step = files_per_commit or max(1, spark.sparkContext.defaultParallelism)
    for k in range(0, len(left), step):
        group = left[k:k + step]
        name = uuid.uuid4().hex
        rows = spark.read.schema(table.schema).parquet(*[p for p, _, _ in group])
        if columns is not None:
            rows = rows.select(*columns)
        map_batches(rows, fn, schema, **params).write.parquet(f"{folder.path}/rows/{name}")
        spark.createDataFrame([(*f, name) for f in group], _MANIFEST).coalesce(1).write.parquet(
            f"{folder.path}/manifest/{name}")
        done |= dict.fromkeys(group, name)
    used = sorted(set(done.values()))
    if not used:
        return spark.createDataFrame([], schema)
    kind = schema if isinstance(schema, T.StructType) else T.DataType.fromDDL(schema)
    return spark.read.schema(kind).parquet(*[f"{folder.path}/rows/{n}" for n in used])
