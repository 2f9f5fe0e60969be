"""Writers (S7, S8).  Output folders are created by Spark on write."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path, ship_package
from .readers import NULL_MARK


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header, RFC-4180 quote doubling, no index column.  A null
    is ``NULL_MARK`` and an empty string ``""``, so both come back as they were."""
    (df.write.mode(mode).option("header", True).option("escape", '"').option("nullValue", NULL_MARK)
       .option("emptyValue", '""')
       .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
       .csv(path))


def write_tsv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Tab-separated text with a header and quoting off (what ``read_tsv`` reads).

    Without quoting a field cannot hold a tab or a line break; replace them
    first (each one would otherwise start a new field or row on read)."""
    (df.write.mode(mode).option("header", True).option("sep", "\t").option("quote", "\u0000")
       .option("escape", "\u0000").option("ignoreLeadingWhiteSpace", False)
       .option("ignoreTrailingWhiteSpace", False).option("emptyValue", "").option("nullValue", "").csv(path))


def write_json_array(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON arrays, one per file, a record a line (nulls are written as such)."""
    ship_package(df.sparkSession)
    record = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
    df.select(record.alias("value")).mapInArrow(_as_array, "value string").write.mode(mode).text(path)


def _as_array(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    before = "["
    for batch in batches:
        lines = []
        for record in batch.column(0).to_pylist():
            lines.append(before + record)
            before = ","
        yield pa.RecordBatch.from_pydict({"value": pa.array(lines, pa.string())})
    yield pa.RecordBatch.from_pydict({"value": ["]" if before == "," else "[]"]})


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ("split",),
                  mode: str = "overwrite") -> None:
    """Columnar sink, partitioned by split so readers prune folders."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def land(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet under the shared ``spark.checkpoint.dir``
    and read it back.

    Use it where a stage is consumed more than once (a corpus feeding both
    the vocabulary count and the encoding, features feeding both the batch
    counts and the batch rows): each consumer then scans the columns it needs
    instead of recomputing the stage, and the lineage ends at the written
    table, so a lost executor does not replay the upstream work.  The
    reference also writes its corpus and features to disk between stages.
    The folder is deleted when the process ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
