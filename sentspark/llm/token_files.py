"""Token-id output: Parquet lists that can be read selectively.

Documents are dealt by ranges of their id, sorted, encoded and written by
Spark's Parquet writer.  Ids are dictionary encoded (a vocabulary under 65,536
entries makes 16-bit codes); the id, offset and count columns are delta
encoded (Parquet 2 pages).  Row groups and pages have set sizes and every
column chunk has page indexes, so a reader of metadata opens no token page and
a reader of an id range opens few.  A document's offset within its file is
stored; a second, tiny table holds each file's first position.

The order is by id, nulls first, equal ids by their texts; repeated rows are
documents of their own.  Null text counts as empty (the end id alone).  An
empty table writes no rows.  Texts are encoded whole, however long: a task
holds one Arrow batch of them.  Only the id and the text are read, so other
columns and their names don't matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path, ship_package
from . import textkernel as tk
from .tables import row_key, text_or_empty
from .tokenizers_public import byte_level

TOKENIZER = "byte_bpe_50k.json"
END = 0
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 128 << 10


def _encode(tokenizer: str, folder: str | None, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, last = byte_level(tokenizer, folder), end.to_bytes(4, "little")
        offset = 0
        for whole in batches:
            for batch in tk.chunks(whole, "text", 1 << 19):
                ids = encoder.encode(batch.column("text").to_pylist())
                n = np.fromiter((len(x) // 4 + 1 for x in ids), dtype=np.int64, count=len(ids))
                flat = np.frombuffer(b"".join([x + last for x in ids]), dtype="<u4").astype(np.int32)
                before = offset + np.concatenate([[0], np.cumsum(n)[:-1]])
                offset += int(n.sum())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)),
                                                 pa.array(flat))
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "part": batch.column("part"),
                                                  "offset": pa.array(before), "n_tokens": pa.array(n),
                                                  "ids": lists})
    return run


def write(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, folder: str | None = None, end: int = END,
          row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES, id_col: str = "doc_id",
          text_col: str = "text") -> None:
    """Token files of ``docs`` in ``path/tokens`` and the files' first positions in ``path/starts``."""
    spark = docs.sparkSession
    ship_package(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # texts break ties, so that rows without an id (or with one id) are dealt apart too
    rows = (docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_or_empty(f"`{text_col}`").alias("text"))
            .withColumn("key", row_key("text"))
            .repartitionByRange(parts, "doc_id", "key").sortWithinPartitions("doc_id", "key", "text")
            .withColumn("part", F.spark_partition_id()))
    out = T.StructType([rows.schema["doc_id"], T.StructField("part", T.IntegerType()),
                        T.StructField("offset", T.LongType()), T.StructField("n_tokens", T.LongType()),
                        T.StructField("ids", T.ArrayType(T.IntegerType()))])
    tokens = rows.select("doc_id", "part", "text").mapInArrow(_encode(tokenizer, folder, end), out)
    options = {"parquet.writer.version": "PARQUET_2_0", "parquet.block.size": str(row_group_bytes),
               "parquet.page.size": str(page_bytes), "parquet.enable.dictionary": "false",
               "parquet.enable.dictionary#ids.list.element": "true",
               "parquet.dictionary.page.size": str(1 << 20), "compression": "zstd"}
    tokens.write.options(**options).parquet(f"{path}/tokens")
    # one row per file: how many ids come before it (range parts are in order)
    sizes = spark.read.parquet(f"{path}/tokens").groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")) \
         .write.parquet(f"{path}/starts")


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens`` without opening a token page."""
    return _started(spark, path).select("doc_id", "start", "n_tokens")


def read(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids``; filters on ``doc_id`` reach the row groups."""
    return _started(spark, path).select("doc_id", "start", "n_tokens", "ids")


def _started(spark: SparkSession, path: str) -> DataFrame:
    tokens = spark.read.parquet(f"{path}/tokens")
    starts = spark.read.parquet(f"{path}/starts")
    # one row per file: at most the number of shuffle partitions of the write
    return tokens.join(F.broadcast(starts), "part").withColumn("start", F.col("first") + F.col("offset"))


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        flat = np.ascontiguousarray(ids.flatten().to_numpy(), dtype="<u4").view(np.uint8)
        ends = np.cumsum(batch.column("n_tokens").to_numpy()) * 4
        sums = [zlib.crc32(flat[a:b]) for a, b in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist())] \
            if batch.num_rows else []
        yield pa.RecordBatch.from_pydict({**{c: batch.column(c) for c in ("doc_id", "start", "n_tokens")},
                                          "ids_crc32": pa.array(sums, pa.int64())})


def checksums(tokens: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of what ``read`` returns."""
    ship_package(tokens.sparkSession)
    kept = [tokens.schema[c] for c in ("doc_id", "start", "n_tokens")]
    return tokens.mapInArrow(_checksums, T.StructType([*kept, T.StructField("ids_crc32", T.LongType())]))


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """Write ``docs``' tokens under ``spark.checkpoint.dir`` and return the checksums of what is there."""
    spark = docs.sparkSession
    path = scratch_path(spark, "tokens")
    write(docs, path, **options)
    return checksums(read(spark, path))
