"""The cleaning chain (P4-P8, U1) on a Structured Streaming source.

Every step of ``clean_sentences`` is a projection, a filter or a generator,
so the same function runs unchanged on a streaming DataFrame: new text files
landing in a folder are cleaned incrementally and appended to a Parquet
sink.  Progress (which files were read, which batches committed) lives in a
checkpoint under the shared ``spark.checkpoint.dir``, so a restarted query
or a lost executor neither skips nor duplicates input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.text import clean_sentences
from ..session import scratch_path


def clean_sentence_stream(spark: SparkSession, src_dir: str, sink_dir: str,
                          schema: T.StructType, text_col: str = "text",
                          keys: Sequence[str] = ("doc_id",), file_glob: str | None = None,
                          checkpoint_dir: str | None = None,
                          max_files_per_trigger: int | None = None,
                          available_now: bool = True) -> StreamingQuery:
    """Start a stream: Parquet files under ``src_dir`` -> ``(keys, pos,
    sentence)`` appended to Parquet under ``sink_dir``.

    ``schema`` is required (streaming file sources never infer).  With
    ``available_now`` the query drains what is there and stops; otherwise it
    keeps polling.  The file sink's own log makes the output exactly-once.
    """
    reader = spark.readStream.schema(schema)
    if file_glob:
        reader = reader.option("pathGlobFilter", file_glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    docs = reader.parquet(src_dir).select(*keys, text_col)
    out = clean_sentences(docs, text_col, keys)
    ckpt = checkpoint_dir or scratch_path(spark, "stream-clean")
    writer = (out.writeStream.format("parquet").outputMode("append")
                 .option("checkpointLocation", ckpt))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start(sink_dir)
