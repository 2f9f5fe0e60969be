"""Token counts through a digest cache.

A count depends on a text and a tokenizer alone.  Texts are keyed by the
SHA-256 of their normalised content, tokenizers by that of their file; the
cache is a Parquet table of (tokenizer, digest, count), in folders by
tokenizer so that others' rows are never read.  Digests absent from it are
encoded once each and appended; every document then gets its count from the
cache.  A group of copies is reduced to one text on the map side, so none is
ever gathered.

Digests are joined with the cache first, and texts follow only for misses:
with none, no text leaves its task; up to ``SENT_MISSES`` digests (16 MB) go to
all tasks, and only their texts are exchanged; with more (a cold cache) the
distinct texts meet the missing digests in one exchange.  The result is the same.

Normalisation: null is empty; nothing else changes, as every difference can
change the count.  Repeated rows count each; an empty table appends nothing.
An append whose job fails leaves no rows; two appends of one digest are
harmless (the cache is read distinct).  Texts are counted whole, however long.
Only the id and the text are read, so other columns and their names don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import drop_scratch, ship_package
from . import textkernel as tk
from .tables import landed, text_or_empty
from .tokenizers_public import count_tokens, version

TOKENIZER = "piece_bpe_32k.model"
#: Missing digests that are sent to every task, at most (32 bytes each).
SENT_MISSES = 500_000
_CACHE = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("n_tokens", T.LongType())])


def _count(tokenizer: str, folder: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tk.chunks(whole, "text", 1 << 19):
                n = count_tokens(batch.column("text").to_pylist(), tokenizer, folder)
                yield pa.RecordBatch.from_pydict({"digest": batch.column("digest"), "n_tokens": pa.array(n, pa.int64())})
    return run


class CountCache:
    """Stored counts of one tokenizer under ``path``."""

    def __init__(self, spark: SparkSession, path: str, tokenizer: str = TOKENIZER, folder: str | None = None) -> None:
        self.spark, self.tokenizer, self.folder = spark, tokenizer, folder
        self.path = f"{path}/tokenizer={version(tokenizer, folder)}"

    def stored(self) -> bool:
        """Whether any count of this tokenizer is stored."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop)

    def read(self) -> DataFrame:
        if not self.stored():
            return self.spark.createDataFrame([], _CACHE)
        # equal digests have equal counts; distinct rows (not one per digest) leave a
        # join by digest an exchange of its own, in which a hot digest can be split
        return self.spark.read.schema(_CACHE).parquet(self.path).distinct()

    def misses(self, docs: DataFrame, text_col: str = "text") -> tuple[DataFrame | None, str | None]:
        """``digest, text`` of the distinct texts of ``docs`` that are not stored
        (``None``: there are none), and a scratch folder to drop after use."""
        text = text_or_empty(f"`{text_col}`")
        keyed = docs.select(digest(text).alias("digest"), text.alias("text"))
        if not self.stored():
            return _one_each(keyed), None
        known = self.read().select("digest")
        absent, path = landed(keyed.select("digest").distinct().join(known, "digest", "left_anti"), "missing-digests")
        n = absent.count()
        if not n:
            drop_scratch(path)
            return None, None
        if n <= SENT_MISSES:
            return _one_each(keyed.join(F.broadcast(absent), "digest", "left_semi")), path
        # one text of each digest per task first: a join before that would move all
        # copies (and a semi join would be put there by the optimiser)
        marked = absent.withColumn("absent", F.lit(True))
        return _one_each(keyed).join(marked, "digest", "left").where("absent").select("digest", "text"), path

    def fill(self, docs: DataFrame, text_col: str = "text") -> None:
        """Encode and append the distinct texts of ``docs`` that are not stored."""
        ship_package(self.spark)
        rows, path = self.misses(docs, text_col)
        if rows is not None:
            rows.mapInArrow(_count(self.tokenizer, self.folder), _CACHE).write.mode("append").parquet(self.path)
        if path is not None:
            drop_scratch(path)


def _one_each(keyed: DataFrame) -> DataFrame:
    """One text of each digest, reduced in each task before the exchange."""
    return keyed.groupBy("digest").agg(F.first("text").alias("text"))


def digest(text) -> F.Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def annotate(docs: DataFrame, cache: CountCache, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` for every row; fills the cache first."""
    cache.fill(docs, text_col)
    text = text_or_empty(f"`{text_col}`")
    keyed = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"),
                        digest(text).alias("digest"))
    return keyed.join(cache.read(), "digest").select("doc_id", "n_bytes", "n_tokens")
