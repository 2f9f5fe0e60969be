"""Exact deduplication by a heavy-hitter split (DataFrame functions only).

A Misra-Gries summary names the digests that may be frequent.  Their groups
are counted exactly with map-side partial aggregation, and the verified
winners are broadcast, so rows of frequent texts are settled where they are
read.  Only the rows of infrequent digests are shuffled: their groups are
aggregated partially and joined back.

Defined cases: null text counts as empty; equal texts with equal ids (repeated
rows) report the same ``keep_id`` and are all ``kept`` (``dedup`` returns one);
a null id never beats an id, and a group of null ids alone keeps ``keep_id``
null and its rows kept; an empty table gives an empty result.  ``annotate``
reads only the id and the text, so other columns and their names don't matter.
Texts are hashed whole, however long; only digests are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import land, pick, row_key, text_or_empty

#: The summary: so many independent streams (by digest), each with so many
#: counters, of which so many of the most frequent are candidates.  Their
#: product bounds the broadcast: 64 * 64 rows of under 200 bytes.
STREAMS = 64
COUNTERS = 512
CANDIDATES = 64


def frequent_digests(keys: DataFrame, streams: int = STREAMS, counters: int = COUNTERS,
                     candidates: int = CANDIDATES) -> DataFrame:
    """At most ``streams * candidates`` digests that may be frequent.

    ``approx_top_k`` keeps a Misra-Gries summary of ``counters`` items: any
    digest with more than 1 / ``counters`` of its stream is in it.  A digest
    always falls into the same stream, so streams merge apart from each other.
    """
    summary = (keys.groupBy(F.pmod(F.xxhash64("text_sha256"), F.lit(streams)).alias("stream"))
               .agg(F.expr(f"approx_top_k(text_sha256, {candidates}, {counters})").alias("top")))
    return (summary.select(F.explode("top").alias("item"))
            .where("item.count > 1").select(F.col("item.item").alias("text_sha256")))


def _settle(rows: DataFrame) -> DataFrame:
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256, row_key`` for every row."""
    keys = land(docs.select(F.col(f"`{id_col}`").alias("doc_id"), row_key(f"`{text_col}`").alias("row_key"),
                            F.sha2(text_or_empty(f"`{text_col}`").cast("binary"), 256).alias("text_sha256")),
                "exact-keys")
    winners = (keys.join(F.broadcast(frequent_digests(keys)), "text_sha256")
               .groupBy("text_sha256")
               .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
               .where("group_size > 1"))
    winners = land(winners, "exact-winners")  # at most STREAMS * CANDIDATES rows
    heavy = keys.join(F.broadcast(winners), "text_sha256")
    rest = keys.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti")
    # a join rather than a window: a group that is large after all is a skewed join side, which can be split
    groups = rest.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    light = rest.join(groups, "text_sha256")
    cols = ["doc_id", "keep_id", "group_size", "text_sha256", "row_key"]
    return (_settle(heavy.select(*cols).unionByName(light.select(*cols)))
            .select("doc_id", "keep_id", "group_size", "kept", "text_sha256", "row_key"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each text, that with the largest id, with all its columns."""
    kept = annotate(docs, id_col, text_col).where("kept").dropDuplicates(["text_sha256"])
    return pick(docs, kept.select(F.col("doc_id").alias(id_col), "row_key", F.lit(1).alias("copies")),
                "copies", id_col, text_col)
