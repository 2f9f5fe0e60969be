"""From raw documents to token files: the stages of a training corpus.

Every stage reads what its predecessor has kept and returns the columns of
documents; the last one writes token files and returns what they hold of each
document.  ``run`` writes each stage as Parquet under ``spark.checkpoint.dir``
and reads it again, so a stage's losses replay that stage alone.

Defined cases, stage by stage: null and empty texts are judged, deduplicated
(as one group of near duplicates) and written (as the end id) like any other;
texts are read whole, however long; of rows alike in id and text one stays
after near-dedup, and the mix may repeat it; ties are settled by id; an empty
table passes every stage; all columns of documents are carried in one struct,
so extra columns and their names don't matter.  A null id is an id like any other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sentspark.llm import decontaminate, mixing, quality, simhash, token_files
from sentspark.llm.catalog import held_out
from sentspark.llm.tables import landed, read_table
from sentspark.session import drop_scratch

#: A document with a lower quality score is rejected.
QUALITY = 0.3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep(docs, read_table(spark, sf_dir, "labels"), QUALITY, used=~held_out(5, 0))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near duplicates."""
    return simhash.dedup(docs, shingle=3, max_bits=2)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Position, length and checksum of each document's ids in the token files."""
    return token_files.round_trip(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("mix", mix_stage),
    ("tokens", tokens_stage),
]

#: Classifier, fingerprints and tokenizer are beyond SQL; tests hold the
#: pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs, path = landed(stage(spark, docs, sf_dir), f"stage-{name}")
        if before:
            drop_scratch(before)
        before = path
    return docs
