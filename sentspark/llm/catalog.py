"""One registered query per operator, each over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import (centroids, collocations, decontaminate, exact_dedup, mixing, ngram_lm, quality, simhash, token_counts,
               token_files, toxicity, url_labels, urls, warc)
from .tables import read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def held_out(parts: int, remainder: int) -> Column:
    """Whether a document is kept from training: by the crc32 of its id as text."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == remainder, F.lit(False))


@register
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position, length and checksum of each document's ids, from the files."""
    return token_files.round_trip(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


@register
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives hold of each page.  Lengths and digests of responses
    are taken from their payloads, those of revisits from their headers."""
    pages = read_table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType.simpleString()
    rows = warc.round_trip(pages)
    full = F.col("payload").isNotNull()
    return rows.select(warc.page_of("record_id", kind).alias("page_id"),
                       F.when(full, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes"))
                       .alias("payload_bytes"),
                       F.when(full, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"),
                       "record_type", warc.page_of("refers_to", kind).alias("refers_to"))


@register
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of each document."""
    rows = toxicity.score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"),
                          used=~held_out(3, 1))
    return rows.select("doc_id", held_out(3, 1).alias("held_out"), "score",
                       (F.col("score") >= 0.7).cast("int").alias("predicted"), "clauses")


@register
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which row of each text stays; one row per document."""
    docs = read_table(spark, sf_dir, "documents")
    return exact_dedup.annotate(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@register
def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document gives to the mix; one row per document."""
    docs = read_table(spark, sf_dir, "documents")
    return mixing.annotate(docs).select("doc_id", "size", "source_size", "target", "taken")


@register
def op5_ngram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of each document under the model and a unigram base."""
    docs = read_table(spark, sf_dir, "documents")
    model = ngram_lm.train(docs, ~held_out(7, 2))
    return ngram_lm.score(docs, model).withColumn("held_out", held_out(7, 2)).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@register
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of each document."""
    rows = quality.score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"),
                         used=~held_out(5, 0))
    return rows.select("doc_id", held_out(5, 0).alias("held_out"), "score",
                       (F.col("score") >= 0.3).cast("int").alias("predicted"))


@register
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words found in each document."""
    found = decontaminate.annotate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"),
                                   keep=["doc_id"])
    hits = decontaminate.n_hit(F.col("spans"))
    return found.select("row.doc_id", "n_words", hits.alias("n_hit"),
                        F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                        (hits > 0).alias("contaminated"))


@register
def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of each document."""
    found = simhash.annotate(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal().alias("fingerprint"), "component_id")


@register
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document, from a cache that starts empty."""
    cache = token_counts.CountCache(spark, scratch_path(spark, "count-cache"))
    rows = token_counts.annotate(read_table(spark, sf_dir, "documents"), cache)
    return rows.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


@register
def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of each vector and the inertia of the clustering."""
    return centroids.cluster(read_table(spark, sf_dir, "embeddings")).drop("checked")


#: Rules of the page filter (host and path prefix).
URL_RULES = ("allow com/", "block example.com/en/", "allow www.example.com/en/", "block net/es/", "block net/fr/")


@register
def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on each page's URL: by the longest rule, else by the model."""
    model = urls.train(url_labels.table(spark))
    rules = [urls.parse_rule(line) for line in URL_RULES]
    return urls.judge(read_table(spark, sf_dir, "pages"), model, rules, keep=["page_id"]).select(
        "page_id", "host", "path", "rule", "verdict", "p_block")


@register
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's best phrases."""
    return collocations.mine(read_table(spark, sf_dir, "documents"))
