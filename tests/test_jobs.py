"""The two end-to-end jobs on the sf0.001 tables."""

from pyspark.sql import functions as F

from sentspark.operators import corpus as CO
from sentspark.operators.text import clean_sentences
from sentspark.plans import jobs as J
from sentspark.plans import standins as S
from sentspark.session import scratch_path
from sentspark.sources import readers as R

SMOKE = "/root/testdata/sf0.001"


def test_prepare_corpus_and_make_datasets(spark):
    docs = S.table(spark, SMOKE, "documents")
    h = S.headlines(spark, SMOKE)
    heads = [h.where(F.col("split") == s) for s in ("train", "dev")]
    pairs = S.sts_pairs(spark, SMOKE)
    out = scratch_path(spark, "corpus-job")
    by = {"dev": pairs.where(F.pmod("conv_id", F.lit(2)) == 0), "test": pairs.where(F.pmod("conv_id", F.lit(2)) == 1)}
    paths = J.prepare_corpus(docs, heads, [pairs], out, eval_pairs=by)

    n_wiki = clean_sentences(docs).count()
    wiki = R.read_by_extension(spark, paths["wiki"], R.SENTENCE_SCHEMA)
    assert wiki.count() == n_wiki
    add = R.read_by_extension(spark, paths["add"], R.SENTENCE_SCHEMA, multiline=True)
    assert add.count() == n_wiki + h.count()
    unsup = R.read_by_extension(spark, paths["unsup"], R.SENTENCE_SCHEMA, multiline=True)
    flat = CO.unpivot_pairs(pairs.select("conv_id", "turn", "sentence1", "sentence2"), ["conv_id", "turn"])
    assert unsup.count() == flat.where(F.col("sentence").isNotNull()).count()

    evals = {split: paths[split] for split in by}
    feats = J.make_datasets(spark, paths["wiki"], evals, scratch_path(spark, "job-features"),
                            vocab_size=512, max_length=16)
    d = spark.read.parquet(feats)
    counts = {r.split: r["count"] for r in d.groupBy("split").count().collect()}
    assert counts["train"] == n_wiki
    assert counts["dev"] + counts["test"] == pairs.count()
    bad = d.where(
        (F.size(F.get("input_ids", 0)) != 16) | (F.size(F.get("input_ids", 1)) != 16)
        | (F.get("attention_mask", 0) != F.transform(F.get("input_ids", 0), lambda x: (x != 0).cast("int"))))
    assert bad.count() == 0
    lab = d.where(F.col("split") != "train").agg(F.min("labels"), F.max("labels")).first()
    assert 0.0 <= lab[0] <= lab[1] <= 1.0
    # training rows carry two identical views
    tr = d.where(F.col("split") == "train")
    assert tr.where(F.get("input_ids", 0) != F.get("input_ids", 1)).count() == 0


def test_make_datasets_with_subwords(spark, tmp_path):
    """Training rows are encoded with pieces learned from them; nearly no token is unknown."""
    from sentspark.operators import features as FE
    train = str(tmp_path / "train.parquet")
    clean_sentences(S.table(spark, SMOKE, "documents")).select("sentence").write.parquet(train)
    out = J.make_datasets(spark, train, {}, str(tmp_path / "features"), vocab_size=400, max_length=24, subwords=True)
    rows = spark.read.parquet(out).select(F.explode(F.get("input_ids", 0)).alias("id"))
    n = {r.unknown: r["count"] for r in rows.where(F.col("id") != FE.PAD_ID).groupBy((F.col("id") == FE.UNK_ID).alias("unknown")).count().collect()}
    assert n.get(True, 0) < 0.01 * n[False] and rows.agg(F.max("id")).first()[0] < 400
