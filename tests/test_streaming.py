"""The cleaning chain on a file stream equals the batch result."""

from sentspark.operators.text import clean_sentences
from sentspark.session import scratch_path
from sentspark.streaming.corpus import clean_sentence_stream

SMOKE = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark):
    batch_docs = spark.read.parquet(f"{SMOKE}/documents.parquet")
    schema = batch_docs.schema
    sink = scratch_path(spark, "stream-sink")
    q = clean_sentence_stream(spark, SMOKE, sink, schema, file_glob="documents.parquet")
    q.awaitTermination(300)
    assert q.exception() is None
    got = spark.read.parquet(sink).select("doc_id", "pos", "sentence")
    want = clean_sentences(batch_docs)
    assert got.count() == want.count() > 0
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_stream_plan_is_narrow(spark):
    """No aggregate, join or exchange: the chain needs no state."""
    import contextlib
    import io

    schema = spark.read.parquet(f"{SMOKE}/documents.parquet").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", "documents.parquet").parquet(SMOKE)
    out = clean_sentences(s.select("doc_id", "text"))
    assert out.isStreaming
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        out.explain(True)
    plan = buf.getvalue()
    for node in ("Aggregate", "Join", "Exchange"):
        assert node not in plan


def test_restart_from_checkpoint_processes_only_new_files(spark):
    """Exactly-once across restarts: the second run reads only the new file."""
    from sentspark.operators.text import clean_sentences

    src = scratch_path(spark, "stream-src")
    sink = scratch_path(spark, "stream-sink")
    ckpt = scratch_path(spark, "stream-ckpt")
    first = spark.read.parquet(f"{SMOKE}/documents.parquet").where("doc_id % 2 = 0")
    second = spark.read.parquet(f"{SMOKE}/documents.parquet").where("doc_id % 2 = 1")
    schema = first.schema
    first.coalesce(1).write.parquet(f"{src}/part=a")
    q = clean_sentence_stream(spark, src, sink, schema, checkpoint_dir=ckpt)
    q.awaitTermination(300)
    n1 = spark.read.parquet(sink).count()
    second.coalesce(1).write.parquet(f"{src}/part=b")
    q = clean_sentence_stream(spark, src, sink, schema, checkpoint_dir=ckpt)
    q.awaitTermination(300)
    got = spark.read.parquet(sink).select("doc_id", "pos", "sentence")
    want = clean_sentences(spark.read.parquet(f"{SMOKE}/documents.parquet"))
    assert 0 < n1 < got.count() == want.count()
    assert got.exceptAll(want).count() == 0
