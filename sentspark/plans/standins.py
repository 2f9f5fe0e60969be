"""Reference-shaped inputs derived from the driver's tables with Spark.

Each builder reads whole tables; nothing is sampled or capped.  The SQL
twins of these builders live in ``oracle.py`` (``STANDIN_SQL``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import hash_key, md5_u32
from ..operators.runs import number_steps
from ..operators.text import clean_sentences
from ..sources.readers import spread

# Stand-in shapes (our choices, mirrored in the oracle SQL).
PAIR_BATCH_ROWS = 50        # rows per batch in the two-view table
TRIPLE_BATCH_ROWS = 32      # rows per batch in the three-view table
GLOBAL_RANKS = 4            # workers gathered into one global batch
LOCAL_BATCH_ROWS = 16       # rows per worker per step
HIDDEN_POSITIONS = 10       # token positions per sentence in hidden states
MLM_VOCAB = 8               # vocabulary entries per masked-token position
MLM_LABELLED_PERCENT = 15   # share of positions that carry a label


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, text)``: only the two columns the text chain needs are read.
    The driver's tables are single files, which one task scans; a session that
    sets ``sentspark.spread`` (the bench does) deals their rows to that many."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    parts = spark.conf.get("sentspark.spread", None)
    return spread(docs, ["doc_id"], int(parts)) if parts else docs


def edge_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` and, per benchmark item, texts that the driver's tables
    lack: null, no-break spaces, CJK and Hangul (negative ids)."""
    b = table(spark, sf_dir, "benchmark")
    text, nbsp = F.col("text"), "\u00a0"
    made = [F.lit(None).cast("string"),
            F.concat(F.lit(nbsp), F.replace(text, F.lit(" "), F.lit(nbsp))),
            F.concat(F.lit("\u3000"), text, F.lit(" 漢字! #é€«龥龦» \u2003\x85")),
            F.concat(F.lit("가나다. "), text, F.lit(". 힣힤·한국어" + nbsp))]
    rows = F.explode(F.array(*[F.struct((F.lit(-4) * F.col("item_id") - F.lit(k)).alias("doc_id"), t.alias("text"))
                               for k, t in enumerate(made, 1)])).alias("_r")
    return documents(spark, sf_dir).unionByName(b.select(rows).select("_r.*"))


def wiki_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encyclopedia corpus -> ``(doc_id, pos, sentence)``."""
    return clean_sentences(documents(spark, sf_dir))


def sts_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence pairs with a 0-5 score: turn t with turn t+1 of a conversation
    (null sentence2 on the last turn, null score when turn % 7 = 0).

    The equi-join is on ``(conv_id, turn)``, so a huge conversation still
    hashes over all partitions.
    """
    c = table(spark, sf_dir, "conversations")
    a = c.select("conv_id", "turn", F.col("text").alias("sentence1"))
    b = c.select(F.col("conv_id").alias("_c"), (F.col("turn") - F.lit(1)).alias("_t"),
                 F.col("text").alias("sentence2"))
    j = a.join(b, (F.col("conv_id") == F.col("_c")) & (F.col("turn") == F.col("_t")), "left")
    score = (F.when(F.pmod("turn", F.lit(7)) == 0, F.lit(None).cast("double"))
              .otherwise(F.pmod(F.col("conv_id") + F.col("turn"), F.lit(6)).cast("double")))
    return j.select("conv_id", "turn", "sentence1", "sentence2", score.alias("score"))


def headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headline table ``(item_id, title, label, split)``; even ids train, odd dev."""
    b = table(spark, sf_dir, "benchmark")
    return b.select("item_id", F.col("text").alias("title"),
                    F.pmod("item_id", F.lit(7)).cast("int").alias("label"),
                    F.when(F.pmod("item_id", F.lit(2)) == 0, F.lit("train")).otherwise(F.lit("dev")).alias("split"))


def _gold(l1, l2):
    return (F.when(F.col(l1) == F.col(l2), F.lit(5.0))
             .otherwise(F.lit(5.0) * (F.lit(1.0) - F.abs(F.col(l1) - F.col(l2)) / F.lit(9.0))))


def scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(split, pair_id, v1, v2, gold)``: vectors 2k and 2k+1 form pair k;
    gold from their labels; even pairs dev, odd pairs test."""
    e = table(spark, sf_dir, "embeddings")
    side = F.pmod("vec_id", F.lit(2))
    pid = F.floor(F.col("vec_id") / 2).cast("long")
    x = e.where(side == 0).select(pid.alias("pair_id"), F.col("embedding").cast("array<double>").alias("v1"),
                                  F.col("label").alias("l1"))
    y = e.where(side == 1).select(pid.alias("pair_id"), F.col("embedding").cast("array<double>").alias("v2"),
                                  F.col("label").alias("l2"))
    j = x.join(y, "pair_id", "left")  # an odd last vector has no partner
    split = F.when(F.pmod("pair_id", F.lit(2)) == 0, F.lit("dev")).otherwise(F.lit("test"))
    return j.select(split.alias("split"), "pair_id", "v1", "v2", _gold("l1", "l2").alias("gold"))


def hidden_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token states ``(id, layer, pos, mask, vec)``: vector v is position
    v % 10 of sentence v div 10; three layers (reversed, halved, as is)."""
    e = table(spark, sf_dir, "embeddings")
    emb = F.col("embedding").cast("array<double>")
    sid = F.floor(F.col("vec_id") / HIDDEN_POSITIONS).cast("long")
    pos = F.pmod("vec_id", F.lit(HIDDEN_POSITIONS)).cast("int")
    mask = (pos < F.lit(3) + F.pmod(sid, F.lit(7))).cast("int")
    layers = F.array(
        F.struct(F.lit(0).alias("layer"), F.reverse(emb).alias("vec")),
        F.struct(F.lit(1).alias("layer"), F.transform(emb, lambda x: x * F.lit(0.5)).alias("vec")),
        F.struct(F.lit(2).alias("layer"), emb.alias("vec")))
    return e.select(sid.alias("id"), pos.alias("pos"), mask.alias("mask"), F.inline(layers)) \
            .select("id", "layer", "pos", "mask", "vec")


def views(spark: SparkSession, sf_dir: str, n_views: int = 2) -> DataFrame:
    """Contrastive rows ``(batch_id, row, z1, z2[, z3], gold)``: vector v is
    view v % n of row v div n; the last row may lack views (null)."""
    e = table(spark, sf_dir, "embeddings")
    rk = F.floor(F.col("vec_id") / n_views).cast("long")
    v = F.pmod("vec_id", F.lit(n_views))
    per = PAIR_BATCH_ROWS if n_views == 2 else TRIPLE_BATCH_ROWS
    out = None
    for k in range(n_views):
        part = e.where(v == k).select(rk.alias("row_key"), F.col("embedding").cast("array<double>").alias(f"z{k + 1}"),
                                      F.col("label").alias(f"l{k + 1}"))
        out = part if out is None else out.join(part, "row_key", "left")
    cols = [F.floor(F.col("row_key") / per).cast("long").alias("batch_id"),
            F.pmod("row_key", F.lit(per)).cast("long").alias("row"), "row_key"]
    cols += [f"z{k + 1}" for k in range(n_views)]
    return out.select(*cols, _gold("l1", "l2").alias("gold"))


def step_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-view rows keyed by the step of all workers: ``(batch_id, row, z1, z2)``."""
    v = views(spark, sf_dir, 2)
    g = GLOBAL_RANKS * LOCAL_BATCH_ROWS
    return v.select(F.floor(F.col("row_key") / g).cast("long").alias("batch_id"),
                    F.pmod("row_key", F.lit(g)).cast("long").alias("row"), "z1", "z2")


def metrics_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(run, step, metric)``: run = user, steps numbered by (ts, event_id)."""
    ev = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), "ts", "event_id",
                                               F.col("value").alias("metric"))
    return number_steps(ev, "run", ["ts", "event_id"]).select("run", "step", "metric")


def mlm_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked-token logits ``(row, pos, logits, label)``: event e is position
    e % 10 of row e div 10; 8 vocabulary logits ``3 sin(value + id)``; 85 % of
    positions are unlabelled (-100) by md5."""
    ev = table(spark, sf_dir, "events")
    u = md5_u32(hash_key("mlm", F.col("event_id")))
    label = F.when(F.pmod(u, F.lit(100)) < F.lit(100 - MLM_LABELLED_PERCENT), F.lit(-100)) \
             .otherwise(F.pmod(u, F.lit(MLM_VOCAB))).cast("int")
    logits = F.array(*[F.lit(3.0) * F.sin(F.col("value") + F.lit(k)) for k in range(MLM_VOCAB)])
    return ev.select(F.floor(F.col("event_id") / 10).cast("long").alias("row"),
                     F.pmod("event_id", F.lit(10)).cast("int").alias("pos"), logits.alias("logits"),
                     label.alias("label"))
