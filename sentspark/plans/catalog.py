"""The query catalog: one Spark query per operator key of the survey.

Every query takes ``(spark, sf_dir)``, reads whole driver tables (or data
Spark derives from them) and returns a DataFrame whose column names match
the oracle SQL of the same key.  Float results are rounded to 6 digits.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as TX
from ..functions import vectors as V
from ..operators import contrastive as C
from ..operators import corpus as CO
from ..operators import evaluation as EV
from ..operators import features as FE
from ..operators import resumable as RS
from ..operators import runs as RU
from ..operators import subword as SW
from ..operators import text as TO
from ..operators import vectors as VO
from ..operators.scan import row_index
from ..session import scratch_path
from ..sources import readers as R
from ..sources import sinks as SK
from . import standins as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Query parameters (fixed so Spark and the oracle agree).
VOCAB_SIZE = 4096
SUBWORD_SIZE = 2048
SEED = 42
BATCH_SIZE = 256
PAD_MULTIPLE = 8
DENSE_OUT = 64 // 3   # the reference's head maps hidden -> hidden // 3
DIGITS = 6


def register(key: str):
    def deco(fn: Query) -> Query:
        QUERIES[key] = fn
        return fn
    return deco


def r6(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, DIGITS)


def ids_text(c) -> F.Column:
    """An int array as "a,b,c" (exact, engine-neutral)."""
    # numbers are printed straight into one buffer; casts make a string each, ``translate`` looks up every character
    return F.btrim(F.to_json(F.col(c) if isinstance(c, str) else c), F.lit("[]"))


def dense_weights(out_dim: int = DENSE_OUT, in_dim: int = 64) -> np.ndarray:
    """Deterministic head weights ``sin(o * in_dim + i) / 8`` (bias 0)."""
    o = np.arange(out_dim)[:, None]
    i = np.arange(in_dim)[None, :]
    return np.sin(o * in_dim + i) / 8.0


# --------------------------------------------------------------------- text
@register("clean_sentences")
def q_clean_sentences(spark, sf):
    return S.wiki_sentences(spark, sf)


@register("sentence_break")
def q_sentence_break(spark, sf):
    d = S.table(spark, sf, "documents")
    return d.select("doc_id", TX.sentence_break("text").alias("text"))


@register("nbsp_norm")
def q_nbsp_norm(spark, sf):
    d = S.edge_documents(spark, sf)
    return d.select("doc_id", TX.nbsp_norm(TX.sentence_break("text")).alias("text"))


@register("explode_sentences")
def q_explode_sentences(spark, sf):
    return TO.broken_lines(S.documents(spark, sf), "text", ["doc_id"], "line")


@register("strip_ws")
def q_strip_ws(spark, sf):
    lines = TO.broken_lines(S.edge_documents(spark, sf), "text", ["doc_id"], "line")
    return lines.select("doc_id", "pos", TX.strip_ws("line").alias("line"))


@register("min_len")
def q_min_len(spark, sf):
    lines = TO.broken_lines(S.edge_documents(spark, sf), "text", ["doc_id"], "line")
    s = lines.select("doc_id", "pos", TX.strip_ws("line").alias("line"))
    return s.where(TX.long_enough("line"))


@register("char_filter")
def q_char_filter(spark, sf):
    lines = TO.broken_lines(S.edge_documents(spark, sf), "text", ["doc_id"], "line")
    return lines.select("doc_id", "pos", TX.char_filter(TX.strip_ws("line")).alias("line"))


@register("drop_null")
def q_drop_null(spark, sf):
    return TO.drop_null(S.sts_pairs(spark, sf))


@register("fill_null_text")
def q_fill_null_text(spark, sf):
    p = S.sts_pairs(spark, sf)
    return p.select("conv_id", "turn", TX.fill_null_text("sentence1").alias("sentence1"),
                    TX.fill_null_text("sentence2").alias("sentence2"))


@register("norm_score")
def q_norm_score(spark, sf):
    p = S.sts_pairs(spark, sf)
    return p.select("conv_id", "turn", TX.norm_score("score").alias("labels"))


@register("label_name")
def q_label_name(spark, sf):
    lab = S.table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"),
                                              F.col("toxic").alias("label_ids"))
    return TO.label_name(lab)


@register("preview")
def q_preview(spark, sf):
    return TO.preview(S.wiki_sentences(spark, sf), ["doc_id", "pos"], 5)


@register("rename_col")
def q_rename_col(spark, sf):
    h = S.headlines(spark, sf).select("item_id", "title", "label")
    return TO.rename_col(h, "title", "sentence")


@register("drop_cols")
def q_drop_cols(spark, sf):
    p = S.sts_pairs(spark, sf).withColumn("labels", TX.norm_score("score"))
    return TO.drop_cols(p, ["sentence1", "sentence2", "score"])


@register("project_col")
def q_project_col(spark, sf):
    return TO.project_col(S.wiki_sentences(spark, sf), "sentence")


# ------------------------------------------------------------------- corpus
def _corpora(spark, sf):
    wiki = S.wiki_sentences(spark, sf).select(F.col("doc_id").alias("src_key"), "pos", "sentence")
    h = S.headlines(spark, sf)
    def tc(split):
        part = h.where(F.col("split") == split).select(F.col("item_id").alias("src_key"),
                                                       F.lit(0).alias("pos"), "title")
        return TO.rename_col(part, "title", "sentence")
    return CO.union_corpora([wiki, tc("train"), tc("dev")], "sentence", keep=["src_key", "pos"])


@register("union_corpora")
def q_union_corpora(spark, sf):
    return _corpora(spark, sf)


@register("unpivot_pairs")
def q_unpivot_pairs(spark, sf):
    p = S.sts_pairs(spark, sf).select("conv_id", "turn", "sentence1", "sentence2")
    return CO.unpivot_pairs(p, ["conv_id", "turn"])


@register("union_pairs")
def q_union_pairs(spark, sf):
    p = S.sts_pairs(spark, sf)
    h = S.headlines(spark, sf)
    hp = (h.select("item_id", F.col("title").alias("sentence1"))
            .join(h.select((F.col("item_id") - 1).alias("item_id"), F.col("title").alias("sentence2")),
                  "item_id", "left"))
    return CO.union_pairs([p, hp])


@register("profile")
def q_profile(spark, sf):
    return CO.profile(S.sts_pairs(spark, sf))


# ------------------------------------------------------------------ sources
@register("src_corpus")
def q_src_corpus(spark, sf):
    return R.read_corpus(spark, f"{sf.rstrip('/')}/documents.parquet", "text")


@register("src_json")
def q_src_json(spark, sf):
    path = scratch_path(spark, "headlines") + "/ynat_train.json"
    SK.write_json_array(S.headlines(spark, sf).select("item_id", "label", "title"), path)
    return R.read_json(spark, path, R.HEADLINE_SCHEMA)


def _pairs_as_tsv(spark, sf, path, split_filter=None):
    """Write the pair table as a seven-column TSV with the wanted columns out of
    order: newlines/tabs in text become spaces and a null score is *omitted* (a
    short row), as a hand-made file would be."""
    p = S.sts_pairs(spark, sf)
    if split_filter is not None:
        p = p.where(split_filter)
    clean = lambda c: F.coalesce(F.regexp_replace(F.col(c), "[\t\n\r]", " "), F.lit(""))
    line = F.concat_ws("\t", clean("sentence2"), F.lit("main"), F.col("conv_id").cast("string"),
                       clean("sentence1"), F.lit("2012"), F.col("turn").cast("string"), F.col("score").cast("string"))
    header = "\t".join(["sentence2", "genre", "file", "sentence1", "year", "id", "score"])
    p.select(line.alias(header)).write.option("header", True).option("sep", "\u0001").option("quote", "\u0000") \
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


@register("src_tsv")
def q_src_tsv(spark, sf):
    path = scratch_path(spark, "pairs") + "/sts-train.tsv"
    _pairs_as_tsv(spark, sf, path)
    return R.read_tsv(spark, path, names=["sentence1", "sentence2", "score"], types={"score": "double"})


@register("src_by_ext")
def q_src_by_ext(spark, sf):
    path = scratch_path(spark, "wiki") + "/wiki_train.csv"
    SK.write_csv(S.wiki_sentences(spark, sf).select("doc_id", "sentence"), path)
    return R.read_by_extension(spark, path, R.SENTENCE_SCHEMA)


@register("src_splits")
def q_src_splits(spark, sf):
    root = scratch_path(spark, "splits")
    paths = {}
    for split, cond in (("dev", F.pmod("conv_id", F.lit(2)) == 0), ("test", F.pmod("conv_id", F.lit(2)) == 1)):
        paths[split] = f"{root}/sts-{split}.tsv"
        _pairs_as_tsv(spark, sf, paths[split], cond)
    return R.read_splits(spark, paths, R.PAIR_SCHEMA)


@register("sink_csv")
def q_sink_csv(spark, sf):
    """Sentences, titles (with line breaks) and a null title per fifth item."""
    path = scratch_path(spark, "add") + "/add_train.csv"
    none = S.headlines(spark, sf).where(F.pmod("item_id", F.lit(5)) == 0).select(F.lit(None).cast("string"))
    SK.write_csv(_corpora(spark, sf).select("sentence").union(none), path)
    return R.read_by_extension(spark, path, R.SENTENCE_SCHEMA, multiline=True)


def _eval_features(spark, sf):
    p = S.sts_pairs(spark, sf)
    split = F.when(F.pmod("conv_id", F.lit(2)) == 0, F.lit("dev")).otherwise(F.lit("test"))
    p = FE.pair_build(p.withColumn("labels", TX.norm_score("score")).withColumn("split", split))
    p = p.select("conv_id", "turn", "split", "labels",
                 F.get("sentences", 0).alias("s1"), F.get("sentences", 1).alias("s2"))
    vocab = FE.build_vocab(S.wiki_sentences(spark, sf), "sentence", VOCAB_SIZE)
    enc = FE.encode(p, ["s1", "s2"], vocab, ["conv_id", "turn"], carry=["split", "labels"])
    return enc


@register("sink_parquet")
def q_sink_parquet(spark, sf):
    path = scratch_path(spark, "validation")
    SK.write_parquet(_eval_features(spark, sf), path, ["split"])
    d = spark.read.parquet(path)
    return d.select("split", "conv_id", "turn", r6("labels").alias("labels"),
                    ids_text(F.get("input_ids", 0)).alias("ids1"), ids_text(F.get("input_ids", 1)).alias("ids2"))


@register("src_split_pick")
def q_src_split_pick(spark, sf):
    path = scratch_path(spark, "validation")
    SK.write_parquet(_eval_features(spark, sf), path, ["split"])
    d = R.read_split(spark, path, "dev")
    return d.select("conv_id", "turn", r6("labels").alias("labels"))


# ----------------------------------------------------------------- features
@register("self_pair")
def q_self_pair(spark, sf):
    s = FE.self_pair(S.wiki_sentences(spark, sf))
    return s.select("doc_id", "pos", F.get("sentences", 0).alias("view0"), F.get("sentences", 1).alias("view1"))


@register("pair_build")
def q_pair_build(spark, sf):
    p = FE.pair_build(S.sts_pairs(spark, sf))
    return p.select("conv_id", "turn", F.get("sentences", 0).alias("view0"), F.get("sentences", 1).alias("view1"))


@register("build_vocab")
def q_build_vocab(spark, sf):
    return FE.build_vocab(S.wiki_sentences(spark, sf), "sentence", VOCAB_SIZE)


def _train_features(spark, sf, with_masks=False):
    w = S.wiki_sentences(spark, sf)
    vocab = FE.build_vocab(w, "sentence", VOCAB_SIZE)
    return FE.encode(w, "sentence", vocab, ["doc_id", "pos"], with_masks=with_masks)


@register("encode_pad")
def q_encode_pad(spark, sf):
    e = _train_features(spark, sf)
    return e.select("doc_id", "pos", ids_text("input_ids").alias("input_ids"))


@register("attn_mask")
def q_attn_mask(spark, sf):
    e = _train_features(spark, sf, with_masks=True)
    return e.select("doc_id", "pos", ids_text("attention_mask").alias("attention_mask"),
                    ids_text("token_type_ids").alias("token_type_ids"))


@register("subword_vocab")
def q_subword_vocab(spark, sf):
    return SW.learn_subwords(S.wiki_sentences(spark, sf), "sentence", SUBWORD_SIZE)


@register("subword_encode")
def q_subword_encode(spark, sf):
    """Word pieces learned from the corpus, looked up in the mapped trie."""
    w = SK.land(S.wiki_sentences(spark, sf), "corpus")    # learning and encoding read it
    pieces = SW.subword_tokenizer(SW.learn_subwords(w, "sentence", SUBWORD_SIZE))
    e = FE.encode(w, "sentence", pieces, ["doc_id", "pos"])
    return e.select("doc_id", "pos", ids_text("input_ids").alias("input_ids"))


@register("collate_hook")
def q_collate_hook(spark, sf):
    """A collator of the caller's own (F4): batches by length, without a shuffle order."""
    e = _eval_features(spark, sf).select("conv_id", "turn", F.get("input_ids", 0).alias("ids"))

    def by_length(df, keys, batch_size):
        used = F.size(F.filter("ids", lambda x: x != FE.PAD_ID)).alias("used")
        return row_index(df.select(*keys, used), ["used", *keys], out_col="idx").withColumn(
            "batch_id", F.expr(f"idx div {batch_size}"))

    return FE.collate(e, ["conv_id", "turn"], by_length, batch_size=BATCH_SIZE)


@register("restore_views")
def q_restore_views(spark, sf):
    """The inverse of ``flatten_views``."""
    flat = FE.flatten_views(_eval_features(spark, sf), ["conv_id", "turn"], ["input_ids"])
    back = FE.restore_views(flat, ["conv_id", "turn"], ["input_ids"])
    return back.select("conv_id", "turn", ids_text(F.get("input_ids", 0)).alias("ids1"),
                       ids_text(F.get("input_ids", 1)).alias("ids2"))


@register("batch_assign")
def q_batch_assign(spark, sf):
    w = SK.land(S.wiki_sentences(spark, sf).select("doc_id", "pos"), "corpus-keys")
    return FE.batch_assign(w, ["doc_id", "pos"], BATCH_SIZE, SEED)


@register("pad_batch")
def q_pad_batch(spark, sf):
    w = S.wiki_sentences(spark, sf)
    vocab = FE.build_vocab(w, "sentence", VOCAB_SIZE)
    # the ranges are counted before encoding; encoded rows cross the one exchange
    e = FE.encode(w, "sentence", vocab, ["doc_id", "pos"], pad=False)
    out = FE.batch_and_pad(e, ["doc_id", "pos"], "input_ids", BATCH_SIZE, SEED, PAD_MULTIPLE, counts_from=w)
    return out.select("doc_id", "pos", "batch_id", "width", ids_text("input_ids").alias("input_ids"))


def _pair_features(spark, sf, with_masks=False):
    w = SK.land(S.wiki_sentences(spark, sf), "corpus")    # the vocabulary and the encoding read it
    vocab = FE.build_vocab(w, "sentence", VOCAB_SIZE)
    p = FE.self_pair(w).select("doc_id", "pos", F.get("sentences", 0).alias("a"))  # both views are alike
    return FE.encode(p, ["a", "a"], vocab, ["doc_id", "pos"], with_masks=with_masks)


@register("flatten_views")
def q_flatten_views(spark, sf):
    f = _pair_features(spark, sf, with_masks=True)
    flat = FE.flatten_views(f, ["doc_id", "pos"], ["input_ids", "attention_mask"])
    return flat.select("doc_id", "pos", "view", ids_text("input_ids").alias("input_ids"),
                       ids_text("attention_mask").alias("attention_mask"))


@register("take_view")
def q_take_view(spark, sf):
    e = _eval_features(spark, sf)
    t = FE.take_view(e, "input_ids", 1, "ids2")
    return t.select("conv_id", "turn", ids_text("ids2").alias("input_ids"))


@register("dedup_label")
def q_dedup_label(spark, sf):
    e = _eval_features(spark, sf)
    flat = FE.flatten_views(e, ["conv_id", "turn"], ["input_ids"], repeat=["labels"])
    d = FE.dedup_label(flat, ["conv_id", "turn"], "labels")
    return d.select("conv_id", "turn", r6("labels").alias("labels"))


@register("mlm_mask")
def q_mlm_mask(spark, sf):
    f = _pair_features(spark, sf)
    m = FE.mlm_mask(f, "input_ids", ["doc_id", "pos"], VOCAB_SIZE, seed=SEED, carry=["doc_id", "pos"])
    flat = FE.flatten_views(m, ["doc_id", "pos"], ["mlm_input_ids", "mlm_labels"])
    return flat.select("doc_id", "pos", "view", ids_text("mlm_input_ids").alias("mlm_input_ids"),
                       ids_text("mlm_labels").alias("mlm_labels"))


def _length_features(batch: pa.RecordBatch, max_chars: int) -> pa.RecordBatch:
    """Batched map: code-point length and whitespace-token count, capped length."""
    s = batch.column(batch.schema.get_field_index("sentence"))
    n = pc.utf8_length(s)
    toks = pc.list_value_length(pc.split_pattern(s, " "))
    return pa.RecordBatch.from_arrays(
        [batch.column(0), batch.column(1), n.cast(pa.int64()),
         pc.min_element_wise(n, pa.scalar(max_chars, pa.int32())).cast(pa.int64()), toks.cast(pa.int64())],
        names=["doc_id", "pos", "n_chars", "n_chars_capped", "n_pieces"])


@register("map_batches")
def q_map_batches(spark, sf):
    w = S.wiki_sentences(spark, sf).select("doc_id", "pos", "sentence")
    return FE.map_batches(w, _length_features,
                          "doc_id long, pos int, n_chars long, n_chars_capped long, n_pieces long",
                          max_chars=64)


@register("map_files")
def q_map_files(spark, sf):
    """The batched map over a landed corpus with a commit for every few files."""
    root = scratch_path(spark, "map-files")
    S.wiki_sentences(spark, sf).select("doc_id", "pos", "sentence").write.parquet(root + "/in")
    return RS.map_files(spark, root + "/in", _length_features,
                        "doc_id long, pos int, n_chars long, n_chars_capped long, n_pieces long", root + "/out",
                        max_chars=64)


@register("holdout_split")
def q_holdout_split(spark, sf):
    w = S.wiki_sentences(spark, sf).select("doc_id", "pos")
    return FE.holdout_split(w, ["doc_id", "pos"], seed=SEED)


# ------------------------------------------------------------------ vectors
def _pooled(spark, sf, pooler):
    p = VO.pool(S.hidden_states(spark, sf), pooler, ["id"])
    return VO.explode_vector(p, ["id"], "pooled")


@register("pool_cls")
def q_pool_cls(spark, sf):
    return _pooled(spark, sf, "cls")


@register("pool_avg")
def q_pool_avg(spark, sf):
    return _pooled(spark, sf, "avg")


@register("pool_first_last")
def q_pool_first_last(spark, sf):
    return _pooled(spark, sf, "avg_first_last")


@register("pool_top2")
def q_pool_top2(spark, sf):
    return _pooled(spark, sf, "avg_top2")


@register("dense_tanh")
def q_dense_tanh(spark, sf):
    e = S.table(spark, sf, "embeddings").select("vec_id", "embedding")
    d = VO.dense_tanh(e, "embedding", dense_weights())
    return VO.explode_vector(d, ["vec_id"], "projected")


@register("cos_temp")
def q_cos_temp(spark, sf):
    p = S.scored_pairs(spark, sf)
    return p.select("pair_id", r6(V.cos_temp("v1", "v2")).alias("logit"))


def _sim(spark, sf, fn):
    p = S.scored_pairs(spark, sf)
    return p.select("split", "pair_id", r6(fn("v1", "v2")).alias("score"))


@register("sim_cosine")
def q_sim_cosine(spark, sf):
    return _sim(spark, sf, V.paired_cosine)


@register("sim_manhattan")
def q_sim_manhattan(spark, sf):
    return _sim(spark, sf, V.neg_manhattan)


@register("sim_euclidean")
def q_sim_euclidean(spark, sf):
    return _sim(spark, sf, V.neg_euclidean)


@register("sim_dot")
def q_sim_dot(spark, sf):
    return _sim(spark, sf, V.dot)


# -------------------------------------------------------------- contrastive
def _summary(scores):
    return scores.select("batch_id", "row", "n_cols", r6("pos_logit").alias("pos_logit"),
                         r6("max_logit").alias("max_logit"), r6("lse").alias("lse"))


@register("batch_sim")
def q_batch_sim(spark, sf):
    return _summary(C.in_batch_scores(S.views(spark, sf, 2), ["z1", "z2"]))


@register("hard_neg_cols")
def q_hard_neg_cols(spark, sf):
    return _summary(C.in_batch_scores(S.views(spark, sf, 3), ["z1", "z2", "z3"]))


@register("hard_neg_weight")
def q_hard_neg_weight(spark, sf):
    return _summary(C.in_batch_scores(S.views(spark, sf, 3), ["z1", "z2", "z3"], hard_negative_weight=1.0))


@register("info_nce")
def q_info_nce(spark, sf):
    scores = C.in_batch_scores(S.views(spark, sf, 2), ["z1", "z2"])
    return C.info_nce(scores).select("batch_id", "n_rows", r6("loss").alias("loss"))


@register("global_batch")
def q_global_batch(spark, sf):
    """The negatives of a step are those of all workers: a block product, blocks as large as a worker's batch."""
    scores = C.blocked_scores(S.step_views(spark, sf), ["z1", "z2"], block_rows=S.LOCAL_BATCH_ROWS)
    return C.info_nce(scores).select(F.col("batch_id").alias("step"), "n_rows", r6("loss").alias("loss"))


@register("masked_ce")
def q_masked_ce(spark, sf):
    tok = C.masked_ce(S.mlm_logits(spark, sf), ["row", "pos"])
    return tok.agg(F.count(F.lit(1)).alias("n_tokens"), r6(F.avg("token_loss")).alias("mlm_loss"),
                   r6(F.lit(C.MLM_WEIGHT) * F.avg("token_loss")).alias("weighted_mlm_loss"))


@register("diag_scores")
def q_diag_scores(spark, sf):
    d = C.diag_scores(S.views(spark, sf, 2))
    return d.select("batch_id", "row", r6("score").alias("score"))


# --------------------------------------------------------------- evaluation
@register("pearson")
def q_pearson(spark, sf):
    s = VO.pair_scores(S.scored_pairs(spark, sf))
    return s.groupBy("split").agg(r6(EV.pearson("cosine", "gold")).alias("pearson"))


@register("spearman")
def q_spearman(spark, sf):
    s = VO.pair_scores(S.scored_pairs(spark, sf))
    return EV.spearman(s, "cosine", "gold", ["split"]).select("split", r6("spearman").alias("spearman"))


def _rounded(df, keep=()):
    return df.select(*keep, *[r6(c).alias(c) for c in df.columns if c not in keep])


@register("eval_report")
def q_eval_report(spark, sf):
    return _rounded(EV.eval_report(S.scored_pairs(spark, sf)))


@register("eval_by_split")
def q_eval_by_split(spark, sf):
    return _rounded(EV.eval_report(S.scored_pairs(spark, sf), group_cols=["split"]), keep=["split"])


@register("metric_hook")
def q_metric_hook(spark, sf):
    """A metric of the caller's own (F3): mean absolute difference of cosine and scaled gold, per split."""
    def metrics(scored):
        off = F.abs(F.col("cosine") - F.col("gold") / F.lit(5.0))
        return scored.groupBy("split").agg(F.count(off).alias("n"), r6(F.avg(off)).alias("mean_off"))
    return EV.evaluate(S.scored_pairs(spark, sf), metrics)


@register("eval_diag_report")
def q_eval_diag_report(spark, sf):
    v = S.views(spark, sf, 2)
    d = C.diag_scores(v)
    return _rounded(EV.eval_diag_report(d, "score", "gold"))


# --------------------------------------------------------------------- runs
@register("best_checkpoint")
def q_best_checkpoint(spark, sf):
    b = RU.best_checkpoint(S.metrics_log(spark, sf))
    return b.select("run", "best_step", r6("best_metric").alias("best_metric"))


@register("early_stop")
def q_early_stop(spark, sf):
    e = RU.early_stop(S.metrics_log(spark, sf))
    return e.select("run", "stop_step", "best_step", r6("best_metric").alias("best_metric"))


@register("retain_last_k")
def q_retain_last_k(spark, sf):
    r = RU.retain_last_k(S.metrics_log(spark, sf))
    return r.select("run", "step", r6("metric").alias("metric"), "is_best")
