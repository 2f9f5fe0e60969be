"""End-to-end jobs in the shape of the reference's entry scripts, composed
from the operators only (no logic of their own).

* ``prepare_corpus`` -- clean an encyclopedia text table into sentences,
  union them with headline titles, unpivot sentence-pair tables; each result
  is written as CSV, the dev and test pairs as TSV (the reference's corpus files).
* ``make_datasets`` -- read the training sentences (format by extension) and
  the dev/test pair files, build the vocabulary, encode training rows as two
  identical views and evaluation rows as (sentence1, sentence2) with labels,
  and write Parquet partitioned by split.
* The third script's report is ``evaluation.evaluate`` (per split with
  ``group_cols=["split"]``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import norm_score
from ..operators import corpus as CO
from ..operators import features as FE
from ..operators import subword as SW
from ..operators import text as TO
from ..operators.tokenizing import Tokenizer
from ..sources import readers as R
from ..sources import sinks as SK
from ..sources.paths import dataset_path

ROW_ID = "row_id"


def prepare_corpus(corpus: DataFrame, headlines: Sequence[DataFrame], pairs: Sequence[DataFrame],
                   out_dir: str, keys: Sequence[str] = ("doc_id",), text_col: str = "text",
                   spread_to: int | None = None, eval_pairs: Mapping[str, DataFrame] | None = None) -> dict[str, str]:
    """Corpus preparation.  Returns the written paths:

    * ``wiki``: cleaned sentences of ``corpus`` (P4-P9, U1), one column;
    * ``add``: those sentences, then every headline ``title`` in the order
      given (U2, UNION ALL, nulls kept);
    * ``unsup``: every ``sentence1`` then every ``sentence2`` of each pair
      table (U3), null rows dropped (P9);
    * one TSV per split of ``eval_pairs`` (``dev``, ``test``): ``sentence1``,
      ``sentence2`` and ``score``, tabs and line breaks in texts as spaces.

    ``spread_to`` deals a corpus stored as one file to that many tasks.
    """
    keys = list(keys)
    docs = corpus.select(*keys, text_col)
    if spread_to:
        docs = R.spread(docs, keys, spread_to)
    wiki = TO.drop_null(TO.clean_sentences(docs, text_col, keys))
    paths = {"wiki": dataset_path(out_dir, "wiki_", "train", "csv"),
             "add": dataset_path(out_dir, "add_", "train", "csv"),
             "unsup": dataset_path(out_dir, "unsup_", "train", "csv")}
    SK.write_csv(wiki.select("sentence"), paths["wiki"])
    wiki = R.read_csv(docs.sparkSession, paths["wiki"], R.SENTENCE_SCHEMA)     # cleaned once
    titles = [TO.rename_col(h.select("title"), "title", "sentence") for h in headlines]
    SK.write_csv(CO.union_corpora([wiki, *titles], "sentence").select("sentence"), paths["add"])
    flat = []
    for i, p in enumerate(pairs):
        u = CO.unpivot_pairs(p.select("sentence1", "sentence2").withColumn("_src", F.lit(i)), ["_src"])
        flat.append(u.select("sentence"))
    SK.write_csv(TO.drop_null(CO.union_corpora(flat, "sentence").select("sentence")), paths["unsup"])
    for split, p in (eval_pairs or {}).items():
        paths[split] = dataset_path(out_dir, "sts-", split, "tsv")
        plain = [F.regexp_replace(c, "[\t\n\r]", " ").alias(c) for c in ("sentence1", "sentence2")]
        SK.write_tsv(p.select(*plain, "score"), paths[split])
    return paths


def _keyed(df: DataFrame, name: str) -> DataFrame:
    """A file without keys gets one at landing: ids are written once, so a
    recomputed task can never renumber rows."""
    return SK.land(df.withColumn(ROW_ID, F.monotonically_increasing_id()), name)


def make_datasets(spark: SparkSession, train_path: str, eval_paths: Mapping[str, str], out_dir: str,
                  vocab_size: int = 32000, max_length: int = FE.MAX_SEQ_LENGTH,
                  tokenizer: Tokenizer | None = None, subwords: bool = False) -> str:
    """Feature building.  ``train_path`` holds one ``sentence`` column (CSV,
    TSV, JSON or Parquet by extension); ``eval_paths`` maps split names to
    TSV files with ``sentence1, sentence2, score``.  The vocabulary is that of the
    corpus: its whole words, or with ``subwords`` the word pieces learned from
    it; ``tokenizer`` replaces it (e.g. a pretrained one).  Writes
    ``(row_id, input_ids, attention_mask, token_type_ids, labels)`` per
    split under ``out_dir`` (``labels`` is null for training rows)."""
    train = _keyed(R.read_by_extension(spark, train_path, R.SENTENCE_SCHEMA), "train-keyed")
    if tokenizer is not None:
        vocab = tokenizer
    elif subwords:
        vocab = SW.subword_tokenizer(SW.learn_subwords(train, "sentence", vocab_size))
    else:
        vocab = FE.vocab_tokenizer(FE.build_vocab(train, "sentence", vocab_size), vocab_size)
    views = FE.self_pair(train).select(ROW_ID, F.get("sentences", 0).alias("a"))  # views are alike
    tr = FE.encode(views, ["a", "a"], vocab, [ROW_ID], max_length=max_length, with_masks=True)
    tr = tr.select(F.lit("train").alias("split"), "*", F.lit(None).cast("double").alias("labels"))
    parts = [tr]
    if eval_paths:
        ev = _keyed(R.read_splits(spark, eval_paths, R.PAIR_SCHEMA), "eval-keyed")
        ev = FE.pair_build(ev.withColumn("labels", norm_score("score")))
        ev = ev.select(ROW_ID, "split", "labels", F.get("sentences", 0).alias("s1"), F.get("sentences", 1).alias("s2"))
        enc = FE.encode(ev, ["s1", "s2"], vocab, [ROW_ID], max_length=max_length, with_masks=True,
                        carry=["split", "labels"])
        parts.append(enc.select("split", ROW_ID, "input_ids", "attention_mask", "token_type_ids", "labels"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    SK.write_parquet(out, out_dir, ["split"])
    return out_dir
