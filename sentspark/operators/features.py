"""Feature building: views, vocabulary, encoding, batching, masking.

The reference encodes with a pretrained subword tokenizer.  Here the
vocabulary is a table built from the corpus (space-separated tokens, top-k
by frequency) or a tokenizer of the caller's own; shapes, special-token
placement, truncation, padding and masking follow the reference.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import hash_key, md5_u32
from ..functions.text import fill_null_text
from ..session import ship_package
from .scan import row_index
from .tokenizing import (CLS_ID, MASK_ID, N_SPECIAL, PAD_ID, SEP_ID, SPECIAL_IDS, UNK_ID, Tokenizer, VocabTokenizer,
                         encoder, masker)

# Label value that the masked-token loss ignores.
IGNORE_INDEX = -100
# Defaults of the reference's arguments.
MAX_SEQ_LENGTH = 32
MLM_PROBABILITY = 0.15
MLM_MASK_SHARE = 0.8       # of picked tokens -> MASK
MLM_RANDOM_SHARE = 0.5     # of the remaining picked tokens -> random id
VALIDATION_PERCENT = 5
# Rows of a vocabulary up to which it is sent to every task; beyond, a join.
BROADCAST_VOCAB = 2_000_000
BUCKETS_PER_PARTITION = 4
# Ranges a partition in the count pass of ``batch_and_pad``; one in so many rows may be sent twice.
FINE_BUCKETS = 256


def self_pair(df: DataFrame, col: str = "sentence", out_col: str = "sentences",
              blank_as_null: bool = True) -> DataFrame:
    """Each sentence becomes two identical views; null -> " "."""
    s = fill_null_text(col, blank_as_null=blank_as_null)
    return df.withColumn(out_col, F.array(s, s))


def pair_build(df: DataFrame, c1: str = "sentence1", c2: str = "sentence2",
               out_col: str = "sentences") -> DataFrame:
    """``[sentence1, sentence2]`` with nulls -> " "."""
    return df.withColumn(out_col, F.array(fill_null_text(c1), fill_null_text(c2)))


def tokens(col) -> Column:
    """Space-separated tokens, empty pieces dropped."""
    c = F.col(col) if isinstance(col, str) else col
    return F.filter(F.split(c, " ", -1), lambda t: t != F.lit(""))


def build_vocab(df: DataFrame, col: str = "sentence", vocab_size: int = 32000) -> DataFrame:
    """T4: ``(token, id, cnt)`` for the ``vocab_size - N_SPECIAL`` most frequent
    tokens (ties by token); ids start after the reserved ones.

    * Token counts: ``groupBy`` with map-side partial aggregation.
    * Exact pre-filter: tokens per octave bucket of their count (16 buckets an
      octave, about a thousand at most) give the bucket in which the k-th token
      lies; lower ones are dropped before anything else moves.  The bucket is a
      scalar subquery, computed once.
    * What is left is numbered in two levels in order of (count, token), so
      neither a popular count (all tokens seen once) nor the candidates ever
      meet in one task; the table of bucket totals is bounded by the octave
      buckets plus the first characters of rare tokens, not by the corpus.
    """
    k = vocab_size - N_SPECIAL
    if k <= 0:
        raise ValueError("vocab_size must exceed the number of reserved ids")
    counts = (df.select(F.explode(F.split(col, " ", -1)).alias("token")).where(F.col("token") != "")
                .groupBy("token").agg(F.count(F.lit(1)).alias("cnt"))
                .withColumn("_oct", F.floor(F.log2("cnt") * F.lit(16.0)).cast("int")))
    hist = counts.groupBy("_oct").agg(F.count(F.lit(1)).alias("_n_tok"))
    at_least = F.sum("_n_tok").over(  # over octave buckets only
        Window.orderBy(F.col("_oct").desc()).rowsBetween(Window.unboundedPreceding, 0))
    thr = (hist.withColumn("_at_least", at_least).where(F.col("_at_least") >= F.lit(k))
               .agg(F.max("_oct").alias("_thr"))
               .select(F.coalesce(F.col("_thr"), F.lit(0)).alias("_thr")))  # < k tokens: keep all
    cand = counts.where(F.col("_oct") >= thr.scalar()).withColumn("_less", -F.col("cnt"))
    # a count below 17 has an octave bucket of its own, so it can be cut by token
    part = F.struct((-F.col("_oct")).alias("a"),
                    F.when(F.col("cnt") <= 16, F.substring("token", 1, 1)).otherwise("").alias("b"))
    top = row_index(cand, ["_less", "token"], out_col="_nth", bucket=part).where(F.col("_nth") < k)
    return top.select("token", (F.col("_nth") + F.lit(N_SPECIAL)).cast("int").alias("id"), "cnt")


def vocab_tokenizer(vocab: DataFrame, most: int = BROADCAST_VOCAB) -> VocabTokenizer | None:
    """A tokenizer of the ``(token, id)`` table, or ``None`` if it has more than
    ``most`` rows.  Runs the table's plan: the bounded table is what tasks get."""
    table = vocab.select("token", F.col("id").cast("int").alias("id")).limit(most + 1).toArrow()
    if table.num_rows > most:
        return None
    made = VocabTokenizer.of(table.column("token").to_pylist(), table.column("id").to_numpy())
    made.trie.send(vocab.sparkSession)
    return made


def encode(df: DataFrame, cols, vocab: DataFrame | Tokenizer, keys: Sequence[str],
           max_length: int = MAX_SEQ_LENGTH, pad: bool = True,
           out_col: str = "input_ids", carry: Sequence[str] = (), with_masks: bool = False,
           pad_id: int = PAD_ID, broadcast_rows: int = BROADCAST_VOCAB) -> DataFrame:
    """``[CLS] t1..tn [SEP] [PAD]...``, truncated so the specials fit in L.

    ``cols`` is one text column (-> ``array<int>``) or a list of view columns
    (-> ``array<array<int>>``, one inner array per view; a column named twice
    is encoded once).  ``vocab`` is a ``(token, id)`` table or a tokenizer of
    the caller's own (``tokenizing.Tokenizer``), e.g. a pretrained subword one.
    Encoding is row-local: rows stay in their tasks and nothing is exchanged.
    A table of more than ``broadcast_rows`` rows is joined instead.  ``keys``
    must identify a row; ``carry`` columns ride along.

    ``with_masks`` also returns ``attention_mask`` and ``token_type_ids`` (T5),
    as a tokenizer does.
    """
    if max_length < 2:
        raise ValueError("max_length must leave room for CLS and SEP")
    keys = list(keys) + list(carry)
    nested = not isinstance(cols, str)
    views = list(cols) if nested else [cols]
    tokenizer = vocab_tokenizer(vocab, broadcast_rows) if isinstance(vocab, DataFrame) else vocab
    if tokenizer is None:
        return _encode_by_join(df, views, nested, vocab, keys, max_length, pad, out_col, with_masks)
    ship_package(df.sparkSession)
    texts = {v: f"_text{i}" for i, v in enumerate(dict.fromkeys(views))}
    rows = df.select(*keys, *[F.col(v).cast("string").alias(t) for v, t in texts.items()])
    kind = "array<array<int>>" if nested else "array<int>"
    names = [out_col, "attention_mask", "token_type_ids"][:3 if with_masks else 1]
    out = T.StructType([*(rows.schema[c] for c in keys),
                        *(T.StructField(n, T.DataType.fromDDL(kind)) for n in names)])
    return rows.mapInArrow(encoder(tokenizer, [texts[v] for v in views], nested, keys, out_col, max_length, pad,
                                   pad_id, with_masks), out)


def _encode_by_join(df: DataFrame, views: list[str], nested: bool, vocab: DataFrame, keys: list[str],
                    max_length: int, pad: bool, out_col: str, with_masks: bool) -> DataFrame:
    """``encode`` for a vocabulary too large to send: tokens are exploded, joined
    and collected again per row (two exchanges)."""
    arr = F.array(*[F.col(c) for c in views])
    v = df.select(*keys, F.posexplode(arr).alias("view", "_text"))
    toks = v.select(*keys, "view", F.posexplode_outer(F.slice(tokens("_text"), 1, max_length - 2))
                    .alias("tpos", "token"))
    looked = toks.join(vocab.select("token", F.col("id").alias("tid")), on="token", how="left")
    entry = F.struct(F.col("view"), F.col("tpos"),
                     F.when(F.col("tpos").isNotNull(), F.coalesce(F.col("tid"), F.lit(UNK_ID))).alias("tid"))
    per = looked.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("_t"))

    def ids_of(k):
        mine = F.filter(F.col("_t"), lambda e: (e["view"] == F.lit(k)) & e["tid"].isNotNull())
        ids = F.concat(F.array(F.lit(CLS_ID)), F.transform(mine, lambda e: e["tid"]), F.array(F.lit(SEP_ID)))
        if pad:
            ids = F.concat(ids, F.array_repeat(F.lit(PAD_ID), F.lit(max_length) - F.size(ids)))
        return ids.cast("array<int>")

    def stack(fn):
        return F.array(*[fn(ids_of(k)) for k in range(len(views))]) if nested else fn(ids_of(0))

    out = [stack(lambda ids: ids).alias(out_col)]
    if with_masks:
        out += [stack(attention_mask).alias("attention_mask"), stack(token_type_ids).alias("token_type_ids")]
    return per.select(*keys, *out)


def attention_mask(ids) -> Column:
    """T5: 1 on real tokens, 0 on padding (works on array or array-of-array)."""
    c = F.col(ids) if isinstance(ids, str) else ids
    return F.transform(c, lambda x: (x != F.lit(PAD_ID)).cast("int"))


def token_type_ids(ids) -> Column:
    """T5: all-zero segment ids of the same length."""
    c = F.col(ids) if isinstance(ids, str) else ids
    return F.array_repeat(F.lit(0), F.size(c))


def batch_assign(df: DataFrame, keys: Sequence[str], batch_size: int, seed: int = 42,
                 idx_col: str = "idx", batch_col: str = "batch_id",
                 num_buckets: int | None = None) -> DataFrame:
    """Shuffle by a seeded md5 of the key, number rows ``0..n-1`` in that
    order, ``batch_id = idx div batch_size`` (the last batch is short).

    The order key is an md5, uniform by construction, so its leading 32 bits
    cut it into ``num_buckets`` equal ranges without sampling: bucket b holds
    a contiguous slice of the global order and ~n/num_buckets rows whatever
    the keys look like (no hot bucket).  Rows take one hash exchange on the
    bucket and get a per-bucket ``row_number``; the bucket sizes are counted
    with map-side partial aggregation (one row per bucket and task is
    shuffled), turned into offsets by a window over that tiny table and
    broadcast back.  No Python, no sort of the whole table in one task.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # several buckets per partition: hashing bucket ids onto partitions then
    # evens out (one bucket per partition would leave some tasks with 3-4)
    nb = max(1, num_buckets or BUCKETS_PER_PARTITION * parts)
    key = hash_key(seed, *[F.col(k) for k in keys])
    order = F.md5(key)
    bucket = F.floor(md5_u32(key).cast("double") * F.lit(float(nb)) / F.lit(2.0 ** 32)).cast("int")
    keyed = df.withColumn("_bkt", bucket)
    counts = keyed.groupBy("_bkt").agg(F.count(F.lit(1)).alias("_n"))
    spread = keyed.withColumn("_ord", order).repartition(parts, "_bkt")
    before = Window.orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)  # <= nb rows
    offsets = counts.select("_bkt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    local = F.row_number().over(Window.partitionBy("_bkt").orderBy("_ord", *keys)) - F.lit(1)
    numbered = spread.withColumn("_lrn", local)
    out = numbered.join(F.broadcast(offsets), "_bkt")
    idx = (F.col("_off") + F.col("_lrn")).cast("long")
    return (out.select(*[F.col(f"`{c}`") for c in df.columns], idx.alias(idx_col))
               .withColumn(batch_col, F.floor(F.col(idx_col) / F.lit(batch_size)).cast("long")))


def pad_batch(df: DataFrame, ids_col: str, batch_col: str = "batch_id",
              pad_to_multiple_of: int | None = None, max_length: int | None = None,
              out_col: str | None = None, width_col: str = "width") -> DataFrame:
    """Pad every row to the longest row *of its batch*, rounded up to a
    multiple.  Batches are bounded by the batch size, so the window is too."""
    out_col = out_col or ids_col
    longest = F.max(F.size(ids_col)).over(Window.partitionBy(batch_col))
    return _padded(df, ids_col, longest, pad_to_multiple_of, max_length, out_col, width_col)


def _padded(df: DataFrame, ids_col: str, longest: Column, multiple: int | None, max_length: int | None,
            out_col: str, width_col: str) -> DataFrame:
    width = longest
    if multiple:
        m = F.lit(multiple)
        width = F.ceil(longest / m) * m
    if max_length:
        width = F.least(width, F.lit(max_length))
    out = df.withColumn(width_col, width.cast("int"))
    padded = F.concat(F.col(ids_col), F.array_repeat(F.lit(PAD_ID), F.col(width_col) - F.size(ids_col)))
    return out.withColumn(out_col, padded)


def batch_and_pad(df: DataFrame, keys: Sequence[str], ids_col: str, batch_size: int, seed: int = 42,
                  pad_to_multiple_of: int | None = None, max_length: int | None = None,
                  counts_from: DataFrame | None = None, idx_col: str = "idx", batch_col: str = "batch_id",
                  width_col: str = "width", partitions: int | None = None) -> DataFrame:
    """T6 and T7 with one exchange of the rows: the batches of ``batch_assign``,
    each padded as by ``pad_batch``.

    * Count pass: rows per md5 range (``FINE_BUCKETS`` ranges a partition;
      partial sums, one row a range).  It reads the keys alone, from
      ``counts_from`` if given (the same rows before a costly step such as
      encoding).  Running totals say which numbers a range holds.
    * A partition holds a run of whole batches.  The numbers of a row's range
      name its partition; the few ranges that straddle a border go to both
      sides.  Rows are dealt there directly (``repartitionById``).
    * There each row is numbered, rows of other partitions are dropped, and
      the longest row of each batch is a window that needs no exchange.
    """
    spark = df.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = FINE_BUCKETS * parts
    def key():
        return hash_key(seed, *[F.col(f"`{k}`") for k in keys])

    bucket = F.floor(md5_u32(key()).cast("double") * F.lit(float(ranges)) / F.lit(2.0 ** 32)).cast("int")
    counts = (df if counts_from is None else counts_from).select(bucket.alias("_bkt")).groupBy("_bkt").agg(
        F.count(F.lit(1)).alias("_n"))
    batches = F.ceil(counts.agg(F.sum("_n")).scalar() / F.lit(batch_size))
    held = (F.ceil(batches / F.lit(parts)) * F.lit(batch_size)).cast("long")      # rows of a partition
    before = Window.orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)    # one row a range
    offsets = counts.select("_bkt", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"), held.alias("_held"))
    offsets = offsets.select("_bkt", "_off", "_held", F.sequence(
        F.expr("_off div _held"), F.expr("(_off + _n - 1) div _held")).alias("_parts"))
    dealt = (df.withColumn("_bkt", bucket).withColumn("_ord", F.md5(key()))
               .join(F.broadcast(offsets), "_bkt")
               .withColumn("_part", F.explode("_parts")).drop("_parts")
               .repartitionById(parts, F.col("_part").cast("int")).withColumn("_part", F.col("_part").cast("int")))
    order = Window.partitionBy("_part").orderBy("_bkt", "_ord", *[F.col(f"`{k}`") for k in keys])
    numbered = dealt.withColumn(idx_col, F.first("_off").over(order) + F.row_number().over(order) - F.lit(1))
    mine = numbered.where(F.expr(f"`{idx_col}` div _held") == F.col("_part")).withColumn(
        batch_col, F.expr(f"`{idx_col}` div {int(batch_size)}"))
    longest = F.max(F.size(ids_col)).over(Window.partitionBy("_part", batch_col))
    return _padded(mine, ids_col, longest, pad_to_multiple_of, max_length, ids_col, width_col).select(
        *[F.col(f"`{c}`") for c in df.columns], idx_col, batch_col, width_col)


def flatten_views(df: DataFrame, keys: Sequence[str], cols: Sequence[str],
                  view_col: str = "view", repeat: Sequence[str] = ()) -> DataFrame:
    """``(row, [v0..vk])`` -> ``(row, view, v)``; the other columns in
    ``repeat`` are copied onto every view (as the reference's flattening does)."""
    zipped = F.arrays_zip(*[F.col(c) for c in cols])
    return (df.select(*keys, *repeat, F.posexplode(zipped).alias(view_col, "_z"))
              .select(*keys, *repeat, view_col, *[F.col("_z")[c].alias(c) for c in cols]))


def restore_views(flat: DataFrame, keys: Sequence[str], cols: Sequence[str],
                  view_col: str = "view") -> DataFrame:
    """T8 inverse: regroup views per row in view order (groups hold one row's views)."""
    agg = F.array_sort(F.collect_list(F.struct(F.col(view_col), *[F.col(c) for c in cols]))).alias("_s")
    g = flat.groupBy(*keys).agg(agg)
    def field(name):
        return lambda s: s[name]

    return g.select(*keys, *[F.transform("_s", field(c)).alias(c) for c in cols])


def take_view(df: DataFrame, col: str, k: int, out_col: str | None = None) -> DataFrame:
    """View ``k`` (0-based) of a stacked column."""
    return df.withColumn(out_col or f"{col}_{k}", F.get(F.col(col), k))


def dedup_label(flat: DataFrame, keys: Sequence[str], label_col: str = "labels",
                view_col: str = "view") -> DataFrame:
    """Labels repeated on every view collapse to the first view's."""
    return flat.groupBy(*keys).agg(F.min_by(F.col(label_col), F.col(view_col)).alias(label_col))


def mlm_mask(df: DataFrame, ids_col: str, keys: Sequence[str], vocab_size: int,
             probability: float = MLM_PROBABILITY, seed: int = 42,
             out_ids: str = "mlm_input_ids", out_labels: str = "mlm_labels",
             carry: Sequence[str] | None = None) -> DataFrame:
    """Masked-LM inputs and labels for an ``array<array<int>>`` column.

    Non-special positions are picked with ``probability``; of those 80 % become
    MASK, half of the rest a random id over the whole vocabulary, the rest stay.
    Unpicked labels are -100.  The four draws of a token are disjoint slices
    of one md5 of ``seed:keys:view:pos`` -- stable across retries, no shuffle.

    Works on Arrow batches; padding and other special ids are never hashed.
    All columns of ``df`` come back with the two new ones; ``carry`` names
    fewer, the others then do not travel from the Python workers.
    """
    ship_package(df.sparkSession)
    kept = [f for f in df.schema if carry is None or f.name in carry]
    keyed = df.withColumn("_key", hash_key(seed, *[F.col(k) for k in keys]))
    kind = T.ArrayType(T.ArrayType(T.IntegerType()))
    out = T.StructType([*kept, T.StructField(out_ids, kind), T.StructField(out_labels, kind)])
    return keyed.mapInArrow(masker(ids_col, SPECIAL_IDS, probability, MLM_MASK_SHARE, MLM_RANDOM_SHARE, vocab_size,
                                   IGNORE_INDEX, out_ids, out_labels, "_key", [f.name for f in kept]), out)


def default_batcher(df: DataFrame, keys: Sequence[str], ids_col: str = "input_ids",
                    batch_size: int = 256, seed: int = 42,
                    pad_to_multiple_of: int | None = None) -> DataFrame:
    """The reference's default collation: shuffled fixed-size batches (T6),
    then padding to the longest row of each batch (T7)."""
    return batch_and_pad(df, keys, ids_col, batch_size, seed, pad_to_multiple_of)


def collate(df: DataFrame, keys: Sequence[str],
            batcher: Callable[..., DataFrame] | None = None, **params) -> DataFrame:
    """pluggable collator.  ``batcher(df, keys, **params)`` turns feature
    rows into batch rows (a ``DataFrame -> DataFrame`` step); the default is
    ``default_batcher``."""
    return (batcher or default_batcher)(df, keys, **params)


def map_batches(df: DataFrame, fn: Callable[..., pa.RecordBatch], schema, **params) -> DataFrame:
    """A batched table function with bound parameters, run per Arrow
    batch in every task (the reference's ``Dataset.map(partial(f), batched)``)."""
    bound = functools.partial(fn, **params)

    def run(batches):
        for b in batches:
            yield bound(b)

    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)


def holdout_split(df: DataFrame, keys: Sequence[str], percent: int = VALIDATION_PERCENT,
                  seed: int = 42, out_col: str = "split") -> DataFrame:
    """Hash split: ``md5 value mod 100 < percent`` -> validation."""
    u = md5_u32(hash_key(seed, *[F.col(k) for k in keys]))
    return df.withColumn(out_col, F.when(F.pmod(u, F.lit(100)) < F.lit(percent), F.lit("validation"))
                                   .otherwise(F.lit("train")))
