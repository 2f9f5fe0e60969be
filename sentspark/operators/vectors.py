"""Pooling, dense projection and pair similarities over vector tables.

Token-level hidden states are a long table ``(id, layer, pos, mask, vec)``.
Pooling sums a sentence's vectors where they lie and merges the partial sums by
sentence id; a group holds at most one vector per position and layer, so it is
bounded by the model shape, never by the data.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as V
from ..session import ship_package

POOLERS = ("cls", "cls_before_pooler", "avg", "avg_top2", "avg_first_last")


def pool(df: DataFrame, pooler: str = "cls", keys: Sequence[str] = ("id",),
         layer_col: str = "layer", pos_col: str = "pos", mask_col: str = "mask",
         vec_col: str = "vec", out_col: str = "pooled") -> DataFrame:
    """V1-V4 in one grouped pass per sentence.

    ``cls``/``cls_before_pooler``: last layer, position 0 (the two differ only
    by the dense head, ``dense_tanh``).  ``avg``: masked mean of the last
    layer.  ``avg_first_last``: of the first and last.  ``avg_top2``: of the
    last two.  Layers are those of the whole table (a model's); one layer
    stands for both of a pair of which there is only one.  A zero mask gives a
    vector of nulls; a sentence without position 0 has no ``cls`` row.

    Tasks add up their own positions first: what crosses the exchange is one
    vector a sentence and batch of the picked layers, not one a position;
    ``cls`` keeps one row per task and key.
    """
    if pooler not in POOLERS:
        raise ValueError(f"no such pooling: {pooler} (there are {', '.join(POOLERS)})")
    keys = list(keys)
    layer = F.col(layer_col)
    if pooler in ("cls", "cls_before_pooler"):
        first = df.where(F.col(pos_col) == F.lit(0)).select(*keys, layer, F.col(vec_col))
        return first.groupBy(*keys).agg(V.as_double(F.max_by(vec_col, layer_col)).alias(out_col))
    last = df.agg(F.max(layer_col)).scalar()
    if pooler == "avg":
        other = last
    elif pooler == "avg_first_last":
        other = df.agg(F.min(layer_col)).scalar()
    else:  # avg_top2
        other = F.coalesce(df.where(layer < last).agg(F.max(layer_col)).scalar(), last)
    picked = df.where((layer == last) | (layer == other)).select(
        *keys, F.size(vec_col).alias("_size"), F.when(layer == last, F.col(mask_col).cast("double")).alias("_mask"),
        F.when(F.col(mask_col) != F.lit(0), F.col(mask_col).cast("double")).alias("_weight"),
        V.as_double(vec_col).alias("_vec"), F.when(other == last, F.lit(1.0)).otherwise(F.lit(2.0)).alias("_layers"))
    ship_package(df.sparkSession)
    parts = picked.mapInArrow(_partial_sums(keys), T.StructType([
        *(picked.schema[k] for k in keys), T.StructField("_size", T.IntegerType()),
        T.StructField("_mask", T.DoubleType()), T.StructField("_layers", T.DoubleType()),
        T.StructField("_sum", T.ArrayType(T.DoubleType()))]))
    # one vector a key and batch is left; those of a key are added up
    g = parts.groupBy(*keys).agg(F.collect_list("_sum").alias("_sums"), F.max("_size").alias("_size"),
                                 (F.sum("_mask") * F.max("_layers")).alias("_scale"))
    total = F.aggregate("_sums", F.array_repeat(F.lit(0.0), F.col("_size")),
                        lambda acc, x: F.zip_with(acc, x, lambda a, b: a + b))
    mean = F.zip_with(total, F.array_repeat(F.col("_scale"), F.col("_size")), lambda t, d: F.try_divide(t, d))
    return g.select(*keys, mean.alias(out_col))


def _codes(columns: Sequence[pa.Array]) -> np.ndarray:
    """A number of each row, equal for rows alike in all columns (null is a value)."""
    code = np.zeros(len(columns[0]), dtype=np.int64)
    for c in columns:
        coded = c.dictionary_encode(null_encoding="encode")
        _, code = np.unique(code * len(coded.dictionary) + coded.indices.to_numpy(zero_copy_only=False),
                            return_inverse=True)
    return code


def _partial_sums(keys: Sequence[str]):
    """Per batch, one row a key: the weighted sum of its vectors and of its mask.
    Vectors of another length are summed apart."""
    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            size = batch.column("_size").fill_null(-1)
            code = _codes([*(batch.column(k) for k in keys), size])
            order = np.argsort(code, kind="stable")
            first = np.flatnonzero(np.diff(code[order], prepend=-1))
            lead = pa.array(order[first])
            mask = batch.column("_mask")
            masks = np.add.reduceat(mask.fill_null(0.0).to_numpy()[order], first)
            seen = np.logical_or.reduceat(np.asarray(mask.is_valid())[order], first)
            sizes = np.maximum(size.to_numpy(), 0)
            used = np.asarray(batch.column("_weight").is_valid()) & np.asarray(batch.column("_vec").is_valid())
            weight = batch.column("_weight").fill_null(0.0).to_numpy()
            width = sizes[order[first]]
            end = np.cumsum(width)
            values, gaps = np.zeros(int(end[-1])), np.zeros(int(end[-1]), dtype=bool)
            for w in np.unique(width[width > 0]).tolist():
                rows = order[(sizes[order] == w) & used[order]]          # in order of their keys
                if not len(rows):
                    continue
                flat = batch.column("_vec").take(pa.array(rows)).flatten()
                x = flat.fill_null(0.0).to_numpy(zero_copy_only=False).reshape(-1, w) * weight[rows, None]
                begin = np.flatnonzero(np.diff(code[rows], prepend=-1))
                group = code[rows[begin]]
                at = (end - width)[group][:, None] + np.arange(w)
                values[at] = np.add.reduceat(x, begin, axis=0)
                if flat.null_count:
                    gaps[at] = np.logical_or.reduceat(np.asarray(flat.is_null()).reshape(-1, w), begin, axis=0)
            some = np.bincount(code, weights=used, minlength=len(first)) > 0
            sums = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], end]).astype(np.int32)),
                                            pa.array(values, mask=gaps), mask=pa.array(~some))
            out = {k: batch.column(k).take(lead) for k in keys}
            out |= {"_size": batch.column("_size").take(lead), "_mask": pa.array(masks, mask=~seen),
                    "_layers": batch.column("_layers").take(lead), "_sum": sums}
            yield pa.RecordBatch.from_pydict(out)
    return run


def dense_tanh(df: DataFrame, vec_col: str, weight: np.ndarray, bias: np.ndarray | None = None,
               out_col: str = "projected") -> DataFrame:
    """V5: ``tanh(W x + b)`` per row as one numpy matmul per Arrow batch.

    The weights are the model (``out x in``), shipped once with the task
    closure; rows are processed where they are, with no shuffle.
    """
    w = np.asarray(weight, dtype="float64")
    b = np.zeros(w.shape[0]) if bias is None else np.asarray(bias, dtype="float64")
    in_schema = df.schema
    out_schema = T.StructType(in_schema.fields + [T.StructField(out_col, T.ArrayType(T.DoubleType()), True)])
    idx = in_schema.fieldNames().index(vec_col)
    dim_in, dim_out = w.shape[1], w.shape[0]

    out_field = pa.field(out_col, pa.list_(pa.float64()))

    def run(batches):
        for rb in batches:
            col = rb.column(idx)
            n = len(col)
            lens = np.asarray(col.value_lengths().fill_null(-1))
            ok = lens == dim_in
            res = np.zeros((n, dim_out))
            if ok.all():
                rows = np.asarray(col.flatten().to_numpy(zero_copy_only=False), dtype="float64").reshape(n, dim_in)
                res = np.tanh(rows @ w.T + b)
            elif ok.any():
                good = col.filter(pa.array(ok))
                rows = np.asarray(good.flatten().to_numpy(zero_copy_only=False), dtype="float64").reshape(-1, dim_in)
                res[ok] = np.tanh(rows @ w.T + b)
            offsets = pa.array(np.arange(0, (n + 1) * dim_out, dim_out), type=pa.int32())
            arr = pa.ListArray.from_arrays(offsets, pa.array(res.reshape(-1)), mask=pa.array(~ok))
            yield pa.RecordBatch.from_arrays(list(rb.columns) + [arr],
                                             schema=pa.schema(list(rb.schema) + [out_field]))

    ship_package(df.sparkSession)
    return df.mapInArrow(run, out_schema)


def pair_scores(df: DataFrame, v1: str = "v1", v2: str = "v2") -> DataFrame:
    """The four evaluation similarities in one projection."""
    a, b = V.as_double(v1), V.as_double(v2)
    return df.select("*",
                     V.paired_cosine(a, b).alias("cosine"),
                     V.neg_manhattan(a, b).alias("manhattan"),
                     V.neg_euclidean(a, b).alias("euclidean"),
                     V.dot(a, b).alias("dot"))


def explode_vector(df: DataFrame, keys: Sequence[str], vec_col: str,
                   dim_col: str = "dim", value_col: str = "value", digits: int | None = 6) -> DataFrame:
    """Long form ``(keys, dim, value)`` of a vector column (for reports/tests)."""
    out = df.select(*keys, F.posexplode(V.as_double(vec_col)).alias(dim_col, value_col))
    if digits is not None:
        out = out.withColumn(value_col, F.round(value_col, digits))
    return out
