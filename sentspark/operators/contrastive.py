"""In-batch contrastive scoring.

A batch is built by ``batch_assign`` with a fixed size, so a group here is
bounded by the batch size, not by the data.  Each batch is scored in tiles of
the similarity matrix and reduced as it goes: what comes back is, per anchor,
its own logit, the largest one and the log-sum-exp of the row -- never the
row itself.  Losses are then plain expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as V
from ..functions.vectors import COSINE_EPS, TEMPERATURE, broadcast_scalar
from ..session import ship_package
from .scan import row_index

# Default weight of the masked-token loss in the combined objective.
MLM_WEIGHT = 0.1
# A tile of the similarity matrix: anchors by columns.
TILE = (512, 4096)


def _matrix(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows (zeros where missing), and which are there."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    width = int(size.max(initial=0))
    whole = size == width if width else np.zeros(len(size), dtype=bool)
    out = np.zeros((len(size), width))
    if not width:
        return out, whole
    kept = lists.filter(pa.array(whole))
    out[whole] = np.asarray(kept.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, width)
    whole &= ~np.isnan(out).any(axis=1)
    out[~whole] = 0.0
    return out, whole


def _reduce(views: list[tuple[np.ndarray, np.ndarray]], temp: float, weight: float,
            eps: float) -> tuple[np.ndarray, ...]:
    """Per anchor: own logit, largest logit, log-sum-exp and number of columns."""
    z, there = views[0]
    n = len(z)
    norms = [np.linalg.norm(v, axis=1) for v, _ in views]
    own, most = np.full(n, np.nan), np.full(n, -np.inf)
    total, columns = np.zeros(n), 0
    for k, (other, has) in enumerate(views[1:], 1):
        cols = np.flatnonzero(has)
        columns += len(cols)
        for a in range(0, n, TILE[0]):
            rows = np.arange(a, min(n, a + TILE[0]))
            for b in range(0, len(cols), TILE[1]):
                c = cols[b:b + TILE[1]]
                tile = z[rows] @ other[c].T
                tile /= np.maximum(norms[0][rows, None] * norms[k][None, c], eps) * temp
                at = np.searchsorted(c, rows)
                diagonal = np.flatnonzero((at < len(c)) & (c[np.minimum(at, len(c) - 1)] == rows))
                if k == 1:
                    own[rows[diagonal]] = tile[diagonal, at[diagonal]]
                elif weight:
                    tile[diagonal, at[diagonal]] += weight
                new = np.maximum(most[rows], tile.max(axis=1))
                total[rows] = total[rows] * np.exp(most[rows] - new) + np.exp(tile - new[:, None]).sum(axis=1)
                most[rows] = new
    with np.errstate(divide="ignore"):
        lse = most + np.log(total)
    for x in (own, most, lse):
        x[~there] = np.nan
        x[~np.isfinite(x)] = np.nan
    return own, most, lse, np.full(n, columns)


def in_batch_scores(df: DataFrame, view_cols: Sequence[str], batch_col: str = "batch_id",
                    row_col: str = "row", temp: float = TEMPERATURE,
                    hard_negative_weight: float = 0.0, eps: float = COSINE_EPS) -> DataFrame:
    """V7 (+ V8, V9): an anchor's logits are ``cos(z1_i, z2_j)/temp`` for every j
    of its batch; with a third view, ``cos(z1_i, z3_j)/temp`` columns follow, and
    ``hard_negative_weight`` is added to the anchor's own z3 column.

    Output ``(batch_id, row, label, n_cols, pos_logit, max_logit, lse)``:
    ``label`` is the anchor's position in its batch (rows sorted by
    ``row_col``), the index of its positive; ``pos_logit`` is that column's
    logit and ``lse`` the log-sum-exp of all.

    A null vector (or one of another length, or with a NaN) is missing: as z2
    or z3 it is no column, as z1 or as an anchor's own z2 it makes that
    anchor's values null.  Memory is one batch plus one tile.
    """
    views = list(view_cols)
    if len(views) not in (2, 3):
        raise ValueError("two or three views are supported")
    kinds = [("label", T.IntegerType()), ("n_cols", T.IntegerType()), ("pos_logit", T.DoubleType()),
             ("max_logit", T.DoubleType()), ("lse", T.DoubleType())]
    schema = T.StructType([df.schema[batch_col], df.schema[row_col], *(T.StructField(c, k) for c, k in kinds)])

    def score(batch: pa.Table) -> pa.Table:
        batch = batch.sort_by(row_col)
        own, most, lse, columns = _reduce([_matrix(batch.column(f"_z{k}")) for k in range(len(views))], temp,
                                          hard_negative_weight, eps)
        null = lambda x: pa.array(x, mask=np.isnan(x))
        return pa.table({batch_col: batch.column(batch_col), row_col: batch.column(row_col),
                         "label": pa.array(np.arange(len(own)), pa.int32()), "n_cols": pa.array(columns, pa.int32()),
                         "pos_logit": null(own), "max_logit": null(most), "lse": null(lse)})

    ship_package(df.sparkSession)
    rows = df.select(batch_col, row_col, *[F.col(v).alias(f"_z{k}") for k, v in enumerate(views)])
    return rows.groupBy(batch_col).applyInArrow(score, schema)


# ---- a batch larger than one worker -----------------------------------------

#: Rows of a block, so that a task holds two of them and a tile.
BLOCK_ROWS = 4096


def _block_part(anchors: tuple[np.ndarray, np.ndarray], others: list[tuple[np.ndarray, np.ndarray]],
                own_at: np.ndarray, temp: float, weight: float, eps: float) -> tuple[np.ndarray, ...]:
    """Of one block of anchors against one of columns, per anchor: own logit
    (NaN elsewhere), largest logit, sum of exponentials below it, columns.
    ``own_at`` is each anchor's own row among the columns, -1 in other blocks."""
    z, there = anchors
    n = len(z)
    norm = np.linalg.norm(z, axis=1)
    own, most, total, columns = np.full(n, np.nan), np.full(n, -np.inf), np.zeros(n), 0
    for k, (other, has) in enumerate(others, 1):
        cols = np.flatnonzero(has)
        columns += len(cols)
        if not there.any():
            continue
        place = np.full(len(has) + 1, -1)
        place[cols] = np.arange(len(cols))
        mine = place[own_at]                     # -1 picks the last, which is no column
        lengths = np.linalg.norm(other[cols], axis=1)
        for a in range(0, n, TILE[0]):
            rows = np.arange(a, min(n, a + TILE[0]))
            for b in range(0, len(cols), TILE[1]):
                e = min(b + TILE[1], len(cols))
                tile = z[rows] @ other[cols[b:e]].T
                tile /= np.maximum(norm[rows, None] * lengths[None, b:e], eps) * temp
                here = np.flatnonzero((mine[rows] >= b) & (mine[rows] < e))
                if k == 1:
                    own[rows[here]] = tile[here, mine[rows[here]] - b]
                elif weight:
                    tile[here, mine[rows[here]] - b] += weight
                new = np.maximum(most[rows], tile.max(axis=1))
                total[rows] = total[rows] * np.exp(most[rows] - new) + np.exp(tile - new[:, None]).sum(axis=1)
                most[rows] = new
    for x in (own, most, total):
        x[~there] = np.nan
    return own, most, total, np.full(n, columns)


def blocked_scores(df: DataFrame, view_cols: Sequence[str], batch_col: str = "batch_id", row_col: str = "row",
                   temp: float = TEMPERATURE, hard_negative_weight: float = 0.0, eps: float = COSINE_EPS,
                   block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``in_batch_scores`` for batches of any size (V7-V9, V11), as a block product.

    A batch's rows are dealt to blocks of about ``block_rows`` (by a hash of
    the row, so evenly).  A task gets one block of anchors and one of columns,
    keyed by (batch, row block, column block); of their part of the matrix it
    returns, per anchor, the largest logit and the sum of exponentials below
    it.  Such pairs merge: ``M = max m``, ``S = sum s exp(m - M)``.  Every row
    is sent once per block of its batch; a task holds two blocks and a tile.

    Same columns, null rules and numbers as ``in_batch_scores``.
    """
    views = list(view_cols)
    if len(views) not in (2, 3):
        raise ValueError("two or three views are supported")
    ship_package(df.sparkSession)
    kind, row_kind = (df.schema[c].dataType.simpleString() for c in (batch_col, row_col))
    rows = df.select(F.col(f"`{batch_col}`").alias("_batch"), F.col(f"`{row_col}`").alias("_row"),
                     *[F.col(f"`{v}`").alias(f"_z{k}") for k, v in enumerate(views)])
    sizes = rows.groupBy("_batch").agg(F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("int").alias("_blocks"))
    keyed = rows.join(sizes.withColumnRenamed("_batch", "_b"), F.col("_batch").eqNullSafe(F.col("_b"))).drop("_b")
    keyed = keyed.withColumn("_block", F.pmod(F.xxhash64("_row"), F.col("_blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("_blocks") - F.lit(1)))
    anchors = keyed.select("_batch", F.col("_block").alias("_i"), every.alias("_j"), "_row", "_z0")
    columns = keyed.select(F.col("_batch").alias("_b"), every.alias("_bi"), F.col("_block").alias("_bj"),
                           F.col("_row").alias("_br"), *[F.col(f"_z{k}").alias(f"_c{k}") for k in range(1, len(views))])

    def part(left: pa.Table, right: pa.Table) -> pa.Table:
        # in the block of its own, an anchor meets its own row among the columns
        same = len(left) > 0 and left.column("_i")[0] == left.column("_j")[0]
        own_at = pc.index_in(left.column("_row"), value_set=right.column("_br").combine_chunks()) \
            if same else pa.chunked_array([pa.nulls(len(left), pa.int32())])
        own, most, total, n = _block_part(
            _matrix(left.column("_z0")), [_matrix(right.column(f"_c{k}")) for k in range(1, len(views))],
            pc.fill_null(own_at, -1).to_numpy().astype(np.int64), temp, hard_negative_weight, eps)
        null = lambda x: pa.array(x, mask=np.isnan(x))
        return pa.table({"_batch": left.column("_batch"), "_row": left.column("_row"), "own": null(own),
                         "most": null(most), "total": null(total), "columns": pa.array(n, pa.int32())})

    # a block of anchors meets no block of columns only if the batch has none; it has its own
    parts = anchors.groupBy("_batch", "_i", "_j").cogroup(columns.groupBy("_b", "_bi", "_bj")).applyInArrow(
        part, f"_batch {kind}, _row {row_kind}, own double, most double, total double, columns int")
    merged = parts.groupBy("_batch", "_row").agg(
        F.max("own").alias("pos_logit"), F.max("most").alias("_m"), F.sum("columns").cast("int").alias("n_cols"),
        F.collect_list(F.struct("most", "total")).alias("_parts"))              # one entry a block
    infinite = F.lit(float("-inf"))
    total = F.aggregate(F.filter("_parts", lambda x: x["most"] > infinite), F.lit(0.0),
                        lambda acc, x: acc + x["total"] * F.exp(x["most"] - F.col("_m")))
    most = F.nullif(F.col("_m"), infinite)
    labels = row_index(rows.select("_batch", "_row"), ["_row"], ["_batch"], "label").select(
        F.col("_batch").alias("_lb"), F.col("_row").alias("_lr"), F.col("label").cast("int").alias("label"))
    out = merged.join(labels, F.col("_batch").eqNullSafe(F.col("_lb")) & F.col("_row").eqNullSafe(F.col("_lr")))
    return out.select(F.col("_batch").alias(batch_col), F.col("_row").alias(row_col), "label", "n_cols", "pos_logit",
                      most.alias("max_logit"), (most + F.log(total)).alias("lse"))


def logsumexp(arr) -> F.Column:
    """Stable ``log(sum(exp(x)))`` of an array; the row max is repeated into
    the element loop once (see ``broadcast_scalar``), not recomputed per element."""
    a = F.col(arr) if isinstance(arr, str) else arr
    m = F.array_max(a)
    shifted = F.zip_with(a, broadcast_scalar(m, a), lambda x, mx: F.exp(x - mx))
    return m + F.log(F.aggregate(shifted, F.lit(0.0), lambda acc, x: acc + x))


def row_losses(scores: DataFrame, out_col: str = "loss") -> DataFrame:
    """V10 per anchor: ``logsumexp(row) - row[label]`` (cross-entropy)."""
    return scores.withColumn(out_col, F.col("lse") - F.col("pos_logit"))


def info_nce(scores: DataFrame, batch_col: str = "batch_id") -> DataFrame:
    """Mean cross-entropy per batch ``(batch_id, n_rows, loss)`` over the
    anchors that have one."""
    r = row_losses(scores)
    return r.groupBy(batch_col).agg(F.count(F.lit(1)).alias("n_rows"), F.avg("loss").alias("loss"))


def global_batches(df: DataFrame, step_col: str, rank_col: str, row_col: str,
                   local_batch_rows: int, out_batch: str = "batch_id", out_row: str = "row") -> DataFrame:
    """The negatives of a step come from every worker's local batch.

    Re-key ``(step, rank, row)`` to batch ``step`` with global row
    ``rank * local_batch_rows + row`` -- the gather becomes the shuffle on the
    batch key.
    """
    return (df.withColumn(out_batch, F.col(step_col))
              .withColumn(out_row, F.col(rank_col) * F.lit(local_batch_rows) + F.col(row_col)))


def _segment_losses(logits: pa.ListArray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``logsumexp(list) - list[label]`` of every list, and which have no value."""
    if isinstance(logits, pa.ChunkedArray):
        logits = logits.combine_chunks()
    size = pc.fill_null(pc.list_value_length(logits), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = logits.flatten()                      # of the lists that are there
    gaps = np.asarray(flat.is_null()) if flat.null_count else None
    x = np.asarray(pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False), dtype=np.float64)
    end = np.cumsum(size)
    some = np.flatnonzero(size > 0)
    start = (end - size)[some]
    most = np.maximum.reduceat(x, start) if len(some) else np.zeros(0)
    # shifted by block, so that the spread maxima of a long batch are never held at once
    total = np.empty(len(some))
    step = max(1, int(SEGMENT_VALUES // max(1, size.max(initial=1))))
    with np.errstate(invalid="ignore", over="ignore"):
        for a in range(0, len(some), step):
            own = slice(a, a + step)
            n = size[some[own]]
            values = x[start[a]:start[a] + int(n.sum())]
            total[own] = np.add.reduceat(np.exp(values - np.repeat(most[own], n)), np.cumsum(n) - n)
        label = labels[some]
        inside = (label >= 0) & (label < size[some])
        picked = x[np.where(inside, start + label, start)]
        out = np.zeros(len(size))
        out[some] = most + np.log(total) - picked
    missing = np.ones(len(size), dtype=bool)
    missing[some] = ~inside
    if gaps is not None:
        missing[some] |= np.logical_or.reduceat(gaps, start)
    return out, missing


#: Logits that a task shifts at a time.
SEGMENT_VALUES = 1 << 20


def masked_ce(logits: DataFrame, token_keys: Sequence[str], logits_col: str = "logits",
              label_col: str = "label", ignore_index: int = -100) -> DataFrame:
    """V12 per token: ``logsumexp over vocab - logit[label]`` for tokens whose
    label is not ``ignore_index``.  A token is one row with its logits as an
    array, as a model emits them: nothing is exchanged, and a batch's logits
    are reduced in place, list by list, from one flat buffer, however wide the
    vocabulary.  A null or empty array, a null logit and a label outside the
    array give a null loss."""
    ship_package(logits.sparkSession)
    keys = list(token_keys)
    live = logits.where(F.col(label_col) != F.lit(ignore_index)).select(
        *keys, F.col(label_col).cast("long").alias("_label"), F.col(logits_col).cast("array<double>").alias("_logits"))
    schema = T.StructType([*(live.schema[k] for k in keys), T.StructField("token_loss", T.DoubleType())])

    def run(batches):
        for batch in batches:
            loss, missing = _segment_losses(batch.column("_logits"),
                                            batch.column("_label").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(loss, mask=missing)],
                                             [*keys, "token_loss"])

    return live.mapInArrow(run, schema)


def combined_loss(cl_loss, mlm_loss, weight: float = MLM_WEIGHT) -> F.Column:
    """``loss + mlm_weight * masked_lm_loss``."""
    return F.col(cl_loss) + F.lit(weight) * F.col(mlm_loss)


def diag_scores(df: DataFrame, v1: str = "z1", v2: str = "z2", out_col: str = "score") -> DataFrame:
    """Each anchor's own-pair cosine (the diagonal of its batch block),
    from its own row alone."""
    return df.withColumn(out_col, V.cos_temp(V.as_double(v1), V.as_double(v2), 1.0))
