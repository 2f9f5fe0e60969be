"""Row-local corpus operators (P1-P3, P9, P12, P13, U1 and the cleaning chain).

Nothing here shuffles: every step is a projection, a filter or a generator,
so a whole cleaning chain is one narrow stage that reads only the pruned text
column from Parquet and works unchanged on a streaming DataFrame.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def rename_col(df: DataFrame, src: str, dst: str) -> DataFrame:
    """Copy ``src`` to ``dst`` (overwriting, moved last), drop ``src``.

    ``src == dst`` is a no-op (the reference loses the column; not copied).
    """
    if src == dst:
        return df
    if src not in df.columns:
        raise ValueError(f"column {src!r} not found")
    rest = [F.col(f"`{c}`") for c in df.columns if c not in (src, dst)]
    return df.select(*rest, F.col(f"`{src}`").alias(dst))


def drop_cols(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop input columns after a map."""
    return df.drop(*cols)


def project_col(df: DataFrame, col: str) -> DataFrame:
    """One-column projection (the reference's ``to_list``; never collected)."""
    return df.select(col)


def drop_null(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with any null; "" is not null."""
    return df.na.drop(how="any", subset=list(subset) if subset else None)


def label_name(df: DataFrame) -> DataFrame:
    """``label`` / ``label_ids`` -> ``labels``; ``label_ids`` wins."""
    cols = df.columns
    if "label_ids" in cols:
        out = df.withColumn("labels", F.col("label_ids"))
    elif "label" in cols:
        out = df.withColumn("labels", F.col("label"))
    else:
        return df
    return out.drop(*[c for c in ("label", "label_ids") if c in cols])


def preview(df: DataFrame, order_by: Sequence[str], n: int = 5) -> DataFrame:
    """First ``n`` rows by a key (``head()`` made deterministic).

    Planned as TakeOrderedAndProject: each task keeps its own top-n.
    """
    return df.orderBy(*order_by).limit(n)


def explode_lines(df: DataFrame, text_col: str, keys: Sequence[str],
                  out_col: str = "line") -> DataFrame:
    """One row per "\\n"-separated piece, with its 0-based ``pos``."""
    return df.select(*keys, F.posexplode(T.split_lines(text_col)).alias("pos", out_col))


def broken_lines(df: DataFrame, text_col: str, keys: Sequence[str],
                 out_col: str = "line") -> DataFrame:
    """P4 + P5 + U1: sentence break, NBSP normalisation, split to rows."""
    text = T.nbsp_norm(T.sentence_break(text_col))
    return df.select(*keys, F.posexplode(T.split_lines(text)).alias("pos", out_col))


def clean_sentences(df: DataFrame, text_col: str = "text", keys: Sequence[str] = ("doc_id",),
                    min_chars: int = T.MIN_SENTENCE_CHARS,
                    out_col: str = "sentence") -> DataFrame:
    """P4 -> P5 -> U1 -> P6 -> P7 -> P8 -> P9 over a text table.

    Output ``(*keys, pos, sentence)``; ``pos`` is the piece index inside the
    source text, so ``(keys, pos)`` keeps the original order.  Length is
    tested before the whitelist, so a kept sentence may end up short or "".
    """
    pieces = broken_lines(df, text_col, keys, "piece")
    stripped = pieces.select(*keys, "pos", T.strip_ws("piece").alias("piece"))
    kept = stripped.where(T.long_enough("piece", min_chars))
    out = kept.select(*keys, "pos", T.char_filter("piece").alias(out_col))
    return out.where(F.col(out_col).isNotNull())
