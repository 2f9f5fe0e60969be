"""Corpus assembly: bag unions, pair unpivot, table profile."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_corpora(frames: Sequence[DataFrame], col: str = "sentence",
                  keep: Sequence[str] = (), order_col: str = "src_ord") -> DataFrame:
    """UNION ALL of one text column from several corpora, no dedup.

    ``src_ord`` records which input a row came from (the reference's list
    order), so order can be restored without a global sort.
    """
    out = None
    for i, f in enumerate(frames):
        part = f.select(F.lit(i).alias(order_col), *keep, F.col(col).alias(col))
        out = part if out is None else out.unionByName(part)
    return out


def unpivot_pairs(df: DataFrame, keys: Sequence[str], cols: Sequence[str] = ("sentence1", "sentence2"),
                  side_col: str = "side", out_col: str = "sentence") -> DataFrame:
    """Pair columns -> one column, nulls and duplicates kept, one scan."""
    return df.unpivot(list(keys), list(cols), side_col, out_col)


def union_pairs(frames: Sequence[DataFrame], cols: Sequence[str] = ("sentence1", "sentence2"),
                order_col: str = "src_ord") -> DataFrame:
    """U4: stack pair tables, dropping every other column (score included)."""
    out = None
    for i, f in enumerate(frames):
        part = f.select(F.lit(i).alias(order_col), *cols)
        out = part if out is None else out.unionByName(part)
    return out


def profile(df: DataFrame) -> DataFrame:
    """Per column ``(column, n_rows, n_null)`` from a single aggregation pass."""
    aggs = [F.count(F.lit(1)).alias("_n")]
    aggs += [F.count_if(F.col(f"`{c}`").isNull()).alias(f"_null_{i}") for i, c in enumerate(df.columns)]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_null_{i}").alias("n_null"))
                     for i, c in enumerate(df.columns)])
    return (one.select(F.col("_n").alias("n_rows"), F.inline(rows))
               .select("column", "n_rows", "n_null"))
