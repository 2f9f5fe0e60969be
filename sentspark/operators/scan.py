"""Distributed prefix sums, row indexes and average ranks, in two levels.

A running quantity over a large group needs no single-task window: rows are
cut into *buckets* that are monotone in the order, each (group, bucket) is
scanned by its own native window, and what lies before a bucket comes from a
window over the bucket totals -- one row per (group, bucket), summed with
map-side partial aggregation and joined back.  Nothing is sampled and nothing
runs while the plan is built; only keys and the scanned value take part, other
columns just ride along.  Joins on groups are null-safe.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BUCKET = "_scan_b"
#: Steps of an integer order column per bucket, and buckets per octave of a
#: floating-point one.
INTEGER_STEPS = 1024
PER_OCTAVE = 4096


def order_bucket(df: DataFrame, col: str) -> Column:
    """A bucket of ``col`` that never decreases as ``col`` grows."""
    kind, c = df.schema[col].dataType, F.col(f"`{col}`")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        # sign and logarithm: as many buckets in each octave of magnitude
        size = F.floor((F.log2(F.abs(c)) + F.lit(1100.0)) * F.lit(float(PER_OCTAVE)))
        most = F.lit(2 ** 40)
        return (F.when(F.isnan(c), most + F.lit(1)).when(F.abs(c) == F.lit(float("inf")), F.signum(c).cast("long") * most)
                 .when(c == F.lit(0.0), F.lit(0)).otherwise(F.signum(c).cast("long") * size.cast("long")))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_trunc("hour", c)
    if isinstance(kind, T.StringType):
        return F.substring(c, 1, 2)
    if isinstance(kind, (T.IntegralType, T.DecimalType)):
        return F.floor(c / F.lit(INTEGER_STEPS))
    return c


def prefix_scan(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str],
                value_col: str | Sequence[str], how: str = "sum", out_col: str | Sequence[str] = "prefix",
                exclusive_col: str | Sequence[str] | None = None, desc_order: bool = False,
                bucket: Column | None = None) -> DataFrame:
    """Running ``sum`` or ``max`` of ``value_col`` per group, in order.

    ``(group_cols + order_cols)`` must be unique.  Adds ``out_col`` (inclusive
    prefix) and, if asked, ``exclusive_col`` (prefix before the row; null for
    the first row of a group under ``max``, 0 under ``sum``).  Lists scan
    several values at once.  ``bucket`` overrides ``order_bucket`` of the first
    order column; it must be monotone in the order.
    """
    group_cols, order_cols = list(group_cols), list(order_cols)
    values = [value_col] if isinstance(value_col, str) else list(value_col)
    outs = [out_col] if isinstance(out_col, str) else list(out_col)
    excl = [exclusive_col] if isinstance(exclusive_col, str) else list(exclusive_col or [])
    fold = {"sum": F.sum, "max": F.max}[how]
    way = (lambda c: F.col(f"`{c}`").desc()) if desc_order else (lambda c: F.col(f"`{c}`").asc())
    keyed = df.withColumn(_BUCKET, bucket if bucket is not None else order_bucket(df, order_cols[0]))
    here = Window.partitionBy(*group_cols, _BUCKET).orderBy(*[way(c) for c in order_cols])
    upto = here.rowsBetween(Window.unboundedPreceding, 0)
    earlier = here.rowsBetween(Window.unboundedPreceding, -1)
    local = keyed
    for k, v in enumerate(values):
        local = local.withColumn(f"_in{k}", fold(v).over(upto)).withColumn(f"_ex{k}", fold(v).over(earlier))
    # one row per (group, bucket); the window over it is the only one without buckets
    before = Window.partitionBy(*group_cols).orderBy(way(_BUCKET)).rowsBetween(Window.unboundedPreceding, -1)
    totals = keyed.groupBy(*group_cols, _BUCKET).agg(*[fold(v).alias(f"_t{k}") for k, v in enumerate(values)])
    carry = totals.select(*[F.col(f"`{c}`").alias(f"_g{i}") for i, c in enumerate(group_cols)],
                          F.col(_BUCKET).alias("_b"),
                          *[fold(f"_t{k}").over(before).alias(f"_c{k}") for k in range(len(values))])
    on = local[_BUCKET].eqNullSafe(carry["_b"])
    for i, c in enumerate(group_cols):
        on = on & local[c].eqNullSafe(carry[f"_g{i}"])
    joined = local.join(carry, on)

    def add(a: Column, b: Column) -> Column:
        if how == "max":
            return F.greatest(a, b)   # skips nulls
        return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))

    made = [add(F.col(f"_in{k}"), F.col(f"_c{k}")).alias(o) for k, o in enumerate(outs)]
    made += [add(F.col(f"_ex{k}"), F.col(f"_c{k}")).alias(o) for k, o in enumerate(excl)]
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], *made)


def row_index(df: DataFrame, order_cols: Sequence[str], group_cols: Sequence[str] = (),
              out_col: str = "idx", desc_order: bool = False, bucket: Column | None = None) -> DataFrame:
    """0-based position of each row in ``order_cols`` order (per group).

    Equivalent to ``row_number() - 1`` but with no window over a whole group.
    ``(group_cols + order_cols)`` must be unique.
    """
    one = "_scan_one"
    out = prefix_scan(df.withColumn(one, F.lit(1).cast("long")), group_cols, order_cols, one, "sum",
                      out_col="_scan_pos", desc_order=desc_order, bucket=bucket)
    return out.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_scan_pos") - F.lit(1)).alias(out_col))


def value_ranks(df: DataFrame, group_cols: Sequence[str], value_col: str,
                weights: Sequence[Column], out_cols: Sequence[str]) -> DataFrame:
    """``(group..., value, rank...)`` per distinct non-null value: the average
    rank among all rows, once for each weight (how often a row counts)."""
    counts = [f"_w{k}" for k in range(len(weights))]
    distinct = (df.where(F.col(f"`{value_col}`").isNotNull()).groupBy(*group_cols, value_col)
                  .agg(*[F.sum(w.cast("long")).alias(c) for w, c in zip(weights, counts)]))
    below = [f"_below{k}" for k in range(len(weights))]
    scanned = prefix_scan(distinct, group_cols, [value_col], counts, "sum",
                          out_col=[f"_upto{k}" for k in range(len(weights))], exclusive_col=below)
    return scanned.select(*group_cols, value_col,
                          *[(F.col(b) + (F.col(c) + F.lit(1)) / F.lit(2.0)).alias(o)
                            for b, c, o in zip(below, counts, out_cols)])


def average_rank(df: DataFrame, group_cols: Sequence[str], value_col: str,
                 out_col: str = "rank") -> DataFrame:
    """1-based average ranks (ties share the mean of their positions).

    Rows with a null value get a null rank and do not count.
    """
    group_cols = list(group_cols)
    ranks = value_ranks(df, group_cols, value_col, [F.lit(1)], [out_col])
    ranks = ranks.select(*[F.col(f"`{c}`").alias(f"_g{i}") for i, c in enumerate(group_cols)],
                         F.col(f"`{value_col}`").alias("_v"), out_col)
    on = df[value_col] == ranks["_v"]
    for i, c in enumerate(group_cols):
        on = on & df[c].eqNullSafe(ranks[f"_g{i}"])
    return df.join(ranks, on, "left").select(*[F.col(f"`{c}`") for c in df.columns], out_col)
