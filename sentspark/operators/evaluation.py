"""STS evaluation: Pearson, Spearman and the eight-metric report (A1-A5).

* Pearson is ``covar_pop / (stddev_pop * stddev_pop)`` with ``try_divide``:
  the same value as ``corr`` but NULL (not an ANSI error) for constant input
  or a single row.  Rows with a null on either side are skipped.
* Spearman is Pearson over *average* ranks (ties share their mean position),
  ranked per group in two native levels (``scan``) -- no window over a group,
  no Python and no job before the result is asked for.
* All metrics and groups (e.g. dev/test splits) are ranked in one job.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import value_ranks
from .vectors import pair_scores

# Report metric names, in the reference's order; each maps to the column
# pair_scores produces (named correctly -- the reference swaps two of them).
REPORT_METRICS = ("cosine", "euclidean", "manhattan", "dot")


def pearson(x, y) -> Column:
    """A1 aggregate: NULL when either side is constant or n < 2."""
    x = F.col(x) if isinstance(x, str) else x
    y = F.col(y) if isinstance(y, str) else y
    xv = F.when(y.isNotNull(), x)
    yv = F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_pop(xv, yv), F.stddev_pop(xv) * F.stddev_pop(yv))


def correlations(df: DataFrame, score_cols: Sequence[str], gold_col: str,
                 group_cols: Sequence[str] = ()) -> DataFrame:
    """``(group..., metric, n, pearson, spearman)`` for every score column.

    A row counts for a metric if it has both that score and gold.  Gold is
    ranked once, with one count per metric; scores are ranked in one long
    table.  Ranks join back by value: a tied gold value is a skewed join side,
    which is split, never a group.
    """
    g, m = list(group_cols), list(score_cols)
    wide = df.select(*g, F.col(gold_col).cast("double").alias("y"), *[F.col(c).cast("double").alias(c) for c in m]) \
             .where(F.col("y").isNotNull())
    gold = value_ranks(wide, g, "y", [F.col(c).isNotNull() for c in m], [f"_ry_{c}" for c in m])
    recs = lambda extra: F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("x"), *extra(c))
                                            for c in m]))
    scores = wide.select(*g, recs(lambda c: ())).where("x is not null")
    ranked = value_ranks(scores, [*g, "metric"], "x", [F.lit(1)], ["rx"])
    gold = gold.toDF(*[f"_g{i}" for i in range(len(g))], "_y", *[f"_ry_{c}" for c in m])
    on = wide["y"] == gold["_y"]
    for i, c in enumerate(g):
        on = on & wide[c].eqNullSafe(gold[f"_g{i}"])
    long = (wide.join(gold, on).select(*g, "y", recs(lambda c: (F.col(f"_ry_{c}").alias("ry"),)))
            .where("x is not null"))
    ranked = ranked.toDF(*[f"_h{i}" for i in range(len(g))], "_m", "_x", "rx")
    on = (long["metric"] == ranked["_m"]) & (long["x"] == ranked["_x"])
    for i, c in enumerate(g):
        on = on & long[c].eqNullSafe(ranked[f"_h{i}"])
    return (long.join(ranked, on).groupBy(*g, "metric")
            .agg(F.count(F.lit(1)).alias("n"), pearson("x", "y").alias("pearson"), pearson("rx", "ry").alias("spearman")))


def spearman(df: DataFrame, x: str, y: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """A2: ``(group..., spearman)`` for one score column."""
    c = correlations(df, [x], y, group_cols)
    return c.select(*group_cols, "spearman")


def eval_report(scored_pairs: DataFrame, v1: str = "v1", v2: str = "v2", gold_col: str = "gold",
                group_cols: Sequence[str] = (), prefix: str = "eval") -> DataFrame:
    """A3 / A5: one row (per group) of the eight metrics,
    ``{prefix}_{cosine,euclidean,manhattan,dot}_{pearson,spearman}``."""
    scored = pair_scores(scored_pairs, v1, v2)
    c = correlations(scored, REPORT_METRICS, gold_col, group_cols)
    aggs = []
    for m in REPORT_METRICS:
        for kind in ("pearson", "spearman"):
            aggs.append(F.max(F.when(F.col("metric") == m, F.col(kind))).alias(f"{prefix}_{m}_{kind}"))
    if group_cols:
        return c.groupBy(*group_cols).agg(*aggs)
    return c.agg(*aggs)


def eval_diag_report(diag: DataFrame, score_col: str, gold_col: str) -> DataFrame:
    """A4: ``(pearson, spearman)`` of the own-pair scores against gold."""
    c = correlations(diag, [score_col], gold_col)
    return c.select("pearson", "spearman")


def evaluate(scored_pairs: DataFrame, metrics: Callable[[DataFrame], DataFrame] | None = None,
             v1: str = "v1", v2: str = "v2", gold_col: str = "gold",
             group_cols: Sequence[str] = (), prefix: str = "eval") -> DataFrame:
    """evaluation with a pluggable metric function.

    ``metrics`` receives the pairs with the four similarity columns
    (``cosine, manhattan, euclidean, dot``) added and returns any DataFrame;
    without one, the eight-metric report (A3, or A5 with ``group_cols``).
    """
    if metrics is None:
        return eval_report(scored_pairs, v1, v2, gold_col, group_cols, prefix)
    return metrics(pair_scores(scored_pairs, v1, v2))
