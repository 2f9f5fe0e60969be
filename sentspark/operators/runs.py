"""Training-run bookkeeping on a metrics log ``(run, step, metric)``.

Every running quantity uses the distributed scan, so a run with a third of
all rows is still spread over many tasks; per-run results are aggregates
with map-side partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import prefix_scan, row_index

# Defaults of the reference's training script.
EARLY_STOPPING_PATIENCE = 3
SAVE_TOTAL_LIMIT = 6


def number_steps(log: DataFrame, run_col: str, order_cols, out_col: str = "step") -> DataFrame:
    """1-based step number per run in ``order_cols`` order (unique per run)."""
    out = row_index(log, list(order_cols), [run_col], out_col="_idx")
    return out.withColumn(out_col, F.col("_idx") + F.lit(1)).drop("_idx")


def _measured(metric_col: str):
    return F.col(metric_col).isNotNull() & ~F.isnan(F.col(metric_col).cast("double"))


def best_checkpoint(log: DataFrame, run_col: str = "run", step_col: str = "step",
                    metric_col: str = "metric") -> DataFrame:
    """Step with the highest metric per run; ties -> earliest step.  A null
    or NaN metric is missing, here as in ``early_stop``."""
    best = F.max_by(F.struct(F.col(step_col), F.col(metric_col)),
                    F.struct(F.col(metric_col), -F.col(step_col)))
    return (log.where(_measured(metric_col))
               .groupBy(run_col).agg(best.alias("_b"))
               .select(run_col, F.col("_b")[step_col].alias("best_step"),
                       F.col("_b")[metric_col].alias("best_metric")))


def improvement_log(log: DataFrame, run_col: str = "run", step_col: str = "step",
                    metric_col: str = "metric") -> DataFrame:
    """Adds ``improved`` (strictly above every earlier metric), ``best_so_far``
    and ``last_improved`` (step of the latest improvement) per row.  A row
    without a metric is never an improvement."""
    log = log.withColumn(metric_col, F.when(_measured(metric_col), F.col(metric_col)))
    a = prefix_scan(log, [run_col], [step_col], metric_col, "max", out_col="best_so_far",
                    exclusive_col="_prev_best")
    a = a.withColumn("improved", F.col(metric_col).isNotNull()
                     & (F.col("_prev_best").isNull() | (F.col(metric_col) > F.col("_prev_best"))))
    # Improvements are strict, so each running best is reached at exactly one
    # step: the last improvement of a row is where its running best was set.
    # One row per (run, best) -- an aggregate and an equi-join, not a scan.
    set_at = (a.where("improved").groupBy(run_col, "best_so_far")
                .agg(F.min(step_col).alias("last_improved")))
    set_at = set_at.toDF("_run", "_best", "last_improved")
    on = a[run_col].eqNullSafe(set_at["_run"]) & a["best_so_far"].eqNullSafe(set_at["_best"])
    return (a.join(set_at, on, "left").drop("_prev_best", "_run", "_best")
              .withColumn("last_improved", F.col("last_improved").cast("long")))


def early_stop(log: DataFrame, run_col: str = "run", step_col: str = "step",
               metric_col: str = "metric", patience: int = EARLY_STOPPING_PATIENCE) -> DataFrame:
    """First step at which ``patience`` evaluations in a row brought no
    strict improvement; ``best_step``/``best_metric`` as of that step (or of
    the whole log when training never stops).  Steps must be 1..n."""
    imp = improvement_log(log, run_col, step_col, metric_col)
    stop = (F.col(step_col) - F.col("last_improved")) >= F.lit(patience)
    at = F.when(stop, F.col(step_col))
    last = F.col(step_col)
    return imp.groupBy(run_col).agg(
        F.min(at).alias("stop_step"),
        F.coalesce(F.min_by("last_improved", at), F.max_by("last_improved", last)).alias("best_step"),
        F.coalesce(F.min_by("best_so_far", at), F.max_by("best_so_far", last)).alias("best_metric"))


def retain_last_k(log: DataFrame, run_col: str = "run", step_col: str = "step",
                  metric_col: str = "metric", k: int = SAVE_TOTAL_LIMIT) -> DataFrame:
    """A10: the newest ``k`` checkpoints per run plus the best one."""
    ranked = row_index(log, [step_col], [run_col], out_col="_newest", desc_order=True)
    best = best_checkpoint(log, run_col, step_col, metric_col).select(F.col(run_col).alias("_run"), "best_step")
    joined = ranked.join(best, ranked[run_col].eqNullSafe(best["_run"]), "left")
    keep = (F.col("_newest") < F.lit(k)) | (F.col(step_col) == F.col("best_step"))
    return (joined.where(keep)
                  .select(run_col, step_col, metric_col,
                          (F.col(step_col) == F.col("best_step")).alias("is_best")))
