"""Correlations, ranks and run bookkeeping (A1-A10) and the scan primitive."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sentspark.operators import evaluation as EV
from sentspark.operators import runs as RU
from sentspark.operators.scan import average_rank, order_bucket, prefix_scan, row_index


def _xy(spark, rows):
    rows = [(i, None if x is None else float(x), None if y is None else float(y)) for i, (x, y) in enumerate(rows)]
    return spark.createDataFrame(rows, "pair_id long, x double, y double")


def test_pearson_spearman_values(spark):
    df = _xy(spark, [(1.0, 1.0), (2.0, 3.0), (2.0, 2.0), (4.0, 4.0)])
    c = EV.correlations(df, ["x"], "y").first()
    assert c.pearson == pytest.approx(0.923381, abs=1e-6)
    assert c.spearman == pytest.approx(0.948683, abs=1e-6)


def test_degenerate_inputs_are_null(spark):
    const = _xy(spark, [(1.0, 1.0), (1.0, 2.0), (1.0, 3.0)])
    c = EV.correlations(const, ["x"], "y").first()
    assert c.pearson is None and c.spearman is None
    one = _xy(spark, [(1.0, 2.0)])
    c = EV.correlations(one, ["x"], "y").first()
    assert c.pearson is None and c.spearman is None


def test_null_side_row_ignored(spark):
    with_null = _xy(spark, [(1.0, 1.0), (2.0, 3.0), (2.0, 2.0), (4.0, 4.0), (9.0, None)])
    c = EV.correlations(with_null, ["x"], "y").first()
    assert c.n == 4 and c.pearson == pytest.approx(0.923381, abs=1e-6)


def test_spearman_properties(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 5, 300).astype(float)
    y = x + rng.normal(size=300)
    base = EV.correlations(_xy(spark, list(zip(x, y))), ["x"], "y").first().spearman
    mono = EV.correlations(_xy(spark, list(zip(np.exp(x), y))), ["x"], "y").first().spearman
    rep = EV.correlations(_xy(spark, list(zip(np.tile(x, 3), np.tile(y, 3)))), ["x"], "y").first().spearman
    ref = pd.Series(x).rank().corr(pd.Series(y).rank())
    assert base == pytest.approx(ref, abs=1e-9)
    assert mono == pytest.approx(base, abs=1e-9) and rep == pytest.approx(base, abs=1e-9)


def test_eval_report_names(spark):
    df = spark.createDataFrame([(i, [1.0, float(i)], [1.0, float(i * i % 7)], float(i % 5)) for i in range(20)],
                               "pair_id long, v1 array<double>, v2 array<double>, gold double")
    cols = EV.eval_report(df).columns
    assert cols == [f"eval_{m}_{k}" for m in ("cosine", "euclidean", "manhattan", "dot")
                    for k in ("pearson", "spearman")]


def _log(spark, metrics, run=1):
    return spark.createDataFrame([(run, i + 1, m) for i, m in enumerate(metrics)], "run long, step long, metric double")


def test_best_and_early_stop(spark):
    log = _log(spark, [0.1, 0.3, 0.3, 0.2, 0.25, 0.4])
    assert RU.best_checkpoint(log).first().best_step == 6
    e = RU.early_stop(log).first()
    assert (e.stop_step, e.best_step) == (5, 2)
    never = RU.early_stop(_log(spark, [0.1, 0.2, 0.3])).first()
    assert never.stop_step is None and never.best_step == 3


def test_early_stop_missing_metric_is_no_improvement(spark):
    e = RU.early_stop(_log(spark, [None, 0.1, 0.05, 0.02, 0.01])).first()
    assert (e.stop_step, e.best_step, e.best_metric) == (5, 2, 0.1)
    imp = {r.step: (r.improved, r.last_improved) for r in RU.improvement_log(_log(spark, [None, 0.1, 0.3])).collect()}
    assert imp == {1: (False, None), 2: (True, 2), 3: (True, 3)}


def test_retain_last_k(spark):
    log = _log(spark, [0.9, 0.1, 0.2, 0.3, 0.1, 0.1, 0.1, 0.1, 0.1])
    kept = sorted(r.step for r in RU.retain_last_k(log, k=6).collect())
    assert kept == [1, 4, 5, 6, 7, 8, 9]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([0, 1, None]), st.integers(-3, 3)), min_size=1, max_size=60),
       st.integers(1, 5))
def test_scan_matches_pandas(spark, rows, size):
    pdf = pd.DataFrame({"g": [None if g is None else 2 ** 60 + g for g, _ in rows],
                        "o": range(len(rows)), "v": [float(v) for _, v in rows]}, dtype=object)
    df = spark.createDataFrame([tuple(r) for r in pdf.itertuples(index=False)], "g long, o long, v double")
    b = F.floor(F.col("o") / size)
    by = pdf.astype({"v": float}).groupby(pdf["g"].map(str))["v"]
    sums = {r.o: r.s for r in prefix_scan(df, ["g"], ["o"], "v", "sum", "s", bucket=b).collect()}
    assert np.allclose([sums[o] for o in pdf.o], by.cumsum())
    most = {r.o: r.m for r in prefix_scan(df, ["g"], ["o"], "v", "max", "m", bucket=b).collect()}
    assert np.allclose([most[o] for o in pdf.o], by.cummax())
    ranks = average_rank(df, ["g"], "v").collect()
    assert {r.g for r in ranks} == set(pdf.g)                      # large keys stay what they are
    assert np.allclose([r.rank for r in sorted(ranks, key=lambda r: r.o)], by.rank())


def test_rank_buckets_are_monotone(spark):
    xs = [float("-inf"), -1e300, -2.0, -1.0000001, -1.0, -5e-324, 0.0, 5e-324, 1e-9, 0.5, 0.500000001, 1.0, 3.0, 1e308,
          float("inf"), float("nan")]
    df = spark.createDataFrame([(x,) for x in xs], "v double")
    got = [r[0] for r in df.select(order_bucket(df, "v")).collect()]
    assert got == sorted(got) and len(set(got)) > 12
    ranks = {str(r.v): r["rank"] for r in average_rank(df, [], "v").collect()}
    assert [ranks[str(x)] for x in xs] == list(range(1, len(xs) + 1))


def test_null_group_and_large_keys(spark):
    rows = [(None, i, float(i), float(i * i)) for i in range(30)] + [(2 ** 60 + g, i, float(i), float(-i)) for g in (0, 1)
                                                                   for i in range(20)]
    df = spark.createDataFrame(rows, "g long, pair_id long, x double, y double")
    got = {r.g: (r.n, round(r.spearman, 9)) for r in EV.correlations(df, ["x"], "y", ["g"]).collect()}
    assert got == {None: (30, 1.0), 2 ** 60: (20, -1.0), 2 ** 60 + 1: (20, -1.0)}


def test_gold_ranked_per_metric_null_pattern(spark):
    rows = [(1.0, None, 1.0), (2.0, 5.0, 1.0), (None, 4.0, 3.0), (4.0, 3.0, 2.0), (5.0, 9.0, 9.0), (6.0, 1.0, None)]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    pdf = pd.DataFrame(rows, columns=["a", "b", "y"])
    for r in EV.correlations(df, ["a", "b"], "y").collect():
        own = pdf[[r.metric, "y"]].dropna()
        assert r.n == len(own)
        assert r.spearman == pytest.approx(own[r.metric].rank().corr(own.y.rank()), abs=1e-9)


def test_hot_group_spreads_over_partitions(spark):
    # one group holds 90 % of rows; its windows must still be many
    df = spark.range(20000).select(F.when(F.col("id") % 10 == 0, F.lit(1)).otherwise(F.lit(0)).alias("g"),
                                   F.col("id").alias("o"))
    out = row_index(df, ["o"], ["g"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "windowspecdefinition(g" in plan and "_scan_b" in plan
    pdf = out.toPandas()
    for g, sub in pdf.groupby("g"):
        assert sorted(sub.idx) == list(range(len(sub)))


def test_eval_plan_is_native_and_bucketed(spark):
    """Windows without partition keys may only run over bucket totals, never
    over data rows; no Python node; building the plan runs no job."""
    import re
    df = spark.createDataFrame([(i, float(i % 7), float(i % 5)) for i in range(50)], "pair_id long, x double, y double")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plan-only", "")
    c = EV.correlations(df, ["x"], "y")
    plan = c._jdf.queryExecution().executedPlan().toString()
    assert not tracker.getJobIdsForGroup("plan-only")
    spark.sparkContext.setJobGroup("", "")
    for m in re.finditer(r"windowspecdefinition\(([^,)]*)", plan):
        first = m.group(1)
        if " ASC" in first or " DESC" in first:   # no partition columns
            assert first.startswith("_scan_b"), first
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas", "Arrow"):
        assert node not in plan


def test_nan_metric_is_missing_everywhere(spark):
    log = _log(spark, [0.1, 0.3, float("nan"), 0.2])
    assert RU.best_checkpoint(log).first().best_step == 2
    assert RU.early_stop(log).first().best_step == 2


def test_evaluate_pluggable_metric(spark):
    """a user metric function replaces the report; default is the report."""
    from pyspark.sql import functions as F

    from sentspark.operators.evaluation import evaluate
    pairs = spark.createDataFrame(
        [("dev", 0, [1.0, 0.0], [1.0, 0.0], 5.0), ("dev", 1, [1.0, 0.0], [0.0, 1.0], 0.0),
         ("test", 2, [1.0, 1.0], [1.0, 1.0], 4.0)],
        "split string, pair_id long, v1 array<double>, v2 array<double>, gold double")
    mine = evaluate(pairs, metrics=lambda d: d.groupBy("split").agg(F.avg("cosine").alias("mean_cos")))
    got = {r.split: round(r.mean_cos, 6) for r in mine.collect()}
    assert got == {"dev": 0.5, "test": 1.0}
    default = evaluate(pairs)
    assert "eval_cosine_spearman" in default.columns and default.count() == 1
