"""Pooling, similarities, contrastive losses."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sentspark.functions import vectors as V
from sentspark.operators import contrastive as C
from sentspark.operators import vectors as VO
from sentspark.session import scratch_path


def _hidden(spark, rows):
    return spark.createDataFrame(rows, "id long, layer int, pos int, mask int, vec array<double>")


def test_pool_avg_masked(spark):
    h = _hidden(spark, [(0, 0, 0, 1, [1.0, 2.0]), (0, 0, 1, 1, [3.0, 4.0]), (0, 0, 2, 0, [5.0, 6.0])])
    assert VO.pool(h, "avg").first().pooled == [2.0, 3.0]


def test_pool_zero_mask_gives_nulls(spark):
    h = _hidden(spark, [(0, 0, 0, 0, [1.0, 2.0]), (0, 0, 1, 0, [3.0, 4.0])])
    assert VO.pool(h, "avg").first().pooled == [None, None]


def test_pool_cls_and_layers(spark):
    rows = []
    for layer, scale in ((0, 1.0), (1, 10.0), (2, 100.0)):
        rows += [(0, layer, 0, 1, [scale, 0.0]), (0, layer, 1, 1, [0.0, scale]), (0, layer, 2, 0, [9.0, 9.0])]
    h = _hidden(spark, rows)
    assert VO.pool(h, "cls").first().pooled == [100.0, 0.0]
    assert VO.pool(h, "avg_first_last").first().pooled == pytest.approx([25.25, 25.25])
    assert VO.pool(h, "avg_top2").first().pooled == pytest.approx([27.5, 27.5])
    with pytest.raises(ValueError):
        VO.pool(h, "max")


def test_zero_vector_rules(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [0.0, 0.0])], "x array<double>, y array<double>")
    got = df.select(V.cos_temp("x", "y", temp=1.0).alias("c"), V.paired_cosine("x", "y").alias("p")).collect()
    assert [(r.c, r.p) for r in got] == [(0.0, 0.5), (0.0, 1.0)]


def test_pair_distances(spark):
    df = spark.createDataFrame([([1.0, 2.0], [4.0, 6.0])], "x array<double>, y array<double>")
    r = df.select(V.neg_manhattan("x", "y"), V.neg_euclidean("x", "y"), V.dot("x", "y")).first()
    assert tuple(r) == (-7.0, -5.0, 16.0)


def test_dense_tanh_matches_numpy(spark):
    rng = np.random.default_rng(1)
    w = rng.normal(size=(3, 4))
    b = rng.normal(size=3)
    xs = rng.normal(size=(5, 4))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(xs)] + [(9, None), (10, [1.0])],
                               "k long, v array<double>")
    out = {r.k: r.projected for r in VO.dense_tanh(df, "v", w, b).collect()}
    for i, x in enumerate(xs):
        assert out[i] == pytest.approx(np.tanh(w @ x + b).tolist())
    assert out[9] is None and out[10] is None


def _views(spark, rows, n):
    cols = ", ".join(f"z{k + 1} array<double>" for k in range(n))
    return spark.createDataFrame(rows, f"batch_id long, row long, {cols}")


def test_info_nce_identity(spark):
    v = _views(spark, [(0, 0, [1.0, 0.0], [1.0, 0.0]), (0, 1, [0.0, 1.0], [0.0, 1.0])], 2)
    lg = C.in_batch_scores(v, ["z1", "z2"], temp=1.0)
    assert C.info_nce(lg).first().loss == pytest.approx(math.log(1 + math.exp(-1)), abs=1e-6)


def test_hard_negative_weight(spark):
    v = _views(spark, [(0, 0, [1.0, 0.0], [1.0, 0.0], [0.0, 1.0]), (0, 1, [0.0, 1.0], [0.0, 1.0], [1.0, 0.0])], 3)
    lg = C.in_batch_scores(v, ["z1", "z2", "z3"], temp=1.0, hard_negative_weight=1.0)
    losses = [r.loss for r in C.row_losses(lg).collect()]
    assert losses == pytest.approx([math.log(3 * math.e + 1) - 1] * 2, abs=1e-6)
    assert {r.n_cols for r in lg.collect()} == {4}


def test_more_views_rejected(spark):
    v = _views(spark, [(0, 0, [1.0], [1.0])], 2)
    with pytest.raises(ValueError):
        C.in_batch_scores(v, ["z1", "z2", "z1", "z2"])


def _brute_scores(rows, temp, weight):
    """(own, max, lse, columns) of each anchor, straight from the definition; null vectors are no columns."""
    def cos(a, b):
        return float(np.dot(a, b) / max(np.linalg.norm(a) * np.linalg.norm(b), 1e-8)) / temp
    out = []
    for i, (z1, *others) in enumerate(rows):
        cols = [(k, j, r[k]) for k in range(1, len(rows[0])) for j, r in enumerate(rows) if r[k] is not None]
        if z1 is None:
            out.append((None, None, None, len(cols)))
            continue
        x = [cos(z1, v) + (weight if k == 2 and j == i else 0.0) for k, j, v in cols]
        own = cos(z1, others[0]) if others[0] is not None else None
        out.append((own, max(x), math.log(sum(math.exp(t - max(x)) for t in x)) + max(x), len(cols)))
    return out


def test_tiles_nulls_and_hard_negatives(spark, monkeypatch):
    monkeypatch.setattr(C, "TILE", (3, 4))
    rng = np.random.default_rng(4)
    rows = [[rng.normal(size=5).tolist() for _ in range(3)] for _ in range(17)]
    rows[2][1] = rows[5][2] = rows[9][0] = None
    rows[11][0] = [0.0] * 5
    got = C._reduce([C._matrix(pa.array([r[k] for r in rows], pa.list_(pa.float64()))) for k in range(3)], 0.5, 0.7, 1e-8)
    for i, (own, most, lse, n) in enumerate(_brute_scores(rows, 0.5, 0.7)):
        for have, want in zip((got[0][i], got[1][i], got[2][i]), (own, most, lse)):
            assert np.isnan(have) if want is None else have == pytest.approx(want)
        assert got[3][i] == n
    df = spark.createDataFrame([(0, i, *r) for i, r in enumerate(rows)],
                               "batch_id long, row long, z1 array<double>, z2 array<double>, z3 array<double>")
    out = {r.row: r for r in C.in_batch_scores(df, ["z1", "z2", "z3"], temp=0.5, hard_negative_weight=0.7).collect()}
    assert out[2].pos_logit is None and out[9].lse is None and out[2].lse == pytest.approx(got[2][2])


def test_batch_above_65536_rows(spark):
    n = 66_000
    z = np.random.default_rng(1).normal(size=(n, 2))
    own, most, lse, cols = C._reduce([(z[:300], np.ones(300, bool)), (z, np.ones(n, bool))], 1.0, 0.0, 1e-8)
    assert cols[0] == n and lse[0] >= most[0] >= own[0]


def test_masked_ce_all_ignored_is_null(spark):
    df = spark.createDataFrame([(0, 0, [1.0, 2.0], -100)], "row long, pos int, logits array<double>, label int")
    tok = C.masked_ce(df, ["row", "pos"])
    assert tok.agg(F.avg("token_loss")).first()[0] is None


def test_masked_ce_value(spark):
    df = spark.createDataFrame([(0, 0, [1.0, 2.0], 1)], "row long, pos int, logits array<double>, label int")
    tok = C.masked_ce(df, ["row", "pos"])
    assert tok.first().token_loss == pytest.approx(math.log(math.e + math.e ** 2) - 2.0)
    assert "Exchange" not in tok._jdf.queryExecution().executedPlan().toString()


def test_diag_scores(spark):
    rows = [(b, r, [1.0, float(r)], [1.0, float(r)]) for b in range(2) for r in range(2)]
    d = C.diag_scores(_views(spark, rows, 2))
    got = d.collect()
    assert len(got) == 4 and all(r.score == pytest.approx(1.0) for r in got)
    assert "Exchange" not in d._jdf.queryExecution().executedPlan().toString()


def test_pool_filters_before_the_exchange(spark):
    h = _hidden(spark, [(0, 0, 0, 1, [1.0, 2.0]), (0, 1, 0, 1, [3.0, 4.0]), (1, 1, 1, 1, [5.0, 6.0])])
    assert [(r.id, r.pooled) for r in VO.pool(h, "cls").collect()] == [(0, [3.0, 4.0])]   # 1 has no position 0
    one = _hidden(spark, [(0, 0, 0, 1, [1.0, 2.0])])
    assert VO.pool(one, "avg_top2").first().pooled == VO.pool(one, "avg_first_last").first().pooled == [1.0, 2.0]
    h.write.mode("overwrite").parquet(p := scratch_path(spark, "hidden"))
    h = spark.read.parquet(p)
    for pooler, wanted in (("cls", "pos"), ("avg", "layer")):
        plan = VO.pool(h, pooler)._jdf.queryExecution().executedPlan().toString()
        below = plan[plan.index("Exchange hashpartitioning(id"):]
        assert f"Filter" in below and wanted in below[below.index("Filter"):]


def test_step_views_are_keyed_by_step(spark):
    from sentspark.plans import standins as S
    rows = S.step_views(spark, "/root/testdata/sf0.001")
    g = S.GLOBAL_RANKS * S.LOCAL_BATCH_ROWS
    keys = [r.row_key for r in S.views(spark, "/root/testdata/sf0.001").select("row_key").collect()]
    assert sorted((r.batch_id, r.row) for r in rows.select("batch_id", "row").collect()) == sorted(divmod(k, g) for k in keys)


def test_global_batches_rekey(spark):
    df = spark.createDataFrame([(0, rk, r, [1.0, float(rk)], [1.0, float(r)]) for rk in range(2) for r in range(3)],
                               "step long, rank long, row long, z1 array<double>, z2 array<double>")
    g = C.global_batches(df, "step", "rank", "row", 3)
    assert {r.n_cols for r in C.in_batch_scores(g, ["z1", "z2"]).collect()} == {6}
    assert sorted(r.row for r in g.collect()) == list(range(6))
