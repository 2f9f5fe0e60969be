"""Block products, one-exchange batching, digests, segmented losses, partial sums."""

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sentspark.functions.md5 import md5_words
from sentspark.operators import contrastive as C
from sentspark.operators import features as FE
from sentspark.operators import tokenizing as TK
from sentspark.operators import vectors as VO


def vector_rows(rng, n, views, batches):
    def vec():
        kind = rng.random()
        if kind < 0.05:
            return None
        if kind < 0.08:
            return [1.0, float("nan"), 0.0]
        if kind < 0.1:
            return [0.0, 0.0, 0.0]
        return [rng.uniform(-1, 1) for _ in range(3)]
    return [(rng.choice(batches), i, *[vec() for _ in range(views)]) for i in range(n)]


def rounded(rows):
    return {(r.batch_id, r.row): (r.label, r.n_cols, *[x if x is None else round(x, 9) for x in (r.pos_logit, r.max_logit, r.lse)])
            for r in rows}


@pytest.mark.parametrize("views,weight,block", [(2, 0.0, 7), (3, 0.7, 5), (3, 0.7, 1), (2, 0.0, 10_000)])
def test_block_product_equals_whole_batches(spark, views, weight, block):
    rng = random.Random(block)
    names = ["z1", "z2", "z3"][:views]
    rows = vector_rows(rng, 90, views, [1, 2, 2, 2, 2, 2, 3])
    df = spark.createDataFrame(rows, "batch_id long, row long, " + ", ".join(f"{n} array<double>" for n in names))
    one = C.in_batch_scores(df, names, hard_negative_weight=weight)
    many = C.blocked_scores(df, names, hard_negative_weight=weight, block_rows=block)
    assert many.dtypes == one.dtypes
    assert rounded(many.collect()) == rounded(one.collect())


def test_block_product_of_nothing_and_of_no_columns(spark):
    schema = "batch_id long, row long, z1 array<double>, z2 array<double>"
    assert C.blocked_scores(spark.createDataFrame([], schema), ["z1", "z2"]).count() == 0
    alone = spark.createDataFrame([(1, 1, [1.0], None), (1, 2, None, None)], schema)
    for r in C.blocked_scores(alone, ["z1", "z2"], block_rows=1).collect():
        assert (r.n_cols, r.pos_logit, r.max_logit, r.lse) == (0, None, None, None)


def test_block_product_sends_no_matrix(spark):
    """Each task holds two blocks: no partition of the product gets a whole batch."""
    df = spark.range(400).select(F.lit(1).alias("batch_id"), F.col("id").alias("row"),
                                 F.array(F.rand(1), F.rand(2)).alias("z1"), F.array(F.rand(3), F.rand(4)).alias("z2"))
    got = C.blocked_scores(df, ["z1", "z2"], block_rows=50)
    assert got.count() == 400 and {r.n_cols for r in got.collect()} == {400}


def padded_by_two_steps(df, size, **kw):
    b = FE.batch_assign(df, ["k", "j"], size, 42)
    return FE.pad_batch(b, "ids", "batch_id", **kw)


@pytest.mark.parametrize("n,size,parts", [(0, 4, 3), (1, 4, 3), (10, 4, 1), (503, 16, 8), (503, 1000, 8), (503, 1, 5)])
def test_batch_and_pad_equals_two_steps(spark, n, size, parts):
    df = spark.createDataFrame([(i, i % 3, [2] + [9] * (i * 7 % 5) + [3]) for i in range(n)], "k long, j int, ids array<int>")
    got = FE.batch_and_pad(df, ["k", "j"], "ids", size, 42, pad_to_multiple_of=4, partitions=parts)
    want = padded_by_two_steps(df, size, pad_to_multiple_of=4)
    key = lambda r: (r.k, r.j, r.idx, r.batch_id, r.width, tuple(r.ids))
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
    assert got.columns == want.columns


def test_batch_and_pad_exchanges_rows_once(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), F.array(F.lit(2), F.lit(3)).alias("ids"))
    out = FE.batch_and_pad(df, ["k"], "ids", 32)
    plan = out._jdf.queryExecution().executedPlan().toString()
    rows = [x for x in plan.splitlines() if "Exchange" in x and "ids#" in x]
    assert "shufflepartitionidpassthrough" in plan and not rows
    assert plan.count("shufflepartitionidpassthrough") == 1


def test_md5_of_many():
    rng = random.Random(2)
    messages = [bytes(rng.randrange(256) for _ in range(rng.randint(0, 200))) for _ in range(300)]
    messages += [b"x" * n for n in (55, 56, 63, 64, 119, 120)]
    m = np.zeros((len(messages), max(map(len, messages))), dtype=np.uint8)
    for k, x in enumerate(messages):
        m[k, :len(x)] = np.frombuffer(x, dtype=np.uint8)
    got = md5_words(m, np.array([len(x) for x in messages]))
    assert [g.astype(">u4").tobytes() for g in got] == [hashlib.md5(x).digest() for x in messages]
    assert md5_words(np.zeros((0, 0), np.uint8), np.zeros(0, np.int64)).shape == (0, 4)


def test_masks_draw_from_the_digest_of_each_token(spark):
    """Also with keys of very different lengths, null rows and empty views."""
    rows = [(str(i) * (1 + i % 70), [[2] + list(range(5, 5 + i % 13)) + [3], list(range(20, 20 + i % 5))]) for i in range(60)]
    rows += [("none", None), ("empty", []), ("blank", [[]]), (None, [[7, 8]])]
    df = spark.createDataFrame(rows, "k string, ids array<array<int>>")
    for r in FE.mlm_mask(df, "ids", ["k"], 1000, probability=0.4, seed=3).collect():
        key = f"3:{r.k}" if r.k is not None else "3"
        for v, view in enumerate(r.ids or []):
            for p, token in enumerate(view):
                u = [int.from_bytes(hashlib.md5(f"{key}:{v}:{p}".encode()).digest()[4 * d:4 * d + 4], "big") / 2 ** 32 for d in range(4)]
                if token in FE.SPECIAL_IDS or u[0] >= 0.4:
                    want = (token, -100)
                else:
                    want = (FE.MASK_ID if u[1] < 0.8 else math.floor(u[3] * 1000) if u[2] < 0.5 else token, token)
                assert (r.mlm_input_ids[v][p], r.mlm_labels[v][p]) == want


def test_wide_vocabulary_loss(spark):
    """50,000 logits a token, against numpy; and lists without a value."""
    df = spark.range(6).select(F.col("id").alias("row"), F.lit(0).alias("pos"), F.expr(
        "transform(sequence(0, 49999), k -> 5 * sin(k * (id + 1)))").alias("logits"), (F.col("id") * 9999).cast("int").alias("label"))
    for r in C.masked_ce(df, ["row", "pos"]).collect():
        x = 5 * np.sin(np.arange(50000.0) * (r.row + 1))
        m = x.max()
        assert math.isclose(r.token_loss, m + math.log(np.exp(x - m).sum()) - x[r.row * 9999], rel_tol=1e-12)
    odd = spark.createDataFrame([(1, [1.0, 2.0], 1), (2, [1.0], 1), (3, [], 0), (4, None, 0), (5, [1.0, None], 0), (6, [3.0], -100),
                                 (7, [-800.0, 800.0], 1), (8, [5.0], 0), (9, [1.0], -1), (10, [1.0], None)],
                                "row long, logits array<double>, label int")
    got = {r.row: r.token_loss for r in C.masked_ce(odd, ["row"]).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 7, 8, 9]
    assert [got[k] for k in (2, 3, 4, 5, 9)] == [None] * 5 and got[7] == 0.0 and got[8] == 0.0
    assert math.isclose(got[1], math.log(math.exp(1) + math.exp(2)) - 2, rel_tol=1e-12)


@pytest.mark.parametrize("pooler", ["avg", "avg_first_last", "avg_top2"])
def test_pooling_merges_partial_sums(spark, pooler):
    """Rows of a key in many tasks; two key columns, one of them null; no mask; a null entry."""
    rng = random.Random(1)
    rows = []
    for a, b in [(1, "x"), (1, None), (2, "x"), (3, "y")]:
        for layer in (0, 1, 2):
            for pos in range(5):
                mask = 0 if (a, b) == (3, "y") or pos == 4 else 1
                vec = [rng.uniform(-1, 1) for _ in range(3)]
                if (a, b, layer, pos) == (2, "x", 2, 0):
                    vec[1] = None
                rows.append((a, b, layer, pos, mask, vec))
    df = spark.createDataFrame(rows, "a long, b string, layer int, pos int, mask int, vec array<double>").repartition(7)
    layers = {"avg": [2], "avg_first_last": [0, 2], "avg_top2": [1, 2]}[pooler]
    got = {(r.a, r.b): r.pooled for r in VO.pool(df, pooler, ["a", "b"]).collect()}
    assert len(got) == 4
    for (a, b), pooled in got.items():
        for d in range(3):
            own = [v[d] for x, y, layer, _, m, v in rows if (x, y) == (a, b) and layer in layers and m]
            if not own or None in own:
                assert pooled[d] is None
            else:
                assert math.isclose(pooled[d], sum(own) / len(own), rel_tol=1e-12, abs_tol=1e-15)


def test_digests_of_tokens_whatever_their_keys():
    """Keys of every length: short ones in one block with shared ends, long ones in as many as they need."""
    rng = np.random.default_rng(8)
    for longest in (0, 9, 50, 130):
        keys = ["k" * int(n) + "é" * int(n > 3) for n in rng.integers(0, longest + 1, 40)]
        row, view, pos = (rng.integers(0, n, 500) for n in (len(keys), 3, 120))
        got = TK.token_digests(pa.array(keys, pa.string()), row, view, pos)
        want = [hashlib.md5(f"{keys[r]}:{v}:{p}".encode()).digest() for r, v, p in zip(row, view, pos)]
        assert [g.astype(">u4").tobytes() for g in got] == want
    none = np.zeros(0, np.int64)
    assert TK.token_digests(pa.array(["a"]), none, none, none).shape == (0, 4)
    assert TK.token_digests(pa.array([], pa.string()), none, none, none).shape == (0, 4)


def test_masks_come_back_with_the_columns_asked_for(spark):
    df = spark.createDataFrame([(1, "x", [[2, 9, 3]])], "k long, other string, ids array<array<int>>")
    assert FE.mlm_mask(df, "ids", ["k"], 100).columns == ["k", "other", "ids", "mlm_input_ids", "mlm_labels"]
    few = FE.mlm_mask(df, "ids", ["k"], 100, probability=1.0, carry=["k"])
    assert few.columns == ["k", "mlm_input_ids", "mlm_labels"] and few.first().mlm_labels == [[-100, 9, -100]]
