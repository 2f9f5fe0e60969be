"""Feature building."""

from pyspark.sql import functions as F

from sentspark.operators import features as FE


def _vocab(spark, tokens):
    return spark.createDataFrame([(t, FE.N_SPECIAL + i, 1) for i, t in enumerate(tokens)],
                                 "token string, id int, cnt long")


def test_self_pair(spark):
    df = spark.createDataFrame([("s",), (None,), ("",)], "sentence string")
    got = [r.sentences for r in FE.self_pair(df).collect()]
    assert got == [["s", "s"], [" ", " "], [" ", " "]]


def test_encode_truncate_pad(spark):
    voc = _vocab(spark, [f"t{i}" for i in range(30)])
    df = spark.createDataFrame([(0, "t0 t1 t2"), (1, " ".join(f"t{i}" for i in range(20))), (2, ""), (3, "zz t1")],
                               "k long, s string")
    out = {r.k: r.input_ids for r in FE.encode(df, "s", voc, ["k"], max_length=8).collect()}
    C, S, P = FE.CLS_ID, FE.SEP_ID, FE.PAD_ID
    assert out[0] == [C, 5, 6, 7, S, P, P, P]
    assert out[1] == [C, 5, 6, 7, 8, 9, 10, S]
    assert out[2] == [C, S, P, P, P, P, P, P]
    assert out[3] == [C, FE.UNK_ID, 6, S, P, P, P, P]


def test_encode_views_nested(spark):
    voc = _vocab(spark, ["a", "b"])
    df = spark.createDataFrame([(0, "a", "b a")], "k long, x string, y string")
    r = FE.encode(df, ["x", "y"], voc, ["k"], max_length=5).first()
    assert r.input_ids == [[2, 5, 3, 0, 0], [2, 6, 5, 3, 0]]


def test_vocab_top_k_and_ids(spark):
    df = spark.createDataFrame([("b a a",), ("c a b",)], "sentence string")
    v = FE.build_vocab(df, "sentence", FE.N_SPECIAL + 2).orderBy("id").collect()
    assert [(r.token, r.id, r.cnt) for r in v] == [("a", 5, 3), ("b", 6, 2)]


def test_batches_and_dynamic_padding(spark):
    df = spark.createDataFrame([(i, [2] + [9] * (i % 4) + [3]) for i in range(10)], "k long, ids array<int>")
    b = FE.batch_assign(df, ["k"], 4)
    sizes = sorted(r["count"] for r in b.groupBy("batch_id").count().collect())
    assert sizes == [2, 4, 4]
    assert sorted(r.idx for r in b.collect()) == list(range(10))
    p = FE.pad_batch(b, "ids", "batch_id", pad_to_multiple_of=8)
    for r in p.collect():
        assert r.width == 8 and len(r.ids) == 8


def test_flatten_restore_round_trip(spark):
    df = spark.createDataFrame([(k, [[k, 1], [k, 2], [k, 3]], 0.5 * k) for k in range(3)],
                               "k long, ids array<array<int>>, labels double")
    flat = FE.flatten_views(df, ["k"], ["ids"], repeat=["labels"])
    assert flat.count() == 9
    back = FE.restore_views(flat, ["k"], ["ids"])
    assert sorted((r.k, r.ids) for r in back.collect()) == sorted((r.k, r.ids) for r in df.collect())
    labels = FE.dedup_label(flat, ["k"], "labels")
    assert sorted((r.k, r.labels) for r in labels.collect()) == [(0, 0.0), (1, 0.5), (2, 1.0)]


def test_take_view(spark):
    df = spark.createDataFrame([([[1], [2], [3]],)], "v array<array<int>>")
    assert FE.take_view(df, "v", 2, "z3").first().z3 == [3]


def test_mlm_mask_rules(spark):
    special = [FE.CLS_ID, FE.SEP_ID, FE.PAD_ID, FE.PAD_ID]
    rows = [(0, [special]), (1, [[2] + list(range(10, 40)) + [3]])]
    df = spark.createDataFrame(rows, "k long, ids array<array<int>>")
    none = FE.mlm_mask(df, "ids", ["k"], 100, probability=0.0).collect()
    for r in none:
        assert r.mlm_input_ids == r.ids and all(x == -100 for v in r.mlm_labels for x in v)
    full = {r.k: r for r in FE.mlm_mask(df, "ids", ["k"], 100, probability=1.0).collect()}
    assert full[0].mlm_input_ids == [special] and all(x == -100 for x in full[0].mlm_labels[0])
    labs = full[1].mlm_labels[0]
    assert labs[0] == -100 and labs[-1] == -100 and labs[1:-1] == list(range(10, 40))


def test_mlm_rates(spark):
    df = spark.range(2000).select(F.col("id").alias("k"),
                                  F.array(F.concat(F.array(F.lit(2)), F.array_repeat(F.lit(50), 30),
                                                   F.array(F.lit(3)))).alias("ids"))
    m = FE.mlm_mask(df, "ids", ["k"], 1000, probability=0.15)
    z = m.select(F.explode(F.arrays_zip(F.col("ids")[0].alias("a"), F.col("mlm_input_ids")[0].alias("b"),
                                        F.col("mlm_labels")[0].alias("c"))).alias("z"))
    agg = z.agg(F.count(F.lit(1)).alias("n"),
                F.count_if(F.col("z.c") != -100).alias("picked"),
                F.count_if(F.col("z.b") == FE.MASK_ID).alias("masked"),
                F.count_if((F.col("z.a") == 2) & (F.col("z.c") != -100)).alias("special_picked")).first()
    n_real = 2000 * 30
    assert abs(agg.picked / n_real - 0.15) < 0.01
    assert abs(agg.masked / agg.picked - 0.8) < 0.02
    assert agg.special_picked == 0


def test_holdout_is_stable(spark):
    df = spark.range(5000).select(F.col("id").alias("k"))
    a = FE.holdout_split(df, ["k"]).where("split = 'validation'").count()
    assert 150 < a < 350
    assert a == FE.holdout_split(df, ["k"]).where("split = 'validation'").count()


def test_map_batches_binds_params(spark):
    import pyarrow as pa
    import pyarrow.compute as pc

    def add(batch, k):
        return pa.RecordBatch.from_arrays([pc.add(batch.column(0), k)], names=["id"])

    out = FE.map_batches(spark.range(5), add, "id long", k=10)
    assert sorted(r.id for r in out.collect()) == [10, 11, 12, 13, 14]


def test_collate_pluggable_batcher(spark):
    """default collation batches and pads per batch; a custom batcher wins."""
    from sentspark.operators import features as FE
    rows = [(i, [2] + [7] * (i % 5) + [3]) for i in range(10)]
    df = spark.createDataFrame(rows, "k long, input_ids array<int>")
    out = FE.collate(df, ["k"], batch_size=4, seed=1, pad_to_multiple_of=8).collect()
    assert sorted(r.idx for r in out) == list(range(10))
    for r in out:
        assert len(r.input_ids) == r.width and r.width % 8 == 0
    custom = FE.collate(df, ["k"], batcher=lambda d, keys, **p: d.withColumn("batch_id", d.k % 2))
    assert {r.batch_id for r in custom.collect()} == {0, 1}


def test_encode_masks_equal_elementwise_definition(spark):
    """Native masks from encode == the per-element T5 definitions."""
    from pyspark.sql import functions as F

    from sentspark.operators import features as FE
    df = spark.createDataFrame([(0, "a b c", "d"), (1, "", "a a a a a a a a a a"), (2, None, "b")],
                               "k long, s1 string, s2 string")
    vocab = FE.build_vocab(df.select(F.col("s2").alias("sentence")), "sentence", FE.N_SPECIAL + 3)
    for cols in ("s1", ["s1", "s2"]):
        for pad in (True, False):
            e = FE.encode(df, cols, vocab, ["k"], max_length=8, pad=pad, with_masks=True)
            nested = not isinstance(cols, str)
            want_m = (F.transform("input_ids", lambda v: FE.attention_mask(v)) if nested
                      else FE.attention_mask("input_ids"))
            want_t = (F.transform("input_ids", lambda v: FE.token_type_ids(v)) if nested
                      else FE.token_type_ids("input_ids"))
            bad = e.where((F.col("attention_mask") != want_m) | (F.col("token_type_ids") != want_t)).count()
            assert bad == 0, (cols, pad)


def test_encode_with_own_tokenizer(spark):
    """The hook: any callable from texts to id lists, padded and masked alike."""
    def by_length(texts, max_length):
        return [[101, *(len(w) for w in t.split())][:max_length - 1] + [102] for t in texts]

    df = spark.createDataFrame([(0, "aa b", "x"), (1, None, "a b c d e f g h")], "k long, s string, t string")
    out = {r.k: r for r in FE.encode(df, ["s", "t"], by_length, ["k"], max_length=5, pad_id=9, with_masks=True).collect()}
    assert out[0].input_ids == [[101, 2, 1, 102, 9], [101, 1, 102, 9, 9]]
    assert out[1].input_ids == [[101, 102, 9, 9, 9], [101, 1, 1, 1, 102]]
    assert out[0].attention_mask == [[1, 1, 1, 1, 0], [1, 1, 1, 0, 0]]
    assert out[0].token_type_ids == [[0] * 5] * 2


def test_encode_by_join_equals_row_local(spark):
    df = spark.createDataFrame([(i, " ".join(f"t{j % (i + 1)}" for j in range(i))) for i in range(12)] + [(99, None)],
                               "k long, s string")
    voc = _vocab(spark, ["t0", "t2", "t3"])
    for pad in (True, False):
        a = FE.encode(df, ["s", "s"], voc, ["k"], max_length=8, pad=pad, with_masks=True)
        b = FE.encode(df, ["s", "s"], voc, ["k"], max_length=8, pad=pad, with_masks=True, broadcast_rows=2)
        assert "Exchange" not in a._jdf.queryExecution().executedPlan().toString()
        key = lambda r: r.k
        assert sorted(a.collect(), key=key) == sorted(b.collect(), key=key)
    assert FE.encode(df.limit(0), "s", voc, ["k"]).count() == 0
