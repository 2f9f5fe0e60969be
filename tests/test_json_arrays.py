"""Array files read by many tasks, against Spark's own reader of whole files."""

import json
import random

import pytest
from pyspark.sql import types as T

from sentspark.sources import json_arrays as JA
from sentspark.sources import readers as R

SCHEMA = T.StructType([
    T.StructField("a", T.LongType()), T.StructField("s", T.StringType()),
    T.StructField("n", T.StructType([T.StructField("x", T.ArrayType(T.IntegerType())), T.StructField("t", T.StringType())])),
    T.StructField("l", T.ArrayType(T.StringType()))])
NASTY = ['"', "\\", '\\"', "{", "}", "[", "]", "},{", '"}', "\\\\", "ü한😀", "\n", "\t", " ", "a", ",", ":", "]}"]


def nasty(rng, n):
    return "".join(rng.choice(NASTY) for _ in range(rng.randint(0, n)))


def records(rng, n):
    out = []
    for i in range(n):
        r = {"a": i, "s": nasty(rng, 12), "n": {"x": [rng.randint(0, 9) for _ in range(rng.randint(0, 4))], "t": nasty(rng, 5)},
             "l": [nasty(rng, 4) for _ in range(rng.randint(0, 3))], "more": {"deep": [[{"z": nasty(rng, 3)}], []]}}
        for k in ("a", "s", "n", "l"):
            if rng.random() < 0.05:
                r[k] = None
            elif rng.random() < 0.05:
                del r[k]
        out.append(r)
    return out


@pytest.fixture()
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes",
                                          "spark.sql.execution.arrow.maxRecordsPerBatch")}
    yield lambda size, rows=10_000: (spark.conf.set("spark.sql.files.maxPartitionBytes", str(size)),
                                     spark.conf.set("spark.sql.files.openCostInBytes", "4"),
                                     spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows)))
    for k, v in old.items():
        spark.conf.set(k, v)


def same(spark, path):
    got, want = R.read_json(spark, path, SCHEMA), R.read_json(spark, path, SCHEMA, multiline=True)
    assert got.schema == want.schema
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


@pytest.mark.parametrize("size,batch", [(64, 10_000), (300, 2), (5000, 3), (1 << 20, 10_000)])
@pytest.mark.parametrize("indent,ascii_only", [(None, True), (2, False)])
def test_same_rows_at_any_split(spark, tmp_path, small_splits, size, batch, indent, ascii_only):
    """Strings with quotes, backslashes and brackets; nested objects; records across many splits."""
    rng = random.Random(size)
    for k in range(2):
        (tmp_path / f"{k}.json").write_text(json.dumps(records(rng, 60), indent=indent, ensure_ascii=ascii_only), encoding="utf-8")
    small_splits(size, batch)
    same(spark, str(tmp_path))


def test_one_file_is_many_tasks(spark, tmp_path, small_splits):
    (tmp_path / "a.json").write_text(json.dumps(records(random.Random(1), 400)))
    small_splits(8192)
    assert JA._splits(spark, str(tmp_path)).rdd.getNumPartitions() > 5
    assert R.read_json(spark, str(tmp_path), SCHEMA).count() == 400


@pytest.mark.parametrize("text", ["[]", " [ ] ", "[{}]", "﻿[{\"a\": 1}]", "[{\"a\":1},{\"a\":2}]\n", "[\n{\"s\":\"x}\"}\n,\n{\"s\":\"\\\\\"}\n]"])
def test_small_arrays(spark, tmp_path, small_splits, text):
    (tmp_path / "a.json").write_text(text, encoding="utf-8")
    small_splits(3)
    same(spark, str(tmp_path))


def test_corpus_by_name_or_path(spark, tmp_path):
    spark.createDataFrame([("x", 1), (None, 2)], "text string, n int").write.parquet(str(tmp_path / "t"))
    spark.read.parquet(str(tmp_path / "t")).createOrReplaceTempView("corpus_view")
    for name in (str(tmp_path / "t"), "corpus_view"):
        got = R.read_corpus(spark, name)
        assert got.columns == ["text"] and sorted(r.text or "" for r in got.collect()) == ["", "x"]
