"""Readers and sinks."""

import os

import pytest

from sentspark.session import scratch_path
from sentspark.sources import paths as P
from sentspark.sources import readers as R
from sentspark.sources import sinks as SK


def _local(p):
    """Plain-Python path of a local ``file:`` URI (tests write fixtures with open())."""
    return p[5:] if p.startswith("file:") else p


def test_tsv_bad_rows(spark):
    d = scratch_path(spark, "tsv-test")
    os.makedirs(_local(d), exist_ok=True)
    with open(_local(f"{d}/x.tsv"), "w", encoding="utf-8") as f:
        f.write("a\tb\tc\td\n1\t2\t3\t4\n5\t6\t7\n8\t9\t10\t11\t12\n\"q\tr\ts\tt\n")
    out = R.read_tsv(spark, f"{d}/x.tsv").collect()
    assert [tuple(r) for r in out] == [("1", "2", "3", "4"), ("5", "6", "7", None), ('"q', "r", "s", "t")]


def _write(path, text):
    os.makedirs(os.path.dirname(_local(path)), exist_ok=True)
    with open(_local(path), "w", encoding="utf-8") as f:
        f.write(text)


def test_tsv_by_name(spark):
    d = scratch_path(spark, "tsv-names")
    head = "genre\tfile\tyear\tscore\tsentence1\tsentence2\tid"
    _write(f"{d}/x.tsv", head + "\n" + "\n".join([
        "g\tf\t1\t4.5\ta\tb\t1", head, "g\tf\t1\tn/a\tc\td", "g\tf\t1\t2\te", "1\t2\t3\t4\t5\t6\t7\t8"]) + "\n")
    out = R.read_by_extension(spark, f"{d}/x.tsv", R.PAIR_SCHEMA).collect()
    # only the first line is the header; a bad score is null; an over-long row goes
    assert [tuple(r) for r in out] == [("a", "b", 4.5), ("sentence1", "sentence2", None), ("c", "d", None), ("e", None, 2.0)]
    rejects = {r.reason: r.n for r in R.tsv_rejects(spark, f"{d}/x.tsv", {"score": "double"}).collect()}
    assert rejects == {"fields": 1, "score": 2}
    with pytest.raises(ValueError, match="no column nothing"):
        R.read_tsv(spark, f"{d}/x.tsv", names=["nothing"])
    _write(f"{d}/folder/1.tsv", "a\tb\n1\t2\n")
    _write(f"{d}/folder/2.tsv", "b\ta\n3\t4\n")
    with pytest.raises(Exception, match="(?i)header"):
        R.read_tsv(spark, f"{d}/folder").collect()


def test_json_shapes_by_content(spark):
    d = scratch_path(spark, "json-shapes")
    want = [("a", 1), (None, 2), ("c", None)]
    array = '[{"title": "a", "label": 1, "extra": 0},\n {"title": null, "label": 2}, {"title": "c"}]'
    _write(f"{d}/flat.json", array.replace("\n", ""))
    _write(f"{d}/lines.json", array)
    _write(f"{d}/indented.json", "[\n  {\n    \"title\": \"a\",\n    \"label\": 1\n  },\n  {\"label\": 2},\n  {\"title\": \"c\"}\n]\n")
    _write(f"{d}/records.jsonl", '{"title": "a", "label": 1}\n{"label": 2}\n{"title": "c"}\n')
    _write(f"{d}/records.json", '{"title": "a", "label": 1}\n{"label": 2}\n{"title": "c"}\n')
    for name in ("flat.json", "lines.json", "indented.json", "records.jsonl", "records.json"):
        out = R.read_by_extension(spark, f"{d}/{name}", R.HEADLINE_SCHEMA)
        assert [tuple(r) for r in out.collect()] == want, name
    df = spark.createDataFrame(want, R.HEADLINE_SCHEMA).repartition(3)
    SK.write_json_array(df, f"{d}/out.json")
    back = R.land_json(spark, f"{d}/out.json", R.HEADLINE_SCHEMA)
    assert sorted(back.collect(), key=str) == sorted(df.collect(), key=str)
    SK.write_json_array(df.limit(0), f"{d}/none.json")
    assert R.read_json(spark, f"{d}/none.json", R.HEADLINE_SCHEMA).count() == 0


def test_csv_keeps_nulls_and_names(spark):
    rows = [(None, 1), ("", 2), ("a,b", 3), ('q"q', 4), ("two\nlines", 5), (" ", None)]
    df = spark.createDataFrame(rows, "sentence string, id int")
    for cols in (["sentence"], ["id", "sentence"]):
        p = scratch_path(spark, "csv-nulls") + "/s.csv"
        SK.write_csv(df.select(*cols).repartition(2), p)
        back = R.read_by_extension(spark, p, R.SENTENCE_SCHEMA, multiline=True)
        assert sorted((r[0] for r in back.collect()), key=str) == sorted((r[0] for r in rows), key=str)
    d = scratch_path(spark, "csv-bad")
    _write(f"{d}/x.csv", "label,title\n1,a\nx,b\n")
    assert [tuple(r) for r in R.read_by_extension(spark, f"{d}/x.csv", R.HEADLINE_SCHEMA).collect()] == [("a", 1), ("b", None)]
    with pytest.raises(ValueError, match="no column sentence"):
        R.read_by_extension(spark, f"{d}/x.csv", R.SENTENCE_SCHEMA)


def test_json_array_file(spark):
    d = scratch_path(spark, "json-test")
    os.makedirs(_local(d), exist_ok=True)
    with open(_local(f"{d}/h.json"), "w", encoding="utf-8") as f:
        f.write('[{"title": "a", "label": 1, "extra": 0}, {"title": null, "label": 2}]')
    out = R.read_json(spark, f"{d}/h.json", R.HEADLINE_SCHEMA, multiline=True).collect()
    assert [tuple(r) for r in out] == [("a", 1), (None, 2)]


def test_csv_round_trip_keeps_spaces_quotes_empty(spark):
    df = spark.createDataFrame([(" lead",), ('say "hi"',), ("",), ("trail ",)], "sentence string")
    p = scratch_path(spark, "csv") + "/s.csv"
    SK.write_csv(df, p)
    back = R.read_by_extension(spark, p, R.SENTENCE_SCHEMA)
    assert sorted(r[0] for r in back.collect()) == sorted([" lead", 'say "hi"', "", "trail "])


def test_parquet_split_pruning(spark):
    df = spark.createDataFrame([("dev", 1), ("test", 2)], "split string, v int")
    p = scratch_path(spark, "pq")
    SK.write_parquet(df, p, ["split"])
    picked = R.read_split(spark, p, "dev")
    assert [r.v for r in picked.collect()] == [1]
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "dev" in plan


def test_splits_reader(spark):
    root = scratch_path(spark, "splits")
    os.makedirs(_local(root), exist_ok=True)
    for s, body in (("dev", "x\ty\t1.0\n"), ("test", "u\tv\n")):
        with open(_local(f"{root}/sts-{s}.tsv"), "w") as f:
            f.write("sentence1\tsentence2\tscore\n" + body)
    out = R.read_splits(spark, {"dev": f"{root}/sts-dev.tsv", "test": f"{root}/sts-test.tsv"}, R.PAIR_SCHEMA)
    assert sorted(tuple(r) for r in out.collect()) == [("u", "v", None, "test"), ("x", "y", 1.0, "dev")]


def test_path_naming():
    assert P.dataset_path(P.folder_path("data", "raw"), "sts-", "dev", "tsv") == "data/raw/sts-dev.tsv"


def test_corpus_reader_prunes_columns(spark):
    df = R.read_corpus(spark, "/root/testdata/sf0.001/documents.parquet")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<text:string>" in plan
