"""The batched map that goes on where it stopped."""

import os

import pytest

from sentspark.operators import resumable as RS


def tagger():
    """A function that workers get by value: it notes each id in a file and
    fails on one of them while ``fail_on`` exists."""
    def tag(batch, log, fail_on):
        import os

        import pyarrow as pa
        ids = batch.column("id").to_pylist()
        with open(log, "a") as f:
            f.write("".join(f"{i}\n" for i in ids))
        if os.path.exists(fail_on) and any(str(i) == open(fail_on).read() for i in ids):
            raise RuntimeError("killed")
        return pa.RecordBatch.from_pydict({"id": batch.column("id"), "twice": pa.array([2 * i for i in ids], pa.int64())})
    return tag


@pytest.fixture()
def place(spark, tmp_path):
    source = str(tmp_path / "in")
    for k in range(6):                           # one file each
        spark.createDataFrame([(10 * k + j,) for j in range(3)], "id long").coalesce(1).write.mode("append").parquet(source)
    return {"source": source, "out": str(tmp_path / "out"), "log": str(tmp_path / "log"), "fail": str(tmp_path / "fail")}


def run(spark, p, **kw):
    return RS.map_files(spark, p["source"], tagger(), "id long, twice long", p["out"], log=p["log"], fail_on=p["fail"], **kw)


def calls(p):
    with open(p["log"]) as f:
        return [int(x) for x in f]


@pytest.mark.parametrize("step", [1, 2])
def test_a_killed_job_goes_on(spark, place, step):
    everything = [10 * k + j for k in range(6) for j in range(3)]
    order = sorted(spark.read.parquet(place["source"]).inputFiles())
    last = spark.read.parquet(order[3]).first().id                 # in the second half
    with open(place["fail"], "w") as f:
        f.write(str(last))
    with pytest.raises(Exception, match="killed"):
        run(spark, place, files_per_commit=step)
    first = calls(place)
    done = {f for (f, _, _), _ in RS.committed(spark, place["out"])}
    assert len(done) == 3 // step * step
    os.remove(place["fail"])
    got = run(spark, place, files_per_commit=step)
    assert sorted((r.id, r.twice) for r in got.collect()) == [(i, 2 * i) for i in everything]
    again = calls(place)[len(first):]
    finished = {r.id for f in done for r in spark.read.parquet(f).collect()}
    assert sorted(again) == sorted(set(everything) - finished)     # not one finished row was mapped twice
    before = len(calls(place))
    assert run(spark, place).count() == 18 and len(calls(place)) == before


def test_rows_without_a_commit_are_never_read(spark, place):
    run(spark, place)
    spark.createDataFrame([(1, 1)], "id long, twice long").write.parquet(place["out"] + "/rows/leftover")
    assert run(spark, place).count() == 18 and not os.path.exists(place["out"] + "/rows/leftover")


def test_a_changed_file_is_mapped_again(spark, place):
    run(spark, place, files_per_commit=1)
    n = len(calls(place))
    spark.createDataFrame([(100,)], "id long").coalesce(1).write.mode("append").parquet(place["source"])
    assert run(spark, place).count() == 19 and len(calls(place)) == n + 1
    gone = spark.read.parquet(place["source"]).where("id = 0").inputFiles()
    path = next(f for f in gone if spark.read.parquet(f).where("id = 0").count()).replace("file://", "").replace("file:", "")
    os.remove(path)
    got = run(spark, place)
    assert sorted(r.id for r in got.collect())[0] == 10 and got.count() == 16 and len(calls(place)) == n + 1


def test_nothing_to_map(spark, tmp_path):
    spark.createDataFrame([], "id long").write.parquet(str(tmp_path / "in"))
    got = RS.map_files(spark, str(tmp_path / "in"), tagger(), "id long, twice long", str(tmp_path / "out"),
                       log=str(tmp_path / "log"), fail_on=str(tmp_path / "fail"))
    assert got.count() == 0 and got.columns == ["id", "twice"]
