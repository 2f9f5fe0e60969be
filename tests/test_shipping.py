"""Python-backed operators work when the driver runs outside this folder
(workers only see the package because ``ship_package`` hands it to them)."""

import os
import subprocess
import sys
import tempfile

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as E
q = E.queries()
n = q["dense_tanh"](spark, "/root/testdata/sf0.001").count()
m = q["batch_sim"](spark, "/root/testdata/sf0.001").count()
print("ROWS", n, m)
"""


def test_python_stages_from_foreign_cwd():
    cwd = tempfile.mkdtemp(prefix="sentspark-foreign-cwd-")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    r = subprocess.run([sys.executable, "-c", SCRIPT], cwd=cwd, env=env, capture_output=True,
                       text=True, timeout=600)
    line = [x for x in r.stdout.splitlines() if x.startswith("ROWS")]
    assert r.returncode == 0 and line, r.stderr[-2000:]
    _, n, m = line[0].split()
    assert int(n) > 0 and int(m) > 0


def test_scratch_folders_are_deleted(tmp_path):
    """Nothing that a finished process landed stays behind."""
    import subprocess
    import sys
    import textwrap
    code = textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})
        from sentspark.session import build_session, drop_scratch, scratch_path
        from sentspark.sources.sinks import land
        import os
        spark = build_session("local[2]")
        spark.sparkContext.setCheckpointDir({str(tmp_path)!r})
        assert land(spark.range(5), "kept").count() == 5
        p = scratch_path(spark, "early")
        spark.range(3).write.parquet(p)
        drop_scratch(p)
        local = p.removeprefix("file:")
        assert not os.path.exists(local) and any("kept" in x for _, d, _ in os.walk({str(tmp_path)!r}) for x in d)
        spark.stop()
    """)
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)
    left = [x for _, d, f in os.walk(tmp_path) for x in [*d, *f] if "sentspark-" in x]
    assert left == []
