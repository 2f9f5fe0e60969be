"""Session helpers: a sane default builder and a shared scratch location."""

from __future__ import annotations

import atexit
import os
import tempfile
import threading
import uuid
import zipfile

from pyspark.sql import SparkSession


def build_session(master: str | None = None, app: str = "sentspark",
                  shuffle_partitions: int | None = None) -> SparkSession:
    """Session with AQE (coalescing + skew join) on.

    On a cluster pass ``master=None`` and let spark-submit decide.  Shuffle
    partitions, unless given (or set in ``SENTSPARK_SHUFFLE_PARTITIONS``):
    one per core in local mode; on a cluster four per core (at least 200),
    with AQE coalescing small ones towards ``advisoryPartitionSizeInBytes``
    (256 MB) -- enough reducers that a 100 TB shuffle does not spill per task.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = (b.config("spark.sql.adaptive.enabled", "true")
          .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
          .config("spark.sql.adaptive.skewJoin.enabled", "true")
          .config("spark.sql.session.timeZone", "UTC")
          .config("spark.sql.execution.arrow.pyspark.enabled", "true")
          # checkpoints of the rank scan are dropped once no plan refers to them
          .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
          .config("spark.ui.enabled", "false"))
    if master and master.startswith("local"):
        b = b.config("spark.driver.memory", os.environ.get("SENTSPARK_DRIVER_MEMORY", "16g"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    local = spark.sparkContext.master.startswith("local")
    if shuffle_partitions is None:
        env = os.environ.get("SENTSPARK_SHUFFLE_PARTITIONS")
        cores = spark.sparkContext.defaultParallelism
        shuffle_partitions = int(env) if env else (cores if local else max(200, 4 * cores))
    spark.conf.set("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if not local:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(256 * 1024 * 1024))
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    The cluster's setting always wins.  Only when it is unset *and* Spark runs
    in local mode (tests, the bench) do we create one ourselves; on a cluster
    an unset value is an error, because a machine-local folder would not
    survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        conf = tempfile.mkdtemp(prefix="sentspark-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder under the shared checkpoint root.  It is deleted
    when this process ends, or earlier by ``drop_scratch``."""
    root = checkpoint_root(spark).rstrip("/")
    path = f"{root}/sentspark-{name}-{uuid.uuid4().hex[:12]}"
    if not _SCRATCH:
        atexit.register(_drop_all)
    _SCRATCH[path] = (spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration())
    return path


def drop_scratch(path: str) -> None:
    """Delete a folder of ``scratch_path`` whose contents no plan needs any more."""
    held = _SCRATCH.pop(path, None)
    if held is not None:
        jvm, conf = held
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(conf).delete(folder, True)


def _drop_all() -> None:
    for path in list(_SCRATCH):
        try:
            drop_scratch(path)
        except Exception:  # the JVM may have ended first; nothing is left to ask
            return


_SCRATCH: dict[str, tuple] = {}
_SHIPPED: set[str] = set()
_SHIP_LOCK = threading.Lock()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers (what
    ``spark-submit --py-files`` does), once per SparkContext.

    Operators that run Python on executors (``mapInPandas``,
    ``applyInPandas``, ``mapInArrow``) pickle functions that refer to this
    package; a worker that cannot import it fails.  The package is zipped on
    the driver and handed to ``addPyFile``, which serves it to every executor
    and puts it on the workers' path.
    """
    sc = spark.sparkContext
    app = sc.applicationId
    with _SHIP_LOCK:
        if app in _SHIPPED:
            return
        pkg_dir = os.path.dirname(os.path.abspath(__file__))
        root = os.path.dirname(pkg_dir)
        out = os.path.join(tempfile.mkdtemp(prefix="sentspark-pyfiles-"), "sentspark.zip")
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for dirpath, dirnames, filenames in os.walk(pkg_dir):
                dirnames[:] = [d for d in dirnames if d != "__pycache__"]
                for f in filenames:
                    if f.endswith(".py"):
                        full = os.path.join(dirpath, f)
                        z.write(full, os.path.relpath(full, root))
        sc.addPyFile(out)
        _SHIPPED.add(app)
