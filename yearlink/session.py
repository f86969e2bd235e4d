"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

# Defaults that hold from local[8] up to a large cluster: AQE re-plans joins,
# coalesces tiny shuffle partitions and splits skewed ones at run time.
_DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Keep Arrow batches small: rows carry 64..768-float vectors.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(
    app: str = "yearlink",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Build (or reuse) a session with the engine defaults.

    ``master`` and ``shuffle_partitions`` are only set when given, so a
    cluster submit keeps whatever the launcher configured.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in _DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def is_local(master: str) -> bool:
    """Whether all tasks run in the driver's process (local, local[n])."""
    return master == "local" or master.startswith("local[")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, creating one only if unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used
    as is; without that setting this fails, as files in a folder of one
    machine cannot be read from the others.  Only in local mode (tests, local
    runs) do we make a scratch folder of our own, removed at the end.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None
    )
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    if not is_local(sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    scratch = tempfile.mkdtemp(prefix="yearlink-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    atexit.register(shutil.rmtree, scratch, ignore_errors=True)
    sc.setCheckpointDir(scratch)
    return sc.getCheckpointDir() or scratch


def checkpoint_table(df):
    """Materialise a DataFrame that later stages read several times, into the
    reliable checkpoint folder (survives executor loss; never local).

    The data is persisted first: an eager reliable checkpoint otherwise
    computes its plan twice (once to count, once to write the files)."""
    from pyspark import StorageLevel

    ensure_checkpoint_dir(df.sparkSession)
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = held.checkpoint(eager=True)
    held.unpersist(blocking=False)
    return out


def parquet_table(df, name: str):
    """Write a DataFrame that later stages read several times as Parquet into
    the shared checkpoint folder and read it back: cuts the lineage like
    :func:`checkpoint_table`, and each reader scans only its own columns."""
    base = ensure_checkpoint_dir(df.sparkSession)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession | None = None) -> None:
    """Make ``yearlink`` importable in the Python workers.

    UDFs and Arrow functions are pickled by reference to this package's
    modules, so executors need the package.  It is zipped once and added with
    ``addPyFile`` (Spark serves it to every executor), once per application.
    Harmless when the package is already installed on the workers.
    """
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        return
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    fd, path = tempfile.mkstemp(prefix="yearlink-", suffix=".zip")
    with zipfile.ZipFile(os.fdopen(fd, "wb"), "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(app)
