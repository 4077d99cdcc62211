"""Session construction and lineage cutting.

On a cluster the session is created by the platform; ``get_spark`` only fills
in settings that are unset, so cluster configuration always wins.
"""

from __future__ import annotations

import gc
import os
import tempfile
import zipfile

from pyspark import SparkConf, SparkContext
from pyspark.sql import DataFrame, SparkSession

# Settings applied only where nothing was submitted (see ``get_spark``). Sizes
# (shuffle partitions, memory) are the cluster's business and have no default here.
_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}

# Scratch folder of a plain local session that names none, and the applications
# whose checkpoint folder is set.
_LOCAL_DIRS: dict[str, str] = {}
_CHECKPOINTING: set[str] = set()


def get_spark(master: str | None = None, app: str = "talentflow",
              extra: dict[str, str] | None = None) -> SparkSession:
    """Return the active session, or build a local one for tests and benches."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    b = SparkSession.builder.appName(app)
    SparkContext._ensure_initialized()  # the JVM side knows what was submitted
    submitted = SparkConf()
    if not submitted.contains("spark.master"):
        b = b.master(master or "local[*]")
    conf = {k: v for k, v in _DEFAULTS.items() if not submitted.contains(k)}
    conf.update({k: v for k, v in (extra or {}).items() if not submitted.contains(k)})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder from ``spark.checkpoint.dir``.

    A cluster names a shared (HDFS/object store) folder in that setting and it
    is used as is. Only when it is unset (local tests) a scratch folder is made.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = _LOCAL_DIRS.get(spark.sparkContext.applicationId)
    if not d:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a shared folder: a machine-local "
                               "folder does not survive the loss of an executor")
        d = tempfile.mkdtemp(prefix="talentflow-ckpt-")
        _LOCAL_DIRS[spark.sparkContext.applicationId] = d
    if spark.sparkContext.applicationId not in _CHECKPOINTING:
        # once per application: every call would open a further subfolder
        spark.sparkContext.setCheckpointDir(d)
        _CHECKPOINTING.add(spark.sparkContext.applicationId)
    return d


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Have Spark delete what no table refers to any more: shuffle files, broadcasts, checkpoints.
    Its cleaner acts on what the driver's garbage collection finds, and a driver that has little
    to do collects seldom, so that the files of all steps would lie there together."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors (once per application), so that Python tasks can
    import it however the driver was started."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(), "talentflow_package.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for top, _, names in os.walk(here):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(top, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    spark.sparkContext.addPyFile(out)
    _SHIPPED.add(app)
