"""Intermediate tables in the shared checkpoint folder.

Tables written here survive the loss of any executor. They lie in one folder per
application below ``spark.checkpoint.dir``, which is removed when the driver ends;
loops drop their own tables as soon as the next round is written.
"""

from __future__ import annotations

import atexit
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentflow.session import checkpoint_dir, ship_package

#: bits of a hash bitmap: 1 MB, whatever the size of what it marks
BITMAP_BITS = 1 << 23

_ROOTS: set[str] = set()


def map_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """``df.mapInArrow`` with the package at hand in the tasks."""
    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)


def map_arrow_frugal(df: DataFrame, run, schema: str) -> DataFrame:
    """``map_arrow`` for stages of many scans: a task that ends hands its free memory back to
    the system, so that workers kept for reuse do not hold what their largest batch took."""
    def frugal(batches):
        try:
            yield from run(batches)
        finally:
            hand_back()
    return map_arrow(df, frugal, schema)


def hand_back() -> None:
    """Return freed memory of Arrow and of the C library to the system."""
    import ctypes

    import pyarrow as pa
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has (whatever its case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def drop_tables(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more."""
    for t in tables:
        drop(t.sparkSession, t.stored_at)


def drop(spark: SparkSession, path: str) -> None:
    """Delete one intermediate table."""
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def _drop_quietly(spark: SparkSession, path: str) -> None:
    try:
        drop(spark, path)
    except Exception:  # noqa: BLE001  the session may already be gone at exit
        pass


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the application's folder below the shared checkpoint folder."""
    root = f"{checkpoint_dir(spark).rstrip('/')}/tables-{spark.sparkContext.applicationId}"
    if root not in _ROOTS:
        _ROOTS.add(root)
        atexit.register(_drop_quietly, spark, root)
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage, and Spark then knows the true size of the table, so that it
    broadcasts it in a join only below ``spark.sql.autoBroadcastJoinThreshold``.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def bitmap(rows: DataFrame, col: str, bits: int = BITMAP_BITS) -> np.ndarray:
    """A bitmap of the low bits of the 64-bit hashes in ``col``.

    Of fixed size: at most ``bits / 64`` rows come to the driver. It serves as a filter that
    never drops a marked hash; what else passes is sorted out by a join afterwards."""
    slot = F.col(col).bitwiseAND(F.lit(bits - 1))
    cells = (rows.select(F.shiftright(slot, 6).cast("int").alias("cell"),
                         F.expr(f"shiftleft(1L, int((`{col}` & {bits - 1}) & 63))").alias("bit"))
             .groupBy("cell").agg(F.bit_or("bit").alias("word")).collect())
    words = np.zeros(bits // 64, dtype=np.int64)
    for c in cells:
        words[c.cell] = c.word
    return words.view(np.uint64)


def marked(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes are marked in a bitmap."""
    slot = hashes & np.uint64(len(words) * 64 - 1)
    return (words[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) != 0
