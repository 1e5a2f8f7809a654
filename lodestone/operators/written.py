"""Tables that are computed once and read several times."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of rows that a Python worker is sent at once (a longer row comes alone), where the session doesn't say.
BATCH_BYTES = "8m"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session. Where it is unset
    and all run on one machine, a temporary folder becomes the setting; on a cluster that is an error."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lodestone-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def written(df: DataFrame, tag: str = "table") -> DataFrame:
    """df, written as Parquet in the shared folder and read back: its lineage ends there, and its size is known."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Removes the files of written tables that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "_path", None):
            spark = t.sparkSession
            there = spark._jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def small(df: DataFrame, most: int = 64 << 20) -> bool:
    """Whether the optimizer's estimate of df, an upper bound for scans, allows a broadcast."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= most


def bounded(rows: DataFrame) -> DataFrame:
    """rows as they are; from here on, what Python workers of the session are sent at once is bounded by bytes, not by 10,000 rows of any length."""
    conf, key = rows.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in conf.getAll:
        conf.set(key, BATCH_BYTES)
    return rows


def released() -> None:
    """Returns freed memory of a Python worker, which outlives its tasks, to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc has it
        ctypes.CDLL(None).malloc_trim(0)
