"""Tables between steps, in the folder that the cluster shares: what is written once is the same for every reader."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a folder of our own only in local mode where that is unset, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[[^-]*\])?$", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="tidemark-ckpt-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return f"file://{_OWN[app]}"


def kept(df: DataFrame, what: str) -> DataFrame:
    """``df``, written and read back. The files stay for as long as a lazy frame may read them: until the one who set
    spark.checkpoint.dir clears it, or until a local session ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def replaced(df: DataFrame, what: str, before: str | None = None) -> tuple[DataFrame, str]:
    """``df``, written and read back, and its folder; then the folder before, which ``df`` may have read, goes, as do the
    shuffles behind it, whose files Spark keeps until the driver happens to collect its garbage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if before:
        old = spark._jvm.org.apache.hadoop.fs.Path(before)
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    gc.collect()
    spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path), path
