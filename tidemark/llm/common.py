"""What the operators of this subpackage share: tables, shared storage, shipping code to executors."""

from __future__ import annotations

import atexit
import io
import os
import re
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch: texts have any length, and a worker holds a batch and what it makes of
#: it. A single text may be longer than this and is a batch of its own.
BATCH_ROWS = 1000
BATCH_BYTES = 4 << 20

_SHIPPED: set[str] = set()
_OWN: dict[str, str] = {}


def tidy(run):
    """A task's function of batches which gives freed memory back at the end: a worker outlives its tasks, and
    what the allocators keep would add up over idle workers."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes

            import pyarrow as pa

            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return tidied


def _plain(size: str) -> int:
    """A setting's number; bytes may have a unit."""
    digits = size.rstrip("bBkKmMgG")
    return int(digits) << {"": 0, "b": 0, "k": 10, "m": 20, "g": 30}[size[len(digits) :].lower()[:1]]


def ship(spark: SparkSession) -> None:
    """Gives executors this package, once per application; they need not see the driver's folders.

    Also makes Arrow batches small enough for whole texts.
    """
    for what, most in (("Records", BATCH_ROWS), ("Bytes", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.max{what}PerBatch"
        if not 0 < _plain(spark.conf.get(name)) <= most:
            spark.conf.set(name, str(most))
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(top):
            for n in sorted(names):
                if n.endswith(".py"):
                    path = os.path.join(folder, n)
                    z.write(path, os.path.relpath(path, os.path.dirname(top)))
    folder = tempfile.mkdtemp(prefix="tidemark-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "tidemark_code.zip")
    with open(path, "wb") as f:
        f.write(data.getvalue())
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


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


class Stored:
    """Tables written to the shared folder so that lineage ends there and nothing is computed twice.

    ``keep`` writes one and reads it back; ``drop`` deletes those that later steps don't read.
    What a returned (lazy) frame still reads stays until the application ends.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.base = spark, f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.mode("overwrite").parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for n in names:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(n))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of frames that are gone, which bounds the disk in use."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


#: Bits of a filter for each key in it, and the fewest and most that a filter has: 32 MB go to a task at most.
BITS_A_KEY, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 28


class Filter:
    """A Bloom filter with one hash: ``may_hold`` is true of every key that was put in.

    It keeps most rows that a join would drop out of the join's shuffle. Its size grows with the number of
    keys up to MOST_BITS; beyond that it lets more rows through, and the join after it stays exact.
    """

    def __init__(self, keys: DataFrame, *columns: str):
        import numpy as np

        self.bits = bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_A_KEY * max(1, keys.count()) - 1).bit_length()))
        at = F.pmod(F.xxhash64(*columns), F.lit(bits))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))
        words = keys.groupBy(F.shiftright(at, 6).cast("int").alias("w")).agg(F.bit_or(bit).alias("bits")).toPandas()
        table = np.zeros(bits // 64, np.int64)
        table[words["w"].to_numpy(int)] = words["bits"].to_numpy(np.int64)
        self.table = keys.sparkSession.sparkContext.broadcast(table)

    def may_hold(self, *columns: str) -> Column:
        import numpy as np
        import pandas as pd

        table = self.table

        def held(at: pd.Series) -> pd.Series:
            at = at.to_numpy()
            return pd.Series((table.value[at >> 6] >> (at & 63)) & np.int64(1) == 1)

        held.__annotations__ = {"at": pd.Series, "return": pd.Series}
        return F.pandas_udf(held, "boolean")(F.pmod(F.xxhash64(*columns), F.lit(self.bits)))


class Columns:
    """A table whose columns have names of our own, whatever they are called: c0, c1 and so on.

    Names may clash with each other, in upper and lower case too, and with names that an operator uses inside.
    """

    def __init__(self, df: DataFrame):
        self.names = df.columns
        self.df = df.toDF(*self.all)

    @property
    def all(self) -> list[str]:
        return [f"c{i}" for i in range(len(self.names))]

    def of(self, name: str) -> str:
        """Our name for the first column of that exact name."""
        if name not in self.names:
            raise ValueError(f"missing columns: {[name]}")
        return f"c{self.names.index(name)}"

    def back(self, df: DataFrame) -> DataFrame:
        """The table's own columns under their own names."""
        return df.select(*self.all).toDF(*self.names)


def without(docs: DataFrame, gone: DataFrame, column: str, store: Stored) -> DataFrame:
    """``docs`` less the rows whose ``column`` is among the values of ``gone``'s only column; nulls stay.

    Only values are joined, and other columns nearly never: what the filter of ``gone`` holds by chance
    is listed, and a second filter finds those rows.
    """
    gone = gone.toDF("gone").where("gone is not null").distinct()
    held = Filter(gone, "gone")
    key = docs.select(F.col(column).alias("key"))
    spared = store.keep(key.where(held.may_hold("key")).distinct().join(gone, F.col("key") == F.col("gone"), "left_anti"), "spared")
    free = Filter(spared, "key")
    stay = docs.where(~held.may_hold(column))
    rest = docs.where(held.may_hold(column)).where(free.may_hold(column)).join(gone, F.col(column) == F.col("gone"), "left_anti")
    return stay.unionByName(rest)


def lower_ascii(c: Column) -> Column:
    """A-Z in lower case and nothing else changed."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, whatever others there are; by position of the first of that exact name."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    if len({n.lower() for n in df.columns}) == len(df.columns):
        return df.select(*(F.col(f"`{n}`") for n in names))
    own = Columns(df)
    return own.df.select(*(F.col(own.of(n)).alias(n) for n in names))
