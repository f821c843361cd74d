"""Several tables as one version: all of them, or none, reach a reader.

A version's tables are written into a folder of its own; then a manifest that names them, with schema, number of rows and a
hash of all rows, is put beside the others, in one step and last. What a writer that is lost has written has no
manifest, so it is in no version. A reader takes the newest manifest and refuses tables that are missing, changed or
mixed with others', and versions that lack a table or a column that it needs.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Mismatch(ValueError):
    """A version that is not what its manifest says, or not what a reader needs."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def fingerprint(df: DataFrame) -> dict:
    """Rows and a hash of them that is the same in any order."""
    h = F.xxhash64(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}))
    n, total, mixed = df.agg(F.count(F.lit(1)), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).first()
    return {"rows": n, "hash": f"{total or 0}:{mixed or 0}"}


def commit(spark: SparkSession, folder: str, tables: Mapping[str, DataFrame]) -> int:
    """Writes tables as the next version and returns its number."""
    place = f"versions/{uuid.uuid4().hex}"
    told = {}
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{place}/{name}")
        told[name] = {"schema": df.schema.simpleString(), **fingerprint(spark.read.schema(df.schema).parquet(f"{folder}/{place}/{name}"))}
    while True:
        version = max(versions(spark, folder), default=0) + 1
        text = json.dumps({"version": version, "place": place, "tables": told}, sort_keys=True)
        # Written aside and moved: a rename onto a name that is taken fails, and the next number is tried.
        fs, aside = _fs(spark, f"{folder}/{place}/manifest")
        out = fs.create(aside, True)
        out.write(bytearray(text.encode()))
        out.close()
        _, path = _fs(spark, f"{folder}/manifests/{version}.json")
        fs.mkdirs(path.getParent())
        if not fs.exists(path) and fs.rename(aside, path):
            return version


def versions(spark: SparkSession, folder: str) -> list[int]:
    fs, path = _fs(spark, f"{folder}/manifests")
    if not fs.exists(path):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(path)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def load(spark: SparkSession, folder: str, needs: Mapping[str, tuple[str, ...]], version: int | None = None) -> dict[str, DataFrame]:
    """The tables of the newest version, or of a stated one, checked; ``needs`` has the columns that each must have."""
    known = versions(spark, folder)
    if not known or (version is not None and version not in known):
        raise Mismatch(f"no such version: {version}" if known else "no version yet")
    told = json.loads("".join(r[0] for r in spark.read.text(f"{folder}/manifests/{version or known[-1]}.json").collect()))
    out = {}
    for name, columns in needs.items():
        entry = told["tables"].get(name)
        if entry is None:
            raise Mismatch(f"version {told['version']} has no {name}")
        path = f"{folder}/{told['place']}/{name}"
        fs, place = _fs(spark, path)
        if not fs.exists(place):
            raise Mismatch(f"{name} is gone")
        df = spark.read.parquet(path)
        if missing := sorted(set(columns) - set(df.columns)):
            raise Mismatch(f"{name} lacks {', '.join(missing)}")
        if df.schema.simpleString() != entry["schema"] or fingerprint(df) != {k: entry[k] for k in ("rows", "hash")}:
            raise Mismatch(f"{name} is not what version {told['version']} says")
        out[name] = df
    return out
