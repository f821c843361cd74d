"""Typed scans at the edges: CSV, JSON lines, JSON documents, file hashes and injected loaders."""

from __future__ import annotations

import datetime
import os
import re
import urllib.request
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ingest import mixed_date, number, require

# Names of columns and of the key of cached extractions.
CORPUS_COLUMNS = ("url", "doc_type", "date", "text", "year", "meeting")
SERIES_COLUMNS = ("observation_date", "VIXCLS")
CACHE_KEY = ("document_id", "source_sha256", "provider", "model_id", "prompt_version")


def strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def csv(spark: SparkSession, path: str, required: tuple[str, ...] = (), keep_empty: bool = False) -> DataFrame:
    """All columns as text, by header name; quoted line breaks and doubled quotes are read, a byte-order mark
    is not part of the first name. With ``keep_empty`` empty fields stay '' and nothing reads as missing."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("quote", '"').option("inferSchema", False)
    df = reader.csv(path)
    df = df.toDF(*(c.lstrip("﻿").removeprefix("ï»¿") for c in df.columns))
    if keep_empty:
        df = df.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns))
    return require(df, required, path)


def corpus(spark: SparkSession, path: str) -> DataFrame:
    return csv(spark, path, CORPUS_COLUMNS)


def series(spark: SparkSession, path: str, date: str = SERIES_COLUMNS[0], value: str = SERIES_COLUMNS[1]) -> DataFrame:
    """Daily observations with coerced date and value; rows that fail keep nulls."""
    return csv(spark, path, (date, value)).select(mixed_date(F.col(date)).alias("trading_date"), number(F.col(value)).alias("value"))


def series_from_text(spark: SparkSession, text: str, value: str) -> DataFrame:
    """Observations from CSV held in a string; the date column has one of two names, a dot is missing."""
    lines = spark.createDataFrame([(x,) for x in text.strip().splitlines()], "line string")
    head = text.strip().splitlines()[0].lstrip("﻿").split(",")
    date = next((c for c in ("observation_date", "DATE") if c in head), None)
    if date is None or value not in head:
        raise ValueError(f"the series lacks its date or {value}")
    parsed = lines.select(F.from_csv("line", ", ".join(f"`{c}` string" for c in head)).alias("r")).select("r.*").where(F.col(date) != date)
    return parsed.select(mixed_date(F.col(date)).alias("trading_date"), number(F.col(value)).alias(value))


def loaded(spark: SparkSession, loader: Callable[..., pd.DataFrame], *args: object) -> DataFrame:
    """What an injected loader brings to the driver, such as a download of a bounded series."""
    return spark.createDataFrame(loader(*args))


def index_prices(spark: SparkSession, loader: Callable[[str, str], pd.DataFrame], start: str, end: str) -> DataFrame:
    """(trading_date, value) of an injected download whose end is exclusive, for an inclusive range of dates. The price
    is adjusted for dividends where the download has that."""
    after = (datetime.date.fromisoformat(end) + datetime.timedelta(days=1)).isoformat()
    raw = loader(start, after)
    price = next((c for c in ("Adj Close", "Close") if c in raw.columns), None)
    if price is None:
        raise ValueError("the download has neither Adj Close nor Close")
    dates = pd.to_datetime(raw.index, utc=True).tz_localize(None).normalize()
    return spark.createDataFrame(pd.DataFrame({"trading_date": dates.date, "value": raw[price].astype(float).to_numpy()}), "trading_date date, value double")


def downloaded(url: str, seconds: float = 60.0) -> str:
    """The text behind a URL; for loaders that a caller allows to use the network."""
    with urllib.request.urlopen(url, timeout=seconds) as answer:  # noqa: S310 - the caller names the address
        return answer.read().decode("utf-8-sig")


def json_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """One record a line; malformed lines are an error that names the first one's number in its file. Files are read in
    pieces, and lines counted piece by piece."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    marked = T.StructType([*kind.fields, T.StructField("_corrupt_record", T.StringType())])
    parsed, bad = F.from_json("value", marked, {"columnNameOfCorruptRecord": "_corrupt_record"}), "x is null or x._corrupt_record is not null"
    # A line's place: its file, where its piece of the file begins, and its number in the task, which rises in a piece.
    place = ("file", "piece", "at")
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("piece"), F.monotonically_increasing_id().alias("at"))
    first = lines.where("trim(value) <> ''").withColumn("x", parsed).where(bad).select(*place).orderBy(*place).first()
    if first:
        earlier = (F.col("piece") < first["piece"]) | ((F.col("piece") == first["piece"]) & (F.col("at") < first["at"]))
        before = lines.where((F.col("file") == first["file"]) & earlier).count()
        raise ValueError(f"{first['file'].rsplit('/', 1)[-1]}, line {before + 1}: not a record")
    return spark.read.schema(kind).option("mode", "FAILFAST").json(path)


def json_document(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def latest(cache: DataFrame, keys: tuple[str, ...] = CACHE_KEY, order: str = "generated_at") -> DataFrame:
    """The last record of each key."""
    # Of records of one time the greatest as text is taken, so that the choice is the same each time.
    w = Window.partitionBy(*keys).orderBy(F.desc(order), F.desc(F.to_json(F.struct("*"))))
    return cache.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def pinned(spark: SparkSession, loader: Callable[[str, str], dict[str, pd.DataFrame]], name: str, revision: str) -> tuple[DataFrame, DataFrame]:
    """Train and test tables of a data set at a fixed revision (a full commit hash), by an injected loader."""
    if not re.fullmatch("[0-9a-f]{40}", revision):
        raise ValueError(f"{name} needs the full hash of a revision, not {revision!r}")
    found = loader(name, revision)
    if lost := sorted({"train", "test"} - set(found)):
        raise ValueError(f"{name} lacks {', '.join(lost)}")
    return spark.createDataFrame(found["train"]), spark.createDataFrame(found["test"])


def stripped(df: DataFrame, split: str | None = None) -> DataFrame:
    """All columns as trimmed text, of one split if it is named; an error where nothing is left."""
    kept = df.select(*(F.trim(F.col(f"`{c}`").cast("string")).alias(c) for c in df.columns))
    kept = kept if split is None else kept.where(F.col("split") == split)
    if not kept.head(1):
        raise ValueError(f"no rows{'' if split is None else f' in split {split}'}")
    return kept


def labelled_splits(train: DataFrame, test: DataFrame, labels: dict[int, str]) -> DataFrame:
    """Train and test rows with named labels; an unknown label or an empty sentence is an error."""
    both = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")), allowMissingColumns=True)
    names = F.create_map(*(F.lit(x) for kv in labels.items() for x in kv))
    out = both.withColumnRenamed("label", "label_id").withColumn("policy_stance", F.element_at(names, F.col("label_id")))
    bad = out.agg(F.count_if(F.col("policy_stance").isNull()), F.count_if(F.coalesce(F.trim("sentence"), F.lit("")) == "")).first()
    if any(bad):
        raise ValueError(f"{bad[0]} unknown labels and {bad[1]} empty sentences")
    return out


def home(path: str, root: str) -> str:
    return path if "://" in path or os.path.isabs(path) else os.path.join(root, path)
