"""Training of a text classifier in epochs of mini-batches, with its gradients added up in Spark.

Words are hashed to ``features`` numbers, and a document's classes score as the sum of its words' weights, divided by the
square root of their number, and a bias.
An epoch deals the training rows anew into mini-batches; for each, every task adds up the gradient of its rows, partial
sums are added ``FAN`` at a time, and the driver takes one step (Adam) with what is a model's size, whatever the rows.
After an epoch the model is tried on the validation rows, and one row with metrics and state is appended to a folder. The
model to use is that of the epoch with the best macro-F1, the first if several are. A run that finds epochs in its
folder goes on behind the last one, as if it had never stopped.

Rows with a label that is not among the labels take no part, nor do rows without a key; null texts have no words. Long
texts are added up piece by piece. Rows are laid out by a hash of their key, so sums are the same each time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import words
from ..storage import kept
from . import evaluate

FAN = 32
#: Words that are looked up together.
PIECE = 1 << 18

HISTORY = "epoch int, loss double, accuracy double, macro_f1 double, run string, state binary"
_SUM = "part long, n long, loss double, gradient binary"


@dataclass(frozen=True)
class Settings:
    labels: tuple[str, ...]
    features: int = 1 << 14
    batches: int = 4
    rate: float = 0.05
    decay: float = 1e-4
    seed: int = 42
    share: float = 0.2

    def name(self) -> str:
        """What an epoch's row must agree in with a run that goes on behind it."""
        return repr(self)


@dataclass
class State:
    """Weights (a row for each feature, and the bias) with Adam's running means."""

    weights: np.ndarray
    mean: np.ndarray
    square: np.ndarray
    steps: int

    @classmethod
    def new(cls, s: Settings) -> State:
        none = np.zeros((s.features + 1, len(s.labels)))
        return cls(none, none.copy(), none.copy(), 0)

    def dump(self) -> bytes:
        return np.concatenate([[float(self.steps)], self.weights.ravel(), self.mean.ravel(), self.square.ravel()]).tobytes()

    @classmethod
    def load(cls, data: bytes, s: Settings) -> State:
        flat = np.frombuffer(data, np.float64)
        parts = flat[1:].reshape(3, s.features + 1, len(s.labels)).copy()
        return cls(*parts, int(flat[0]))

    def step(self, gradient: np.ndarray, s: Settings) -> None:
        self.steps += 1
        self.mean = 0.9 * self.mean + 0.1 * gradient
        self.square = 0.999 * self.square + 0.001 * gradient * gradient
        move = self.mean / (1 - 0.9**self.steps) / (np.sqrt(self.square / (1 - 0.999**self.steps)) + 1e-8)
        self.weights = self.weights - s.rate * (move + s.decay * self.weights)


def _scores(weights: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each document's probabilities."""
    out = np.zeros((len(sizes), weights.shape[1]))
    doc = np.repeat(np.arange(len(sizes)), sizes)
    for low in range(0, len(ids), PIECE):
        own = weights[ids[low : low + PIECE]]
        for c in range(weights.shape[1]):
            out[:, c] += np.bincount(doc[low : low + PIECE], own[:, c], len(sizes))
    out = out / np.sqrt(np.maximum(sizes, 1))[:, None] + weights[-1]
    out = np.exp(out - out.max(axis=1, keepdims=True))
    return out / out.sum(axis=1, keepdims=True)


def _read(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = b.column("ids")
    return b.column("label").to_numpy(), ids.flatten().to_numpy(), ids.value_lengths().to_numpy()


def _gradient(weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        w = weights.value
        total, n, loss = np.zeros_like(w), 0, 0.0
        for b in batches:
            label, ids, sizes = _read(b)
            p = _scores(w, ids, sizes)
            loss -= float(np.log(np.maximum(p[np.arange(len(label)), label], 1e-300)).sum())
            p[np.arange(len(label)), label] -= 1
            doc, each = np.repeat(np.arange(len(sizes)), sizes), p / np.sqrt(np.maximum(sizes, 1))[:, None]
            for low in range(0, len(ids), PIECE):
                for c in range(w.shape[1]):
                    total[:, c] += np.bincount(ids[low : low + PIECE], each[doc[low : low + PIECE], c], len(w))
            total[-1] += p.sum(axis=0)
            n += len(label)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([n], pa.int64()), pa.array([loss]), pa.array([total.tobytes()], pa.binary())], names=["part", "n", "loss", "gradient"])

    return run


def _added(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    table = table.sort_by("part")
    total = sum(np.frombuffer(g, np.float64) for g in table.column("gradient").to_pylist())
    return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "n": pa.array([sum(table.column("n").to_pylist())], pa.int64()), "loss": pa.array([sum(table.column("loss").to_pylist())]), "gradient": pa.array([total.tobytes()], pa.binary())})


def _summed(rows: DataFrame, state: State) -> tuple[np.ndarray, float, int]:
    """Mean gradient, mean loss and number of rows."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(state.weights)  # of a model's size, which the settings bound
    try:
        sums = rows.mapInArrow(_gradient(sent), _SUM).groupBy(F.floor(F.col("part") / FAN).alias("to")).applyInArrow(_added, _SUM)
        sums = kept(sums, "gradients")
        while sums.count() > FAN:
            sums = kept(sums.groupBy(F.floor(F.col("part") / FAN).alias("to")).applyInArrow(_added, _SUM), "gradients")
        parts = sorted(sums.collect(), key=lambda r: r["part"])  # FAN of a model's size at most
    finally:
        sent.destroy()
    n = sum(p["n"] for p in parts)
    total = sum((np.frombuffer(p["gradient"], np.float64) for p in parts), np.zeros(state.weights.size))
    return total.reshape(state.weights.shape) / max(n, 1), sum(p["loss"] for p in parts) / max(n, 1), n


def prepared(docs: DataFrame, key: str, text: str, label: str, s: Settings) -> DataFrame:
    """key, label (its number), ids (hashed words), split; the same rows in the same places each time."""
    number = F.array_position(F.array(*map(F.lit, s.labels)), F.col(label).cast("string")) - 1
    rows = docs.select(F.col(key).cast("string").alias("key"), number.cast("int").alias("label"), F.transform(words(F.coalesce(F.col(text), F.lit("")), ()), lambda w: F.pmod(F.xxhash64(w), F.lit(s.features)).cast("int")).alias("ids"))
    rows = rows.where("key is not null and label is not null and label >= 0")
    rows = kept(rows, "words")
    marks = evaluate.split(rows.select("key", F.col("label").alias("of")), "of", "key", s.share, s.seed).select("key", "split").dropDuplicates(["key"])
    laid = rows.join(marks, "key").select("key", "label", "ids", "split")
    return kept(laid.repartition("key").sortWithinPartitions("key", "label", F.xxhash64("ids")), "examples")


def predictions(rows: DataFrame, state: State, s: Settings) -> DataFrame:
    """key, truth, guess of prepared rows; the first of equally likely labels."""
    sent = rows.sparkSession.sparkContext.broadcast(state.weights)
    labels = s.labels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            truth, ids, sizes = _read(b)
            guess = _scores(sent.value, ids, sizes).argmax(axis=1) if len(sizes) else np.empty(0, int)
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([labels[i] for i in truth], pa.string()), pa.array([labels[i] for i in guess], pa.string())], names=["key", "truth", "guess"])

    return rows.select("key", "label", "ids").mapInArrow(run, "key string, truth string, guess string")


def history(spark: SparkSession, folder: str, s: Settings) -> DataFrame:
    """The epochs of runs with these settings in a folder; none if there is no such folder yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], HISTORY)
    return spark.read.schema(HISTORY).parquet(folder).where(F.col("run") == s.name())


def train(examples: DataFrame, folder: str, s: Settings, epochs: int) -> DataFrame:
    """Trains on prepared rows until the folder has ``epochs`` epochs, and returns their metrics, the best one marked."""
    spark = examples.sparkSession
    last = history(spark, folder, s).orderBy(F.desc("epoch")).first()
    state, done = (State.load(last["state"], s), last["epoch"]) if last else (State.new(s), 0)
    fit, held = examples.where("split = 'train'"), examples.where("split = 'validation'")
    for epoch in range(done + 1, epochs + 1):
        losses = []
        for k in range(s.batches):
            dealt = F.pmod(F.xxhash64("key", F.lit(s.seed), F.lit(epoch)), F.lit(s.batches)) == k
            gradient, loss, n = _summed(fit.where(dealt), state)
            if n:
                state.step(gradient, s)
                losses.append((loss, n))
        metrics = evaluate.macro(evaluate.class_metrics(evaluate.confusion(predictions(held, state, s), "truth", "guess", s.labels))).first()
        mean = sum(a * n for a, n in losses) / max(1, sum(n for _, n in losses))
        row = spark.createDataFrame([(epoch, mean, metrics["accuracy"], metrics["macro_f1"], s.name(), bytearray(state.dump()))], HISTORY)
        row.coalesce(1).write.mode("append").parquet(folder)
    rows = history(spark, folder, s).where(F.col("epoch") <= epochs)
    best = rows.agg(F.max(F.struct("macro_f1", (-F.col("epoch")).alias("e")))).first()[0]
    return rows.select("epoch", "loss", "accuracy", "macro_f1", (F.col("epoch") == F.lit(-best["e"] if best else 0)).alias("best"))


def best(spark: SparkSession, folder: str, s: Settings) -> State:
    """The model of the best epoch."""
    found = history(spark, folder, s).orderBy(F.desc("macro_f1"), "epoch").first()
    if not found:
        raise ValueError("no epoch has been trained with these settings")
    return State.load(found["state"], s)
