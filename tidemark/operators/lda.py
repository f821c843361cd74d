"""Latent Dirichlet allocation by batch variational Bayes, with the topics dealt over Spark's tasks.

Each document's words are counted once and stored in blocks of documents, each with the list of its own terms. The
vocabulary is a table, dealt into shards by a hash of the term. An iteration is two shuffles of arrays: a shard sends each
block the weights of the block's terms; a block fits its documents' topics and sends each shard the sums for them. So no
task and not the driver holds all terms: a block's task has the weights of its own terms, a shard's task those of its
shard, and the driver one sum for each topic and shard.

All documents are in each iteration. A document's topics start even, and are fitted until they change by less than
``CHANGE`` words in the mean; topics' words start as gamma values drawn from the seed for each shard.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import Model
from pyspark.ml.feature import StopWordsRemover
from pyspark.ml.linalg import DenseMatrix
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import kept, replaced

#: Distinct words of documents after which a block is full, of documents fitted together, and terms of a shard.
BLOCK, PIECE, SHARD = 1 << 21, 1 << 17, 1 << 16
CHANGE, LEAPS = 1e-3, 1000

#: Between a shard and a block: the terms' places in the block and the shard, and weights or sums in single precision.
_MESSAGE = "part long, shard int, place binary, pos binary, x binary"
_STATE = "shard int, x binary, total array<double>"
_TYPES = pa.schema([("part", pa.int64()), ("shard", pa.int32()), ("place", pa.binary()), ("pos", pa.binary()), ("x", pa.binary())])


def blocks(docs: DataFrame, text: str, keep: tuple[str, ...]) -> DataFrame:
    """Documents in blocks: their words as places in the block's list of terms, and the columns to keep. Words are runs of
    three or more ASCII letters of the lower-cased text, without English stop words."""
    stop = frozenset(StopWordsRemover.loadDefaultStopWords("english"))
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.struct(*keep).alias("row"))
    schema = T._parse_datatype_string("part long, starts binary, ids binary, counts binary, n int, terms array<string>, documents array<int>").add("rows", T.ArrayType(rows.schema["row"].dataType))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        find, part = re.compile("[a-z]{3,}").findall, TaskContext.get().partitionId() << 32
        places, ids, counts, ends, kept_rows = _places(), array("i"), array("i"), array("q", [0]), []

        def full() -> pa.RecordBatch:
            own = np.array(ids, np.int32)
            rows = pa.concat_arrays(kept_rows)
            narrow = np.min_scalar_type(max(counts, default=0))
            columns = [[part], [ends.tobytes()], [own.tobytes()], [np.array(counts, narrow).tobytes()], [len(rows)], [list(places)], [np.bincount(own, minlength=len(places)).astype(np.int32)]]
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32())]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            return pa.RecordBatch.from_arrays([*arrays, pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)], names=schema.names)

        for b in batches:
            low, texts, own_rows = 0, b.column("text"), b.column("row")
            for i in range(b.num_rows):
                words = Counter(find(texts[i].as_py().lower()))
                for w in stop & words.keys():
                    del words[w]
                ids.extend(map(places.__getitem__, words))
                counts.extend(words.values())
                ends.append(len(ids))
                if len(ids) >= BLOCK:
                    kept_rows.append(own_rows.slice(low, i + 1 - low))
                    yield full()
                    part, low = part + 1, i + 1
                    places, ids, counts, ends, kept_rows = _places(), array("i"), array("i"), array("q", [0]), []
            if low < b.num_rows:
                kept_rows.append(own_rows.slice(low))
        if kept_rows:
            yield full()

    return rows.mapInArrow(run, schema)


def _places() -> defaultdict:
    """Numbers new keys."""
    found = defaultdict()
    found.default_factory = found.__len__
    return found


def _terms(stored: DataFrame) -> DataFrame:
    own = stored.select("part", F.posexplode(F.arrays_zip("terms", "documents")).alias("place", "of"))
    return own.select("part", "place", F.col("of.terms").alias("term"), F.col("of.documents").alias("documents"))


def vocabulary(stored: DataFrame, min_df: float, max_df: float) -> tuple[DataFrame, int]:
    """term, shard and pos of the terms in enough and not too many documents (limits from 1 on are numbers, else shares)."""
    n = stored.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least, most = (limit if limit >= 1 else limit * n for limit in (min_df, max_df))
    counted = _terms(stored).groupBy("term").agg(F.sum("documents").alias("documents"))
    terms = kept(counted.where((F.col("documents") >= least) & (F.col("documents") <= most)).select("term"), "terms")
    size = terms.count()
    if not size:
        raise ValueError("no term is in enough and not too many documents")
    terms = terms.withColumn("shard", F.pmod(F.xxhash64("term"), F.lit(size // SHARD + 1)).cast("int"))
    return kept(terms.withColumn("pos", F.row_number().over(Window.partitionBy("shard").orderBy("term")) - 1), "vocabulary"), size


def _asked(stored: DataFrame, numbered: DataFrame) -> DataFrame:
    """Which terms of each shard a block has."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        return _table([(key[0].as_py(), key[1].as_py(), rows.column("place").to_numpy().astype(np.int32).tobytes(), rows.column("pos").to_numpy().astype(np.int32).tobytes(), b"")])

    return kept(_terms(stored).join(numbered, "term").select("part", "shard", "place", "pos").groupBy("part", "shard").applyInArrow(run, _MESSAGE), "asked")


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_TYPES)], schema=_TYPES)


def _rows(messages: pa.Table) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, bytes]]:
    for r in messages.sort_by([("part", "ascending"), ("shard", "ascending")]).to_pylist():
        yield r["part"], r["shard"], np.frombuffer(r["place"], np.int32), np.frombuffer(r["pos"], np.int32), r["x"]


def exp_digamma(x: np.ndarray) -> np.ndarray:
    """The digamma function's exponential for x > 0: six steps of the recurrence, then the asymptotic series."""
    z, y = x * (x + 5), x + 6
    i = 1 / (y * y)
    return np.exp(np.log(y) - 0.5 / y - i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i * (1 / 240 - i / 132)))) - (2 * x + 5) * (1 / z + 1 / (z + 4) + 1 / (z + 6)))


def fit(beta: np.ndarray, starts: np.ndarray, ids: np.ndarray, counts: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Each document's topics (zeros if it has no words), and for each term and topic the sum, over documents, of count times
    topic by the word's likelihood. Documents of like sizes are fitted together, padded by a term without weight."""
    size, k = beta.shape
    own_weights = np.concatenate([beta, np.zeros((1, k))]).T.copy()
    ids, counts = np.append(ids, size).astype(np.intp), np.append(counts, 0).astype(float)
    gammas, sums, lengths = np.zeros((len(starts) - 1, k)), np.zeros((k, size + 1)), np.diff(starts)
    order = np.argsort(lengths, kind="stable")
    low = int(np.searchsorted(lengths[order], 1))
    while low < len(order):
        sizes = lengths[order[low : low + PIECE]]
        fitting = np.arange(1, len(sizes) + 1) * sizes <= PIECE
        own = order[low : low + max(1, int(fitting.sum()))]  # areas grow with the number, so the fitting ones come first
        low += len(own)
        each = np.arange(lengths[own].max())
        at = starts[own][:, None] + each
        at[each >= lengths[own][:, None]] = -1
        terms, n = ids[at], counts[at]
        weights = np.empty((len(own), k, len(each)))
        for j in range(k):
            weights[:, j] = own_weights[j][terms]
        gammas[own] = gamma = _settled(weights, n, alpha)
        theta = exp_digamma(gamma)
        n /= np.vecmat(theta, weights) + 1e-100
        for j in range(k):
            sums[j] += np.bincount(terms.ravel(), (n * theta[:, j : j + 1]).ravel(), size + 1)
    return gammas, sums[:, :size].T.copy()


def _settled(weights: np.ndarray, n: np.ndarray, alpha: float) -> np.ndarray:
    """The topics at which a step of the fixed-point iteration changes less than ``CHANGE``. After two steps a document leaps
    along them (SQUAREM), as the steps alone creep while topics are alike; after ``LEAPS`` leaps it steps, which always ends."""
    out, at, gamma, leaps = np.ones((len(n), weights.shape[1])), np.arange(len(n)), np.ones((len(n), weights.shape[1])), 0
    space = np.empty_like(n)

    def step(x: np.ndarray) -> np.ndarray:
        theta, phi = exp_digamma(x), space[: len(x)]
        np.vecmat(theta, weights, out=phi)
        phi += 1e-100
        np.divide(n, phi, out=phi)
        return theta * np.matvec(weights, phi) + alpha

    done = np.zeros(len(n), bool)
    while True:
        once = step(gamma)
        twice = step(once)
        first, second = once - gamma, twice - once
        settled = ~done & (np.abs(second).sum(axis=1) < CHANGE * gamma.shape[1])
        out[at[settled]] = twice[settled]
        done |= settled
        if done.all():
            return out
        gamma, leaps = twice, leaps + 1
        if leaps <= LEAPS:
            bend = second - first
            far = np.maximum(np.sqrt((first * first).sum(axis=1) / np.maximum((bend * bend).sum(axis=1), 1e-300)), 1)[:, None]
            gamma = np.maximum(once - first + 2 * far * first + far * far * bend, alpha)
        if done.sum() * 5 >= len(done):
            at, gamma, weights, n, done = at[~done], gamma[~done], weights[~done], n[~done], done[~done]


def _fitted(block: pa.Table, messages: pa.Table, scale: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's topics, sums and weights."""
    starts, ids = (np.frombuffer(block.column(c)[0].as_py(), kind) for c, kind in (("starts", np.int64), ("ids", np.int32)))
    counts = block.column("counts")[0].as_py()
    counts = np.frombuffer(counts, f"u{len(counts) // max(1, len(ids)) or 1}")
    size = int(ids.max(initial=-1)) + 1
    beta, known = np.zeros((size, len(scale))), np.zeros(size, bool)
    for _, _, place, _, x in _rows(messages):
        beta[place], known[place] = np.frombuffer(x, np.float32).reshape(-1, len(scale)) / scale, True
    own = known[ids]
    starts = np.concatenate([[0], np.cumsum(own)])[starts]
    return *fit(beta, starts, ids[own], counts[own], alpha), beta


def _expected(scale: np.ndarray, alpha: float) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    def run(key: tuple[pa.Scalar, ...], block: pa.Table, messages: pa.Table) -> pa.Table:
        if not messages.num_rows:
            return _table([])
        _, sums, beta = _fitted(block, messages, scale, alpha)
        return _table([(part, shard, b"", pos.tobytes(), (sums[place] * beta[place]).astype(np.float32).tobytes()) for part, shard, place, pos, _ in _rows(messages)])

    return run


def _maximised(topics: int, seed: int, prior: float | None) -> Callable[[tuple, pa.Table], pa.Table]:
    """A shard's weights: prior and sums (None: drawn)."""

    def run(key: tuple[pa.Scalar, ...], messages: pa.Table) -> pa.Table:
        shard, rows = key[0].as_py(), list(_rows(messages))
        size = 1 + max(int(pos.max()) for _, _, _, pos, _ in rows)  # each term of the vocabulary is in a block
        if prior is None:
            weights = np.random.default_rng([seed, shard]).gamma(100, 0.01, (size, topics))
        else:
            weights = np.full((size, topics), prior)
            for _, _, _, pos, x in rows:
                weights[pos] += np.frombuffer(x, np.float32).reshape(-1, topics)  # a block has a term once
        return pa.table({"shard": pa.array([shard], pa.int32()), "x": pa.array([weights.tobytes()], pa.binary()), "total": pa.array([weights.sum(axis=0).tolist()])})

    return run


def _sent(asked: DataFrame, state: DataFrame, topics: int) -> DataFrame:
    """What blocks get of the shards' weights."""

    def run(key: tuple[pa.Scalar, ...], asked: pa.Table, state: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return _table([])
        sent = exp_digamma(np.frombuffer(state.column("x")[0].as_py()).reshape(-1, topics)).astype(np.float32)
        return _table([(part, shard, place.tobytes(), pos.tobytes(), sent[pos].tobytes()) for part, shard, place, pos, _ in _rows(asked)])

    return asked.groupBy("shard").cogroup(state.groupBy("shard")).applyInArrow(run, _MESSAGE)


class Topics(Model):
    """Fitted topics; the weights are a stored table."""

    def __init__(self, text: str, topics: int, size: int, numbered: DataFrame, state: DataFrame, total: np.ndarray):
        super().__init__()
        self.text, self.topics, self.size, self.numbered, self.state, self.total = text, topics, size, numbered, state, total

    def vocabSize(self) -> int:  # noqa: N802  named as in pyspark.ml
        return self.size

    def weights(self) -> DataFrame:
        """term and its weight in each topic."""
        k = self.topics

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for shard, x in zip(b.column("shard").to_pylist(), b.column("x").to_pylist(), strict=True):
                    own = np.frombuffer(x)
                    n = len(own) // k
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, shard, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(own))], names=["shard", "pos", "weights"])

        return self.state.select("shard", "x").mapInArrow(run, "shard int, pos int, weights array<double>").join(self.numbered, ["shard", "pos"]).select("term", "weights")

    def topicsMatrix(self) -> DenseMatrix:  # noqa: N802
        """A row for each term, in order; for models that fit the driver."""
        rows = np.array([r["weights"] for r in self.weights().orderBy("term").collect()])
        return DenseMatrix(self.size, self.topics, rows.ravel(order="F").tolist())

    def leading(self, n: int) -> DataFrame:
        """Each topic's n leading terms: topic, rank, term, weight (its share of the topic); equal ones by term."""
        shares = self.weights().select("term", F.posexplode("weights").alias("topic", "w"))
        shares = shares.select("topic", "term", (F.col("w") / F.element_at(F.array(*map(F.lit, self.total.tolist())), F.col("topic") + 1)).alias("weight"))
        ranked = shares.withColumn("rank", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("weight"), "term"))).where(F.col("rank") <= n)
        return ranked.select("topic", "rank", "term", "weight")

    def _transform(self, docs: DataFrame) -> DataFrame:
        stored = kept(blocks(docs, self.text, tuple(docs.columns)), "blocks")
        return self.assigned(stored, _sent(_asked(stored, self.numbered), self.state, self.topics))

    def assigned(self, stored: DataFrame, messages: DataFrame) -> DataFrame:
        """The kept columns of documents in blocks, with the first largest topic and its weight: 0 and 0.0 without words."""
        own, scale, alpha = stored.schema["rows"].dataType.elementType, exp_digamma(self.total), 1 / self.topics
        schema = T.StructType([*own.fields, T.StructField("topic", T.IntegerType()), T.StructField("topic_weight", T.DoubleType())])

        def run(key: tuple[pa.Scalar, ...], block: pa.Table, messages: pa.Table) -> pa.Table:
            gammas = _fitted(block, messages, scale, alpha)[0]
            shares = gammas / np.maximum(gammas.sum(axis=1, keepdims=True), 1e-300)
            rows = block.column("rows").combine_chunks().flatten()
            return pa.table([*rows.flatten(), pa.array(shares.argmax(axis=1).astype(np.int32)), pa.array(shares.max(axis=1))], names=schema.names)

        return stored.select("part", "starts", "ids", "counts", "rows").groupBy("part").cogroup(messages.groupBy("part")).applyInArrow(run, schema)


def train(docs: DataFrame, text: str, topics: int, seed: int, min_df: float, max_df: float, iterations: int, keep: tuple[str, ...]) -> tuple[Topics, DataFrame]:
    """The model, and the documents' kept columns with topic and topic_weight."""
    stored = kept(blocks(docs, text, keep), "blocks")
    numbered, size = vocabulary(stored, min_df, max_df)
    asked = _asked(stored, numbered)
    state, path = replaced(asked.groupBy("shard").applyInArrow(_maximised(topics, seed, None), _STATE), "topics")
    several = 2 * stored.count()  # partitions: parts that meet by their hash would wait for each other
    words = stored.select("part", "starts", "ids", "counts").repartition(several, "part").persist(StorageLevel.DISK_ONLY)
    try:
        words.count()  # its partitioning is known from then on, and its blocks stay where they are
        for i in range(iterations + 1):
            total = np.array([r["total"] for r in state.orderBy("shard").select("total").collect()]).sum(axis=0)
            sent = _sent(asked, state, topics)
            if i < iterations:
                sums = words.groupBy("part").cogroup(sent.groupBy("part")).applyInArrow(_expected(exp_digamma(total), 1 / topics), _MESSAGE)
                state, path = replaced(sums.groupBy("shard").applyInArrow(_maximised(topics, seed, 1 / topics), _STATE), "topics", path)
    finally:
        words.unpersist()
    model = Topics(text, topics, size, numbered, state, total)
    return model, model.assigned(stored, sent)
