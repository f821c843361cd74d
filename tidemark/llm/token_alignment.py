"""Alignment of two tokenizers' tokens, and how often their tokens end together in the corpus.

Tokenizer A is a byte-level vocabulary (a `tokenizers` file), B a vocabulary of pieces with byte fallback (a
`sentencepiece` file) that puts a blank before a text; so A reads the text with a blank before it. The ends of A's
and of B's tokens, in bytes, are two rising sequences. Merging them finds the offsets where both have an end:
these cut the tokens into *groups*, and the two tokens that end there are a *link*. Spark adds up how many links
join each pair of ids in the whole corpus, finds each id's highest count, and joins both back to the documents.

A task gathers the links of documents into *blocks* of about ``BLOCK_LINKS``. A pair of ids is one row a block,
however often it occurs, so that a pair in every text costs a row a block; what a document needs of the
counts are numbers of its block's pairs. Counts go back to a block as rows sorted before its documents, and a worker
holds the counts of one block. Rows of one pair meet in a join, which AQE splits.

Texts that are null or empty, or whose tokens don't spell the blank and the text byte by byte (B may
change letters, and its sign for a blank may stand in the text), have no tokens: zeros and an empty string.
Repeated rows count once each and get a row each. A very long text is a block of its own. Ties: all pairs that have
an id's highest count are best. An empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stored, only, ship, tidy

#: Links after which a block ends, and documents, for those without any.
BLOCK_LINKS, BLOCK_DOCS = 2_000_000, 100_000
#: Rows of pairs in one batch.
PAIR_ROWS = 200_000
#: How a byte-level vocabulary with this public pre-tokenizer cuts a text.
_CUT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts with more characters go through the vocabulary's own library, whose pattern has no limit of steps.
LONG_TEXT = 100_000


class ByteLevel:
    """Ids of a byte-level vocabulary and the bytes of each.

    Where ids rise with the order of merges, as in the public vocabulary, the same ids come from `tiktoken`, in a
    quarter of the time; tests hold them against the vocabulary's own library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, cut = told["model"], told["pre_tokenizer"]
        if told["normalizer"] is not None or cut != cut | {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}:
            raise ValueError("a byte-level vocabulary without a normalizer or a prefix is needed")
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = iter(range(256, 512))
        byte = {chr(b) if b in shown else chr(next(hidden)): b for b in range(256)}
        special = {t["content"] for t in told["added_tokens"]}
        self.bytes = [b""] * (1 + max(model["vocab"].values()))
        for token, i in model["vocab"].items():
            self.bytes[i] = b"" if token in special else bytes(byte[c] for c in token)
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        self.fast = None
        if all(a < b for a, b in zip(merged, merged[1:], strict=False)):
            import tiktoken

            self.fast = tiktoken.Encoding("byte-level", pat_str=_CUT, mergeable_ranks={b: i for i, b in enumerate(self.bytes) if b}, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None and len(text) <= LONG_TEXT:
            return self.fast.encode_to_numpy(text, disallowed_special=())
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int64)


class Pieces:
    """Ids of a vocabulary of pieces and the bytes of each."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        piece = [self.model.id_to_piece(i) for i in range(n)]
        self.bytes = [bytes([int(piece[i][1:-1], 16)]) if self.model.is_byte(i) else b"" if self.model.is_control(i) or self.model.is_unknown(i) else piece[i].replace("▁", " ").encode() for i in range(n)]

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text), np.int64)


class Aligner:
    """Both vocabularies, and what the tokens of one text have to do with each other."""

    def __init__(self, byte_level: str, pieces: str):
        self.a, self.b = ByteLevel(byte_level), Pieces(pieces)
        self.size_a, self.size_b = (np.array([len(x) for x in v.bytes], np.int64) for v in (self.a, self.b))

    @cached_property
    def written(self) -> list[bytes]:
        """Each id with the sign after it: A's within a group, A's last, B's within a group, B's last."""
        return [b"%d%b" % (i, sign) for v, signs in ((self.a, (b",", b"|")), (self.b, (b",", b";"))) for sign in signs for i in range(len(v.bytes))]

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        if not text:
            return None
        spelt = " " + text
        a, b = self.a.ids(spelt), self.b.ids(text)
        want = spelt.encode()
        if any(b"".join(map(v.bytes.__getitem__, ids.tolist())) != want for v, ids in ((self.a, a), (self.b, b))):
            return None
        return a.astype(np.int64), b.astype(np.int64)

    def groups(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the last A token and the last B token of each group, by one merge of the two runs of ends."""
        ends = np.concatenate((np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])))
        order = np.argsort(ends, kind="stable")  # two rising runs are merged, A first where both have an end
        merged = ends[order]
        both = np.flatnonzero(merged[1:] == merged[:-1])
        return order[both], order[both + 1] - len(a)

    def spelled(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> bytes:
        """``a1,a2|b1;a3|b2,b3``: the ids of each group, in order."""
        code_a, code_b = a.copy(), b + 2 * len(self.size_a)
        code_a[last_a] += len(self.size_a)
        code_b[last_b] += len(self.size_b)
        first_a, first_b = np.concatenate(([0], last_a[:-1] + 1)), np.concatenate(([0], last_b[:-1] + 1))
        line = np.empty(len(a) + len(b), np.int64)
        line[np.arange(len(a)) + np.repeat(first_b, last_a + 1 - first_a)] = code_a
        line[np.arange(len(b)) + np.repeat(last_a + 1, last_b + 1 - first_b)] = code_b
        return b"".join(map(self.written.__getitem__, line.tolist()))[:-1]


@lru_cache(maxsize=1)
def _aligner(byte_level: str, pieces: str) -> Aligner:
    return Aligner(byte_level, pieces)


def _packed(numbers: np.ndarray) -> bytes:
    """Sorted numbers as steps, low bytes first: the upper bytes are nearly all zero and take no room once compressed."""
    steps = np.diff(np.sort(numbers), prepend=0).astype("<u4")
    return steps.view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64))


#: Rows of documents (with ``links``, numbers of pairs in their block) and rows of pairs (with ``pos``, that number).
_ROWS = "block long, pos int, a int, b int, n long, doc_id long, n_a long, n_b long, n_links long, groups binary, links binary"
_SCHEMA = pa.schema([("block", pa.int64()), ("pos", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_links", pa.int64()), ("groups", pa.binary()), ("links", pa.binary())])


def _batch(size: int, /, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(size, f.type) for f in _SCHEMA], schema=_SCHEMA)


def _blocks(byte_level: str, pieces: str, whole: bool):
    def flushed(block: int, docs: list[tuple], codes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        told = pa.array(np.concatenate([*codes, np.empty(0, np.int64)])).dictionary_encode()
        number, pairs = told.indices.to_numpy(), told.dictionary.to_numpy()
        n = np.bincount(number, minlength=len(pairs))
        for low in range(0, len(pairs), PAIR_ROWS):
            part = pairs[low : low + PAIR_ROWS]
            yield _batch(len(part), block=pa.array(np.full(len(part), block)), pos=pa.array(np.arange(low, low + len(part))), a=pa.array(part >> 32), b=pa.array(part & 0xFFFFFFFF), n=pa.array(n[low : low + len(part)]))
        ends = np.cumsum([len(c) for c in codes])
        for low in range(0, len(docs), 1000):
            rows = docs[low : low + 1000]
            doc_id, n_a, n_b, groups = zip(*rows, strict=True)
            links = [_packed(number[e - len(c) : e]) for e, c in zip(ends[low : low + 1000], codes[low : low + 1000], strict=True)]
            sizes = [len(c) for c in codes[low : low + 1000]]
            yield _batch(len(rows), block=pa.array(np.full(len(rows), block)), doc_id=pa.array(doc_id, pa.int64()), n_a=pa.array(n_a), n_b=pa.array(n_b), n_links=pa.array(sizes), groups=pa.array(groups, pa.binary()), links=pa.array(links, pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, aligner = TaskContext.get().partitionId() << 32, _aligner(byte_level, pieces)
        docs: list[tuple] = []
        codes: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens = aligner.tokens(text.as_py())
                if tokens is None:
                    docs.append((doc_id, 0, 0, b""))
                    codes.append(np.empty(0, np.int64))
                else:
                    a, b = tokens
                    last_a, last_b = aligner.groups(a, b)
                    spelled = aligner.spelled(a, b, last_a, last_b)
                    docs.append((doc_id, len(a), len(b), spelled if whole else hashlib.sha256(spelled).hexdigest().encode()))
                    codes.append(a[last_a] << 32 | b[last_b])
                    held += len(last_a) + (len(spelled) // 8 if whole else 0)
                if held >= BLOCK_LINKS or len(docs) >= BLOCK_DOCS:
                    yield from flushed(block, docs, codes)
                    block, docs, codes, held = block + 1, [], [], 0
        if docs:
            yield from flushed(block, docs, codes)

    return tidy(run)


_DOCS = "doc_id long, n_a long, n_b long, n_links long, n_best_a long, n_best_b long, count_sum long, groups binary"


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted: a block's pairs by number, then its documents."""
    block, counts = None, np.empty((0, 3), np.int64)
    parts: list[np.ndarray] = []
    for batch in batches:
        own, pair = batch.column("block").to_numpy(), np.asarray(batch.column("pos").is_valid())
        numbers = np.stack([batch.column(c).fill_null(0).cast(pa.int64()).to_numpy() for c in ("n", "best_a", "best_b")], 1)
        edges = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (pair[1:] != pair[:-1]), [True]))) if len(own) else [0]
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            if own[low] != block:
                block, parts = own[low], []
                counts = np.empty((0, 3), np.int64)
            if pair[low]:
                parts.append(numbers[low:high])
                continue
            if parts:
                counts, parts = np.concatenate([counts, *parts]), []
            rows = batch.slice(low, high - low)
            sums = np.array([counts[_unpacked(x)].sum(axis=0) for x in rows.column("links").to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("doc_id", "n_a", "n_b", "n_links")), *(pa.array(np.ascontiguousarray(sums[:, i])) for i in (1, 2, 0)), rows.column("groups")], names=["doc_id", "n_a", "n_b", "n_links", "n_best_a", "n_best_b", "count_sum", "groups"])


def counted(rows: DataFrame) -> DataFrame:
    """a, b, n, most_a, most_b: the links of each pair of ids, and the highest number of any pair with the same A
    (or B) id; an id has as many pairs as the other vocabulary has ids at most."""
    counts = rows.where("pos is not null").groupBy("a", "b").agg(F.sum("n").alias("n"))
    return counts.select("a", "b", "n", *(F.max("n").over(Window.partitionBy(side)).alias(f"most_{side}") for side in ("a", "b")))


def align(docs: DataFrame, byte_level: str, pieces: str, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """Documents and pairs of ids.

    Documents: doc_id, n_a, n_b, n_links (as many as groups), n_best_a and n_best_b (links whose pair has the highest
    count of its A or B id), count_sum (of the counts of its links), groups (as text if ``whole``, else its SHA-256
    in hex; '' without tokens). Pairs: as ``counted`` says. The vocabularies are files that all executors see.
    """
    spark = docs.sparkSession
    ship(spark)
    store = Stored(spark, "token-alignment")
    rows = store.keep(only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_blocks(byte_level, pieces, whole), _ROWS), "rows")
    counts = store.keep(counted(rows), "counts")
    pairs = rows.where("pos is not null").select("block", "pos", "a", "b")
    best = [(F.col("n") == F.col(f"most_{side}")).cast("int").alias(f"best_{side}") for side in ("a", "b")]
    known = pairs.join(counts.select("a", "b", "n", *best), ["a", "b"]).drop("a", "b")
    own = rows.where("pos is null").select("block", "doc_id", "n_a", "n_b", "n_links", "groups", "links")
    laid = known.unionByName(own, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", F.col("pos").asc_nulls_last())
    found = laid.mapInArrow(tidy(_told), _DOCS)
    return found.withColumn("groups", F.col("groups").cast("string")), counts
