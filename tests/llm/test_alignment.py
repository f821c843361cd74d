import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidemark.llm import token_alignment
from tidemark.llm.queries import queries

from .conftest import frame

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain(rows):
    """The contract word by word, with both libraries and two pointers."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_model, b_model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_model.encode_special_tokens = True
    letters = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(b): b for b in letters} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in letters)}
    pairs, docs = Counter(), []
    for doc_id, text in rows:
        a, b = (a_model.encode(" " + text, add_special_tokens=False).ids, b_model.encode(text)) if text else ([], [])
        spelt_a = [bytes(byte[c] for c in a_model.id_to_token(i)) for i in a]
        spelt_b = [bytes([int(b_model.id_to_piece(i)[1:-1], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(spelt_a) != (" " + text).encode() or b"".join(spelt_b) != (" " + text).encode():
            docs.append((doc_id, [], [], [], []))
            continue
        i = j = at_a = at_b = first_a = first_b = 0
        links, groups = [], []
        while i < len(a):
            at_a += len(spelt_a[i])
            while at_b < at_a:
                at_b += len(spelt_b[j])
                j += 1
            i += 1
            if at_a == at_b:
                links.append((a[i - 1], b[j - 1]))
                groups.append(",".join(map(str, a[first_a:i])) + "|" + ",".join(map(str, b[first_b:j])))
                first_a, first_b = i, j
        pairs.update(links)
        docs.append((doc_id, a, b, links, groups))
    most = {}
    for (_, y), n in pairs.items():
        most[y] = max(most.get(y, 0), n)
    out = []
    for doc_id, a, b, links, groups in docs:
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        out.append((doc_id, len(a), len(b), len(groups), len(links), sum(pairs[x] == most[x[1]] for x in links), sum(pairs[x] for x in links), sha))
    return sorted(map(repr, out)), pairs


TEXTS = [
    None, "", " ", "  two  blanks ", "it's <|endoftext|> </s> <0x41> plain", "tab\tline\r\n\n end ", "café naïve 中文 한글 \U0001f600 नमस्ते", "a▁sign", "　wide",
    "é ﬁ ½", "\x00 null", "x" * 5000, "word " * 3000, " " * 300 + "deep", "12345 6789.01", "The quick brown fox", "The quick brown fox",
]


def found(df):
    align, _ = token_alignment.align(df, A, B)
    rows = align.select("doc_id", "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", F.col("n_best_b"), "count_sum", "groups").collect()
    return sorted(repr(tuple(r)) for r in rows)


def test_alignment_of_odd_texts_and_prose(spark, prose, monkeypatch):
    rows = list(enumerate(TEXTS)) + [(1000 + i, t) for i, t in prose]
    assert found(frame(spark, rows).repartition(5)) == plain(rows)[0]


def test_query_equals_two_pointers(spark, sf_small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(repr(tuple(r)) for r in queries()["op11_token_alignment"](spark, sf_small).collect()) == plain(rows)[0]


def test_pairs_and_whole_groups(spark, prose):
    docs, counts = token_alignment.align(frame(spark, prose), A, B, whole=True)
    want = plain(prose)[1]
    got = {(r.a, r.b): (r.n, r.most_a, r.most_b) for r in counts.collect()}
    assert {k: v[0] for k, v in got.items()} == dict(want)
    assert all(v[1] == max(n for (a, _), n in want.items() if a == k[0]) and v[2] == max(n for (_, b), n in want.items() if b == k[1]) for k, v in got.items())
    for r in docs.collect():
        groups = [g.split("|") for g in r.groups.split(";")] if r.groups else []
        assert len(groups) == r.n_links and sum(len(a.split(",")) for a, _ in groups) == r.n_a and sum(len(b.split(",")) for _, b in groups) == r.n_b


def test_many_small_blocks(spark, prose, monkeypatch):
    """Blocks end after few links here, within a task, in the workers too."""
    rows = list(enumerate(TEXTS)) + [(1000 + i, t) for i, t in prose]
    aligner = token_alignment.Aligner(A, B)
    import pyarrow as pa

    class Task:
        @staticmethod
        def get():
            return Task

        @staticmethod
        def partitionId():
            return 3

    monkeypatch.setattr("pyspark.TaskContext", Task)
    monkeypatch.setattr(token_alignment, "BLOCK_LINKS", 50)
    monkeypatch.setattr(token_alignment, "_aligner", lambda *_: aligner)
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([t for _, t in rows])], names=["doc_id", "text"])
    made = pa.Table.from_batches(list(token_alignment._blocks(A, B, False)(iter([batch]))))
    blocks = made.to_pylist()
    assert len({r["block"] for r in blocks}) > 20 and sum(r["pos"] is None for r in blocks) == len(rows)
    assert Counter({(r["a"], r["b"]): 0 for r in blocks if r["pos"] is not None}).keys() == plain(rows)[1].keys()
    df = spark.createDataFrame(blocks, token_alignment._ROWS)
    assert {(r.a, r.b): r.n for r in token_alignment.counted(df).collect()} == dict(plain(rows)[1])


@pytest.mark.parametrize("text", [" " * 3_000_000 + "x", "\n" * 200_000, "y" * 300_000, "z 1 " * 200_000])
def test_very_long_texts(text):
    aligner = token_alignment.Aligner(A, B)
    a, b = aligner.tokens(text)
    last_a, last_b = aligner.groups(a, b)
    assert len(last_a) == len(last_b) > 0 and last_a[-1] == len(a) - 1 and last_b[-1] == len(b) - 1
    if len(text) < 500_000:
        assert aligner.a.fast.encode_ordinary(" " + text) == a.tolist()


def test_byte_level_ids_equal_the_library():
    r = random.Random(4)
    aligner = token_alignment.ByteLevel(A)
    for _ in range(300):
        text = " " + "".join(chr(r.choice([32, 32, 39, 115, r.randrange(1, 0x300), r.randrange(0x2000, 0x2070), r.randrange(0x3000, 0xD000), r.randrange(0x10000, 0x20000)])) for _ in range(r.randrange(1, 60)))
        assert aligner.ids(text).tolist() == aligner.library.encode(text, add_special_tokens=False).ids


def test_empty_table(spark, empty, odd):
    docs, counts = token_alignment.align(empty, A, B)
    assert docs.collect() == [] and counts.collect() == []
    assert found(odd) == plain([(r.doc_id, r.text) for r in odd.collect()])[0]
