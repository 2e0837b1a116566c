"""Token counts equal the libraries' own, however batches and texts are cut."""

import random

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from spanveil.llm import token_counts as T

PIECES = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def odd_texts():
    r = random.Random(5)
    signs = " ▁\t\n\x00abcdeTheing éß中文\U0001f600<s></s><0x41>  "
    return ["".join(r.choice(signs) for _ in range(r.randint(0, 150))) for _ in range(400)] + ["", " ", "  ", "\n", "a" * 300, "▁" * 100, " " * 100, "</s>"]


@pytest.mark.parametrize("piece", [1, 7, 50_000])
def test_pieces_add_up(model, monkeypatch, piece):
    monkeypatch.setattr(T, "PIECE", piece)
    monkeypatch.setattr(T, "GROUP", 500)
    codec, texts = T.SentencePiece(open(PIECES, "rb").read()), odd_texts()
    assert T.lengths(codec, texts).tolist() == [len(model.encode(t)) for t in texts]
    assert piece > 100 or max(len(codec.pieces(t)) for t in texts) > 3


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_files_of_the_other_library(spark, monkeypatch, name):
    monkeypatch.setattr(T, "PIECE", 20)
    path = public_tokenizers.path(name)
    codec, own = T.Words(open(path, "rb").read()), Tokenizer.from_file(path)
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()] + odd_texts() + ["a <|endoftext|> b c d e f g h i j k l m n"]
    assert T.lengths(codec, texts).tolist() == [len(own.encode(t or "", add_special_tokens=False)) for t in texts]
    assert max(len(codec.pieces(t or "")) for t in texts) > 3


def test_groups_are_of_near_equal_bytes():
    import numpy as np

    sizes = np.array([10] * 50 + [900_000] + [40_000] * 60)
    parts = [int(sizes[a:b].sum()) for a, b in T._groups(sizes)]
    assert sum(parts) == sizes.sum() and len(parts) == 4 and max(parts) <= sizes.sum() / 4 + 900_000
    assert list(T._groups(np.array([5]))) == [(0, 1)]


def test_whole_tables(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = sorted((r["doc_id"], len((r["text"] or "").encode()), len(model.encode(r["text"] or ""))) for r in docs.collect())
    got = T.count_tokens(docs, PIECES).collect()
    assert sorted(tuple(r)[:3] for r in got) == want and all(r["over_limit"] == (r["n_tokens"] > 4096) for r in got)
    assert any(r["over_limit"] for r in got)


def test_odd_rows(spark, model):
    long = "The word and äöü. " * 60_000
    rows = [(1, None), (1, None), (None, "a b"), (2, ""), (3, long), (3, long), (4, "x" * 200_000)]
    docs = spark.createDataFrame([(*r, 9, "t") for r in rows], f"{SCHEMA}, n_tokens int, n_bytes string")
    out = T.count_tokens(docs, PIECES)
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(((i, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 4096) for i, t in rows), key=repr)
    assert T.count_tokens(spark.createDataFrame([], SCHEMA), PIECES).count() == 0
