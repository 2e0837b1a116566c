import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from spanveil.llm.batches import column_bytes
from spanveil.llm.sentencepiece_codec import Codec, Vocabulary, decode, encode

PATH = "/opt/tokenizers/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def codec():
    return Codec(Vocabulary.load(PATH))


def test_equals_the_library(codec):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rng = random.Random(2)
    texts = ["", " ", "  ", "a b", " a  b ", "hello   world\n\tÉé 𝄞 ½ ﬁ", "x" * 300, "\n\n", "a\r\nb();\r\n", "<s> </s> <0x0A>", "日本語 テスト", "a▁b", "é" * 50, "The quick brown fox"]
    texts += ["a" + " " * n + "b" for n in range(70)] + [" " * n for n in range(70)] + [" " * n + "\n" + " " * n + ";" for n in range(5)]
    texts += ["".join(rng.choice("abcdefgh   \n.,éüß12\t'\"{}();") for _ in range(rng.randint(1, 200))) for _ in range(300)]
    x = codec.segments(*column_bytes(pa.array([t.replace("▁", " ") for t in texts])))
    codec.learn(*codec.missing([x]))
    ids, offs, same = codec.encode(x)
    assert same.all()
    for i, t in enumerate(texts):
        assert ids[offs[i] : offs[i + 1]].tolist() == library.encode(t), repr(t)
    assert codec.decode(ids.astype("int64"), offs) == [t.replace("▁", " ") for t in texts]


def test_segments_of_one_hash_are_told_apart(codec):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = ["one two", "", "three four one", "two"]
    x = codec.segments(*column_bytes(pa.array(texts)))
    codec.learn(*codec.missing([x]))
    x.hashes = np.where(x.hashes == x.hashes[1], x.hashes[0], x.hashes)  # " two" claims the hash of " one"
    ids, offs, same = codec.encode(x)
    assert same.all() and [ids[a:b].tolist() for a, b in zip(offs, offs[1:])] == [library.encode(t) for t in texts]


def test_long_and_repeated_texts_and_clashing_names(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = [(1, "ab" * 150_000), (2, " " * 100_000 + "x"), (3, "word " * 60_000), (4, "same"), (4, "same"), (5, "\n" * 1000)]
    df = spark.createDataFrame([(i, t, [7], 1, "k") for i, t in rows], "doc_id long, text string, ids array<int>, n_ids int, id string")
    got = sorted((r.doc_id, r.ids) for r in encode(df, PATH).collect())
    assert got == sorted((i, library.encode(t)) for i, t in rows)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(None, "a b"), (9999, None)], docs.schema))
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    out = encode(docs, PATH)
    got = {r.doc_id: r for r in out.collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        assert got[i].ids == library.encode(t or "") and got[i].n_ids == len(got[i].ids) and got[i].round_trip
    assert {r.doc_id: r.text for r in decode(out, PATH).collect()} == {i: t or "" for i, t in texts.items()}
    assert encode(docs.limit(0), PATH).collect() == []
