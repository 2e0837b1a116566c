import hashlib
import random
import re
from collections import Counter

import pytest

from spanveil.llm import repeats
from spanveil.llm.substring_dedup import substring_dedup
from spanveil.llm.suffix_array_dedup import suffix_array_dedup


def brute(texts, width, unit):
    seqs = [re.findall(r"[^\x20\x09-\x0D]+", t or "") if unit == "words" else list((t or "").encode()) for t in texts]
    seen = Counter(tuple(s[i : i + width]) for s in seqs for i in range(len(s) - width + 1))
    out = []
    for s in seqs:
        gone = [False] * len(s)
        for i in range(len(s) - width + 1):
            if seen[tuple(s[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        left = [x for x, g in zip(s, gone) if not g]
        kept = " ".join(left).encode() if unit == "words" else bytes(left)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(s), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed=5):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("aeioubcdé") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    text = lambda n: rng.choice([" ", "\n"]).join(rng.choice(vocabulary) for _ in range(n))
    base = [text(rng.randint(0, 150)) for _ in range(30)]
    shared = text(14)
    out = list(base)
    for b in base[:12]:  # near copies
        w = b.split(" ")
        if w:
            w[rng.randrange(len(w))] = "X"
        out.append(" ".join(w))
    out += base[12:16] + [f"{text(9)} {shared} {text(5)}" for _ in range(12)]
    out += ["a b " * 30, "a" * 90, "", None, " \n", "é" * 40, base[3], base[3]]
    return out


@pytest.mark.parametrize("hot", [4000, 2])
@pytest.mark.parametrize(("unit", "width", "f"), [("words", 8, substring_dedup), ("bytes", 32, suffix_array_dedup)])
def test_equals_brute_force(spark, monkeypatch, unit, width, f, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    texts = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n string").repartition(3)
    n = "n_words" if unit == "words" else "n_bytes"
    got = {r.doc_id: (r[n], r.n_removed, r.n_spans, r.kept_sha256) for r in f(df, width=width).collect()}
    want = dict(enumerate(brute(texts, width, unit)))
    assert got == want
    assert sum(x[1] for x in got.values()) > 500


def test_empty_and_null(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup(df).collect() == []
    df = spark.createDataFrame([(None, "a b"), (None, None), (1, None)], "doc_id long, text string")
    assert sorted((r.n_bytes, r.n_removed) for r in suffix_array_dedup(df).collect()) == [(0, 0), (0, 0), (3, 0)]


@pytest.mark.parametrize(("unit", "width", "f"), [("words", 35, substring_dedup), ("bytes", 400, suffix_array_dedup)])
def test_rows_equal_in_id_and_text_and_very_long_ones(spark, unit, width, f):
    rng = random.Random(8)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(30_000))
    part = " ".join(long.split(" ")[1000:1100])
    texts = [long, f"before {part} after", part * 1, "ab " * 40_000, "short"]
    rows = [(1, texts[0]), (2, texts[1]), (3, texts[2]), (3, texts[2]), (4, texts[3]), (5, texts[4]), (5, texts[4])]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, k1 int, spans int")
    n = "n_words" if unit == "words" else "n_bytes"
    got = sorted((r.doc_id, r[n], r.n_removed) for r in f(df, width=width).collect())
    size = lambda t: len(t.split()) if unit == "words" else len(t)
    assert [(i, k) for i, k, _ in got] == sorted((i, size(t)) for i, t in rows)
    removed = [r for _, _, r in got]
    covered = size(part)
    assert removed[0] == pytest.approx(covered, abs=3 if unit == "bytes" else 0) and removed[1] >= covered
    assert removed[2] == removed[3] == covered and removed[4] == size(texts[3]) and removed[5:] == [0, 0]


def test_passages_of_over_50_words_go_from_400_bytes_on(spark, tmp_path):
    """What the contract of op 10 says of planted passages: bytes count, not words; op 4 counts words."""
    from spanveil.llm.queries import op4_substring_dedup, op10_suffix_array_dedup

    rng = random.Random(21)

    def passage(size, letters="abcdefgh"):
        words = " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(60)).encode()
        return words.decode() + "x" * (size - len(words))

    sizes = {394: passage(394), 399: passage(399), 400: passage(400), 450: passage(450)}
    accents = " ".join(["é" + passage(360)[:4] for _ in range(55)])
    accents += "x" * (400 - len(accents.encode()))  # 400 bytes, fewer characters
    assert len(accents) < 400 == len(accents.encode())
    hosts = [(n, p) for n, p in [*sizes.items(), (400, accents)] for _ in range(3)]
    # no two hosts have the same byte beside a passage, so none repeats further
    texts = [f"{passage(300)} {chr(48 + i)}{p}{chr(65 + i)} {passage(300)}" for i, (_, p) in enumerate(hosts)]
    assert min(len(p.split()) for _, p in hosts) > 50
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in op10_suffix_array_dedup(spark, str(tmp_path)).collect()}
    assert got == {i: (len(t.encode()), n if n >= 400 else 0, int(n >= 400)) for i, (t, (n, _)) in enumerate(zip(texts, hosts, strict=True))}
    assert min(r.n_removed for r in op4_substring_dedup(spark, str(tmp_path)).collect()) > 50
