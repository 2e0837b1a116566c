"""Vector codes: bounds against comparing everything, and the whole result against a plain Lloyd loop."""

import hashlib
import random

import numpy as np
import pytest

from spanveil.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int"
NAMES = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def brute(rows, parts=16, entries=64, rounds=2):
    kept = [r for r in rows if r[1] is not None and all(v is not None and np.isfinite(v) for v in r[1])]
    ints = [[int(np.floor(256 * float(np.float32(v)))) for v in r[1]] for r in kept]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, ints[i]))[:entries]
    width = len(ints[order[0]])
    books, code, error = [], [""] * len(kept), [0] * len(kept)
    for p in range(parts):
        a, b = p * width // parts, (p + 1) * width // parts
        book = [list(ints[i][a:b]) for i in order]
        for k in range(rounds + 1):
            at = [min(range(len(book)), key=lambda e: (sum((u - v) ** 2 for u, v in zip(x[a:b], book[e])), e)) for x in ints]
            for e in range(len(book)) if k < rounds else ():
                mine = [x[a:b] for x, m in zip(ints, at) if m == e]
                if mine:
                    book[e] = [sum(c) // len(mine) for c in zip(*mine)]
        for i, m in enumerate(at):
            code[i] += f"{m:02x}"
            error[i] += sum((u - v) ** 2 for u, v in zip(ints[i][a:b], book[m]))
        books += [v for e in book for v in e]
    sha = hashlib.sha256(",".join(map(str, books)).encode()).hexdigest()
    return sorted(((r[0], c, e, sum(f for q, f in zip(kept, error) if q[2] == r[2]), sha) for r, c, e in zip(kept, code, error)), key=repr)


def result(spark, rows, **kw):
    return sorted((tuple(r[c] for c in NAMES) for r in V.compress(spark.createDataFrame(rows, SCHEMA), **kw).collect()), key=repr)


def test_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert result(spark, rows[:200]) == brute(rows[:200])


@pytest.mark.parametrize("scale", [0.01, 1.0, 2000.0])
def test_ties_repeats_and_faulty_rows(spark, scale):
    r = random.Random(int(scale * 100))
    rows = [(r.choice([k, k, k // 2, None]), [r.choice([-1, 0, 0.5, 1]) * scale for _ in range(32)], r.choice([None, 1, 2])) for k in range(150)]
    rows += [rows[70]] * 60 + [(900, None, 1), (901, [None] * 32, 1), (902, [float("nan")] * 32, 1), (903, [float("inf")] + [0.0] * 31, 1), (904, [float("-inf")] * 32, None)]
    assert result(spark, rows) == brute(rows)
    assert result(spark, rows, parts=5, entries=3, rounds=4) == brute(rows, 5, 3, 4)


def test_few_rows_and_other_widths(spark):
    assert V.compress(spark.createDataFrame([], SCHEMA)).count() == 0
    assert V.compress(spark.createDataFrame([(1, None, 1)], SCHEMA)).count() == 0
    assert result(spark, [(5, [0.25] * 16, None)]) == brute([(5, [0.25] * 16, None)])
    got = result(spark, [(1, [0.5] * 20, 1), (2, [0.5] * 3, 1), (3, [1.5] * 20, 1)])
    assert got == brute([(1, [0.5] * 20, 1), (3, [1.5] * 20, 1)])
    named = spark.createDataFrame([(1, [0.5] * 16, 1, "c", 2.0)], f"{SCHEMA}, code string, x double")
    assert V.compress(named).columns == NAMES


def test_bounds_hold_and_save_scans():
    r = np.random.default_rng(6)
    for trial in range(30):
        x = r.integers(-20, 20, (300, 3)) * (1 if trial % 2 else 1000)
        old = x[:8].copy()
        code, upper, lower = V.scan(x, old)
        for _ in range(4):
            book = old + r.integers(-1, 2, old.shape)
            code, upper, lower, n = V.reassign(x, code, upper, lower, old, book)
            d = ((x[:, None] - book[None]) ** 2).sum(2)
            assert (code == d.argmin(1)).all()
            own = d[np.arange(len(x)), code]
            d[np.arange(len(x)), code] = np.iinfo(np.int64).max
            assert (upper.astype(float) ** 2 >= own).all() and (np.maximum(lower.astype(float), 0) ** 2 <= d.min(1)).all()
            assert trial % 2 or n < 150
            old = book
