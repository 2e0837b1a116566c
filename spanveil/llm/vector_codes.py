"""Vector code compression: vectors of integers are cut into parts and each part becomes the index of its nearest codebook entry.

Codebooks are learned by Lloyd rounds in which a part keeps, from round to round, an upper bound of its distance to its own entry
and a lower bound of its distance to the second nearest (Hamerly). Moved entries loosen both bounds; only where they no longer
prove strictly that the own entry is the nearest are all entries compared again, in integers. Bounds are rounded outwards, and a
tie never passes a strict test, so the result is that of comparing everything every time.

The state of the rows (integers, codes, bounds) is a table in the shared folder, written once a round. Only sums per entry
reach the driver: parts x entries rows, whatever the table holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.session import discard, materialise

#: Rows whose distances to all entries are held at once.
CHUNK = 4096
#: Rows of a hot label are joined to its sum in as many groups.
SALTS = 16
#: Integers beyond this would let a sum of squares leave 64 bits.
MOST = 1 << 28

Books = list[np.ndarray]


def cuts(width: int, parts: int) -> list[tuple[int, int]]:
    return [(i * width // parts, (i + 1) * width // parts) for i in range(parts)]


def _distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), len(book)), np.int64)
    for j in range(x.shape[1]):
        d = x[:, j, None] - book[None, :, j]
        out += d * d
    return out


def _roots(squares: np.ndarray, up: bool) -> np.ndarray:
    """Square roots in 32 bits, rounded away from the true value in one direction."""
    r = np.sqrt(squares.astype(np.float64)).astype(np.float32)
    return np.nextafter(np.nextafter(r, np.float32(np.inf if up else -np.inf)), np.float32(np.inf if up else -np.inf))


def scan(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest entry, the lowest of equals; upper bound; lower bound of the second nearest) by comparing all entries."""
    code, upper, lower = np.zeros(len(x), np.int16), np.zeros(len(x), np.float32), np.full(len(x), np.inf, np.float32)
    for a in range(0, len(x), CHUNK):
        d = _distances(x[a : a + CHUNK], book)
        at = d.argmin(1)
        code[a : a + CHUNK], row = at, np.arange(len(d))
        upper[a : a + CHUNK] = _roots(d[row, at], True)
        if len(book) > 1:
            d[row, at] = np.iinfo(np.int64).max
            lower[a : a + CHUNK] = np.maximum(_roots(d.min(1), False), 0)
    return code, upper, lower


def reassign(x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, old: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The assignment after the entries moved from ``old`` to ``book``, its bounds, and how many rows had to be scanned."""
    moved = _roots(((book - old) ** 2).sum(1), True)
    # the lower bound gives way by the largest move of any other entry
    order = np.argsort(moved, kind="stable")
    most = np.full(len(book), moved[order[-1]], np.float32)
    most[order[-1]] = moved[order[-2]] if len(book) > 1 else 0
    infinity = np.float32(np.inf)
    upper = np.nextafter(upper + moved[code], infinity)
    lower = np.nextafter(lower - most[code], -infinity)
    unsure = np.flatnonzero(~(upper < lower))
    if len(unsure):  # the true distance to the own entry may settle it
        own = x[unsure] - book[code[unsure]]
        upper[unsure] = _roots((own * own).sum(1), True)
        unsure = unsure[~(upper[unsure] < lower[unsure])]
    code = code.copy()
    if len(unsure):
        code[unsure], upper[unsure], lower[unsure] = scan(x[unsure], book)
    return code, upper, lower, len(unsure)


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 0))


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).reshape(-1), kind))


def _assign(held, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their codes and bounds under the new codebooks, from those under the old ones if there are any."""
    old, books = held.value
    parts = cuts(sum(b.shape[1] for b in books), len(books))
    for batch in it:
        if not batch.num_rows:
            continue
        x = _column(batch, "x").astype(np.int64)
        before = [_column(batch, c) for c in ("code", "upper", "lower")] if old else None
        code, upper, lower = np.zeros((len(x), len(parts)), np.int16), np.zeros((len(x), len(parts)), np.float32), np.zeros((len(x), len(parts)), np.float32)
        scans = np.full(len(x), len(parts), np.int64) if not old else np.zeros(len(x), np.int64)
        for p, (a, b) in enumerate(parts):
            if old:
                c, u, v = (m[:, p] for m in before)
                code[:, p], upper[:, p], lower[:, p], n = reassign(x[:, a:b], c, u, v, old[p], books[p])
                scans[0] += n
            else:
                code[:, p], upper[:, p], lower[:, p] = scan(x[:, a:b], books[p])
        out = {"code": _lists(code, pa.int16()), "upper": _lists(upper, pa.float32()), "lower": _lists(lower, pa.float32()), "scans": pa.array(scans)}
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("x"), *out.values()], names=["row", "x", *out])


def _sums(held, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: rows and component sums of each entry of each part."""
    books = held.value
    parts = cuts(sum(b.shape[1] for b in books), len(books))
    n, total = [np.zeros(len(b), np.int64) for b in books], [np.zeros(b.shape, np.int64) for b in books]
    for batch in it:
        if batch.num_rows:
            x, code = _column(batch, "x").astype(np.int64), _column(batch, "code")
            for p, (a, b) in enumerate(parts):
                n[p] += np.bincount(code[:, p], minlength=len(n[p]))
                np.add.at(total[p], code[:, p], x[:, a:b])
    rows = [(p, e, k, int(total[p][e, k]), int(n[p][e])) for p in range(len(parts)) for e in np.flatnonzero(n[p]).tolist() for k in range(total[p].shape[1])]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(5)], names=["part", "entry", "k", "total", "n"])


def _errors(held, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    books = held.value
    parts = cuts(sum(b.shape[1] for b in books), len(books))
    for batch in it:
        if batch.num_rows:
            x, code = _column(batch, "x").astype(np.int64), _column(batch, "code")
            error = sum(((x[:, a:b] - books[p][code[:, p]]) ** 2).sum(1) for p, (a, b) in enumerate(parts))
            text = [bytes(c).hex() for c in code.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(text), pa.array(error, pa.int64())], names=["row", "code", "error"])


def integers(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """row (id, label) and x (array of long) of the rows whose vector is there and finite throughout."""
    whole = F.col(vector_col).isNotNull() & ~F.exists(vector_col, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    x = F.transform(vector_col, lambda v: F.floor(v.cast("double") * 256).cast("long"))
    return rows.filter(whole).select(F.struct(F.col(id_col).alias("id"), F.col(label_col).alias("label")).alias("row"), x.alias("x"))


def moved_books(state: DataFrame, books: Books) -> Books:
    """Each entry replaced by the floored mean of its parts; entries without any stay."""
    spark = state.sparkSession
    held = spark.sparkContext.broadcast(books)
    sums = state.select("x", "code").mapInArrow(partial(_sums, held), "part long, entry long, k long, total long, n long")
    out = [b.copy() for b in books]
    for r in sums.groupBy("part", "entry", "k").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        out[r["part"]][r["entry"], r["k"]] = r["total"] // r["n"]
    return out


def digest(books: Books) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for e in b.tolist() for v in e).encode()).hexdigest()


def learn(rows: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> tuple[DataFrame, Books]:
    """The rows of ``integers`` with codes and bounds under the final codebooks (a table in the shared folder, to be discarded),
    and those codebooks.

    Codebooks start as the parts of the ``entries`` smallest ids, equal ids in order of their vectors, null ids last.
    """
    spark = rows.sparkSession
    first = [r["x"] for r in rows.orderBy(F.col("row.id").asc_nulls_last(), "x").limit(entries).select("x").collect()]
    if not first:
        return rows.selectExpr("row", "x", "array() AS code"), []
    width = len(first[0])
    # rows of another width than the first can't be cut alike; those too large for exact sums end the job
    same = rows.filter(F.size("x") == width).withColumn("x", F.when(F.exists("x", lambda v: F.abs(v) > MOST), F.raise_error(F.lit("a component is beyond 2^20"))).otherwise(F.col("x")))
    start = np.array([f for f in first if len(f) == width], np.int64).reshape(-1, width)
    books = [start[:, a:b].copy() for a, b in cuts(width, parts)]
    kind = f"row {rows.schema['row'].dataType.simpleString()}, x array<bigint>, code array<smallint>, upper array<float>, lower array<float>, scans bigint"
    state, old = same, None
    for k in range(rounds + 1):
        held = spark.sparkContext.broadcast((old, books))
        now = materialise(state.mapInArrow(partial(_assign, held), kind), "codes")
        if old:
            discard(state)
        state = now
        if k < rounds:
            old, books = books, moved_books(state, books)
    return state, books


def compress(rows: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, code, error, label_error and codebooks_sha256 of every row with a whole vector.

    A component x counts as floor(256 x). A code has two hex digits for each part, so at most 256 entries. Rows whose vector is
    null, or holds a null, NaN or infinite component, are left out; so are vectors of another length than that of the smallest
    id. A length that the parts don't divide is cut as evenly as can be. Equal rows all stay and share a code; labels that are
    null count as one. With fewer rows than entries there are fewer entries. An empty table gives an empty table. Components
    beyond 2^20 in size end the job with an error, as sums of their squares would not be exact.
    """
    if entries > 256:
        raise ValueError("a code has two hex digits: at most 256 entries")
    kept = integers(rows, id_col, vector_col, label_col)
    state, books = learn(kept, parts, entries, rounds)
    spark = rows.sparkSession
    kind = f"row {kept.schema['row'].dataType.simpleString()}, code string, error bigint"
    if not books:
        found = spark.createDataFrame([], kind)
    else:
        held = spark.sparkContext.broadcast(books)
        found = materialise(state.select("row", "x", "code").mapInArrow(partial(_errors, held), kind), "codes")
        discard(state)
    # the rows of a label are dealt to SALTS groups by their id, and so is the label's sum
    sums = found.groupBy(F.col("row.label").alias("label")).agg(F.sum("error").alias("label_error"))
    sums = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = found.withColumn("salt", F.pmod(F.hash("row.id", "code"), F.lit(SALTS)))
    out = dealt.join(sums, dealt["row.label"].eqNullSafe(sums["label"]) & (dealt["salt"] == sums["salt"]))
    return out.select(F.col("row.id").alias(id_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
