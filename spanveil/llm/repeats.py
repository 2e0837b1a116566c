"""Exact removal of long repeated strings, shared by the word (op 4) and the byte (op 10) operator.

A string of ``width`` units (words or bytes) that starts at two places holds the same *anchor* at both: the k-gram with
the smallest hash among its k-grams. So the windows of a document fall into runs with one anchor each, and only runs
whose anchor occurs elsewhere can hold a repeated window. The plan:

1. every run becomes a row (anchor hash, hash of the run's whole content, place); rows are counted by anchor with
   map-side combining, and the rows of anchors that occur once go. Nothing else ever leaves the scan.
2. Anchors whose runs all have the same content need no closer look: every window repeats.
3. For the rest, one copy of each distinct run content is cut out of its document and dealt by anchor; there the
   operator's own index (suffix automaton or Burrows-Wheeler transform) finds the repeated windows. A task works on
   its anchors in batches of bounded bytes. An anchor with more than ``HOT`` distinct contents is not dealt by anchor:
   those of its contents that share a core with another are dealt by window content, so no task gathers it.
4. Spans are gathered per document and cut out of the text in one join.

Text crosses the network twice: once to cut contents out of it, once to cut the spans.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.llm import batches as B
from spanveil.session import materialise

#: Distinct contents of one anchor up to which they are indexed together.
HOT = 2_000
#: Bytes of run contents that are indexed at once.
INDEX_BYTES = 1_000_000

_RUNS = "ah long, ch long, k1 long, k2 long, start int, wins int, lead int"
_CUT = "ah long, ch long, once boolean, k1 long, k2 long, start int, wins int, lead int, content binary"
_SPANS = "k1 long, k2 long, s int, e int"


class Units:
    """A block of documents as units: their values to hash, each document's first unit, and their byte ranges."""

    def __init__(self, kind: str, buf: np.ndarray, offs: np.ndarray) -> None:
        self.kind, self.buf = kind, buf
        if kind == "bytes":
            self.offs, self.roll = offs, B.Rolling.of_bytes(buf)
            self.starts = self.ends = None
        else:
            raw = B.Rolling.of_bytes(buf)
            self.starts, self.ends, self.offs = B.words(buf, offs)
            self.values = raw.of(self.starts, self.ends)
            self.roll = B.Rolling(self.values)

    def cut(self, doc: int, first: int, last: int) -> bytes:
        a, b = self.offs[doc] + first, self.offs[doc] + last
        if self.kind == "bytes":
            return self.buf[a:b].tobytes()
        return self.buf[self.starts[a] : self.ends[b - 1]].tobytes()


def runs_of(units: Units, width: int, k: int) -> tuple[np.ndarray, ...]:
    """(document, first window, windows, anchor's place in the first window, anchor hash, content hash) of each run."""
    none = tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),) * 2
    n = int(units.offs[-1])
    if n < width:
        return none
    bits = max(22, n.bit_length())
    low = np.uint64((1 << bits) - 1)
    order = (units.roll.of_all(k) & ~low) | np.arange(n - k + 1, dtype=np.uint64)
    anchor = (B.sliding_min(order, width - k + 1) & low).astype(np.int64)
    sizes = np.diff(units.offs)
    doc = np.flatnonzero(sizes >= width)
    if not len(doc):
        return none
    at = B.expand(units.offs[doc], sizes[doc] - width + 1)
    of = np.repeat(doc, sizes[doc] - width + 1)
    mine = anchor[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (mine[1:] != mine[:-1]) | (of[1:] != of[:-1])
    head = np.flatnonzero(new)
    wins = np.diff(np.append(head, len(at)))
    first, a = at[head], mine[head]
    lead = a - first
    content = B.mix(units.roll.of(first, first + wins - 1 + width) ^ (lead.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    return of[head], first - units.offs[of[head]], wins, lead, units.roll.of(a, a + k), content


def _runs(kind: str, width: int, k: int, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, buf, offs in B.blocks(it, "text"):
        doc, first, wins, lead, ah, ch = runs_of(Units(kind, buf, offs), width, k)
        k1, k2 = (part.column(c).to_numpy(zero_copy_only=False)[doc] for c in ("k1", "k2"))
        yield pa.RecordBatch.from_arrays(
            [pa.array(B.signed(ah)), pa.array(B.signed(ch)), pa.array(k1), pa.array(k2), *(pa.array(x.astype(np.int32)) for x in (first, wins, lead))],
            names=["ah", "ch", "k1", "k2", "start", "wins", "lead"],
        )


def _cut(kind: str, width: int, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["ah", "ch", "once", "k1", "k2", "start", "wins", "lead"]
    for part, buf, offs in B.blocks(it, "text"):
        units = Units(kind, buf, offs)
        asked = part.column("asked")
        counts = np.diff(asked.offsets.to_numpy())
        of = np.repeat(np.arange(part.num_rows), counts)
        rows = asked.flatten()
        cols = {c: rows.field(c).to_numpy(zero_copy_only=False) for c in ("ah", "ch", "once", "start", "wins", "lead")}
        cols |= {c: part.column(c).to_numpy(zero_copy_only=False)[of] for c in ("k1", "k2")}
        step = 4000
        for i in range(0, len(of), step):
            some = slice(i, i + step)
            content = [units.cut(d, s, s + w - 1 + width) for d, s, w in zip(of[some].tolist(), cols["start"][some].tolist(), cols["wins"][some].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(cols[c][some]) for c in names] + [pa.array(content, pa.binary())], names=[*names, "content"])


def _cores(units: Units, ah: np.ndarray, wins: np.ndarray, lead: np.ndarray, width: int, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(contents, hashes) of the four cores of each content.

    The windows of a content, by their offset to the anchor (below ``reach``), fall into four classes; all windows of a class
    hold the same core. If no core occurs twice at the same place beside the anchor, no window does.
    """
    step = -(-reach // 4)
    for q in range(4):
        # offsets of the anchor in the windows of this class: [low, high]; a content has them from lead down to lead - wins + 1
        low, high = q * step, (q + 1) * step - 1
        rows = np.flatnonzero((lead >= low) & (lead - wins + 1 <= high))
        # a window whose anchor is at offset o starts at lead - o: common to all offsets of the class is this range
        first = units.offs[rows] + lead[rows] - low
        yield rows, B.mix(units.roll.of(first, first + width + low - high) ^ B.mix(ah[rows].astype(np.int64).view(np.uint64)))


def _candidates(units: Units, ah: np.ndarray, wins: np.ndarray, lead: np.ndarray, width: int, reach: int) -> np.ndarray:
    """Which contents have a core in common with another of their anchor."""
    keep = np.zeros(len(ah), dtype=bool)
    for rows, key in _cores(units, ah, wins, lead, width, reach):
        if len(rows):
            _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
            keep[rows[counts[inverse] > 1]] = True
    return keep


def _core_rows(kind: str, width: int, reach: int, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, buf, offs in B.blocks(it, "content"):
        ah, ch, wins, lead = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("ah", "ch", "wins", "lead"))
        for rows, key in _cores(Units(kind, buf, offs), ah, wins, lead, width, reach):
            yield pa.RecordBatch.from_arrays([pa.array(B.signed(key)), pa.array(ah[rows]), pa.array(ch[rows])], names=["core", "ah", "ch"])


Engine = Callable[[Units, int], np.ndarray]


def _index(kind: str, width: int, reach: int, engine: Engine, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contents sorted by anchor → spans of repeated windows in the contents that occur once."""
    held: list[pa.RecordBatch] = []

    def flush() -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        held.clear()
        ah, wins, lead, once = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("ah", "wins", "lead", "once"))
        units = Units(kind, *B.column_bytes(rows.column("content")))
        keep = _candidates(units, ah, wins.astype(np.int64), lead.astype(np.int64), width, reach)
        if not keep.any():
            return
        rows = rows.filter(pa.array(keep))
        wins, start, once = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("wins", "start", "once"))
        buf, offs = B.column_bytes(rows.column("content"))
        first = 0
        while first < len(offs) - 1:  # whole anchors, about INDEX_BYTES at a time
            last = min(len(offs) - 1, max(first + 1, int(np.searchsorted(offs, offs[first] + INDEX_BYTES, side="right"))))
            some = rows.column("ah").to_numpy(zero_copy_only=False)
            while last < len(offs) - 1 and some[last] == some[last - 1]:
                last += 1
            units = Units(kind, buf[offs[first] : offs[last]], offs[first : last + 1] - offs[first])
            twice = engine(units, width)
            mine = np.repeat(once[first:last], wins[first:last]) & twice[B.expand(units.offs[:-1], wins[first:last].astype(np.int64))]
            doc = np.repeat(np.arange(first, last), wins[first:last])
            place = B.expand(start[first:last].astype(np.int64), wins[first:last].astype(np.int64))
            hit = np.flatnonzero(mine)
            if len(hit):
                new = np.ones(len(hit), dtype=bool)
                new[1:] = (np.diff(hit) != 1) | (doc[hit[1:]] != doc[hit[:-1]])
                heads = np.flatnonzero(new)
                tails = np.append(heads[1:], len(hit)) - 1
                k1, k2 = (rows.column(c).to_numpy(zero_copy_only=False)[doc[hit[heads]]] for c in ("k1", "k2"))
                yield pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), pa.array(place[hit[heads]].astype(np.int32)), pa.array((place[hit[tails]] + width).astype(np.int32))], names=["k1", "k2", "s", "e"])
            first = last

    size, tail = 0, None
    for batch in it:
        if not batch.num_rows:
            continue
        ah = batch.column("ah").to_numpy(zero_copy_only=False)
        if held and size > 4 * INDEX_BYTES:
            same = int(np.searchsorted(ah != tail, True)) if ah[0] == tail else 0
            if same:
                held.append(batch.slice(0, same))
                batch, ah = batch.slice(same), ah[same:]
            if len(ah):
                yield from flush()
                size = 0
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
            tail = ah[-1]
    if held:
        yield from flush()


def _windows(kind: str, width: int, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contents of hot anchors → a row (content hash of 128 bits, place) for each window."""
    for part, buf, offs in B.blocks(it, "content"):
        units = Units(kind, buf, offs)
        wins, start = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("wins", "start"))
        of = np.repeat(np.arange(part.num_rows), wins)
        at = B.expand(units.offs[:-1], wins)
        h1 = units.roll.of(at, at + width)
        h2 = B.mix(units.roll.of(at, at + width // 2) ^ (h1 >> np.uint64(7)))
        cols = [B.signed(h1), B.signed(h2), *(part.column(c).to_numpy(zero_copy_only=False)[of] for c in ("k1", "k2", "once"))]
        yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in cols), pa.array(B.expand(start, wins).astype(np.int32))], names=["h1", "h2", "k1", "k2", "once", "s"])


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _finish(kind: str, keep_text: bool, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with their spans → counts, the digest of what is left and, if asked for, that text."""
    for part, buf, offs in B.blocks(it, "text"):
        starts = ends = None
        if kind == "words":
            starts, ends, firsts = B.words(buf, offs)
        else:
            firsts = offs
        n = np.diff(firsts)
        found, removed, count, digest, kept = part.column("spans").to_pylist(), [], [], [], []
        for i, spans in enumerate(found):
            union = _union([(x["s"], x["e"]) for x in spans]) if spans else []
            removed.append(sum(e - s for s, e in union))
            count.append(len(union))
            edges = [0, *(x for se in union for x in se), int(n[i])]
            gaps = [(a, b) for a, b in zip(edges[::2], edges[1::2], strict=True) if a < b]
            base = int(firsts[i])
            if kind == "bytes":
                left = b"".join(buf[base + a : base + b].tobytes() for a, b in gaps)
            else:
                left = b" ".join(buf[starts[j] : ends[j]].tobytes() for a, b in gaps for j in range(base + a, base + b))
            digest.append(sha256(left).hexdigest())
            if keep_text:
                kept.append(left.decode("utf-8", "ignore"))
        cols = [part.column("id"), pa.array(n.astype(np.int64)), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(digest, pa.string())]
        yield pa.RecordBatch.from_arrays(cols + ([pa.array(kept, pa.string())] if keep_text else []), names=["id", "n", "n_removed", "n_spans", "kept_sha256"] + (["kept"] if keep_text else []))


def remove_repeats(docs: DataFrame, kind: str, width: int, k: int, engine: Engine, id_col: str, text_col: str, keep_text: bool) -> DataFrame:
    """(id, n, n_removed, n_spans, kept_sha256[, kept]) for every row; see the operators for the contract."""
    spark = docs.sparkSession
    B.tune(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    base = base.select(F.xxhash64("id", "text").alias("k1"), F.xxhash64("text", "id", F.lit(7)).alias("k2"), "id", "text")

    runs = base.select("k1", "k2", "text").mapInArrow(partial(_runs, kind, width, k), _RUNS)
    anchors = runs.groupBy("ah").agg(F.count("*").alias("c"), F.min("ch").alias("lo"), F.max("ch").alias("hi")).filter("c > 1").select("ah", (F.col("lo") == F.col("hi")).alias("same"))
    # written first, so that both sides of the join are plain exchanges, of which AQE splits a hot anchor's
    again = materialise(runs.join(materialise(anchors, "repeats-anchors"), "ah"), "repeats-runs")

    window = F.col("start") + F.col("wins") - 1 + width
    spans = [again.filter("same").select("k1", "k2", F.col("start").alias("s"), window.alias("e"))]
    mixed = again.filter("not same")
    place = F.struct("k1", "k2", "start", "wins", "lead")
    contents = materialise(mixed.groupBy("ah", "ch").agg(F.count("*").alias("c"), F.min(place).alias("at")), "repeats-contents")
    spans.append(mixed.join(contents.filter("c > 1").select("ah", "ch"), ["ah", "ch"]).select("k1", "k2", F.col("start").alias("s"), window.alias("e")))

    hot = contents.groupBy("ah").agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select("ah", F.lit(True).alias("hot"))
    rows = contents.select("ah", "ch", (F.col("c") == 1).alias("once"), "at.*")
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = base.repartition(parts, "k1", "k2")

    def cut(of: DataFrame) -> DataFrame:
        asked = of.groupBy("k1", "k2").agg(F.collect_list(F.struct("ah", "ch", "once", "start", "wins", "lead")).alias("asked"))
        return dealt.join(asked, ["k1", "k2"], "left").filter("asked is not null").mapInArrow(partial(_cut, kind, width), _CUT)

    every = materialise(cut(rows), "repeats-cut")
    if hot.isEmpty():
        cold = every
    else:
        cold, held = every.join(hot, "ah", "left_anti"), every.join(hot, "ah", "left_semi")
        cores = held.mapInArrow(partial(_core_rows, kind, width, width - k + 1), "core long, ah long, ch long")
        shared = cores.join(cores.groupBy("core").agg(F.count("*").alias("c")).filter("c > 1").select("core"), "core").select("ah", "ch").distinct()
        lone = held.join(shared, ["ah", "ch"], "left_semi").mapInArrow(partial(_windows, kind, width), "h1 long, h2 long, k1 long, k2 long, once boolean, s int")
        # A window that occurs twice: as counts by content, combined before the exchange; its places come back by a join, which AQE can split.
        twice = lone.groupBy("h1", "h2").agg(F.count("*").alias("c")).filter("c > 1").select("h1", "h2")
        spans.append(lone.join(twice, ["h1", "h2"]).filter("once").select("k1", "k2", "s", (F.col("s") + width).alias("e")))
    spans.append(cold.repartition(parts, "ah").sortWithinPartitions("ah").mapInArrow(partial(_index, kind, width, width - k + 1, engine), _SPANS))

    found = spans[0]
    for more in spans[1:]:
        found = found.unionByName(more)
    found = found.groupBy("k1", "k2").agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    schema = "id {0}, n long, n_removed long, n_spans long, kept_sha256 string{1}".format(base.schema["id"].dataType.simpleString(), ", kept string" if keep_text else "")
    return dealt.join(found, ["k1", "k2"], "left").select("id", "text", "spans").mapInArrow(partial(_finish, kind, keep_text), schema)
