"""Op 8: SentencePiece (BPE with byte fallback) encoding by suffix-array matching, and decoding.

Pieces hold no space mark but at their front, so a text falls into segments (space marks and what follows up to the next
ones) that are encoded each by itself. They are told apart by their hashes, on arrays, and a worker encodes each distinct
segment once; decoding every text again tells whether two segments ever had one hash, and such texts are encoded anew. New
segments of a batch are laid end to end and indexed by a suffix array over their first ``longest`` characters. Every piece of
the vocabulary is binary-searched in it at once, which gives its range of occurrences; the occurrences are edges from where a piece starts to where it ends. Sorted by
position they are relaxed: a piece reaches its end if merging would keep it beside the piece that reached its start. Of a
byte-pair vocabulary just one piece reaches each position, so the result is the one that merging by rank gives.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.llm import batches as B

MARK = "▁"
#: Characters of new segments that are indexed at once, and of segments that a worker remembers.
INDEX_CHARS, MEMORY_CHARS = 300_000, 6_000_000
#: Pairs of pieces whose fit a worker remembers.
MEMORY_PAIRS = 500_000
#: Bytes of text that are encoded at once: the search for all pieces is paid once for as much.
GROUP = 8_000_000
_GAP = 0x10FFFF  # between segments; not a character of any text
_STRANGE, _NOT = -1, -2  # what reaches a position in place of a piece: a character without one, nothing yet


@dataclass
class Vocabulary:
    pieces: list[str]
    scores: list[float]
    kinds: list[str]  # normal, byte or other
    rank: dict[str, tuple[float, int]] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Reads a SentencePiece model file on the driver; executors get its pieces, not the file."""
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        n = p.get_piece_size()
        kind = lambda i: "byte" if p.is_byte(i) else "other" if p.is_control(i) or p.is_unknown(i) or p.is_unused(i) else "normal"
        return cls([p.id_to_piece(i) for i in range(n)], [p.get_score(i) for i in range(n)], [kind(i) for i in range(n)])

    def __post_init__(self) -> None:
        normal = [i for i, k in enumerate(self.kinds) if k == "normal"]
        self.rank = {self.pieces[i]: (self.scores[i], i) for i in normal}
        by_score: dict[float, list[str]] = {}
        for i in normal:
            p = self.pieces[i]
            if MARK in p.lstrip(MARK) or (p.startswith(MARK * 2) and p.strip(MARK)):
                raise ValueError(f"a piece with a space mark inside: {p!r}")
            by_score.setdefault(self.scores[i], []).append(p)
        if any(len(x) > 1 and any(p.strip(MARK) for p in x) for x in by_score.values()):
            raise ValueError("pieces other than runs of the space mark have equal scores")

    def merge(self, text: str) -> list[str]:
        """The definition: join the neighbours that make the piece of the highest score, leftmost first, while any do."""
        parts = list(text)
        while len(parts) > 1:
            best = max(((self.rank[a + b][0], -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.rank), default=None)
            if best is None:
                break
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts


@dataclass
class Segments:
    """The segments of a block of texts: bytes with a space before each text, places, hashes, and each text's first one."""

    wide: np.ndarray
    offs: np.ndarray
    starts: np.ndarray
    stops: np.ndarray
    hashes: np.ndarray
    firsts: np.ndarray

    def text(self, i: int) -> str:
        return self.wide[self.starts[i] : self.stops[i]].tobytes().decode().replace(" ", MARK)


class Codec:
    """Encodes and decodes with one vocabulary; keeps the segments it has met, up to a bound."""

    def __init__(self, v: Vocabulary) -> None:
        self.v = v
        # pieces that merging itself never ends in can't be in a result
        self.usable = [i for p, (_, i) in v.rank.items() if v.merge(p) == [p]]
        self.longest = max(len(v.pieces[i]) for i in self.usable)
        self.lengths = np.array([len(v.pieces[i]) for i in self.usable])
        # each piece's characters as big-endian numbers, so that comparing bytes compares characters; and the end of its range
        points = np.zeros((len(self.usable), self.longest), ">u4")
        for row, i in enumerate(self.usable):
            points[row, : self.lengths[row]] = [ord(c) + 1 for c in v.pieces[i]]
        self.from_, self.to = points, np.where(points, points, 0xFFFFFFFF).astype(">u4")
        self.bytes_at = {int(v.pieces[i][3:5], 16): i for i, k in enumerate(v.kinds) if k == "byte"}
        self.unknown = next((i for i, p in enumerate(v.pieces) if v.kinds[i] == "other" and p == "<unk>"), 0)
        inside = set("".join(v.rank))
        self.cuts = np.zeros(256, dtype=bool)  # white space that no piece holds stands by itself
        self.cuts[[ord(c) for c in "\n\t\x0b\x0c" if c not in inside]] = True
        self.fit_keys, self.fit_ok = np.zeros(0, np.int64), np.zeros(0, dtype=bool)
        self.short_runs: dict[int, list[int]] = {}
        self.forget()
        # for decoding: the bytes of each id, laid end to end
        texts = [bytes([int(p[3:5], 16)]) if k == "byte" else p.replace(MARK, " ").encode() if k == "normal" else b"" for p, k in zip(v.pieces, v.kinds, strict=True)]
        self.out_bytes = np.frombuffer(b"".join(texts), np.uint8)
        self.out_sizes = np.array([len(t) for t in texts])
        self.out_starts = np.cumsum(self.out_sizes) - self.out_sizes

    def forget(self) -> None:
        self.known = np.zeros(0, np.uint64)  # hashes of segments in order, and where their ids are
        self.starts = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)
        self.chars = 0

    # encoding

    def _suffix_array(self, text: np.ndarray) -> np.ndarray:
        """Places of the text in the order of the ``longest`` characters from there on, by prefix doubling."""
        n = len(text)
        _, rank = np.unique(text, return_inverse=True)
        rank = rank.astype(np.int64) + 1
        bits = int(n + 1).bit_length()
        low = np.uint64((1 << bits) - 1)
        at = np.arange(n, dtype=np.uint64)
        order, length = np.arange(n), 1
        while length < self.longest:
            second = np.zeros(n, np.int64)
            second[: n - length] = rank[length:] if n > length else 0
            if 3 * bits <= 64:
                key = np.sort((rank.astype(np.uint64) << np.uint64(2 * bits)) | (second.astype(np.uint64) << np.uint64(bits)) | at)
                order, high = (key & low).astype(np.int64), key >> np.uint64(bits)
                new = np.append(True, high[1:] != high[:-1])
            else:
                order = np.lexsort((second, rank))
                new = np.append(True, (rank[order[1:]] != rank[order[:-1]]) | (second[order[1:]] != second[order[:-1]]))
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new)
            length *= 2
        return order

    def _ranges(self, text: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each usable piece the range of ``order`` where it starts: all pieces are searched together."""
        n = len(order)
        padded = np.concatenate((text + 1, np.zeros(self.longest, np.int64))).astype(">u4")
        there = np.empty((n, self.longest), ">u4")
        for i in range(self.longest):
            there[:, i] = padded[order + i]
        wide = f"S{4 * self.longest}"
        suffixes = there.view(wide).ravel()
        return np.searchsorted(suffixes, self.from_.view(wide).ravel(), "left"), np.searchsorted(suffixes, self.to.view(wide).ravel(), "right")

    def _keep(self, a: int, b: int) -> bool:
        """Whether merging the texts of two pieces, joined, gives back just these two."""
        p, q = self.v.pieces[a], self.v.pieces[b]
        return self.v.merge(p + q) == [p, q]

    def _fit(self, keys: np.ndarray) -> np.ndarray:
        """``_keep`` of pairs, each given as first * pieces + second; what a worker has found out it remembers."""
        many = len(self.v.pieces)
        pairs, inverse = np.unique(keys, return_inverse=True)
        at = np.searchsorted(self.fit_keys, pairs)
        new = np.ones(len(pairs), dtype=bool)
        inside = at < len(self.fit_keys)
        new[inside] = self.fit_keys[at[inside]] != pairs[inside]
        ok = np.zeros(len(pairs), dtype=bool)
        ok[~new] = self.fit_ok[at[~new]]
        if new.any():
            ok[new] = [self._keep(k // many, k % many) for k in pairs[new].tolist()]
            if len(self.fit_keys) > MEMORY_PAIRS:
                self.fit_keys, self.fit_ok = pairs[new], ok[new]
            else:
                self.fit_keys, self.fit_ok = np.insert(self.fit_keys, at[new], pairs[new]), np.insert(self.fit_ok, at[new], ok[new])
        return ok[inverse]

    def _relax(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all segments, how many each has): edges are relaxed by where they end, in all segments at once."""
        text = np.frombuffer("".join(s + chr(_GAP) for s in segments).encode("utf-32-le"), np.uint32).astype(np.int64)
        order = self._suffix_array(text)
        lo, hi = self._ranges(text, order)
        counts = hi - lo
        start = order[B.expand(lo, counts)]
        end = start + np.repeat(self.lengths, counts)
        piece = np.repeat(np.array(self.usable, np.int64), counts)
        # characters outside the vocabulary: an edge that no merge crosses
        single = np.zeros(len(text), dtype=bool)
        single[start[end == start + 1]] = True
        strange = np.flatnonzero(~single & (text != _GAP))
        start, end, piece = np.append(start, strange), np.append(end, strange + 1), np.append(piece, np.full(len(strange), _STRANGE))
        bounds = np.flatnonzero(text == _GAP)
        firsts = np.append(0, bounds[:-1] + 1)
        begins = np.zeros(len(text) + 1, dtype=bool)
        begins[firsts] = True
        many = len(self.v.pieces)
        reached = np.full(len(text) + 1, _NOT, np.int64)
        origin = np.zeros(len(text) + 1, np.int64)
        place = end - np.repeat(firsts, bounds - firsts + 1)[start]  # how far into its segment an edge ends
        by = np.lexsort((start, place))
        rounds = np.flatnonzero(np.diff(place[by], prepend=-1))
        if len(rounds) * 30 > len(by):  # a few very long segments: nothing to do side by side
            self._one_by_one(*(x[by] for x in (start, end, piece)), begins, reached, origin)
            rounds = rounds[:0]
        for a, b in zip(rounds.tolist(), np.append(rounds[1:], len(by)).tolist(), strict=False):
            some = by[a:b]
            s, p = start[some], piece[some]
            before = reached[s]
            ok = begins[s] | (before != _NOT)
            asked = np.flatnonzero(ok & ~begins[s] & (before >= 0) & (p >= 0))
            ok[asked] = self._fit(before[asked] * many + p[asked])
            here = some[ok][::-1]  # of several, the longest
            reached[end[here]], origin[end[here]] = piece[here], start[here]
        # back from the ends, all segments at once
        left, at, found = np.arange(len(segments)), bounds.copy(), []
        while len(left):
            p = reached[at]
            if (p == _NOT).any():
                raise AssertionError("no way through a segment")
            found.append((left, p, at))
            at = origin[at]
            more = at > firsts[left]
            left, at = left[more], at[more]
        of, ids, at = (np.concatenate([x[i] for x in found]) for i in range(3)) if found else (np.zeros(0, np.int64),) * 3
        by = np.lexsort((at, of))
        of, ids, at = of[by], ids[by], at[by]
        if (ids == _STRANGE).any():
            raw = [[self.bytes_at[x] for x in chr(text[i - 1]).encode()] if self.bytes_at else [self.unknown] for i in at[ids == _STRANGE].tolist()]
            times = np.ones(len(ids), np.int64)
            times[ids == _STRANGE] = [len(x) for x in raw]
            of, ids = np.repeat(of, times), np.repeat(ids, times)
            ids[ids == _STRANGE] = [x for r in raw for x in r]
        return ids.astype(np.int32), np.bincount(of, minlength=len(segments))

    def _one_by_one(self, start: np.ndarray, end: np.ndarray, piece: np.ndarray, begins: np.ndarray, reached: np.ndarray, origin: np.ndarray) -> None:
        fits: dict[tuple[int, int], bool] = {}
        for i in range(0, len(start), 100_000):
            for s, e, p in zip(*(x[i : i + 100_000].tolist() for x in (start, end, piece)), strict=True):
                before = reached[s]
                if reached[e] != _NOT or (before == _NOT and not begins[s]):
                    continue
                if before >= 0 and p >= 0 and not begins[s]:
                    key = int(before), p
                    if key not in fits:
                        fits[key] = self._keep(*key)
                    if not fits[key]:
                        continue
                reached[e], origin[e] = p, s

    def _run(self, n: int) -> list[int]:
        """Ids of n space marks; all their merges have one score and so go from the left."""
        longest = max(len(p) for p in self.v.rank if not p.strip(MARK))
        full, rest = (max(0, n // longest - 2), n - longest * max(0, n // longest - 2)) if n else (0, 0)
        if rest not in self.short_runs:
            self.short_runs[rest] = [self.v.rank[p][1] for p in self.v.merge(MARK * rest)]
        return [self.v.rank[MARK * longest][1]] * full + self.short_runs[rest]

    def ids_of(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all segments, how many each has)."""
        parts, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        # of several leading marks all but the last are a run of their own, unless that one stays alone too
        tails = [MARK + s.lstrip(MARK) if s.startswith(MARK * 2) else s for s in segments]
        at = 0
        while at < len(tails):
            size, first = 0, at
            while at < len(tails) and (size == 0 or size + len(tails[at]) < INDEX_CHARS):
                size += len(tails[at]) + 1
                at += 1
            ids, n = self._relax(tails[first:at])
            parts.append(ids)
            sizes.append(n)
        ids, n = np.concatenate(parts), np.concatenate(sizes)
        runs = [i for i, s in enumerate(segments) if s.startswith(MARK * 2)]
        if not runs:
            return ids, n
        alone = self.v.rank.get(MARK, (0, -1))[1]
        each = np.split(ids, np.cumsum(n)[:-1])
        for i in runs:
            marks = len(segments[i]) - len(segments[i].lstrip(MARK))
            whole = int(each[i][0] == alone)
            each[i] = np.append(np.array(self._run(marks if whole else marks - 1), np.int32), each[i][whole:])
        return np.concatenate(each), np.array([len(x) for x in each])

    def learn(self, hashes: np.ndarray, segments: list[str]) -> None:
        """Remembers the ids of new segments, given with their hashes."""
        ids, sizes = self.ids_of(segments)
        starts = len(self.flat) + np.cumsum(sizes) - sizes
        self.flat = np.concatenate((self.flat, ids))
        self.chars += sum(map(len, segments))
        known = np.concatenate((self.known, hashes))
        order = np.argsort(known, kind="stable")
        self.known = known[order]
        self.starts, self.sizes = np.concatenate((self.starts, starts))[order], np.concatenate((self.sizes, sizes))[order]

    def segments(self, buf: np.ndarray, offs: np.ndarray) -> Segments:
        """Those of a block of texts, the space mark in them already a space; a space goes before each that isn't empty."""
        sizes = np.diff(offs)
        shift = np.cumsum(sizes > 0)
        ends = offs[1:] + shift
        wide = np.full(int(ends[-1]) if len(ends) else 0, 0x20, np.uint8)
        wide[np.arange(len(buf)) + np.repeat(shift, sizes)] = buf
        space, cut = wide == 0x20, self.cuts[wide]
        head = cut | space
        head[1:] &= cut[1:] | ~space[:-1]
        head[1:] |= cut[:-1]
        offs = np.append(0, ends)
        head[offs[:-1][sizes > 0]] = True
        starts = np.flatnonzero(head)
        stops = np.append(starts[1:], len(wide))
        return Segments(wide, offs, starts, stops, B.Rolling.of_bytes(wide).of(starts, stops), np.searchsorted(starts, offs))

    def missing(self, blocks: list[Segments]) -> tuple[np.ndarray, list[str]]:
        """The hashes and texts of segments not yet known."""
        found: dict[int, str] = {}
        for x in blocks:
            hashes, first = np.unique(x.hashes, return_index=True)
            at = np.minimum(np.searchsorted(self.known, hashes), max(0, len(self.known) - 1))
            new = self.known[at] != hashes if len(self.known) else np.ones(len(hashes), dtype=bool)
            for h, i in zip(hashes[new].tolist(), first[new].tolist(), strict=True):
                if h not in found:
                    found[h] = x.text(i)
        return np.array(list(found), np.uint64), list(found.values())

    def encode(self, x: Segments) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, the n + 1 offsets of each text's, whether decoding gives each back); all segments are known."""
        which = np.searchsorted(self.known, x.hashes)
        sizes = self.sizes[which]
        ids = self.flat[B.expand(self.starts[which], sizes)]
        offs = np.append(0, np.cumsum(sizes))[x.firsts]
        raw = self._bytes(ids)
        if len(raw) == len(x.wide) and (raw == x.wide).all():
            return ids, offs, np.ones(len(offs) - 1, dtype=bool)
        parts, same = [], []
        for i in range(len(offs) - 1):
            mine, want = ids[offs[i] : offs[i + 1]], x.wide[x.offs[i] : x.offs[i + 1]]
            ok = np.array_equal(self._bytes(mine), want)
            if not ok:  # two segments with one hash, or a vocabulary that can't give every text back
                mine = self.ids_of([x.text(k) for k in range(x.firsts[i], x.firsts[i + 1])])[0]
                ok = np.array_equal(self._bytes(mine), want)
            parts.append(mine)
            same.append(ok)
        return np.concatenate(parts), np.append(0, np.cumsum([len(p) for p in parts])), np.array(same)

    def _bytes(self, ids: np.ndarray) -> np.ndarray:
        return self.out_bytes[B.expand(self.out_starts[ids], self.out_sizes[ids])]

    def decode(self, ids: np.ndarray, offs: np.ndarray) -> list[str]:
        """The texts of runs of ids, without the space put before each."""
        sizes = self.out_sizes[ids]
        raw = self.out_bytes[B.expand(self.out_starts[ids], sizes)].tobytes()
        ends = np.append(0, np.cumsum(sizes))[offs].tolist()
        out = []
        for a, b in zip(ends, ends[1:], strict=False):
            text = raw[a:b].decode("utf-8", "replace")
            out.append(text[1:] if text.startswith(" ") else text)
        return out


_CODECS: list = []


def _codec(held) -> Codec:
    v = held.value
    if not _CODECS or _CODECS[0] is not v:
        _CODECS[:] = [v, Codec(v)]
    return _CODECS[1]


def _groups(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of about GROUP bytes of text (a longer document is one by itself)."""
    held: list[pa.RecordBatch] = []
    size = 0
    for part, buf, _ in B.blocks(it, "text"):
        held.append(part)
        size += len(buf)
        if size >= GROUP:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _encode(held, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codec = _codec(held)
    for group in _groups(it):
        parts, blocks = [], []
        for part, buf, offs in B.blocks(iter([group]), "text"):
            if MARK.encode() in buf.tobytes():
                buf, offs = B.column_bytes(pc.replace_substring(part.column("text"), MARK, " "))
            parts.append(part)
            blocks.append(codec.segments(buf, offs))
        if codec.chars > MEMORY_CHARS:
            codec.forget()
        hashes, texts = codec.missing(blocks)
        if len(hashes):
            codec.learn(hashes, texts)
        for part, x in zip(parts, blocks, strict=True):
            ids, offs, same = codec.encode(x)
            lists = pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([part.column("id"), lists, pa.array(np.diff(offs)), pa.array(same, pa.bool_())], names=["id", "ids", "n_ids", "round_trip"])


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (array of int), n_ids and round_trip (decoding gives the text back) of every row.

    Null and empty texts have no ids. Whole texts are encoded; characters without a piece become their bytes. A text with
    the space mark itself decodes to one with a space there, as the format can't tell them apart. Repeated rows have equal
    results, null ids are carried along, other columns are not read, and an empty table gives an empty table.
    """
    B.tune(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model_path))
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = base.schema["id"].dataType.simpleString()
    return base.mapInArrow(partial(_encode, held), f"id {kind}, ids array<int>, n_ids long, round_trip boolean").withColumnRenamed("id", id_col)


def _decode(held, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codec = _codec(held)
    for part in it:
        col = part.column("ids")
        offs = col.offsets.to_numpy().astype(np.int64)
        texts = codec.decode(col.values.to_numpy(zero_copy_only=False)[offs[0] : offs[-1]].astype(np.int64), offs - offs[0])
        yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(texts, pa.string())], names=["id", "text"])


def decode(rows: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and text of every row of ids; a null list is an empty text."""
    B.tune(rows.sparkSession)
    held = rows.sparkSession.sparkContext.broadcast(Vocabulary.load(model_path))
    base = rows.select(F.col(id_col).alias("id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))
    kind = base.schema["id"].dataType.simpleString()
    return base.mapInArrow(partial(_decode, held), f"id {kind}, text string").withColumnRenamed("id", id_col)
