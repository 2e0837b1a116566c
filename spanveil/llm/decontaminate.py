"""Op 3: benchmark decontamination by template canonicalisation.

Tokens become templates: numbers and units are replaced by typed placeholders, other words are lowered and stripped of
punctuation. That is the first of two readings; in the second, names (capitalised words, and those that begin a sentence)
are placeholders as well. A benchmark text is the set of its template windows in both readings. A document that holds windows
in line with each other that cover a share of the text's tokens is a candidate, found by its windows' hashes. The slots
(what the placeholders replaced) then have to be consistent: one value of the item stands for one value of the document
wherever it occurs. That catches questions asked anew with other numbers and names, and leaves alone texts that only happen
to have the shape of one.

The hash join of windows is one of sorted arrays: executors make the windows of the benchmark, and blocks of at most about
``BLOCK`` windows are broadcast one after the other, so that each has a proven size, however large the benchmark is. The
documents aren't shuffled; they are read once for each block.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanveil.llm import batches as B
from spanveil.llm.carried import pack, unpack
from spanveil.session import materialise

#: Template windows of the benchmark in one broadcast, about.
BLOCK = 200_000
#: Tokens of a benchmark text that are looked for as one; a longer text is several.
PIECE = 5_000
#: How far words put in or left out may shift a passage against its item.
DRIFT = 8
# Units that may follow a number.
UNITS = frozenset(
    "mm cm m km mg g kg t ml l s sec second seconds min minute minutes h hour hours day days week weeks month months year years "
    "inch inches foot feet yard yards mile miles ounce ounces pound pounds dollar dollars euro euros cent cents percent degree degrees "
    "meter meters metre metres kilometer kilometers gram grams kilogram kilograms liter liters litre litres watt watts volt volts".split()
)
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_STRIP = re.compile(r"^[^\w$€£%]+|[^\w$€£%]+$")
_NUMBER = re.compile(r"[$€£]?\d+(?:[.,:/]\d+)*%?")
_END = (".", "!", "?", ":")
#: The two readings: as they are written, and with names open.
PLAIN, NAMED = 0, 1


def canonical(text: str, reading: int = NAMED) -> tuple[list[str], list[str | None], list[tuple[int, int]]]:
    """(template tokens, the slot value of each or None, their character ranges).

    A name is a capitalised word of two letters or more; one after another are one name, but for one that begins a sentence.
    """
    tokens: list[str] = []
    slots: list[str | None] = []
    ranges: list[tuple[int, int]] = []
    start_of_sentence = True
    for m in _WORD.finditer(text):
        raw = m[0]
        word = _STRIP.sub("", raw)
        if word:
            number = _NUMBER.fullmatch(word)
            if number:
                kind, slot = "<num>", word.lower()
            elif tokens and tokens[-1] == "<num>" and word.lower() in UNITS:
                kind, slot = "<unit>", word.lower()
            elif reading == NAMED and word[0].isupper() and len(word) > 1 and word[0].isalpha():
                kind, slot = "<name>", word.lower()
            else:
                kind, slot = word.lower(), None
            if kind == "<name>" and tokens and tokens[-1] == "<name>" and not start_of_sentence:
                slots[-1] = f"{slots[-1]} {slot}"
                ranges[-1] = (ranges[-1][0], m.end())
            else:
                tokens.append(kind)
                slots.append(slot)
                ranges.append((m.start(), m.end()))
        start_of_sentence = raw.endswith(_END) or (start_of_sentence and not word)
    return tokens, slots, ranges


def _hashes(tokens: list[str], width: int) -> np.ndarray:
    """The hashes of the template windows; of a shorter text, of all of it."""
    if not tokens:
        return np.zeros(0, np.uint64)
    raw = " ".join(tokens).encode()
    buf = np.frombuffer(raw, np.uint8)
    starts, ends, _ = B.words(buf, np.array([0, len(raw)]))
    roll = B.Rolling(B.Rolling.of_bytes(buf).of(starts, ends))
    return roll.of_all(width) if len(tokens) >= width else roll.of(np.array([0]), np.array([len(tokens)]))


_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _letter_pairs(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the pairs of neighbouring words, of which only the ASCII letters, lowered, count."""
    keep = _LETTER[buf] | _SPACE[buf]
    at = np.concatenate(([0], np.cumsum(keep)))[offs]
    low = B.LOWER[buf[keep]]
    starts, ends, firsts = B.words(low, at)
    if len(starts) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    of = np.repeat(np.arange(len(offs) - 1), np.diff(firsts))
    pair = B.Rolling(B.Rolling.of_bytes(low).of(starts, ends)).of_all(2)
    inside = of[1:] == of[:-1]
    return of[:-1][inside], pair[inside]


def consistent(item: list[str | None], doc: list[str | None]) -> bool:
    """Whether slots of the item map to slots of the document one to one, wherever they recur."""
    there: dict[str, str] = {}
    back: dict[str, str] = {}
    return all(a is None or b is None or (there.setdefault(a, b) == b and back.setdefault(b, a) == a) for a, b in zip(item, doc, strict=True))


def _marks(tokens: list[str], slots: list[str | None], width: int) -> list[tuple[str, str] | None]:
    """For each window its longest pair of neighbouring literal words: a text without that pair doesn't hold the window."""
    letters = [re.sub("[^a-z]", "", t) if v is None else "" for t, v in zip(tokens, slots, strict=True)]
    out = []
    for i in range(max(1, len(tokens) - width + 1)):
        some = letters[i : i + width]
        best = max(((len(a) + len(b), a, b) for a, b in zip(some, some[1:], strict=False) if a and b), default=None)
        out.append(best[1:] if best else None)
    return out


def _pair_hashes(pairs: list[tuple[str, str]]) -> np.ndarray:
    raw = [f"{a} {b}".encode() for a, b in pairs]
    return _letter_pairs(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))[1]


_SEED = (np.uint64(0), np.uint64(0x9E3779B97F4A7C15))
_ENTRY = "item string, reading int, tokens string, slots string, windows binary, marks array<string>"


def _entries(width: int, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Benchmark texts → a row for each reading of each piece: its tokens, slots, window hashes and their marks."""
    for batch in it:
        rows = []
        for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for reading in (PLAIN, NAMED):
                tokens, slots, _ = canonical(text, reading)
                for a in range(0, len(tokens), PIECE):
                    t, v = tokens[a : a + PIECE], slots[a : a + PIECE]
                    marks = ["" if m is None else " ".join(m) for m in _marks(t, v, width)]
                    rows.append((item, reading, " ".join(t), "\t".join(x or "" for x in v), (_hashes(t, width) ^ _SEED[reading]).tobytes(), marks))
        kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.binary(), pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["item", "reading", "tokens", "slots", "windows", "marks"])


class Index:
    """One block of the benchmark: window hashes in order, where they stand, and the pairs of words that mark them."""

    def __init__(self, rows: list, width: int, share: float) -> None:
        self.width, self.share = width, share
        self.items = [r["item"] for r in rows]
        self.readings = [r["reading"] for r in rows]
        self.texts = [(r["tokens"].split(" "), [x or None for x in r["slots"].split("\t")]) for r in rows]
        self.least = np.array([share * len(t) for t, _ in self.texts])
        hashes = [np.frombuffer(r["windows"], np.uint64) for r in rows]
        order = np.argsort(np.concatenate(hashes), kind="stable")
        self.hashes = np.concatenate(hashes)[order]
        self.of = np.repeat(np.arange(len(rows)), [len(h) for h in hashes])[order]
        self.at = np.concatenate([np.arange(len(h)) for h in hashes])[order]
        self.lengths = [sorted({min(width, len(t)) for (t, _), r in zip(self.texts, self.readings, strict=True) if r == reading}) for reading in (PLAIN, NAMED)]
        # how many tokens of a text the windows of each mark cover; those of windows without a mark may be anywhere
        cover: dict[tuple[str, int], set[int]] = defaultdict(set)
        anywhere = np.zeros(len(rows))
        for k, r in enumerate(rows):
            size = min(width, len(self.texts[k][0]))
            bare: set[int] = set()
            for i, mark in enumerate(r["marks"]):
                (cover[mark, k] if mark else bare).update(range(i, i + size))
            anywhere[k] = len(bare)
        self.least_marked = self.least - anywhere
        self.always = np.flatnonzero(self.least_marked <= 0)
        names = sorted({m for m, _ in cover})
        raw = _pair_hashes([tuple(m.split(" ")) for m in names])
        by = np.argsort(raw, kind="stable")
        place = {names[j]: i for i, j in enumerate(by.tolist())}
        self.pairs = raw[by]
        links = sorted((place[m], k, len(v)) for (m, k), v in cover.items())
        self.link_text, self.link_tokens = (np.array([x[i] for x in links], np.int64) for i in (1, 2))
        self.link_from = np.searchsorted(np.array([x[0] for x in links], np.int64), np.arange(len(names) + 1))

    def likely(self, buf: np.ndarray, offs: np.ndarray) -> dict[int, list[int]]:
        """The documents of a block that may hold a text, and which: their word pairs mark windows that could cover enough of it."""
        raw = buf.tobytes()
        n = len(self.texts)
        # two characters whose lower case has an ASCII letter that they haven't
        if "\u212a".encode() in raw or "\u0130".encode() in raw:
            return {i: list(range(n)) for i in range(len(offs) - 1)}
        out: dict[int, list[int]] = defaultdict(list)
        if len(self.always):
            for i in np.flatnonzero(np.diff(offs) > 0).tolist():
                out[i] += self.always.tolist()
        of, pair = _letter_pairs(buf, offs)
        if len(pair) and len(self.pairs):
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            hit = self.pairs[at] == pair
            both = np.unique(of[hit] * len(self.pairs) + at[hit])
            doc, mark = both // len(self.pairs), both % len(self.pairs)
            counts = self.link_from[mark + 1] - self.link_from[mark]
            link = B.expand(self.link_from[mark], counts)
            key, inverse = np.unique(np.repeat(doc, counts) * n + self.link_text[link], return_inverse=True)
            tokens = np.bincount(inverse, weights=self.link_tokens[link], minlength=len(key))
            for k in key[(tokens >= self.least_marked[key % n]) & (self.least_marked[key % n] > 0)].tolist():
                out[k // n].append(k % n)
        return out

    def search(self, text: str, wanted: list[int]) -> list[tuple[str, int, int, int, bool]]:
        """(item, windows found, windows of the text, tokens covered, verbatim) of the wanted texts that the document holds."""
        best: dict[str, tuple] = {}
        for reading in (PLAIN, NAMED):
            mine = {k for k in wanted if self.readings[k] == reading}
            if not mine:
                continue
            tokens, slots, _ = canonical(text, reading)
            found: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
            for length in self.lengths[reading]:
                if length > len(tokens):
                    continue
                h = (_hashes(tokens, length) if length < self.width or len(tokens) >= self.width else np.zeros(0, np.uint64)) ^ _SEED[reading]
                lo = np.searchsorted(self.hashes, h, "left")
                hi = np.searchsorted(self.hashes, h, "right")
                for p in np.flatnonzero(hi > lo).tolist():
                    for j in range(int(lo[p]), int(hi[p])):
                        k, q = int(self.of[j]), int(self.at[j])
                        if k in mine and min(self.width, len(self.texts[k][0])) == length:
                            found[k][p - q].append((q, p))
            for k, shifts in found.items():
                hit = self._in_line(k, shifts, slots)
                if hit and hit > best.get(self.items[k], ()):
                    best[self.items[k]] = hit
        return [(item, n, of, covered, same) for item, (_, covered, n, same, of) in sorted(best.items())]

    def _in_line(self, k: int, shifts: dict[int, list[tuple[int, int]]], slots: list[str | None]) -> tuple | None:
        its, their = self.texts[k]
        n, size = max(1, len(its) - self.width + 1), min(self.width, len(its))
        best = None
        # a word put in or left out moves the rest a little: windows within DRIFT of a shift belong to it
        for centre in sorted(shifts, key=lambda d: (-len(shifts[d]), d)):
            hits: dict[int, int] = {}
            for away in sorted(range(-DRIFT, DRIFT + 1), key=abs):
                for q, p in shifts.get(centre + away, ()):
                    hits.setdefault(q, p)
            if best and best[2] >= len(hits):
                continue
            if min(size * len(hits), len(its)) < self.least[k]:
                continue
            covered = sorted({(q + j, p + j) for q, p in hits.items() for j in range(size)})
            tokens = len({q for q, _ in covered})
            if tokens < self.least[k]:
                continue
            a, b = [their[q] for q, _ in covered], [slots[p] for _, p in covered]
            if consistent(a, b):
                best = (tokens / len(its), tokens, len(hits), a == b, n)
        return best


def _search(held, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = held.value
    for part, buf, offs in B.blocks(it, "text"):
        texts = part.column("text")
        rows = [(k, *r) for k, wanted in index.likely(buf, offs).items() for r in index.search(texts[k].as_py(), wanted)]
        at = pa.array([r[0] for r in rows], pa.int64())
        cols = [part.column(c).take(at) for c in ("id", "k1", "k2")] + [pa.array([r[1] for r in rows], pa.string())]
        cols += [pa.array([r[k] for r in rows], pa.int64()) for k in (2, 3, 4)] + [pa.array([r[5] for r in rows], pa.bool_())]
        yield pa.RecordBatch.from_arrays(cols, names=["id", "k1", "k2", "item", "n_found", "n_windows", "n_tokens", "verbatim"])


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 8, share: float = 0.6, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each (document, item) where windows of ``width`` template tokens (a shorter item is one window) that stand in
    line and have consistent slots cover ``share`` or more of the item's tokens: id, k1 and k2 (hashes of id and text),
    item_id, n_found, n_windows, n_tokens, verbatim (all slots are the item's own). Clean documents have no row.

    Whole texts are searched. Null, empty and wordless texts and items match nothing; repeated documents have a row each; the
    texts of a repeated item (same id) are each looked for, and the one covered best is reported; an item beyond ``PIECE``
    tokens is looked for in pieces. Items keep their type of id; those without one are left out. A null document id is
    carried along. Columns other than those named are not read. An empty table on either side gives an empty table.
    """
    spark = docs.sparkSession
    B.tune(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumns({"k1": F.xxhash64("id", "text"), "k2": F.xxhash64("text", "id", F.lit(7))})
    kind, item_kind = base.schema["id"].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).cast("string").alias("text")).dropna().distinct()
    entries = materialise(items.mapInArrow(partial(_entries, width), _ENTRY), "decontaminate-entries")
    found: list[DataFrame] = []
    block: list = []
    size = 0

    def search() -> None:
        held = spark.sparkContext.broadcast(Index(block, width, share))
        schema = f"id {kind}, k1 long, k2 long, item string, n_found long, n_windows long, n_tokens long, verbatim boolean"
        found.append(materialise(base.mapInArrow(partial(_search, held), schema), "decontaminate"))
        held.unpersist()

    for row in entries.toLocalIterator():
        block.append(row)
        size += len(row["marks"])
        if size >= BLOCK:
            search()
            block, size = [], 0
    if block:
        search()
    if not found:
        found = [spark.createDataFrame([], f"id {kind}, k1 long, k2 long, item string, n_found long, n_windows long, n_tokens long, verbatim boolean")]
    out = reduce(DataFrame.unionByName, found)
    if len(found) > 1:  # an item may have texts in several blocks; repeated documents keep a row each
        best = F.row_number().over(Window.partitionBy("k1", "k2", "item", "block").orderBy("n_tokens"))
        out = reduce(DataFrame.unionByName, (f.withColumn("block", F.lit(i)) for i, f in enumerate(found))).withColumn("copy", best)
        rank = F.row_number().over(Window.partitionBy("k1", "k2", "item", "copy").orderBy(F.desc("n_tokens"), F.desc("n_found"), "block"))
        out = out.withColumn("rank", rank).filter("rank = 1")
    columns = ["k1", "k2", F.col("item").cast(item_kind).alias("item_id"), "n_found", "n_windows", "n_tokens", "verbatim"]
    return out.select(F.col("id").alias(id_col), *columns)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs``, all their columns whatever their names, in which ``contaminated`` finds nothing."""
    hits = contaminated(docs, benchmark, id_col=id_col, text_col=text_col, **how).select("k1", "k2").distinct()
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    keyed = pack(docs, k1=F.xxhash64(F.col(f"`{id_col}`"), text), k2=F.xxhash64(text, F.col(f"`{id_col}`"), F.lit(7)))
    return unpack(keyed.join(hits, ["k1", "k2"], "left_anti"))
