"""Op 9: quality rules with perplexity bands of a modified Kneser-Ney model.

The model is one of byte 5-grams per language, fitted on the distinct texts that pass the base rules and hold at most
``SYMBOLS_PER_100`` symbols to 100 words, as a model that has read symbol junk finds it usual. Spark counts their 5-grams
(each task sends its own sums), derives the continuation counts of the lower orders, the three discounts of each order and
the interpolated probability of each 5-gram. 5-grams that only other texts hold are counted as 0 and have the probability
that the lower orders give. The whole model is kept as sorted hash arrays: the 64-bit hash of (language, 5-gram), which is
one to one, and its log probabilities. They are cut by ranges of the hash into blocks of about ``BLOCK_KEYS`` entries; each
is a broadcast, and the texts are read once for each block.

A document is scored by its mean log probability per byte; a text that the model has read leaves one occurrence of each of
its 5-grams out. Per language, a band around the quartiles over the texts of the model is kept; documents above (noise) or
below (mechanical repetition) are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanveil.llm import batches as B
from spanveil.llm.carried import pack, unpack
from spanveil.session import discard, materialise

ORDER = 5
#: More symbols than this to 100 words keep a text out of the model (not out of the result, which its perplexity decides).
SYMBOLS_PER_100 = 10
#: Entries of the model in one broadcast, on average.
BLOCK_KEYS = 1 << 22
#: Texts that a task remembers as sent; copies that it has forgotten go when all tasks' texts are put in order.
_REMEMBERED = 500_000
SYMBOLS = b"#*$%&|<>"
_IS_SYMBOL = np.zeros(256, dtype=bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_COUNTS = "key long, n long"


def language_code(lang: Column) -> Column:
    """A two- or three-letter language code as a number below 27**3, anything else as 0: so there are few languages."""
    tag = F.lower(F.regexp_extract(F.coalesce(lang.cast("string"), F.lit("")), r"^([A-Za-z]{2,3})(?:[-_]|$)", 1))
    at = lambda i: F.greatest(F.ascii(F.substring(tag, i, 1)) - 96, F.lit(0))
    return (at(1) * 729 + at(2) * 27 + at(3)).cast("int")


def _grams(buf: np.ndarray, offs: np.ndarray, lang: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, key) of the 5-grams of a block; the key is exact: 15 bits of language, 40 bits of bytes."""
    sizes = np.diff(offs)
    doc = np.flatnonzero(sizes >= ORDER)
    counts = sizes[doc] - ORDER + 1
    at = B.expand(offs[doc], counts)
    of = np.repeat(doc, counts)
    packed = np.zeros(max(0, len(buf) - ORDER + 1), np.uint64)
    for i in range(ORDER):
        packed = (packed << np.uint64(8)) | buf[i : len(buf) - ORDER + 1 + i]
    return of, packed[at] | (lang[of].astype(np.uint64) << np.uint64(8 * ORDER))


def _merge(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate([x[i] for x in held]) for i in (0, 1))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[heads], np.add.reduceat(counts, heads) if len(heads) else counts


def _fitted(base: dict[str, np.ndarray], min_words: int, max_repeat_percent: int) -> np.ndarray:
    """Whether the model is fitted on each document of a block, from its base counts."""
    usual = 100 * base["n_symbols"] <= SYMBOLS_PER_100 * base["n_words"]
    return usual & ~base_failed(base["n_words"], base["n_repeat_words"], min_words, max_repeat_percent)


def _send_once(passes, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text of a task once, with ``fitted``: copies are not shuffled, so a text with many makes no hot task."""
    sent: set[tuple[int, int, int]] = set()
    for part, buf, offs in B.blocks(it, "text"):
        new = np.zeros(part.num_rows, dtype=bool)
        for i, key in enumerate(zip(*(part.column(c).to_pylist() for c in ("code", "h1", "h2")))):
            if key not in sent:
                new[i] = True
                sent.add(key)
        if len(sent) > _REMEMBERED:
            sent.clear()
        fitted = passes(base_features(buf, offs))
        yield part.append_column("fitted", pa.array(fitted)).filter(pa.array(new))


def _count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n) of texts in the order of their hashes, each once; n is 0 for texts that the model isn't fitted on."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    waiting = 0
    last = None

    def send(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(keys), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(B.signed(keys[i : i + 100_000])), pa.array(counts[i : i + 100_000])], names=["key", "n"])

    for part, buf, offs in B.blocks(it, "text"):
        code = part.column("code").to_numpy(zero_copy_only=False)
        fitted = part.column("fitted").to_numpy(zero_copy_only=False)
        new = np.zeros(part.num_rows, dtype=bool)
        for i, key in enumerate(zip(*(part.column(c).to_pylist() for c in ("code", "h1", "h2")))):
            new[i] = key != last
            last = key
        of, keys = _grams(buf, offs, code)
        for some, times in ((new & fitted, 1), (new & ~fitted, 0)):
            mine = np.sort(keys[some[of]])
            heads = np.flatnonzero(np.append(True, mine[1:] != mine[:-1])) if len(mine) else np.zeros(0, np.int64)
            held.append((mine[heads], np.diff(np.append(heads, len(mine))) * times))
            waiting += len(heads)
        if waiting > 1_500_000:
            held = [_merge(held)]
            waiting = len(held[0][0])
            if waiting > 1_000_000:  # a task never holds more than this; Spark adds up the rest
                yield from send(*held.pop())
                waiting = 0
    if held:
        yield from send(*_merge(held))


def kneser_ney(counts: DataFrame) -> DataFrame:
    """(key, n, logp, logp_left): interpolated modified Kneser-Ney log probability of each counted 5-gram, and the one that it
    has if one of its occurrences is left out, which is what scores a text that the model has read.

    ``counts`` has (key, n), the key being language code and bytes as in ``_grams``. Orders below the highest use the number
    of distinct bytes before an n-gram in place of its count; the lowest is interpolated with a uniform one over 256 bytes.
    A 5-gram with n = 0 adds nothing to any count and gets the probability of one not seen; its logp_left means nothing.
    """
    lang = lambda c, order: F.shiftright(c, 8 * order)
    types = {ORDER: counts.select("key", F.col("n").alias("a"))}
    for order in range(ORDER - 1, 0, -1):
        suffix = (F.shiftright("key", 8 * (order + 1)) * F.lit(1 << (8 * order)) + F.col("key").bitwiseAND(F.lit((1 << (8 * order)) - 1))).alias("key")
        types[order] = materialise(types[order + 1].select(suffix, "a").groupBy("key").agg(F.count_if(F.col("a") > 0).alias("a")), "quality-types")
    lower = None
    for order in range(1, ORDER + 1):
        t = types[order].withColumn("lang", lang(F.col("key"), order)).withColumn("ctx", F.shiftright("key", 8))
        hits = [F.count_if(F.col("a") == i).cast("double").alias(f"t{i}") for i in (1, 2, 3, 4)]
        # without one of the counts of counts a discount is undefined: then a usual value stands in
        d = t.groupBy("lang").agg(*hits).withColumn("y", F.try_divide(F.col("t1"), F.col("t1") + 2 * F.col("t2")))
        for i, usual in ((1, 0.5), (2, 1.0), (3, 1.5)):
            found = F.lit(float(i)) - (i + 1) * F.col("y") * F.try_divide(F.col(f"t{i + 1}"), F.col(f"t{i}"))
            d = d.withColumn(f"d{i}", F.when((found > 0) & (found < i), found).otherwise(F.lit(usual)))
        d = d.select(F.col("lang").alias("dl"), "d1", "d2", "d3")
        c = t.groupBy("lang", "ctx").agg(F.sum("a").alias("total"), F.count_if(F.col("a") == 1).alias("n1"), F.count_if(F.col("a") == 2).alias("n2"), F.count_if(F.col("a") > 2).alias("n3"))
        # one row per language, of which there are fewer than 27**3
        c = c.join(F.broadcast(d), F.col("lang") == F.col("dl")).drop("dl", "lang")
        cut = lambda a: F.when(a == 1, F.col("d1")).when(a == 2, F.col("d2")).otherwise(F.col("d3"))
        one, less = F.col("a") - 1, F.col("total") - 1
        own = F.when(F.col("a") > 0, F.greatest(F.col("a") - cut(F.col("a")), F.lit(0.0)) / F.col("total")).otherwise(F.lit(0.0))
        mass = F.col("d1") * F.col("n1") + F.col("d2") * F.col("n2") + F.col("d3") * F.col("n3")
        rest = F.when(F.col("total") > 0, mass / F.col("total")).otherwise(F.lit(1.0))
        own_left = F.when(one > 0, F.greatest(one - cut(one), F.lit(0.0)) / less).otherwise(F.lit(0.0))
        rest_left = F.when(less > 0, F.least(mass / less, F.lit(1.0))).otherwise(F.lit(1.0))
        columns = [F.col("a"), own.alias("own"), rest.alias("rest"), own_left.alias("own_left"), rest_left.alias("rest_left")]
        p = t.join(c, "ctx")
        if lower is None:
            p = p.select("key", *columns, F.lit(1 / 256).alias("q"), F.lit(1 / 256).alias("q_left"))
        else:
            back = (F.shiftright("key", 8 * order) * F.lit(1 << (8 * (order - 1))) + F.col("key").bitwiseAND(F.lit((1 << (8 * (order - 1))) - 1))).alias("back")
            p = p.select("key", *columns, back).join(lower, "back")
        # an n-gram seen once takes its contribution to the lower order away with it
        below = F.when(F.col("a") == 1, F.col("q_left")).otherwise(F.col("q"))
        p = p.select("key", "a", (F.col("own") + F.col("rest") * F.col("q")).alias("p"), (F.col("own_left") + F.col("rest_left") * below).alias("p_left"))
        # each order is written, so that no plan holds those below it
        if order < ORDER:
            now = materialise(p.select(F.col("key").alias("back"), F.col("p").alias("q"), F.col("p_left").alias("q_left")), "quality-lower")
            discard(types[order], *([lower] if lower is not None else []))
            lower = now
    return p.select("key", F.col("a").alias("n"), F.log("p").alias("logp"), F.log("p_left").alias("logp_left"))


def _chunks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries in order → runs of one cell as bytes, so that the driver has nothing to sort or convert."""
    for batch in it:
        cell = batch.column("cell").to_numpy()
        edges = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]
        cols = [batch.column(c).to_numpy() for c in ("h", "logp", "logp_left")]
        runs = [(a, b) for a, b in zip(edges, edges[1:], strict=False) if a < b]
        yield pa.RecordBatch.from_arrays([pa.array([c[a:b].tobytes() for a, b in runs], pa.binary()) for c in cols], names=["h", "logp", "logp_left"])


def sorted_hash_arrays(model: DataFrame, bits: int, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The part of the model whose hashes begin with the ``bits`` bits of ``block``: (hashes in order, logp, logp_left)."""
    mine = model.filter(F.shiftrightunsigned("h", 64 - bits) == block) if bits else model
    cells = mine.withColumn("cell", F.shiftrightunsigned("h", 64 - bits - 5)).repartition(32, "cell").sortWithinPartitions("cell", "h").select("cell", "h", F.col("logp").cast("float"), F.col("logp_left").cast("float"))
    rows = cells.mapInArrow(_chunks, "h binary, logp binary, logp_left binary").collect()
    # runs don't overlap: the first hash of each puts them in order
    rows.sort(key=lambda r: int(np.frombuffer(r["h"], np.uint64, 1)[0]))
    return tuple(np.concatenate([np.zeros(0, t), *(np.frombuffer(r[c], t) for r in rows)]) for c, t in (("h", np.uint64), ("logp", np.float32), ("logp_left", np.float32)))


_LAID_OUT: list = []


def _places(held, bits: int, h: np.ndarray) -> np.ndarray:
    """The places of hashes that are all in a block of the model; its index is made once in a Python worker."""
    model = held.value
    hashes = model[0]
    # all hashes of a block begin with the same bits; those after them tell them apart
    lead = lambda x, n: (x << np.uint64(bits)) >> np.uint64(64 - n)
    if not _LAID_OUT or _LAID_OUT[0] is not model:
        n = len(hashes).bit_length() + 1
        _LAID_OUT[:] = [model, np.searchsorted(lead(hashes, n), np.arange(1 << n, dtype=np.uint64)).astype(np.int32), n]
    at = _LAID_OUT[1][lead(h, _LAID_OUT[2])].astype(np.int64)
    left = np.flatnonzero(hashes[np.minimum(at, len(hashes) - 1)] != h)
    while len(left):
        at[left] += 1
        if at[left].max() >= len(hashes):
            raise ValueError("a text holds a 5-gram that was not counted: the rows changed between two readings")
        left = left[hashes[at[left]] != h[left]]
    return at


_P = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def xxhash64_of_longs(x: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 (seed 42) of a column of longs, on arrays."""
    turn = lambda v, r: (v << np.uint64(r)) | (v >> np.uint64(64 - r))
    h = np.full(len(x), (42 + int(_P[4]) + 8) & (2**64 - 1), np.uint64)
    h ^= turn(x.astype(np.uint64) * _P[1], 31) * _P[0]
    h = turn(h, 27) * _P[0] + _P[3]
    h ^= h >> np.uint64(33)
    h *= _P[1]
    h ^= h >> np.uint64(29)
    h *= _P[2]
    return h ^ (h >> np.uint64(32))


def base_features(buf: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of the base rules for each document of a block."""
    starts, ends, firsts = B.words(buf, offs)
    size = len(offs) - 1
    of = np.repeat(np.arange(size), np.diff(firsts))
    lead = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
    symbols = np.concatenate(([0], np.cumsum(_IS_SYMBOL[buf])))
    sums = lambda v: np.bincount(of, weights=v, minlength=size).astype(np.int64)
    words = B.Rolling.of_bytes(buf).of(starts, ends)
    again = np.zeros(len(words), dtype=bool)
    if len(words) > 2:
        inside = np.flatnonzero(of[2:] == of[:-2])
        three = B.Rolling(words).of_all(3)[inside]
        key = B.mix(three ^ B.mix(of[inside].astype(np.uint64)))
        ordered = np.sort(key)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        hit = inside[np.isin(key, twice)] if len(twice) else inside[:0]
        for i in range(3):
            again[hit + i] = True
    raw = buf.tobytes()
    dup = np.zeros(size, np.int64)
    for i in range(size):
        lines = raw[offs[i] : offs[i + 1]].split(b"\n")
        if len(lines) > 1:
            seen: set[bytes] = set()
            for line in lines:
                if line in seen:
                    dup[i] += 1
                elif line.strip(b" \t\r\x0b\x0c"):
                    seen.add(line)
    return {"n_words": np.diff(firsts), "word_chars": sums(lead[ends] - lead[starts]), "n_symbols": symbols[offs[1:]] - symbols[offs[:-1]], "n_dup_lines": dup, "n_repeat_words": sums(again)}


_FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def base_failed(n_words, n_repeat_words, min_words: int, max_repeat_percent: int):
    """The verdict of the base rules, on arrays or columns."""
    return (n_words < min_words) | (100 * n_repeat_words > max_repeat_percent * n_words)


def _score(held, bits: int, block: int, passes, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of log probabilities that a block of the model gives each document; the first also has the base counts."""
    for part, buf, offs in B.blocks(it, "text"):
        of, keys = _grams(buf, offs, part.column("code").to_numpy(zero_copy_only=False))
        n = np.bincount(of, minlength=part.num_rows)
        base = base_features(buf, offs)
        fitted = passes(base)
        h = xxhash64_of_longs(keys)
        if bits:
            mine = (h >> np.uint64(64 - bits)) == np.uint64(block)
            of, h = of[mine], h[mine]
        total = np.zeros(part.num_rows)
        if len(h):
            at = _places(held, bits, h)
            total = np.bincount(of, weights=np.where(fitted[of], held.value[2][at], held.value[1][at]), minlength=part.num_rows)
        if block:
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("k1", "k2", "code")), pa.array(total)], names=["k1", "k2", "code", "total"])
            continue
        cols = [part.column(c) for c in ("id", "k1", "k2", "code")] + [pa.array(x.astype(np.int64)) for x in base.values()]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(fitted), pa.array(total), pa.array(n.astype(np.int64))], names=["id", "k1", "k2", "code", *base, "fitted", "total", "n_grams"])


def quality(docs: DataFrame, reach: float = 4.0, min_words: int = 50, max_repeat_percent: int = 50, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Base counts, base_failed, entropy (nats a byte), perplexity and kept for every row; also k1, k2, hashes of (id, text).

    A language's band of entropies runs from its lower quartile to its upper, each moved outward by ``reach`` times the
    distance between them; shorter documents, whose mean varies more, get 3 / sqrt(n) more. A language none of whose
    texts the model is fitted on has no band, and what passes its base rules is kept. Null and empty texts have no words and fail the base rules. A null or odd language has the band of code 0, as every language has its
    own. Repeated rows get equal results and count once in the quartiles. Null ids are carried along; other columns are
    not read. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    B.tune(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), text.alias("text"), language_code(F.col(lang_col)).alias("code"))
    passes = partial(_fitted, min_words=min_words, max_repeat_percent=max_repeat_percent)
    texts = base.filter("text <> ''").select("code", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), "text").alias("h2"), "text")
    texts = texts.mapInArrow(partial(_send_once, passes), "code int, h1 long, h2 long, text string, fitted boolean")
    texts = texts.repartition("h1", "h2", "code").sortWithinPartitions("h1", "h2", "code")
    counts = materialise(texts.mapInArrow(_count, _COUNTS).groupBy("key").agg(F.sum("n").alias("n")), "quality-counts")
    model = materialise(kneser_ney(counts).select(F.xxhash64("key").alias("h"), "logp", "logp_left"), "quality-model")
    discard(counts)
    bits = max(0, -(-model.count() // BLOCK_KEYS) - 1).bit_length()
    keyed = base.select("id", F.xxhash64("id", "text").alias("k1"), F.xxhash64("text", "id", F.lit(7)).alias("k2"), "code", "text")
    kind = base.schema["id"].dataType.simpleString()
    more_totals = []
    for block in range(1 << bits):
        held = spark.sparkContext.broadcast(sorted_hash_arrays(model, bits, block))
        score = partial(_score, held, bits, block, passes)
        if block:
            part = keyed.select("k1", "k2", "code", "text").mapInArrow(score, "k1 long, k2 long, code int, total double")
            # repeated rows have equal sums
            part = part.groupBy("k1", "k2", "code").agg(F.max("total").alias("more_total"))
            more_totals.append(materialise(part, "quality-part"))
        else:
            scored = materialise(keyed.mapInArrow(score, f"id {kind}, k1 long, k2 long, code int, {_FEATURES}, fitted boolean, total double, n_grams long"), "quality-scores")
        held.unpersist()
    if more_totals:
        rest = reduce(DataFrame.unionAll, more_totals).groupBy("k1", "k2", "code").agg(F.sum("more_total").alias("more_total"))
        scored = materialise(scored.join(rest, ["k1", "k2", "code"]).withColumn("total", F.col("total") + F.col("more_total")).drop("more_total"), "quality-sums")
    scored = scored.withColumn("entropy", F.when(F.col("n_grams") > 0, -F.col("total") / F.col("n_grams")).otherwise(F.lit(0.0))).drop("total")
    scored = scored.withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words"), min_words, max_repeat_percent))
    # equal texts of a language have equal figures, whatever else they hold: copies count once
    once = scored.filter("fitted").groupBy("code", "n_grams", "entropy").agg(F.count("*").alias("c"))
    # quartiles of entropies to four digits: a bounded number of sums, and the same however the rows are dealt
    bins = once.groupBy("code", F.round(F.col("entropy") * 10_000).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    so_far = F.sum("n").over(Window.partitionBy("code").orderBy("bin")) / F.sum("n").over(Window.partitionBy("code"))
    quartile = lambda q: F.min(F.when(F.col("so_far") >= q, F.col("bin"))) / 10_000
    bands = bins.withColumn("so_far", so_far).groupBy("code").agg(quartile(0.25).alias("q1"), quartile(0.75).alias("q3"))
    wide = reach * (F.col("q3") - F.col("q1"))
    bands = bands.select(F.col("code").alias("bc"), (F.col("q1") - wide).alias("low"), (F.col("q3") + wide).alias("high"))
    # one row per language, of which there are fewer than 27**3
    out = scored.join(F.broadcast(bands), F.col("code") == F.col("bc"), "left")
    more = F.lit(3.0) / F.sqrt(F.greatest("n_grams", F.lit(1)))
    inside = (F.col("entropy") >= F.col("low") - more) & (F.col("entropy") <= F.col("high") + more)
    out = out.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True))).withColumn("perplexity", F.exp("entropy"))
    return out.drop("bc", "n_grams", "code", "fitted").withColumnRenamed("id", id_col)


def reject(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **limits) -> DataFrame:
    """The rows of ``docs``, all their columns whatever their names, that ``quality`` keeps; repeated rows stay repeated."""
    verdict = quality(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, **limits).filter("kept").select("k1", "k2").distinct()
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    keyed = pack(docs, k1=F.xxhash64(F.col(f"`{id_col}`"), text), k2=F.xxhash64(text, F.col(f"`{id_col}`"), F.lit(7)))
    return unpack(keyed.join(verdict, ["k1", "k2"], "left_semi"))
