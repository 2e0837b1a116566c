"""Op 6: similarity join on word shingles by vertical partitioning.

Shingles have one global order, rarest first: a shingle is as rare as its rarest word, and how often words occur is read from
a sketch of fixed size (counts by hash bucket), so the order is the same everywhere, shingles with a rare word come first and
very common ones last. The order is cut into ``FRAGMENTS`` fragments of about equal mass. Two sets that link share a number of shingles among the first of each (the prefix, which lies in the first
fragments); a node that shares fewer with all others together is out. Then:

1. Documents with equal sets are one node, so copies never meet each other.
2. Each prefix shingle held by two nodes or more names its smallest node as leader; a node joins the cluster of the leader
   that most of its shingles name. Large groups of near copies so become one cluster.
3. In a cluster all pairs are decided in blocks of about ``BLOCK`` nodes, cut by size, so that a block only meets those whose
   sizes allow a link. Texts go to their blocks, which make the sets; only a spanning forest of the links leaves a block, never
   the pairs.
4. Pairs that share prefix shingles across clusters are listed, and go if their prefixes have too few in common. For those
   left, each fragment's partial overlap is a row of its own, and Spark sums the rows per pair.
5. Connected components of the links.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanveil.llm import batches as B
from spanveil.llm.carried import pack, unpack
from spanveil.llm.components import components
from spanveil.session import discard, materialise

SKETCH_BITS = 20
#: The sketch is sent in this many parts by each task, and summed part by part.
_PARTS = 16
#: Nodes in a block of a cluster; fragments of the global order; columns of a matrix when overlaps are counted.
BLOCK, FRAGMENTS, COLUMNS = 512, 8, 4096
#: Sizes that differ by less than one in so many are a step; shingles for which a node counts once more in a block.
STEP, HEAVY = 50, 2048
#: Sets that a task remembers so as to send each once.
SEEN = 500_000


def _bucket(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, A-Z lowered, and the n + 1 offsets of each document's."""
    low = B.LOWER[buf]
    starts, ends, firsts = B.words(low, offs)
    return B.Rolling.of_bytes(low).of(starts, ends), firsts


def shingle_sets(buf: np.ndarray, offs: np.ndarray, size: int, sketch: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The sorted distinct shingle hashes of each document and how often their rarest words occur; with fewer words than
    ``size``, all of them are one shingle."""
    words, firsts = _words(buf, offs)
    load = sketch[_bucket(words)]
    roll = B.Rolling(words)
    every, rarest = roll.of_all(size), B.sliding_min(load, size)
    out = []
    for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
        if b - a >= size:
            items, first = np.unique(every[a : b - size + 1], return_index=True)
            out.append((items, rarest[a + first]))
        elif b > a:
            out.append((roll.of(np.array([a]), np.array([b])), load[a:b].min(keepdims=True)))
        else:
            out.append((np.zeros(0, np.uint64), load[:0]))
    return out


def _identity(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    if not len(s):
        return 0, 0
    one = B.mix(s)
    two = B.mix(s ^ np.uint64(0xA0761D6478BD642F))
    both = np.array([one.sum(dtype=np.uint64), two.sum(dtype=np.uint64)], np.uint64) + np.uint64(len(s))
    return tuple(B.signed(B.mix(both)).tolist())


def _sketch(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """This task's share of the sketch, in parts."""
    counts = np.zeros(1 << SKETCH_BITS, np.int32)
    for _, buf, offs in B.blocks(it, "text"):
        counts += np.bincount(_bucket(_words(buf, offs)[0]), minlength=len(counts)).astype(np.int32)
    if counts.any():
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(_PARTS), pa.int32()), pa.array([x.tobytes() for x in np.split(counts, _PARTS)], pa.binary())], names=["part", "counts"])


def _sum_parts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in it:
        for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts"), strict=True):
            more = np.frombuffer(counts.as_buffer(), np.int32).astype(np.int64)
            held[part] = held[part] + more if part in held else more
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["part", "counts"])


def _survey(size: int, percent: int, held, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document; the first of a set in this task has the prefix, in the global order."""
    sketch = held.value
    seen: set[tuple[int, int]] = set()
    for part, buf, offs in B.blocks(it, "text"):
        n, ids, short, tokens = [], [], [], []
        for s, load in shingle_sets(buf, offs, size, sketch):
            key = _identity(s)
            n.append(len(s))
            ids.append(key)
            first, every = prefix_lengths(len(s), percent) if len(s) else (0, 0)
            short.append(first)
            if key in seen or not len(s):
                tokens.append(None)
                continue
            if len(seen) >= SEEN:
                seen.clear()
            seen.add(key)
            tokens.append(B.signed(s[np.lexsort((s, load))[:every]]))
        cols = [part.column("id"), part.column("k1"), pa.array(n, pa.int64()), pa.array([x for x, _ in ids], pa.int64()), pa.array([y for _, y in ids], pa.int64()), pa.array(short, pa.int32()), pa.array(tokens, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(cols, names=["id", "k1", "n", "sid", "check", "short", "tokens"])


def least_common(n):
    """How many shingles two linked sets have in common among the first that each shows, the smaller having n."""
    return min(8, max(1, n // 20))


def prefix_lengths(n: int, percent: int) -> tuple[int, int]:
    """How many first shingles a set of n has to show to longer sets (or equally long ones), and to any.

    With an overlap of o or more, sets of n and m have k in common among their first n - o + k and m - o + k.
    """
    more = least_common(n)
    return min(n, n - -(-2 * percent * n // (100 + percent)) + more), min(n, n - -(-percent * n // 100) + more)


#: Bits of the filter through which texts pass that are needed again; the join behind it is exact.
FILTER_BITS = 24


def _hold(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The filter's bits that this task's keys set, in parts."""
    bits = np.zeros(1 << FILTER_BITS, dtype=bool)
    for batch in it:
        bits[batch.column("k1").to_numpy().view(np.uint64) >> np.uint64(64 - FILTER_BITS)] = True
    if bits.any():
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(_PARTS), pa.int32()), pa.array([x.tobytes() for x in np.split(np.packbits(bits), _PARTS)], pa.binary())], names=["part", "bits"])


def _join_parts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in it:
        for part, bits in zip(batch.column("part").to_pylist(), batch.column("bits"), strict=True):
            more = np.frombuffer(bits.as_buffer(), np.uint8)
            held[part] = held[part] | more if part in held else more.copy()
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["part", "bits"])


def _needed(held, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows whose key may be needed, those of one key once for each task."""
    bits = np.unpackbits(held.value).view(bool)
    sent: set[int] = set()
    for batch in it:
        keys = batch.column("k1").to_numpy()
        pick = []
        for i in np.flatnonzero(bits[keys.view(np.uint64) >> np.uint64(64 - FILTER_BITS)]).tolist():
            if keys[i] not in sent:
                if len(sent) >= SEEN:
                    sent.clear()
                sent.add(int(keys[i]))
                pick.append(i)
        if pick:
            yield batch.take(pa.array(pick, pa.int64()))


def _segments(size: int, held, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, fragment, shingles): each set cut by the fragments of the global order. Rows come by node; each is cut once."""
    sketch, pivots = held.value
    last = None
    for part, buf, offs in B.blocks(it, "text"):
        row, fragment, items = [], [], []
        for r, (i, (s, load)) in enumerate(zip(part.column("node").to_pylist(), shingle_sets(buf, offs, size, sketch), strict=True)):
            if i == last:
                continue
            last = i
            of = np.searchsorted(pivots, load)
            for f in np.unique(of).tolist():
                row.append(r)
                fragment.append(f)
                items.append(s[of == f].tobytes())
        for i in range(0, len(row), 1000):
            some = slice(i, i + 1000)
            node = part.column("node").take(pa.array(row[some], pa.int64()))
            yield pa.RecordBatch.from_arrays([node, pa.array(fragment[some], pa.int32()), pa.array(items[some], pa.binary())], names=["node", "fragment", "items"])


def overlaps(of: np.ndarray, items: np.ndarray, g: int) -> np.ndarray:
    """The sizes of all pairwise intersections of the g sets' shingles in one fragment of the order."""
    order = np.argsort(items, kind="stable")
    items, of = items[order], of[order]
    new = np.append(True, items[1:] != items[:-1])
    counts = np.diff(np.append(np.flatnonzero(new), len(items)))
    shared = np.repeat(counts > 1, counts)  # a shingle of one set alone overlaps with none
    of = of[shared]
    _, column = np.unique((np.cumsum(new) - 1)[shared], return_inverse=True)
    total = np.zeros((g, g), np.float32)
    width = max(64, min(COLUMNS, 8_000_000 // max(g, 1)))
    last = int(column[-1]) + 1 if len(column) else 0
    for a in range(0, last, width):
        lo, hi = np.searchsorted(column, [a, a + width])
        some = np.zeros((g, min(width, last - a)), np.float32)
        some[of[lo:hi], column[lo:hi] - a] = 1
        total += some @ some.T
    return np.rint(total).astype(np.int64)


def _forest(link: np.ndarray) -> np.ndarray:
    """For each node the first node of its component in a matrix of links."""
    label = np.arange(len(link))
    while True:
        new = np.where(link, label[None, :], len(link)).min(axis=1)
        new = np.minimum(new, label)[np.minimum(new, label)]
        if (new == label).all():
            return label
        label = new


def _clusters(size: int, percent: int, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts sorted by (lead, one, two) → edges of a spanning forest of each pair of blocks."""
    at: dict[int, int] = {}  # the nodes of the pair of blocks, their blocks and their sets
    blocks: list[int] = []
    items: list[np.ndarray] = []
    key = None

    def decide() -> pa.RecordBatch:
        g = len(at)
        n = np.array([len(x) for x in items], np.int64)
        inter = overlaps(np.repeat(np.arange(g), n), np.concatenate(items), g) if g > 1 else np.zeros((g, g), np.int64)
        link = 100 * inter >= percent * (n[:, None] + n[None, :] - inter)
        np.fill_diagonal(link, True)
        if key and key[1] != key[2]:
            side = np.array([b == key[1] for b in blocks])
            link &= (side[:, None] != side[None, :]) | np.eye(g, dtype=bool)
        nodes = np.array(list(at), np.int64)
        label = _forest(link) if g else np.zeros(0, np.int64)
        rows = np.flatnonzero(label != np.arange(g))
        at.clear()
        blocks.clear()
        items.clear()
        return pa.RecordBatch.from_arrays([pa.array(nodes[rows], pa.int64()), pa.array(nodes[label[rows]], pa.int64())], names=["a", "b"])

    level = np.zeros(1 << SKETCH_BITS, np.int32)  # the order of shingles is not asked for here
    for part, buf, offs in B.blocks(it, "text"):
        cols = [part.column(c).to_pylist() for c in ("lead", "one", "two", "node", "block")]
        for lead, one, two, node, block, (s, _) in zip(*cols, shingle_sets(buf, offs, size, level), strict=True):
            if (lead, one, two) != key:
                if key:
                    yield decide()
                key = (lead, one, two)
            if node not in at:  # documents that repeat a node bring the same
                at[node] = len(at)
                blocks.append(block)
                items.append(s)
    yield decide()


def _partial(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The overlap of each pair in a fragment, from the shingles that its two sets have there."""
    for batch in it:
        counts = []
        for p, q in zip(batch.column("x"), batch.column("y"), strict=True):
            p, q = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
            at = np.searchsorted(q, p)
            counts.append(int((q[np.minimum(at, len(q) - 1)] == p).sum()))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("a", "b", "na", "nb")), pa.array(counts, pa.int64())], names=["a", "b", "na", "nb", "c"])


def _by_size(inner: DataFrame, percent: int) -> DataFrame:
    """node, n, lead and the node's block in its cluster (``lead``), with the first and last block that hold sizes with which one
    of the block's own can link; nodes that are alone in a cluster are left out.

    Blocks follow the sizes of their nodes, in steps of one in ``STEP``, by a running sum of the steps' weights (a cluster has no
    more steps than there are between 1 and the largest size); within a step nodes are dealt by hash. A node weighs one, and one
    more for each ``HEAVY`` shingles, so that many large sets make more blocks.
    """
    inner = inner.withColumns({"step": F.floor(F.log("n") * STEP).cast("int"), "weight": 1 + F.floor(F.col("n") / HEAVY)})
    steps = inner.groupBy("lead", "step").agg(F.count("*").alias("many"), F.sum("weight").alias("weight"))
    ahead = Window.partitionBy("lead").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("lead")
    steps = steps.withColumns({"before": F.coalesce(F.sum("weight").over(ahead), F.lit(0)), "nodes": F.sum("many").over(whole), "all": F.sum("weight").over(whole)})
    steps = steps.filter("nodes > 1").select("lead", "step", F.col("weight").alias("span"), "before", (F.col("all") / F.ceil(F.col("all") / BLOCK)).alias("width"))
    place = F.col("before") + F.pmod(F.xxhash64("node"), F.col("span"))
    placed = inner.join(steps, ["lead", "step"]).select("node", "n", "lead", F.floor(place / F.col("width")).cast("int").alias("block"))
    bounds = placed.groupBy("lead", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    other = bounds.select("lead", F.col("block").alias("with"), F.col("least").alias("least_"), F.col("most").alias("most_"))
    meet = (100 * F.col("most") >= percent * F.col("least_")) & (100 * F.col("most_") >= percent * F.col("least"))
    reach = bounds.join(other, "lead").filter(meet).groupBy("lead", "block").agg(F.min("with").alias("low"), F.max("with").alias("high"))
    return placed.join(reach, ["lead", "block"]).select("node", "n", "lead", "block", "low", "high")


def _ceil(a: Column, b: int) -> Column:
    return -F.floor(-a / F.lit(b)).cast("long")


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles and component_id of every row: documents whose sets of ``size``-word shingles have a Jaccard
    similarity of ``percent`` % or more are linked, and component_id is the smallest id that links reach.

    Null and empty texts, and texts without a word, have an empty set, link with nothing and are their own component.
    Rows with one id are one node of the graph. A null id is carried along and never is a component's id: its component is
    that of the ids it is linked with, or null. Other columns are not read; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    B.tune(spark)
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("k1", F.xxhash64("id", "text"))
    kind = base.schema["id"].dataType.simpleString()
    # the whole sketch has 2**SKETCH_BITS numbers, whatever the input
    slices = base.select("text").mapInArrow(_sketch, "part int, counts binary").repartition(_PARTS, "part").mapInArrow(_sum_parts, "part int, counts binary")
    sketch = np.zeros((_PARTS, (1 << SKETCH_BITS) // _PARTS), np.int64)
    for r in slices.collect():
        sketch[r["part"]] = np.frombuffer(r["counts"], np.int64)
    sketch = np.minimum(sketch.ravel(), 2**31 - 1).astype(np.int32)
    load = np.sort(sketch)
    mass = np.cumsum(load, dtype=np.float64)
    # where the rarest of ``size`` words is as likely to fall below as a fragment's share of all shingles
    share = 1 - (1 - np.arange(1, FRAGMENTS) / FRAGMENTS) ** (1 / size)
    pivots = load[np.minimum(np.searchsorted(mass, mass[-1] * share), len(load) - 1)]
    held = spark.sparkContext.broadcast(sketch)
    cuts = spark.sparkContext.broadcast((sketch, np.unique(pivots)))

    survey = materialise(base.mapInArrow(partial(_survey, size, percent, held), f"id {kind}, k1 long, n long, sid long, check long, short int, tokens array<long>"), "jaccard-survey")
    # nodes: sets, told apart by 128 bits and numbered once, as written
    nodes = survey.filter("tokens is not null").groupBy("sid", "check").agg(F.min("k1").alias("k1"), F.max("n").alias("n"), F.max("short").alias("short"), F.any_value("tokens").alias("tokens"))
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "jaccard-nodes")
    rows = materialise(survey.select("id", "n", "sid", "check").join(nodes.select("sid", "check", "node"), ["sid", "check"], "left").select("id", "n", "node"), "jaccard-rows")
    discard(survey)

    prefixes = nodes.select("node", "n", "short", F.posexplode("tokens").alias("at", "token"))
    prefixes = prefixes.select("token", "node", (F.col("n") * 2 + (F.col("at") < F.col("short")).cast("int")).alias("tag"))
    leads = materialise(prefixes.groupBy("token").agg(F.min("node").alias("lead"), F.max("node").alias("hi")).filter("lead <> hi").select("token", "lead"), "jaccard-leads")
    members = materialise(prefixes.join(leads, "token"), "jaccard-members")
    discard(leads)
    size_of = F.floor(F.col("tag") / 2)
    common = lambda n: F.least(F.lit(8), F.greatest(F.lit(1), F.floor(n / 20)))  # noqa: E731  as least_common
    # a node that shares too few shingles with all others together can't link; without it, others may share fewer
    able = members.groupBy("node").agg(F.count("*").alias("c"), F.max(size_of).alias("n")).filter(F.col("c") >= common(F.floor(F.col("n") * percent / 100))).select("node")
    able = materialise(able, "jaccard-able")
    shared = members.join(able, "node").groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo <> hi").select("token", F.col("lo").alias("lead"))
    shared = materialise(shared, "jaccard-shared")
    fewer = materialise(members.drop("lead").join(able, "node").join(shared, "token"), "jaccard-members")
    discard(members, able, shared)
    members = fewer

    def homes(leading: DataFrame) -> DataFrame:
        votes = leading.groupBy("node", "lead").agg(F.count("*").alias("votes"))
        return materialise(votes.groupBy("node").agg(F.min(F.struct((-F.col("votes")).alias("votes"), "lead")).alias("best")).select("node", F.col("best.lead").alias("lead")), "jaccard-home")

    home = homes(members)
    for _ in range(2):
        # clusters that share many shingles become one: now the smallest cluster among a shingle's nodes leads
        least = materialise(members.drop("lead").join(home, "node").groupBy("token").agg(F.min("lead").alias("lead")), "jaccard-least")
        moved = homes(members.drop("lead").join(least, "token"))
        discard(home, least)
        home = moved
    # only a node that shares enough shingles with nodes of its own cluster can link there
    own = members.select("token", "node", "tag").join(home, "node")
    pairable = materialise(own.groupBy("token", "lead").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo <> hi").select("token", "lead"), "jaccard-pairable")
    inner = own.join(pairable, ["token", "lead"]).groupBy("node").agg(F.count("*").alias("c"), F.max(size_of).alias("n"), F.any_value("lead").alias("lead"))
    inner = materialise(inner.filter(F.col("c") >= common(F.floor(F.col("n") * percent / 100))).select("node", "lead", "n"), "jaccard-inner")
    blocked = materialise(_by_size(inner, percent), "jaccard-blocked")
    discard(pairable, inner)

    # pairs across clusters; a pair is led by the prefix of its shorter set
    homed = members.join(home.withColumnRenamed("lead", "cluster"), "node").select("token", "node", "cluster", size_of.alias("n"), (F.col("tag") % 2 == 1).alias("short"))
    mixed = materialise(homed.groupBy("token").agg(F.min("cluster").alias("lo"), F.max("cluster").alias("hi")).filter("lo <> hi").select("token"), "jaccard-mixed")
    homed = materialise(homed.join(mixed, "token"), "jaccard-homed")
    other = homed.select("token", *(F.col(c).alias(f"{c}_") for c in ("node", "cluster", "n", "short")))
    close = (100 * F.col("n") >= percent * F.col("n_")) & (F.col("short") & ((F.col("n") < F.col("n_")) | ((F.col("n") == F.col("n_")) & (F.col("node") < F.col("node_")))))
    pairs = homed.join(other, "token").filter((F.col("cluster") != F.col("cluster_")) & (F.col("n") <= F.col("n_")) & close)
    pairs = pairs.groupBy(F.col("node").alias("a"), F.col("node_").alias("b")).agg(F.count("*").alias("c"), F.max("n").alias("n")).filter(F.col("c") >= common(F.col("n"))).select("a", "b")
    # their whole prefixes say more: with an overlap of o, sets of n and m have so many in common among their first p and q
    one, two = (nodes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("tokens").alias(f"t{c}")) for c in ("a", "b"))
    pairs = pairs.join(one, "a").join(two, "b")
    o = _ceil(percent * (F.col("na") + F.col("nb")), 100 + percent)
    pairs = pairs.filter(F.size(F.array_intersect("ta", "tb")) >= F.least(*(F.size(f"t{c}") - F.col(f"n{c}") + o for c in ("a", "b"))))
    pairs = materialise(pairs.select("a", "b", "na", "nb"), "jaccard-pairs")
    discard(mixed, homed, members, home)

    # the texts of the nodes that may link; documents that repeat a node bring the same. A node's cluster and whether it has
    # pairs go along. Texts are exchanged and not sets, of which they are a third; the sets of a pair of blocks are made by its task
    crossing = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("crossing", F.lit(True))
    ends = materialise(nodes.select("k1", "node").join(blocked.join(crossing, "node", "full_outer"), "node"), "jaccard-ends")
    discard(nodes, blocked)
    # the whole filter has 2**FILTER_BITS bits, whatever the input
    bits = np.zeros((_PARTS, (1 << FILTER_BITS) // 8 // _PARTS), np.uint8)
    for r in ends.select("k1").mapInArrow(_hold, "part int, bits binary").repartition(_PARTS, "part").mapInArrow(_join_parts, "part int, bits binary").collect():
        bits[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    bits = bits.ravel()
    texts = base.select("k1", "text").mapInArrow(partial(_needed, spark.sparkContext.broadcast(bits)), "k1 long, text string").repartition(parts, "k1")
    segments = materialise(texts.join(ends, "k1").drop("k1").withColumnRenamed("text", "items"), "jaccard-segments")
    inside = segments.filter("lead is not null").withColumn("with", F.explode(F.sequence("low", "high")))
    inside = inside.select("lead", F.least("block", "with").alias("one"), F.greatest("block", "with").alias("two"), "node", "block", F.col("items").alias("text"))
    inside = inside.repartition(parts, "lead", "one", "two").sortWithinPartitions("lead", "one", "two").mapInArrow(partial(_clusters, size, percent), "a long, b long")
    paired = segments.filter("crossing").select("node", F.col("items").alias("text")).repartition(parts, "node").sortWithinPartitions("node")
    paired = materialise(paired.mapInArrow(partial(_segments, size, cuts), "node long, fragment int, items binary"), "jaccard-cut")
    across = pairs.join(paired.select(F.col("node").alias("a"), "fragment", F.col("items").alias("x")), "a")
    across = across.join(paired.select(F.col("node").alias("b"), "fragment", F.col("items").alias("y")), ["b", "fragment"])
    across = across.select("a", "b", "na", "nb", "x", "y").mapInArrow(_partial, "a long, b long, na long, nb long, c long").groupBy("a", "b", "na", "nb").agg(F.sum("c").alias("c"))
    across = across.filter(100 * F.col("c") >= percent * (F.col("na") + F.col("nb") - F.col("c"))).select("a", "b")
    # rows that share an id are one node
    full = rows.filter("n > 0")
    same = full.filter("id is not null").groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("hi")).filter("a <> hi").select("id", "a")
    same = full.join(same, "id").select("a", F.col("node").alias("b"))
    labels = materialise(components(inside.unionByName(across).unionByName(same)), "jaccard-labels")
    discard(pairs, ends, segments, paired)

    labelled = materialise(full.join(labels, "node", "left").select("id", "n", F.coalesce("label", "node").alias("label")), "jaccard-labelled")
    smallest = labelled.groupBy("label").agg(F.min("id").alias("component_id"))
    out = labelled.join(smallest, "label").select("id", "n", "component_id")
    out = out.unionByName(rows.filter("n = 0").select("id", "n", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def keep_first(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, of which one of each group of near duplicates stays: that of the smallest id.

    Rows that repeat that id count as copies: one of them stays. A row with a null id stays if nothing with an id is like it.
    Columns of any name are carried along.
    """
    groups = jaccard_components(docs, size, percent, id_col, text_col)
    stay = groups.filter(F.col("component_id").isNull() | (F.col(id_col) == F.col("component_id"))).select(F.col(id_col).alias("stay")).distinct()
    stay = materialise(stay, "jaccard-stay")
    base = pack(docs, id=F.col(f"`{id_col}`"))
    joined = base.join(stay, F.col("id").eqNullSafe(F.col("stay")), "left_semi")
    twice = base.groupBy("id").count().filter((F.col("count") > 1) & F.col("id").isNotNull())
    if not twice.isEmpty():
        joined = joined.filter(F.col("id").isNotNull()).dropDuplicates(["id"]).unionByName(joined.filter(F.col("id").isNull()))
    return unpack(joined)
