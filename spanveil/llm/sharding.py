"""Op 1: a consistent-hash ring with virtual nodes and bounded loads.

The ring is cut into a fixed number of cells. Each shard owns virtual nodes in cells drawn by hash; a row falls into the
cell of its hash and belongs to the next virtual node clockwise. Only the number of rows of each cell (at most ``CELLS``
numbers, whatever the input) goes to the driver. There the bounded loads are settled: rows that find their shard full
continue clockwise to the next virtual node whose shard has room. The outcome is a table of (cell, ranks, shard, first
slot) pieces, one per cell and at most two more per shard, so it is broadcast; rows find their piece by their rank
within the cell. A cell that many rows fall into, equal ones included, is ranked in ``SALTS`` parts whose sizes are added up.
No text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanveil.session import materialise

CELLS = 1 << 14
#: Parts in which a cell's rows are ranked.
SALTS = 64


def _scramble(x: int) -> int:
    x = (x * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1)
    x ^= x >> 29
    x = (x * 0xBF58476D1CE4E5B9) & (2**64 - 1)
    return x ^ (x >> 32)


def ring(shards: int, replicas: int) -> list[tuple[int, int]]:
    """(cell, shard) of the virtual nodes, clockwise; a cell that is taken sends the newcomer on to the next one.

    Nodes are placed shard by shard, so one more shard leaves those of the others where they are.
    """
    taken: dict[int, int] = {}
    for s in range(shards):
        for r in range(replicas):
            cell = _scramble((s << 20) + r) % CELLS
            while cell in taken:
                cell = (cell + 1) % CELLS
            taken[cell] = s
    return sorted(taken.items())


def settle(counts: dict[int, int], shards: int, replicas: int) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, end rank, shard, slot of the first rank): loads at most one row apart, whatever the counts.

    A shard may take floor(n / shards) rows, and those with most rows of their own one more until all n have a place.
    """
    nodes = ring(shards, replicas)
    cells = [c for c, _ in nodes]
    node_of = {}
    i = 0
    for c in range(CELLS):
        while i < len(cells) and cells[i] < c:
            i += 1
        node_of[c] = i % len(nodes)
    own = [0] * shards
    for c, n in counts.items():
        own[nodes[node_of[c]][1]] += n
    least, more = divmod(sum(counts.values()), shards)
    room = [least] * shards
    for s in sorted(range(shards), key=lambda s: (-own[s], s))[:more]:
        room[s] += 1
    used = [0] * shards
    onward = list(range(len(nodes)))

    def free(at: int) -> int:
        """The first node from ``at`` on, clockwise, whose shard has room; full ones are skipped for good."""
        path = []
        while used[nodes[at][1]] >= room[nodes[at][1]]:
            path.append(at)
            at = onward[at] if onward[at] != at else (at + 1) % len(nodes)
            if len(path) > 2 * len(nodes):
                raise AssertionError("no room left")
        for x in path:
            onward[x] = at
        return at

    pieces, waiting = [], []
    for c in sorted(counts):
        n, s = counts[c], nodes[node_of[c]][1]
        take = min(n, room[s] - used[s])
        if take:
            pieces.append((c, 0, take, s, used[s]))
            used[s] += take
        if take < n:
            waiting.append((c, take, n))
    for c, first, end in waiting:
        while first < end:
            s = nodes[free(node_of[c])][1]
            take = min(end - first, room[s] - used[s])
            pieces.append((c, first, first + take, s, used[s]))
            used[s] += take
            first += take
    return pieces


def shard(docs: DataFrame, shards: int = 40, replicas: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Puts every row into a shard by the law ``rows``: shard sizes differ by one row at most.

    Returns id, size (UTF-8 bytes of the text and 16), text_crc32, law, shard, slot (0, 1, ... within the shard) and
    grown_shard (null under this law). Null texts count as empty; rows with a null or repeated id are rows like others,
    told apart by their text; rows equal in both take slots of their cell in any order, as nothing tells them apart. However
    long a text is, it counts whole. An empty table gives an empty table. Columns other than the two named are not read.
    """
    if shards < 1 or shards * replicas > CELLS:
        raise ValueError(f"between 1 and {CELLS} virtual nodes")
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("_id"), (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    base = base.withColumn("_hash", F.xxhash64("_id", "text_crc32")).withColumn("_cell", F.pmod(F.shiftrightunsigned("_hash", 20), F.lit(CELLS)).cast("int"))
    # written once, so that a row's part of its cell stays what it is when a task is run again
    base = materialise(base.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")), "sharding-rows")
    sizes = materialise(base.groupBy("_cell", "_salt").count(), "sharding-sizes")
    counts = {r["_cell"]: r["n"] for r in sizes.groupBy("_cell").agg(F.sum("count").alias("n")).collect()}
    pieces = spark.createDataFrame(settle(counts, shards, replicas), "_at int, _first long, _end long, shard int, _slot long")
    if pieces.count() > CELLS + 2 * shards:
        raise AssertionError("more pieces than the ring can have")
    before = F.coalesce(F.sum("count").over(Window.partitionBy("_cell").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # CELLS * SALTS rows at most
    offsets = sizes.select("_cell", "_salt", before.alias("_before"))
    order = Window.partitionBy("_cell", "_salt").orderBy("_hash", "_id", "text_crc32", "size")
    ranked = base.withColumn("_rank", F.row_number().over(order)).join(offsets, ["_cell", "_salt"]).withColumn("_rank", F.col("_before") + F.col("_rank") - 1)
    out = ranked.join(F.broadcast(pieces), (F.col("_cell") == F.col("_at")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_end")))
    return out.select(
        F.col("_id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("_slot") + F.col("_rank") - F.col("_first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
