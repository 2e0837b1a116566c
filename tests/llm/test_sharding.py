import zlib
from collections import Counter

from pyspark.sql import functions as F

from spanveil.llm.sharding import CELLS, ring, settle, shard


def test_one_more_shard_moves_no_other_node():
    before, after = dict(ring(7, 20)), dict(ring(8, 20))
    assert all(after[c] == s for c, s in before.items())
    assert sum(s == 7 for s in after.values()) == 20


def test_settle_any_counts():
    for counts in ({5: 1000}, {i: i % 7 for i in range(CELLS)}, {0: 3}, {}):
        pieces = settle({k: v for k, v in counts.items() if v}, 9, 16)
        load = Counter()
        for _, a, b, s, slot in pieces:
            assert slot == load[s] and a < b
            load[s] += b - a
        n = sum(counts.values())
        assert sum(load.values()) == n
        assert max(load.values(), default=0) - min((load[s] for s in range(9)), default=0) <= 1


def test_limited_movement():
    """Most rows sit on the shard of their own virtual node."""
    counts = {c: 3 for c in range(CELLS)}
    nodes = ring(20, 64)
    pieces = settle(counts, 20, 64)
    cells = sorted(dict(nodes))
    own = dict(nodes)
    home = lambda c: own[next((x for x in cells if x >= c), cells[0])]
    stay = sum(b - a for c, a, b, s, _ in pieces if home(c) == s)
    assert stay / (3 * CELLS) > 0.85


def test_rows(spark):
    rows = [(i, "é" * (i % 5), 1) for i in range(500)] + [(None, None, 2)] * 3 + [(7, "same", 3)] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string, size int").repartition(3)
    out = shard(df, 8).collect()
    assert len(out) == len(rows)
    loads = Counter(r.shard for r in out)
    assert max(loads.values()) - min(loads.values()) <= 1 and len(loads) == 8
    for s in loads:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(loads[s]))
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == want
    assert {r.law for r in out} == {"rows"} and {r.grown_shard for r in out} == {None}
    assert shard(df.limit(0), 8).collect() == []


def brute(cells, shards, replicas):
    """(cell, shard) of every row, one row after the other: first those that fit their own shard, then the rest clockwise."""
    nodes = ring(shards, replicas)
    at = lambda cell: next((i for i, (c, _) in enumerate(nodes) if c >= cell), 0)
    own = Counter(nodes[at(c)][1] for c in cells)
    least, more = divmod(len(cells), shards)
    room = {s: least for s in range(shards)}
    for s in sorted(range(shards), key=lambda s: (-own[s], s))[:more]:
        room[s] += 1
    out, waiting = Counter(), []
    for c in sorted(cells):
        s = nodes[at(c)][1]
        if room[s]:
            room[s] -= 1
            out[c, s] += 1
        else:
            waiting.append(c)
    for c in waiting:
        i = at(c)
        while not room[nodes[i % len(nodes)][1]]:
            i += 1
        room[nodes[i % len(nodes)][1]] -= 1
        out[c, nodes[i % len(nodes)][1]] += 1
    return out


def test_equals_brute_force(spark):
    rows = [(i, f"text {i % 37}", "x") for i in range(400)] + [(5, "copy", "y")] * 300 + [(9, "long " * 100_000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _cell string").repartition(4)
    out = shard(df, 7, 16)
    cell = F.pmod(F.shiftrightunsigned(F.xxhash64("doc_id", "text_crc32"), 20), F.lit(CELLS)).cast("int")
    got = out.withColumn("cell", cell).collect()
    assert Counter((r.cell, r.shard) for r in got) == brute([r.cell for r in got], 7, 16)
    assert sorted((r.shard, r.slot) for r in got) == [(s, i) for s in range(7) for i in range(Counter(r.shard for r in got)[s])]
