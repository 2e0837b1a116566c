import random
import re

import pytest

from spanveil.llm import jaccard_join
from spanveil.llm.jaccard_join import jaccard_components, keep_first


def brute(rows, size, percent):
    sets = []
    for i, t in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append((i, {tuple(w[j : j + size]) for j in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())))
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            (i, a), (j, b) = sets[x], sets[y]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in sets}


def corpus(seed, near=40):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(80)] + ["The", "THE", "É", "é"]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    out = [text(rng.randint(0, 80)) for _ in range(60)]
    line = text(12)
    out += [text(4) + line + text(3) for _ in range(25)]
    base = text(70)
    for _ in range(near):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        out.append(w)
    out += [out[3], out[5], base, base, [x.upper() for x in base], [], ["a"], ["A"], ["a", "b"]]
    return [" ".join(w) for w in out]


@pytest.mark.parametrize(("size", "percent", "block"), [(4, 85, 512), (5, 80, 8)])
def test_equals_brute_force(spark, monkeypatch, size, percent, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = list(enumerate(corpus(size))) + [(1000, None), (1001, " \n")]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, id string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df, size, percent).collect()}
    assert got == brute(rows, size, percent)


def test_keep_first_and_edges(spark):
    t = "one two three four five six seven eight nine ten"
    df = spark.createDataFrame([(3, t, "a"), (2, t, "b"), (2, t, "c"), (9, "other words " * 5, "d"), (None, t, "e"), (None, "x y z", "f"), (5, None, "g")], "doc_id long, text string, lang string")
    out = keep_first(df)
    assert out.columns == df.columns
    got = out.collect()
    assert sorted(str(r.doc_id) for r in got) == ["2", "5", "9", "None", "None"]
    assert jaccard_components(df.limit(0)).collect() == []


def test_cut_sets_are_exchanged_once(spark, monkeypatch):
    rng = random.Random(7)
    rows = []
    for i in range(200):
        words = [f"{rng.getrandbits(40):x}" for _ in range(400)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:-1], "other"]))]
    sc = spark.sparkContext._jsc.sc()
    figures = {}

    def written():
        sc.listenerBus().waitUntilEmpty(20_000)
        machines = sc.statusStore().executorList(True)
        return sum(machines.apply(i).totalShuffleWrite() for i in range(machines.size()))

    def spied(df, label="step", f=jaccard_join.materialise):
        out = f(df, label)
        if label == "jaccard-segments":
            figures["items"] = sum(len(r["items"]) for r in out.select("items").collect())
        return out

    def components(edges, f=jaccard_join.components):
        before = written()
        edges.collect()
        figures["exchanged"] = written() - before
        return f(edges)

    monkeypatch.setattr(jaccard_join, "materialise", spied)
    monkeypatch.setattr(jaccard_join, "components", components)
    joins = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as on tables too large to broadcast
    try:
        got = {r.doc_id: r.component_id for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", joins)
    assert got == {i: i - i % 2 for i in range(400)}
    assert 0 < figures["exchanged"] < 1.25 * figures["items"]


def test_blocks_follow_sizes(spark):
    # documents of many sizes in one cluster, as those that share a passage: most can't link, so most blocks needn't meet
    rows = [(i, 40 + i, 7) for i in range(6000)] + [(6000, 40, 8)]
    got = jaccard_join._by_size(spark.createDataFrame(rows, "node long, n long, lead long"), 85).collect()
    assert len(got) == 6000 and all(r.low <= r.block <= r.high for r in got)
    at = {r.n: r for r in got}
    assert all(at[n].low <= at[m].block <= at[n].high for n in at for m in (n * 85 // 100 + 1, n - 1, n + 1, n * 100 // 85) if m in at)
    blocks = max(r.block for r in got) + 1
    assert blocks >= 6000 / jaccard_join.BLOCK and sum(r.high - r.low + 1 for r in got) < 0.5 * blocks * len(got)


def test_what_links_need_is_kept_as_texts(spark, monkeypatch):
    rows = [(i, " ".join(f"{(i // 2) * 7919 + j:x}" for j in range(400 - i % 2))) for i in range(200)]
    spark.createDataFrame([(1,)], "a int").count()
    kept = []

    def spied(df, label="step", f=jaccard_join.materialise):
        out = f(df, label)
        if label == "jaccard-segments":
            kept.append(sum(len(r["items"]) for r in out.collect()))
        return out

    monkeypatch.setattr(jaccard_join, "materialise", spied)
    got = {r.doc_id: r.component_id for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()}
    assert got == {i: i - i % 2 for i in range(200)}
    assert kept and kept[0] <= sum(len(t) for _, t in rows) < 8 * 200 * 396
