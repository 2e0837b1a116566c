import random

from spanveil.llm import decontaminate
from spanveil.llm.decontaminate import DRIFT, NAMED, PLAIN, canonical, consistent, contaminated, remove_contaminated

ITEM = "Yesterday Tom Miller bought 12 apples for 3 dollars each, then gave 4 apples to Anna before Tom Miller paid for the 12 apples. How much is left?"
AGAIN = "Filler words before. Yesterday Bob bought 15 apples for 7 euros each, then gave 9 apples to Carla Smith before Bob paid for the 15 apples. How much is left? And more."
WRONG = "Yesterday Bob bought 15 apples for 7 euros each, then gave 9 apples to Carla before Peter paid for the 88 apples. How much is left?"


def test_canonical():
    text = "It cost Mr. Tom Miller 3.50 dollars (or 4%) in May 2020."
    tokens, slots, ranges = canonical(text)
    assert tokens == ["<name>", "cost", "<name>", "<name>", "<num>", "<unit>", "or", "<num>", "in", "<name>", "<num>"]
    assert slots[3] == "tom miller" and slots[4] == "3.50" and len(ranges) == len(tokens)
    assert canonical(text, PLAIN)[0] == ["it", "cost", "mr", "tom", "miller", "<num>", "<unit>", "or", "<num>", "in", "may", "<num>"]


NAMES = "Tom has 5 apples. Tom gives 2 apples to Eve. Tom keeps the other apples. How many apples has Tom now?"


def test_names_at_the_start_lowered_copies_and_repeated_items(spark):
    bench = spark.createDataFrame([("a", NAMES), ("a", "the second text of one item has other words in it"), ("a", NAMES), ("b", "Stand still now")], "item_id string, text string")
    rows = [(1, NAMES.replace("Tom", "Bob").replace("Eve", "Ann").replace("5", "9")), (2, NAMES.lower()), (3, NAMES.upper()), (4, "so the second text of one item has other words in it too")]
    rows += [(5, "they said: Stand still now, please"), (6, NAMES.replace("Tom keeps", "Bob keeps").replace("has Tom", "has Bob").replace("5", "7").replace("2", "3"))]
    rows += [(7, "Bob has 5 pears. Eve sells 2 boats to Tom. Ann keeps the other door. How long is it now?"), (8, (NAMES + " ") * 3000), (9, "word " * 60_000)]
    docs = spark.createDataFrame(rows + [rows[3]], "doc_id long, text string")
    want = [(1, "a"), (2, "a"), (3, "a"), (4, "a"), (4, "a"), (5, "b"), (6, "a"), (8, "a")]  # 6: all but two words are as they were
    assert sorted((r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()) == want


def brute(docs, items, width=8, share=0.6):
    """Every text of every item against every document, in both readings, by comparing windows as lists."""
    out = set()
    for i, t in docs:
        for item, text in items:
            for reading in (PLAIN, NAMED):
                a, va, _ = canonical(text or "", reading)
                b, vb, _ = canonical(t or "", reading)
                size = min(width, len(a))
                hits = [(q, p) for q in range(len(a) - size + 1) for p in range(len(b) - size + 1) if size and a[q : q + size] == b[p : p + size]]
                for centre in {p - q for q, p in hits}:
                    mine = {}
                    for q, p in sorted(hits, key=lambda x: abs(x[1] - x[0] - centre)):
                        if abs(p - q - centre) <= DRIFT:
                            mine.setdefault(q, p)
                    covered = {(q + j, p + j) for q, p in mine.items() for j in range(size)}
                    if len({q for q, _ in covered}) >= share * len(a) and consistent([va[q] for q, _ in sorted(covered)], [vb[p] for _, p in sorted(covered)]):
                        out.add((i, item))
    return out


def test_equals_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["alpha", "Beta", "gamma", "Delta", "12", "7", "km", "hours", "Epsilon", "zeta.", "eta", "é", "Theta?", "iota", "kappa", "lambda"]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(make(rng.randint(1, 40)))) for k in range(25)]
    docs = []
    for i in range(120):
        words = items[rng.randrange(len(items))][1].split()
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(words))
            words[at : at + rng.randint(0, 1)] = rng.choice([[], ["Bob"], ["99"], ["other"]])
            words = words or ["x"]
        docs.append((i, " ".join(make(rng.randint(0, 20)) + words + make(rng.randint(0, 20)))))
    schema = "{0} long, text string"
    out = contaminated(spark.createDataFrame(docs, schema.format("doc_id")).repartition(2), spark.createDataFrame(items, schema.format("item_id")))
    want = brute(docs, items)
    assert {(r.doc_id, r.item_id) for r in out.collect()} == want and len(want) > 60


def test_reparameterised(spark, monkeypatch):
    bench = spark.createDataFrame([(1, ITEM), (2, "short item"), (3, None), (None, "x"), (4, "")], "item_id long, text string")
    rows = [(1, f"a b c. {ITEM} d e f."), (2, AGAIN), (3, WRONG), (4, "Something else entirely with 12 apples and Tom Miller."), (5, None), (6, ""), (None, AGAIN), (7, "short item"), (8, "a short item")]
    docs = spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id long, text string, item_id long")
    for block in (200_000, 10):
        monkeypatch.setattr(decontaminate, "BLOCK", block)
        got = {(r.doc_id, r.item_id): r.verbatim for r in contaminated(docs, bench).collect()}
        assert got == {(1, 1): True, (2, 1): False, (None, 1): False, (7, 2): True, (8, 2): True}
    left = remove_contaminated(docs, bench)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [3, 4, 5, 6]
    assert contaminated(docs.limit(0), bench).collect() == [] and contaminated(docs, bench.limit(0)).collect() == []


def test_words_put_in_or_left_out(spark):
    item = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40))
    words = item.split()
    rows = [(1, " ".join(words[:20] + ["extra"] + words[20:])), (2, " ".join(words[:18] + words[20:])), (3, " ".join(words[:15])), (4, " ".join(reversed(words)))]
    docs = spark.createDataFrame([(i, f"lead in {t} and out") for i, t in rows], "doc_id long, text string")
    got = contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == [1, 2]


def test_every_verbatim_item_is_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    items = [(r.item_id, " ".join(r.text.split())) for r in bench.collect()]
    want = {(r.doc_id, i) for r in docs.collect() for i, t in items if t in " ".join(r.text.split())}
    got = {(r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()}
    print(len(want), len(got), sorted(got - want)[:10])
    assert want <= got and len(got) < len(want) + 15
