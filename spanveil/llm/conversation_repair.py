"""Conversation structure repair: the cheapest edits that make the roles of a conversation read ``(s?(ua)+)?``.

Edits of a row: Keep (0), Rerole to the role that is due (3), Delete (4; the only one for blank and repeated rows); an empty turn
of the role that is due can be put in anywhere (Insert, 3); a truncated row that stays costs 3 more. Costs to go are found
backwards over rows and grammar states; a walk forwards then takes, of the edits that are tight, the one first in ASCII.

A conversation may be as long as a third of the table, so it is cut into blocks of at most ``BLOCK`` rows. A block is known by the
4 x 4 matrix of its costs between states; costs to go pass from block to block through these, states through the exits that the
walks of a block lead to, both in streams over one small row a block. Texts take part in nothing of this: a row is known by its
digest, and texts are joined again for the lines that stay.

Rows of one turn stand in order of their digests (equal rows, and so the copies that damage makes, beside each other).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from spanveil.session import discard, materialise

#: Rows of a block, as a power of two.
BLOCK_BITS = 12
#: Characters of lines that are held before they are passed on.
PART = 1 << 20
SPACE = " \t\n\x0b\x0c\r"

# states: nothing yet, after s, after u, after a; the state that the role that is due leads to
DUE = (2, 2, 3, 2)
ROLE = ("", "", "user", "assistant")
#: Where keeping a row of role s, u, a or another leads to from each state.
GO = ((1, 2, None, None), (None, 2, None, None), (None, None, 3, None), (None, 2, None, None))
#: Costs to go at the end of a conversation.
END = (0, 6, 3, 0)
FAR = 1 << 60
FREE, TRUNCATED, GONE = range(3)

Costs = tuple[int, ...]


def before(kind: str, copies: int, after: Costs) -> Costs:
    """The costs to go before a row, from those after it; its further copies are deleted."""
    role, fate = (ord(kind) - 97) % 4, (ord(kind) - 97) // 4
    after = tuple(v + 4 * (copies - 1) for v in after)
    out = []
    for q in range(4):
        best = 4 + after[q]
        if fate != GONE:
            extra = 3 if fate == TRUNCATED else 0
            to = GO[q][role]
            best = min(best, 3 + extra + after[DUE[q]], FAR if to is None else extra + after[to])
        out.append(best)
    return tuple(min(out[q], 3 + out[DUE[q]], 6 + out[DUE[DUE[q]]]) for q in range(4))


def costs(kinds: str, copies: list[int], after: Costs) -> list[Costs]:
    """The costs to go before every row of a block and after the last."""
    out = [after]
    for k, n in zip(reversed(kinds), reversed(copies), strict=True):
        out.append(before(k, n, out[-1]))
    return out[::-1]


def matrix(kinds: str, copies: list[int]) -> list[int]:
    """The least cost from each state before a block to each state after it, row by row."""
    ends = [costs(kinds, copies, tuple(0 if p == q else FAR for p in range(4)))[0] for q in range(4)]
    return [ends[q][p] for p in range(4) for q in range(4)]


def walk(kinds: str, copies: list[int], togo: list[Costs], q: int) -> Iterator[tuple[int, str, int]]:
    """(row, letter, state after it) of the edits from state ``q`` on, D before I before K before R among the tight."""
    for i, (k, n) in enumerate(zip(kinds, copies, strict=True)):
        role, fate = (ord(k) - 97) % 4, (ord(k) - 97) // 4
        extra = 3 if fate == TRUNCATED else 0
        while True:
            left = togo[i][q] - 4 * (n - 1)
            if 4 + togo[i + 1][q] == left:
                yield i, "D", q
            elif 3 + togo[i][DUE[q]] == togo[i][q]:
                q = DUE[q]
                yield i, "I", q
                continue
            elif GO[q][role] is not None and extra + togo[i + 1][GO[q][role]] == left:
                q = GO[q][role]
                yield i, "K", q
            else:
                q = DUE[q]
                yield i, "R", q
            break


def ending(q: int) -> Iterator[int]:
    """The states that the empty turns after the last row of a conversation lead to."""
    while END[q]:
        q = DUE[q]
        yield q


def _blocks(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in it:
        for i in range(batch.num_rows):
            yield {c: batch.column(c)[i].as_py() for c in batch.schema.names}


def _rows(rows: Iterator[dict], schema: pa.Schema, size: int = 1000) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


_LONGS = pa.list_(pa.int64())


def _matrices(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        m = [matrix(k, n) for k, n in zip(batch.column("kinds").to_pylist(), batch.column("copies").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("head"), pa.array(m, _LONGS)], names=["conv", "head", "matrix"])


def _backwards(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a conversation from the last to the first: the costs to go after each."""

    def run():
        now, after = object(), END
        for r in _blocks(it):
            last = r["conv"] != now
            now, after = r["conv"], END if last else after
            yield {"head": r["head"], "last": last, "after": list(after)}
            m = r["matrix"]
            after = tuple(min(m[4 * p + q] + after[q] for q in range(4)) for p in range(4))

    return _rows(run(), pa.schema([("head", pa.int64()), ("last", pa.bool_()), ("after", _LONGS)]))


def _exits(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state after a block for each state before it."""
    for batch in it:
        out = []
        for k, n, after in zip(*(batch.column(c).to_pylist() for c in ("kinds", "copies", "after")), strict=True):
            togo = costs(k, n, tuple(after))
            ends = []
            for q in range(4):
                for _, _, to in walk(k, n, togo, q):
                    q = to
                ends.append(q)
            out.append(ends)
        names = ["conv", "head", "last", "after", "opens", "closes"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out, _LONGS)], names=[*names, "exits"])


LEGAL = {(0, 1), (1, 2), (2, 1)}


def _forwards(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a conversation from the first to the last: the state before each, and whether the roles where two blocks meet
    are out of order."""

    def run():
        now, q, role = object(), 0, None
        for r in _blocks(it):
            first = r["conv"] != now
            now, q = r["conv"], 0 if first else q
            yield {"head": r["head"], "last": r["last"], "after": r["after"], "entry": q, "broken": int(not first and (role, r["opens"]) not in LEGAL)}
            q, role = r["exits"][q], r["closes"]

    return _rows(run(), pa.schema([("head", pa.int64()), ("last", pa.bool_()), ("after", _LONGS), ("entry", pa.int64()), ("broken", pa.int64())]))


_LINE = pa.struct([("at", pa.int64()), ("sub", pa.int64()), ("role", pa.string()), ("key", pa.binary())])


def _decide(kind: pa.DataType, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit, cost and lines of each block. A line is a row that stays (``role`` null: its own) or an empty turn (``key`` null)."""

    def run():
        for r in _blocks(it):
            kinds, copies, ids, keys = r["kinds"], r["copies"], r["ids"], r["keys"]
            togo = costs(kinds, copies, tuple(r["after"]))
            audit, lines, q = [], [], r["entry"]
            for i, letter, to in walk(kinds, copies, togo, q):
                q = to
                audit.append(letter)
                if letter == "I":
                    lines.append({"at": ids[i], "sub": len(lines), "role": ROLE[q], "key": None})
                else:
                    audit.append("D" * (copies[i] - 1))
                    if letter != "D":
                        lines.append({"at": ids[i], "sub": len(lines), "role": ROLE[q] if letter == "R" else None, "key": keys[i]})
            cost = togo[0][r["entry"]] - togo[-1][q]
            for q in ending(q) if r["last"] else ():
                audit.append("I")
                cost += 3
                lines.append({"at": ids[-1], "sub": len(lines), "role": ROLE[q], "key": None})
            roles = [(ord(k) - 97) % 4 for k in kinds]
            illegal = r["broken"] + sum(n - 1 for n in copies) + sum(p not in LEGAL for p in zip(roles, roles[1:]))
            yield {"conv": r["conv"], "head": r["head"], "audit": "".join(audit), "cost": cost, "illegal": illegal, "lines": lines}

    schema = pa.schema([("conv", kind), ("head", pa.int64()), ("audit", pa.string()), ("cost", pa.int64()), ("illegal", pa.int64()), ("lines", pa.list_(_LINE))])
    return _rows(run(), schema, 100)


def _runs(kind: pa.DataType, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted lines of a partition: the digest of a conversation that surely begins and ends here and is short, and else its lines
    as parts of about ``PART`` characters. Its first and last conversation may go on in a neighbouring partition."""
    schema = pa.schema([("conv", kind), ("at", pa.int64()), ("sub", pa.int64()), ("part", pa.string()), ("sha", pa.string())])

    def out(conv, at, text, whole):
        row = {"conv": conv, "at": at[0], "sub": at[1], "part": None if whole else text, "sha": hashlib.sha256(text.encode()).hexdigest() if whole else None}
        return pa.RecordBatch.from_pylist([row], schema)

    now, held, size, start, inside = object(), [], 0, None, False
    for batch in it:
        for conv, at, sub, line in zip(*(batch.column(c).to_pylist() for c in ("conv", "at", "sub", "line")), strict=True):
            if conv != now:
                if held:
                    yield out(now, start, "\n".join(held), inside)
                inside = start is not None
                now, held, size, start = conv, [], 0, (at, sub)
            elif size > PART:
                yield out(now, start, "\n".join(held), False)
                held, size, start, inside = [], 0, (at, sub), False
            held.append(line)
            size += len(line) + 1
    if held:
        yield out(now, start, "\n".join(held), False)


def _digests(kind: pa.DataType, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted parts of conversations: their digests, a part at a time."""
    now, hashed = object(), None

    def out():
        return pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([hashed.hexdigest()])], names=["conv", "sha"])

    for batch in it:
        for i in range(batch.num_rows):
            conv, part = batch.column("conv")[i].as_py(), batch.column("part")[i].as_py()
            if conv != now:
                if hashed:
                    yield out()
                now, hashed = conv, hashlib.sha256(part.encode())
            else:
                hashed.update(b"\n" + part.encode())
    if hashed:
        yield out()


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, turn, role, text, n: the rows as a CRC of conversation and turn damages them. In it, as in role and text, null is one
    space. Rows that stand twice have n = 2."""

    def filled(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    case = F.pmod(F.crc32(F.encode(F.concat(filled(conv_col), F.lit(":"), filled(turn_col)), "UTF-8")), F.lit(20))
    text = F.when(case == 1, "").when(case == 2, F.translate(filled(text_col), ".!?", "")).otherwise(filled(text_col))
    role = F.when(case == 4, "user").otherwise(filled(role_col))
    out = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"), F.when(case == 3, 2).otherwise(1).cast("long").alias("n"), case.alias("case"))
    return out.filter("case <> 0").drop("case")


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows with ``key`` (a digest of all that is in them), ``same`` (of conversation, role and text) and ``kind``."""
    text = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    conv, turn = F.coalesce(F.col("conv").cast("string"), F.lit("-")), F.coalesce(F.col("turn").cast("string"), F.lit("-"))
    last = F.right(F.rtrim(F.col("text"), F.lit(SPACE)), F.lit(1))
    role = F.when(F.substring("role", 1, 1) == "s", 0).when(F.substring("role", 1, 1) == "u", 1).when(F.substring("role", 1, 1) == "a", 2).otherwise(3)
    fate = F.when(last == "", GONE).when(last.isin(".", "!", "?"), FREE).otherwise(TRUNCATED)
    return rows.withColumns({"key": F.unhex(F.sha2(F.concat_ws(":", conv, turn, text), 256)), "same": F.unhex(F.sha2(F.concat_ws(":", conv, text), 256)), "role_kind": role, "fate": fate})


def repair(rows: DataFrame) -> DataFrame:
    """conv, turns (distinct, without null), low, high (of the turns), blank, duplicate, truncated, illegal, cost, audit and
    repaired_sha256 of every conversation of ``rows`` (conv, turn, role, text, n).

    Rows are read by turn, null first, those of one turn by their digests; equal rows are repeats of the first. A role without a
    first letter, or with another than s, u and a, can't be kept, only replaced or deleted. A null conversation is one like
    others. Very long texts are moved, never held together; a conversation's audit is one string, and its lines pass through
    one task, a part at a time. An empty table gives an empty table. Other columns aren't read.
    """
    keyed = _keyed(rows)
    spots = keyed.groupBy("conv", "turn", "key", "same", "role_kind", "fate").agg(F.sum("n").alias("n"))
    spots = spots.repartitionByRange("conv", "turn", "key").sortWithinPartitions("conv", "turn", "key").withColumn("id", F.monotonically_increasing_id())
    spots = materialise(spots, "turns")
    firsts = spots.groupBy("same").agg(F.min("id").alias("id")).select("id", F.lit(True).alias("first"))
    read = spots.join(firsts, "id", "left").withColumn("first", F.coalesce("first", F.lit(False)))

    conv = spots.schema["conv"].dataType.simpleString()
    held = to_arrow_type(spots.schema["conv"].dataType)
    kind = F.chr(97 + F.col("role_kind") + 4 * F.when(F.col("first"), F.col("fate")).otherwise(GONE))
    rows_ = F.sort_array(F.collect_list(F.struct("id", kind.alias("kind"), "n", "key", "role_kind", "fate", "first")))
    blocks = read.groupBy("conv", F.shiftright("id", BLOCK_BITS).alias("block")).agg(rows_.alias("r"))

    def total(value) -> Column:
        return F.aggregate("r", F.lit(0).cast("long"), lambda a, x: a + value(x))

    blocks = blocks.select(
        "conv", F.col("r")[0]["id"].alias("head"), F.array_join("r.kind", "").alias("kinds"), F.col("r.n").alias("copies"), F.col("r.id").alias("ids"), F.col("r.key").alias("keys"),
        F.col("r")[0]["role_kind"].cast("long").alias("opens"), F.element_at("r", -1)["role_kind"].cast("long").alias("closes"),
        total(lambda x: F.when(x["fate"] == GONE, x["n"]).otherwise(0)).alias("blank"),
        total(lambda x: F.when(x["fate"] == GONE, 0).otherwise(x["n"] - x["first"].cast("long"))).alias("duplicate"),
        total(lambda x: F.when((x["fate"] == TRUNCATED) & x["first"], 1).otherwise(0)).alias("truncated"),
    )
    blocks = materialise(blocks, "turn-blocks")

    costs_ = blocks.select("conv", "head", "kinds", "copies").mapInArrow(_matrices, f"conv {conv}, head long, matrix array<long>")
    togo = costs_.repartition("conv").sortWithinPartitions("conv", F.desc("head")).mapInArrow(_backwards, "head long, last boolean, after array<long>")
    exits = blocks.join(togo, "head").select("conv", "head", "kinds", "copies", "last", "after", "opens", "closes")
    exits = exits.mapInArrow(_exits, f"conv {conv}, head long, last boolean, after array<long>, opens long, closes long, exits array<long>")
    states = exits.repartition("conv").sortWithinPartitions("conv", "head").mapInArrow(_forwards, "head long, last boolean, after array<long>, entry long, broken long")
    lines = "array<struct<at:bigint,sub:bigint,role:string,key:binary>>"
    decided = blocks.join(states, "head").select("conv", "head", "kinds", "copies", "ids", "keys", "last", "after", "entry", "broken")
    decided = materialise(decided.mapInArrow(partial(_decide, held), f"conv {conv}, head long, audit string, cost long, illegal long, lines {lines}"), "turn-edits")

    line = decided.select("conv", F.explode("lines").alias("l")).select("conv", "l.*")
    texts = keyed.groupBy("key").agg(F.first(F.struct("role", "text")).alias("t"))
    stay = line.filter("key IS NOT NULL").join(texts, "key").select("conv", "at", "sub", F.concat(F.coalesce("role", "t.role"), F.lit(":"), F.col("t.text")).alias("line"))
    put_in = line.filter("key IS NULL").select("conv", "at", "sub", F.concat("role", F.lit(":")).alias("line"))
    runs = stay.unionByName(put_in).repartitionByRange("conv", "at", "sub").sortWithinPartitions("conv", "at", "sub")
    runs = materialise(runs.mapInArrow(partial(_runs, held), f"conv {conv}, at long, sub long, part string, sha string"), "turn-lines")
    parts = runs.filter("part IS NOT NULL").select("conv", "at", "sub", "part").repartition("conv").sortWithinPartitions("conv", "at", "sub")
    digests = runs.filter("sha IS NOT NULL").select("conv", "sha").unionByName(parts.select("conv", "part").mapInArrow(partial(_digests, held), f"conv {conv}, sha string"))

    turns = spots.groupBy("conv", "turn").agg(F.lit(1)).groupBy("conv").agg(F.count("turn").alias("turns"), F.min("turn").alias("low"), F.max("turn").alias("high"))
    # one row for each source of a conversation's figures, put together by a group, which takes a null conversation as any other
    figures = turns.unionByName(digests, True).unionByName(blocks.select("conv", "blank", "duplicate", "truncated"), True)
    figures = figures.unionByName(decided.select("conv", "illegal", "cost", F.struct("head", "audit").alias("edits")), True)
    out = figures.groupBy("conv").agg(
        *(F.max(c).alias(c) for c in ("turns", "low", "high", "sha")),
        *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")),
        F.array_join(F.transform(F.sort_array(F.collect_list("edits")), lambda x: x["audit"]), "").alias("audit"),
    )
    out = materialise(out.withColumn("repaired_sha256", F.coalesce("sha", F.sha2(F.lit(""), 256))).drop("sha"), "repaired")
    discard(spots, blocks, decided, runs)
    return out


def repair_damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The report of ``repair`` on the damaged rows for every conversation of ``rows``; one that lost all rows has zeros, no edits
    and the digest of nothing."""
    found = repair(damage(rows, conv_col, turn_col, role_col, text_col))
    all_ = rows.select(F.col(conv_col).alias("conv")).distinct()
    both = all_.join(found.withColumnRenamed("conv", "c"), F.col("conv").eqNullSafe(F.col("c")), "left")
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).cast("long")
    counts = (F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost"))
    return both.select(F.col("conv").alias(conv_col), gaps.alias("gaps"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
