"""Op 5 [native]: line dedup by a log-template tree of fixed depth.

A line goes down the tree by its number of tokens (level 1) and its ``LEAD`` leading tokens (level 2), tokens with a digit
counting as a variable field. Every template of a line holds both, so a leaf that fewer lines than ``FEWEST`` reach can't
recur: its lines are pruned before any template is made. In the leaves that are left, a template is the whole line with its
variable fields open, or the line with one of three segments behind the leading tokens left open as well, which generalises
fields that vary without digits.

How many different texts a template needs to recur depends on its length: a whole line of n tokens recurs in
``max(2, ceil(weight / n))`` texts, so that a passage is dropped from its second text on and a word or two need many; a line
with an open segment needs ``min_docs``. Lines of recurring templates are dropped, and one copy stays, in the document of the
smallest id, so that no content is lost.

Only hashes are shuffled, first combined by template; text is joined once, with the line numbers to drop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.llm.carried import pack
from spanveil.session import discard, materialise

#: A token with a digit; it can only begin where a token begins, which keeps the search linear.
_VARIABLE = r"(?<![^\x20])[^\x20\n0-9]*+[0-9][^\x20\n]*+"
LEAD = 3
OPEN = "<*>"
#: Fewer lines than this never recur.
FEWEST = 2
#: Lines with fewer tokens have no template with an open segment.
SEGMENTED = 8


def plain(text: Column) -> Column:
    """The text with its lines' tokens one space apart, which is how templates see it; most texts are so already."""
    odd = text.rlike(r"[\t\x0B-\r]|\x20[\x20\n]|\n\x20|^\x20|\x20$")
    apart = F.regexp_replace(text, r"[\t\x0B-\r\x20]+", " ")
    return F.when(odd, F.regexp_replace(apart, r"(?m)(?<=^|\n)\x20|\x20(?=\n|\z)", "")).otherwise(text)


def masked(line: Column) -> Column:
    """Tokens with a digit become open fields."""
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, _VARIABLE, OPEN)).otherwise(line)


def tokens_in(line: Column) -> Column:
    """The number of tokens of a plain line."""
    return F.when(line == "", 0).otherwise(F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1)


def _first(line: Column, n: Column) -> Column:
    return F.call_function("substring_index", line, F.lit(" "), n)


def leaf(line: Column, n: Column) -> Column:
    """The leaf of a plain line: by its number of tokens and the leading ones."""
    return F.xxhash64(n, masked(_first(line, F.lit(LEAD))))


def templates(line: Column, n: Column, weight: int, min_docs: int) -> Column:
    """(key, needs) of the templates of a masked line: one if it is under ``SEGMENTED`` tokens, else four."""
    rest = n - LEAD
    one, two = F.floor(rest / 3).cast("int"), F.floor(2 * rest / 3).cast("int")
    to_one, to_two = _first(line, one + LEAD), _first(line, two + LEAD)
    after = lambda front: F.substring(line, F.length(front) + 2, F.length(line))
    row = lambda needs, *parts: F.struct(F.xxhash64(n, *parts).alias("key"), F.lit(needs).cast("int").alias("needs") if isinstance(needs, int) else needs.cast("int").alias("needs"))
    whole = row(F.greatest(F.lit(FEWEST), F.ceil(F.lit(weight) / n)), F.lit(0), line)
    opened = (row(min_docs, F.lit(1), _first(line, F.lit(LEAD)), after(to_one)), row(min_docs, F.lit(2), to_one, after(to_two)), row(min_docs, F.lit(3), to_two))
    return F.when(n < SEGMENTED, F.array(whole)).otherwise(F.array(whole, *opened))


def drop_lines(docs: DataFrame, min_docs: int = 10, weight: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns, the text without the lines of recurring templates, and n_lines and n_dropped (long).

    Lines are what ``\\n`` separates; the others stay as they are, in order. Texts that are equal count as one document
    when templates are counted, and keep equal lines; so do repeated rows. Null texts stay null and have no lines; empty
    ones have one line. A line without a token has no template and stays. The copy that stays is that of the smallest id
    (null ids first; then by hash). Columns named like the two new ones are replaced; any other names are left alone. An
    empty table gives an empty table.
    """
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    base = pack(docs.select(*(F.col(f"`{c}`") for c in kept)), without=text_col, id=F.col(f"`{id_col}`"), text=F.col(f"`{text_col}`").cast("string"))
    text = F.col("text")
    base = base.withColumns({"th": F.xxhash64("text"), "t2": F.xxhash64("text", F.lit(7))})
    lines = base.filter(text.isNotNull()).select("id", "th", "t2", F.posexplode(F.split(plain(text), "\n")).alias("at", "line")).filter("line <> ''")
    lines = lines.withColumn("n", tokens_in(F.col("line")))
    lines = lines.withColumn("leaf", leaf(F.col("line"), F.col("n")))

    # down the tree: lines of a leaf that few reach are pruned
    busy = materialise(lines.groupBy("leaf").agg(F.count("*").alias("c")).filter(F.col("c") >= FEWEST).select("leaf"), "lines-busy")
    left = lines.join(busy, "leaf").withColumn("line", masked(F.col("line")))
    rows = left.select("id", "th", "t2", "at", F.explode(templates(F.col("line"), F.col("n"), weight, min_docs)).alias("t")).select("id", "th", "t2", "at", "t.*")
    rows = materialise(rows, "lines-rows")
    # distinct texts by template; then the first place, which stays
    pairs = rows.groupBy("key", "needs", "th", "t2").agg(F.min("id").alias("id"), F.max(F.col("id").isNull()).alias("none"))
    first = F.min(F.struct(~F.col("none"), "id", "th", "t2")).alias("first")
    recurring = pairs.groupBy("key", "needs").agg(F.count("*").alias("c"), first).filter(F.col("c") >= F.col("needs"))
    recurring = materialise(recurring.select("key", F.col("first.th").alias("th1"), F.col("first.t2").alias("t21")), "lines-recurring")
    gone = rows.join(recurring, "key").filter((F.col("th") != F.col("th1")) | (F.col("t2") != F.col("t21")))
    gone = materialise(gone.groupBy("th", "t2").agg(F.collect_set("at").alias("gone")), "lines-gone")
    discard(busy, rows, recurring)

    joined = base.join(gone, ["th", "t2"], "left")
    lines = F.split(text, "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    new = F.when(F.col("gone").isNull() | text.isNull(), text).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    n_lines = F.when(text.isNull(), 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    given = [new.alias(c) if c == text_col else F.col(f"row.`{c}`") for c in kept]
    return joined.select(*given, n_lines.alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))
