"""Phrases of a lexicon in texts by a hash join of word n-grams, and what the packs' terms say about the text around them.

A text's words become rows only where a word begins some phrase at all (a hash set of bounded size); from each of these the n-grams
up to the longest phrase are joined. Overlapping phrases are settled island by island, the longest first. Labels and negative terms are looked for by windows
over a text's phrases, so nothing is paired with everything.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanveil.functions.spans import let, sums_before
from spanveil.rules.lexica import PACKS, Pack

WORD = r"[\p{L}\p{N}]+(?:[-'][\p{L}\p{N}]+)*"
#: First words of phrases; so many go with the plan, as a hash set.
MOST_FIRSTS = 100_000
#: Characters within which a label raises and a negative term drops a term.
NEAR = 48


def phrase_key(term: Column, normal: Callable[[Column], Column] = F.lower) -> Column:
    """The normalised words of a phrase."""
    return F.transform(F.regexp_extract_all(term, F.lit(WORD), F.lit(0)), normal)


def lexicon_table(spark: SparkSession, packs: Sequence[Pack] = PACKS) -> DataFrame:
    """(pack, kind, category, words): the terms of the packs; words are lower-cased."""
    rows = [(p.id, *t) for p in packs for t in p.terms()]
    return spark.createDataFrame(rows, "pack string, kind string, category string, term string").select("pack", "kind", "category", phrase_key(F.col("term")).alias("words"))


def find_phrases(docs: DataFrame, lexicon: DataFrame, normal: Callable[[Column], Column] = F.lower, id_col: str = "doc_id", text_col: str = "text", per: Sequence[str] = (), reach: int = 0) -> DataFrame:
    """(id, s, e, value, and the columns of ``lexicon`` but ``words``) of the phrases that stand in the texts; with ``reach``,
    also ``after``, so many characters behind a phrase. Texts are read once.

    Of overlapping phrases (with equal ``per`` columns of the lexicon, such as its pack) the longest in words stays, of equals the
    leftmost; equal spans that are several entries all stay. Null texts have none; ids have to tell texts apart.
    """
    entries = lexicon.withColumns({"n": F.size("words"), "key": F.array_join("words", " "), "first": F.get("words", F.lit(0))}).drop("words").filter("n > 0")
    firsts = [r["first"] for r in entries.select("first").distinct().limit(MOST_FIRSTS + 1).collect()]
    if len(firsts) > MOST_FIRSTS:
        raise ValueError(f"a lexicon whose phrases begin with more than {MOST_FIRSTS} words is no dictionary")
    longest = entries.agg(F.max("n")).first()[0] or 0
    text = F.col(text_col)

    none = F.array().cast("array<struct<s:int,ends:array<int>,words:array<string>,said:string>>")

    def ahead(w: Column) -> Column:
        """Each word that begins a phrase, with the ends and normalised forms of those that a phrase from there can hold, and
        their text. Only these words' places are summed up."""
        begins = F.array_compact(F.transform(w, lambda x, i: F.when(normal(x).isin(*firsts), i)))

        def rows(at: Column, between: Column) -> Column:
            def placed(before: Callable[[Column], Column]) -> Column:
                def row(i: Column) -> Column:
                    some = F.slice(w, i + 1, F.lit(longest))
                    start = lambda k: before(k) + F.length(F.get(between, k))
                    return let(F.transform(some, lambda y, k: start(i + k) + F.length(y)), lambda ends: let(start(i), lambda first: said(some, ends, first)))

                return F.transform(at, row)

            return sums_before(F.transform(w, lambda m, i: F.length(F.get(between, i)) + F.length(m)), placed)

        return let(begins, lambda at: F.when(F.size(at) > 0, let(F.split(text, WORD, -1), lambda between: rows(at, between))).otherwise(none))

    def said(some: Column, ends: Column, s: Column) -> Column:
        whole = F.substring(text, s + 1, F.element_at(ends, -1) - s + reach)
        return F.struct(s.alias("s"), ends.alias("ends"), F.transform(some, normal).alias("words"), whole.alias("said"))

    if not longest:
        return docs.limit(0).crossJoin(lexicon.limit(0)).select(F.col(id_col), F.lit(0).alias("s"), F.lit(0).alias("e"), F.lit("").alias("value"), *([F.lit("").alias("after")] if reach else []), *(c for c in lexicon.columns if c != "words"))
    rows = docs.select(F.col(id_col).alias("id"), F.explode(let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), ahead)).alias("x")).select("id", "x.*")
    grams = F.array(*(F.struct(F.lit(n).alias("n"), F.array_join(F.slice("words", 1, n), " ").alias("key")) for n in range(1, longest + 1)))
    rows = rows.select("id", "s", "ends", "said", F.explode(grams).alias("g")).filter(F.col("g.n") <= F.size("ends"))
    rows = rows.select("id", "s", F.get("ends", F.col("g.n") - 1).alias("e"), "said", F.col("g.n").alias("n"), F.col("g.key").alias("key"))
    wide = F.col("e") - F.col("s")
    rows = rows.withColumns({"value": F.substring("said", F.lit(1), wide)} | ({"after": F.substring("said", wide + 1, F.lit(reach))} if reach else {}))
    kept = _longest_first(rows.drop("said").join(entries.drop("first"), ["n", "key"]), ("id", *per))
    return kept.select(F.col("id").alias(id_col), "s", "e", "value", *(["after"] if reach else []), *(c for c in lexicon.columns if c != "words"))


def _longest_first(hits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The hits that stay; what else a span's hits hold goes along with it, so that they are found only once."""
    rest = [c for c in hits.columns if c not in (*keys, "s", "e", "n")]
    spans = hits.groupBy(*keys, "s", "e", "n").agg(F.collect_list(F.struct(*rest)).alias("rest"))
    before = Window.partitionBy(*keys).orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*keys).orderBy("s", "e").rowsBetween(Window.unboundedPreceding, 0)
    marked = spans.withColumn("_new", F.coalesce(F.col("s") >= F.max("e").over(before), F.lit(True)).cast("int")).withColumn("_island", F.sum("_new").over(upto))
    order = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("rank"), "s", "e", "rest")))
    fold = F.aggregate("_all", F.filter("_all", lambda x: F.lit(False)), lambda held, x: F.when(F.exists(held, lambda h: (h["s"] < x["e"]) & (x["s"] < h["e"])), held).otherwise(F.array_append(held, x)))
    kept = marked.groupBy(*keys, "_island").agg(order.alias("_all")).select(*keys, F.explode(fold).alias("_x"))
    return kept.select(*keys, "_x.s", "_x.e", F.explode("_x.rest").alias("_r")).select(*keys, "s", "e", "_r.*")


def lexicon_findings(docs: DataFrame, lexicon: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pack, category, s, e, value, confidence): sensitive terms, and names behind an honorific or a context of names.

    A bare label is never found. A term, or name, with a label of its category (for names: ``name``) in the ``NEAR`` characters
    before it is of medium confidence, else low. One with a negative term as near on either side, or that is one, is none.
    """
    hits = find_phrases(docs, lexicon, id_col=id_col, text_col=text_col, per=("pack", "kind"), reach=120).withColumnRenamed(id_col, "id")
    lead = F.col("kind").isin("honorific", "context")
    name = F.regexp_extract("after", r"^(?:\.?[ \t]+|:[ \t]*)(\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)*(?:[ \t]\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)*){0,2})", 1)
    gap = F.length(F.regexp_extract("after", r"^(?:\.?[ \t]+|:[ \t]*)", 0))
    # a lead gives way to the name behind it; labels and negative terms are marks
    read = hits.withColumn("value", F.when(lead, name).otherwise(F.col("value"))).filter("value <> ''")
    read = read.withColumn("s", F.when(lead, F.col("e") + gap).otherwise(F.col("s"))).withColumn("e", F.when(lead, F.col("s") + F.length("value")).otherwise(F.col("e")))
    category = F.when(lead, "name").when(F.col("kind") != "negative", F.col("category"))
    kind = F.when(F.col("kind").isin("label", "negative"), F.col("kind")).otherwise("found")
    both = read.filter(lead | F.col("kind").isin("sensitive", "label", "negative")).select("id", "pack", category.alias("category"), "s", "e", "value", kind.alias("kind")).distinct()
    # the nearest label before, of the same pack and category; the nearest negative term on either side, of the same pack
    # a label counts from where it ends, so that one inside a term hides none before it
    ended = F.when(F.col("kind") == "label", F.col("e")).otherwise(F.col("s"))
    labels = Window.partitionBy("id", "pack", "category").orderBy(ended, F.col("kind") != "label").rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy("id", "pack").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("id", "pack").orderBy("s", "e").rowsBetween(0, Window.unboundedFollowing)
    read = both.withColumns({
        "label_e": F.max(F.when(F.col("kind") == "label", F.col("e"))).over(labels),
        "no_e": F.max(F.when(F.col("kind") == "negative", F.col("e"))).over(back),
        "no_s": F.min(F.when(F.col("kind") == "negative", F.col("s"))).over(ahead),
    }).filter("kind = 'found'")
    apart = F.coalesce(F.col("s") - F.col("no_e") > NEAR, F.lit(True)) & F.coalesce(F.col("no_s") - F.col("e") > NEAR, F.lit(True))
    labelled = F.coalesce((F.col("label_e") <= F.col("s")) & (F.col("s") - F.col("label_e") <= NEAR), F.lit(False))
    out = read.filter(apart).withColumn("confidence", F.when(labelled, "medium").otherwise("low"))
    return out.select(F.col("id").alias(id_col), "pack", "category", "s", "e", "value", "confidence")
