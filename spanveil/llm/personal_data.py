"""Op 7 [native]: personal data, and terms that reveal it by information content.

Base kinds are found by pattern, with positions. So are secrets, runs of letters and digits of so much information of their
own (``SECRET_LENGTH`` characters or more of both sorts) that they are keys rather than words. What is found are the protected
entities, each at three levels, as exact values seldom recur: the value, what it belongs to (mail domain, network, card issuer,
number block), and its kind. A term (a word beside an entity on its line) reveals an entity by their pointwise mutual
information over the corpus,

    PMI(e; t) = log2( n(t, e) * N / (n(t) * n(e)) )    against    IC(e) = -log2( n(e) / N ),

with n(t, e) texts where t stands beside e, n(t) texts with t anywhere, n(e) texts with e and N texts, each distinct text
counted once. PMI equals IC where the term never stands without the entity. Terms with PMI >= ``share`` * IC for an entity of
any level and n(t, e) >= ``support`` exceed the disclosure threshold: wherever they stand, in any text, they become spans of
the kind ``term`` and are removed like the entities themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.functions.spans import find_spans
from spanveil.session import materialise

# A match of the first three can only begin where a run of their characters begins or the last match ended: said so, and with
# possessive repeats, the search is linear on any text and never deep.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
WORD = r"[\p{L}\p{M}\p{N}_]+"
SECRET_LENGTH = 20
SECRET = rf"(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9])(?=[0-9]*+[A-Za-z])[A-Za-z0-9]{{{SECRET_LENGTH},}}+"
#: Hash slots of the filter for words.
SLOTS = 1 << 20
#: Characters to either side of an entity in which terms are looked for.
REACH = 60


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _valid(kind: str, v: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(v, r"\."), lambda p: (F.length(part(p)) < 3) | ((F.length(part(p)) == 3) & (part(p) <= "255")))
    if kind == "card":
        return F.length(_digits(v)).between(16, 19) & F.call_function("luhn_check", _digits(v))
    if kind == "phone":
        return F.length(_digits(v)).between(8, 15)
    return F.lit(True)


_SPAN = "array<struct<kind:string,s:int,e:int,value:string>>"
KINDS = (("email", EMAIL, "@"), ("ip", IP, "."), ("card", CARD, None), ("phone", PHONE, "+"))


def base_spans(text: Column) -> Column:
    """``array<struct<kind, s, e, value>>`` of the four kinds, in that order and then by start."""
    none = F.array().cast(_SPAN)

    def of(kind: str, pattern: str, mark: str | None) -> Column:
        some = F.filter(find_spans(text, pattern), lambda x: _valid(kind, x["value"]))
        rows = F.transform(some, lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["value"].alias("value")))
        return F.when(F.contains(text, F.lit(mark)) if mark else text.rlike("[0-9][ -]?[0-9]"), rows).otherwise(none)

    return F.concat(*(of(*k) for k in KINDS))


def secret_spans(text: Column, others: Column) -> Column:
    """As ``base_spans``: secrets that overlap none of the others."""
    free = F.filter(find_spans(text, SECRET), lambda x: ~F.exists(others, lambda o: (o["s"] < x["e"]) & (x["s"] < o["e"])))
    rows = F.transform(free, lambda x: F.struct(F.lit("secret").alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["value"].alias("value")))
    return F.when(text.rlike(f"[A-Za-z0-9]{{{SECRET_LENGTH}}}"), rows).otherwise(F.array().cast(_SPAN))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def _terms_beside(text: Column, s: Column, e: Column) -> Column:
    """Whole words on the entity's line within REACH characters, with their places."""
    first = F.greatest(s - REACH, F.lit(0))
    before = F.substring(text, first + 1, s - first)
    after = F.substring(text, e + 1, F.lit(REACH))
    line = F.substring_index(before, "\n", -1)
    left = F.filter(find_spans(line, WORD, s - F.length(line)), lambda x: (x["s"] > first) | (first == 0) | F.contains(before, F.lit("\n")))
    right = F.filter(find_spans(F.substring_index(after, "\n", 1), WORD, e), lambda x: (x["e"] < e + REACH) | (F.length(text) <= e + REACH))
    # a word that touches the entity may be the rest of one that it cuts
    return F.concat(F.filter(left, lambda x: x["e"] < s), F.filter(right, lambda x: x["s"] > e))


def _entities(kind: Column, value: Column) -> Column:
    """The three levels of an entity: its value, what that belongs to, its kind."""
    low, digits = F.lower(value), _digits(value)
    exact = F.when(kind.isin("card", "phone"), digits).when(kind == "secret", value).otherwise(low)
    group = F.when(kind == "email", F.substring_index(low, "@", -1)).when(kind == "ip", F.substring_index(low, ".", 2)).when(kind == "card", F.substring(digits, 1, 6)).when(kind == "phone", F.substring(digits, 1, 4)).otherwise(F.length(value).cast("string"))
    return F.array(F.concat(kind, F.lit("="), exact), F.concat(kind, F.lit("~"), group), kind)


def _words(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(k1, k2, term) of the distinct words of texts that are among ``terms``, or share one of the ``SLOTS`` hash slots with one:
    a filter of bounded size, so that other words are never shuffled."""
    words = texts.select("k1", "k2", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)))).alias("term"))
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS)).cast("int")
    # SLOTS rows at most
    wanted = terms.select(slot("term").alias("slot")).distinct()
    return words.join(F.broadcast(wanted), slot("term") == F.col("slot"), "left_semi")


def detect(docs: DataFrame, share: float = 0.9, support: int = 3, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """n_email, n_ip, n_card, n_phone, base_sha256, n_secret, n_term, n_spans, spans and, with ``keep_text``, clean_text for
    every row.

    ``spans`` is kind:start:end of the base kinds in their order, of secrets and of terms, comma-joined; terms and secrets
    overlap none of those before. In clean_text spans become their kind in brackets (overlapping base spans one bracket, of
    the first). Null texts are empty and have no spans. Repeated rows have equal results and count once in the statistics.
    Null ids are carried along; other columns are not read. An empty table gives an empty table.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64("text", F.lit(7))})
    found = keyed.withColumn("base", F.when(F.col("text").rlike("[0-9@]"), base_spans(F.col("text"))).otherwise(F.array().cast(_SPAN)))
    found = found.withColumn("secrets", F.when(F.col("text").rlike("[0-9]"), secret_spans(F.col("text"), F.col("base"))).otherwise(F.array().cast(_SPAN)))
    beside = F.transform(F.concat("base", "secrets"), lambda x: F.struct(_entities(x["kind"], x["value"]).alias("entities"), F.array_distinct(F.transform(_terms_beside(F.col("text"), x["s"], x["e"]), lambda t: F.lower(t["value"]))).alias("terms")))
    rows = materialise(found.select("id", "k1", "k2", "base", "secrets", beside.alias("beside")), "personal-rows")

    near = rows.select("k1", "k2", F.explode("beside").alias("b")).select("k1", "k2", F.explode("b.entities").alias("entity"), "b.terms")
    entities = near.select("k1", "k2", "entity").distinct().groupBy("entity").agg(F.count("*").alias("n_e"))
    together = near.select("k1", "k2", "entity", F.explode("terms").alias("term")).distinct().groupBy("entity", "term").agg(F.count("*").alias("n_te")).filter(F.col("n_te") >= support)
    together = materialise(together, "personal-together")
    # each distinct text once, as in the other two counts
    each = keyed.groupBy("k1", "k2").agg(F.first("text").alias("text"))
    known = _words(each, together).groupBy("term").agg(F.count("*").alias("n_t"))
    total = float(max(rows.select("k1", "k2").distinct().count(), 1))
    scored = together.join(entities, "entity").join(known, "term")
    content = F.log2(F.lit(total) / F.col("n_e"))
    mutual = F.log2(F.col("n_te") * F.lit(total) / (F.col("n_t") * F.col("n_e")))
    telling = materialise(scored.filter(mutual >= share * content).select("term").distinct(), "personal-telling")

    # wherever a telling term stands
    hold = _words(keyed, telling).join(telling, "term").groupBy("k1", "k2").agg(F.collect_set("term").alias("telling"))
    hold = materialise(hold, "personal-holding")
    hits = F.filter(find_spans(F.col("text"), WORD), lambda x: F.array_contains("telling", F.lower(x["value"])))
    places = keyed.join(hold, ["k1", "k2"]).select("k1", "k2", F.transform(hits, lambda x: F.struct(F.lit("term").alias("kind"), x["s"].alias("s"), x["e"].alias("e"))).alias("terms"))
    places = materialise(places.groupBy("k1", "k2").agg(F.first("terms").alias("terms")), "personal-places")

    bare = lambda c: F.transform(c, lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    out = rows.select("id", "k1", "k2", bare("base").alias("base"), bare("secrets").alias("secrets")).join(places, ["k1", "k2"], "left")
    free = F.filter("terms", lambda x: ~F.exists(F.concat("base", "secrets"), lambda o: (o["s"] < x["e"]) & (x["s"] < o["e"])))
    out = out.withColumn("terms", F.coalesce(free, F.array().cast("array<struct<kind:string,s:int,e:int>>")))
    of = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [of(k) for k, _, _ in KINDS]
    every = F.concat("base", "secrets", "terms")
    more = [F.size(F.col(c)).cast("long").alias(f"n_{c[:-1]}") for c in ("secrets", "terms")] + [F.size(every).cast("long").alias("n_spans")]
    result = out.select("id", "k1", "k2", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), *more, _joined(every).alias("spans"), every.alias("all"))
    columns = [*(f"n_{k}" for k, _, _ in KINDS), "base_sha256", "n_secret", "n_term", "n_spans", "spans"]
    if keep_text:
        result = materialise(result, "personal-result").dropDuplicates(["k1", "k2"]).drop("id").join(keyed, ["k1", "k2"], "right")
        return result.select(F.col("id").alias(id_col), *columns, cut_out(F.col("text"), F.col("all")).alias("clean_text"))
    return result.select(F.col("id").alias(id_col), *columns)


def cut_out(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; spans that overlap are one, named by the first."""
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("e"), x["kind"].alias("kind"))))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        end = -x["e"]
        fresh = x["s"] >= acc["at"]
        piece = F.concat(F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), F.lit("["), x["kind"], F.lit("]"))
        return F.struct(F.greatest(acc["at"], end).cast("int").alias("at"), F.when(fresh, F.array_append(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(ordered, begin, step)
    whole = F.concat(F.array_join(done["out"], ""), F.substring(text, done["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, whole).otherwise(text)
