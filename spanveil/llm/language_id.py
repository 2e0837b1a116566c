"""Op 2: language identification, word first, with backoff to shorter and shorter character n-grams.

Training reads a bounded number of labelled rows (``sample`` distinct rows, those with the smallest hash of their id), whole;
the model holds what they hold, so its size, and with it what is broadcast, doesn't grow with the input. Prediction reads
every whole text, in Arrow batches. ``words`` is the one definition of a word for both.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.llm.batches import tune

#: A letter and what letters and marks follow it.
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_LETTERS = re.compile(r"[^\W\d_]+")
#: Longest character n-gram; a word stands between the marks < and >.
ORDER = 4
UNDETERMINED = "und"


@cache
def _odd() -> re.Pattern:
    """Marks and numerals other than digits: only where one stands, ``_LETTERS`` isn't the same as ``_WORD``."""
    hits = [c for c in range(0x110000) if unicodedata.category(chr(c)) in ("Mn", "Mc", "Me", "Nl", "No")]
    breaks = [i for i in range(1, len(hits)) if hits[i] != hits[i - 1] + 1]
    runs = zip([hits[0], *(hits[i] for i in breaks)], [*(hits[i - 1] for i in breaks), hits[-1]], strict=True)
    return re.compile("[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in runs) + "]")


def words(text: str) -> list[str]:
    low = text.lower()
    return (_LETTERS if low.isascii() or not _odd().search(low) else _WORD).findall(low)


@dataclass
class Model:
    """Log frequencies per language of words and of n-grams: rows of ``table``, found by ``words`` and ``grams``."""

    langs: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    table: np.ndarray
    _rows: dict[str, int] = field(default_factory=dict)
    _known: int = 0
    _vectors: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))

    def _row(self, word: str) -> int:
        """The row of a word's vector among those that this worker has met."""
        if self._known >= len(self._vectors):
            more = np.zeros((max(1024, 2 * len(self._vectors)), len(self.langs)), np.float32)
            if len(self._vectors):
                more[: len(self._vectors)] = self._vectors
            self._vectors = more
        self._vectors[self._known] = self.vector(word)
        self._rows[word] = self._known
        self._known += 1
        return self._known - 1

    def vector(self, word: str) -> np.ndarray:
        """What a word says for each language: its own log frequencies if known, else the mean of the longest known
        n-grams from each position on, each falling back to a shorter one, and nothing for unknown characters."""
        at = self.words.get(word)
        if at is not None:
            return self.table[at]
        marked = f"<{word}>"
        found = []
        i = 0
        while i < len(marked):
            for n in range(min(ORDER, len(marked) - i), 0, -1):
                at = self.grams.get(marked[i : i + n])
                if at is not None:
                    found.append(at)
                    break
            i += 1
        if len(found) > 1000:  # as many rows as there are different n-grams, however long the word
            rows, times = np.unique(found, return_counts=True)
            return (times @ self.table[rows] / len(found)).astype(np.float32)
        return self.table[found].mean(axis=0) if found else np.zeros(len(self.langs), np.float32)

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = Counter(words(text)) if text else None
        if not counts or not self.langs:
            return UNDETERMINED, 0.0
        if len(self._rows) > 200_000:
            self._rows.clear()
            self._known = 0
        found = list(map(self._rows.get, counts))
        if None in found:
            found = [self._row(w) if r is None else r for w, r in zip(counts, found, strict=True)]
        total = np.fromiter(counts.values(), np.float64, len(counts)) @ self._vectors[found]
        # the mean over words keeps long texts from saturating: the score is comparable between lengths
        mean = total / sum(counts.values()) * min(8.0, len(counts) ** 0.5)
        odds = np.exp(mean - mean.max())
        best = int(np.argmax(total))
        return self.langs[best], float(odds[best] / odds.sum())


def _log_rows(counts: pd.DataFrame, key: str, langs: list[str]) -> tuple[dict[str, int], np.ndarray]:
    if counts.empty:
        return {}, np.zeros((0, len(langs)))
    at = {x: i for i, x in enumerate(langs)}
    rows = {x: i for i, x in enumerate(sorted(counts[key].unique()))}
    table = np.full((len(rows), len(langs)), 0.5)
    np.add.at(table, (counts[key].map(rows).to_numpy(), counts["lang"].map(at).to_numpy()), counts["n"].to_numpy())
    return rows, np.log(table / table.sum(axis=0))


def _count_words(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in it:
        counts = Counter((lang, w) for lang, t in zip(part["lang"], part["text"], strict=True) for w in words(t))
        yield pd.DataFrame([(lang, w, n) for (lang, w), n in counts.items()], columns=["lang", "word", "n"])


def train(docs: DataFrame, labelled: Column, sample: int = 4000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fits the tables on at most ``sample`` rows for which ``labelled`` holds and the label and text are not null.

    Rows equal in id, text and label count as one. A word met only once says nothing by itself, its n-grams do. Without a
    labelled row, or a word in them, the model knows no language.
    """
    tune(docs.sparkSession)
    some = docs.filter(labelled & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    text = F.col(text_col).cast("string")
    some = some.select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col).cast("string")).alias("h"), F.xxhash64(text, F.col(id_col).cast("string")).alias("t"), text.alias("text"))
    keys = ["h", "t", "lang"]
    chosen = some.select(*keys).distinct().orderBy(*keys).limit(sample)
    # at most ``sample`` rows
    rows = some.join(F.broadcast(chosen), keys, "left_semi").groupBy(*keys).agg(F.first("text").alias("text")).select("lang", "text")
    counted = rows.mapInPandas(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counted["lang"].unique())
    words_at, word_rows = _log_rows(counted[counted.groupby("word")["n"].transform("sum") > 1], "word", langs)
    grams: Counter = Counter()
    for lang, word, n in counted[["lang", "word", "n"]].itertuples(index=False):
        marked = f"<{word}>"
        for size in range(1, ORDER + 1):
            for i in range(len(marked) - size + 1):
                grams[lang, marked[i : i + size]] += n
    frame = pd.DataFrame([(a, b, n) for (a, b), n in grams.items()], columns=["lang", "gram", "n"])
    grams_at, gram_rows = _log_rows(frame, "gram", langs)
    table = np.concatenate([word_rows, gram_rows]).astype(np.float32)
    # what all languages share says nothing: only the differences are kept
    if table.size:
        table -= table.mean(axis=1, keepdims=True)
    return Model(langs, words_at, {x: i + len(word_rows) for x, i in grams_at.items()}, table)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred and score (0 to 1) of every row, from the whole text alone.

    A text that is null, empty or without a letter gets ``und`` and 0; so does every text if nothing was labelled. However
    long a text or a word is, it is read whole. Equal
    texts get equal results; between languages that tie the first by name is taken. Null ids are carried along, other
    columns are not read, and an empty table gives an empty table.
    """
    tune(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = held.value
        for part in it:
            found = [m.predict(t) for t in part["text"]]
            yield pd.DataFrame({"id": part["id"], "lang_pred": [x for x, _ in found], "score": [float(y) for _, y in found]})

    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = base.schema["id"].dataType.simpleString()
    # the id stays out of pandas: a null among integers would turn them into floating point
    if kind in ("bigint", "int"):
        base = base.withColumn("id", F.col("id").cast("string"))
    out = base.mapInPandas(run, "id string, lang_pred string, score double") if kind in ("bigint", "int", "string") else base.mapInPandas(run, f"id {kind}, lang_pred string, score double")
    return out.select(F.col("id").cast(kind).alias(id_col), "lang_pred", "score")
