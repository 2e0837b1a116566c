"""Token counts: texts go through a public tokenizer in Arrow batches and only lengths come back.

A batch is cut into groups of near equal bytes, so the memory of an encoding call doesn't hang on how long the texts of a batch
are. A text of more than ``PIECE`` characters is encoded in pieces, cut only where no token can cross: there the counts of the
pieces add up to the count of the whole.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: UTF-8 bytes encoded in one call, about.
GROUP = 1_000_000
#: Characters after which a text is cut at the next safe place.
PIECE = 50_000
_SPACED = re.compile(r"[A-Za-z](?= [A-Za-z])")


class SentencePiece:
    """Counts by a ``.model`` file. Two neighbouring characters that stand together in no piece are a safe place, as merges
    only make pieces. A later piece is encoded behind a character that no piece holds, so that it gets no leading space mark;
    what that character costs is taken off again."""

    def __init__(self, data: bytes) -> None:
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_proto=data)
        names = [self._model.id_to_piece(i) for i in range(self._model.get_piece_size()) if not self._model.is_byte(i)]
        self._joined = {p[i : i + 2].replace("▁", " ") for p in names for i in range(len(p) - 1)}
        held = {c for p in names for c in p}
        self._guard = next(chr(c) for c in range(0xE000, 0xF8FF) if chr(c) not in held)
        self._cost = len(self._model.encode(self._guard))
        # normalisers that change text move the places, and unknown characters that merge join pieces: such texts aren't cut
        probe = "a  Äﬁ ①　b "
        self._cuts = self._model.piece_to_id("<0x41>") != self._model.unk_id() and self._model.normalize(probe).replace("▁", " ").removeprefix(" ") == probe

    def pieces(self, text: str) -> list[str]:
        out, start = [], 0
        while self._cuts and len(text) - start > PIECE:
            at = start + PIECE
            while at < len(text) and text[at - 1 : at + 1].replace("▁", " ") in self._joined:
                at += 1
            if at == len(text):
                break
            out.append(text[start:at])
            start = at
        return [*out, text[start:]]

    def counts(self, texts: list[str], later: list[bool]) -> list[int]:
        ids = self._model.encode([self._guard + t if p else t for t, p in zip(texts, later, strict=True)], num_threads=1)
        return [len(x) - self._cost * p for x, p in zip(ids, later, strict=True)]


class Words:
    """Counts by a ``.json`` file whose pre-tokenizer splits before a space between two letters, which makes that a safe place;
    by a file of another kind, texts are encoded whole."""

    def __init__(self, data: bytes) -> None:
        from tokenizers import Tokenizer

        self._model = Tokenizer.from_str(data.decode())
        self._model.no_truncation()
        self._model.no_padding()
        first = json.loads(data).get("pre_tokenizer") or {}
        first = first["pretokenizers"][0] if first.get("type") == "Sequence" else first
        bytes_ = first.get("type") == "ByteLevel" and first["use_regex"] and not first["add_prefix_space"]
        self._cuts = bytes_ or (first.get("type") == "Split" and first["behavior"] == "Removed" and first["invert"])

    def pieces(self, text: str) -> list[str]:
        out, start = [], 0
        while self._cuts and len(text) - start > PIECE and (m := _SPACED.search(text, start + PIECE)):
            out.append(text[start : m.end()])
            start = m.end()
        return [*out, text[start:]]

    def counts(self, texts: list[str], later: list[bool]) -> list[int]:
        return [len(x) for x in self._model.encode_batch_fast(texts, add_special_tokens=False)]


#: The tokenizers that a Python worker has built, by the digest of their file.
_LOADED: dict[str, SentencePiece | Words] = {}


def _groups(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of near equal bytes: the running sum is cut at as many even marks as groups are needed."""
    ends = np.cumsum(sizes)
    n = max(1, -(-int(ends[-1]) // GROUP))
    cuts = np.unique([0, *np.searchsorted(ends, ends[-1] * np.arange(1, n) / n), len(sizes)])
    yield from zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)


def lengths(codec: SentencePiece | Words, texts: list[str | None]) -> np.ndarray:
    """The number of tokens of each text; null has none."""
    cut = [codec.pieces(t) if t else [] for t in texts]
    flat = [p for ps in cut for p in ps]
    row = np.repeat(np.arange(len(cut)), [len(ps) for ps in cut])
    out = np.zeros(len(cut), np.int64)
    if flat:
        later = np.concatenate(([False], row[1:] == row[:-1])).tolist()
        for a, b in _groups(np.array([len(p.encode()) for p in flat])):
            np.add.at(out, row[a:b], codec.counts(flat[a:b], later[a:b]))
    return out


def token_count(spark, path: str) -> Callable[[Column], Column]:
    """A function of a text column that gives its number of tokens (long) by the tokenizer file at ``path``, ``.model`` or
    ``.json``. The driver reads the file (a few MB) and broadcasts it; a Python worker builds the tokenizer once."""
    kind = {".model": SentencePiece, ".json": Words}[Path(path).suffix]
    data = Path(path).read_bytes()
    held, name = spark.sparkContext.broadcast(data), hashlib.sha256(data).hexdigest()

    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if name not in _LOADED:
            _LOADED[name] = kind(held.value)
        for texts in batches:
            yield pa.array(lengths(_LOADED[name], texts.to_pylist()), pa.int64())

    return count


def count_tokens(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens) of every row.

    Null and empty texts have no bytes and no tokens. Repeated rows are counted alike, null ids are carried along, other columns
    aren't read whatever their names, and an empty table gives an empty table. Texts are counted whole, however long; one
    without any safe place is encoded in one piece.
    """
    count = token_count(docs.sparkSession, path)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), count(text).alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
