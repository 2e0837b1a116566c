"""Folders and files as tables, and tables as overlays and logs.

A file that cannot be read is a row with an error, never a missing row: whoever decides about egress sees it as blocked.
"""

from __future__ import annotations

import codecs
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.sources.folder import list_folder, open_store

# What is read where no extensions are chosen.
DEFAULT_EXTENSIONS = (".txt", ".md", ".markdown", ".rst", ".csv", ".tsv", ".json", ".log", ".html", ".htm", ".xml", ".yaml", ".yml", ".pdf", ".docx", ".doc", ".rtf")
UNSUPPORTED = (".html", ".htm", ".rtf", ".doc", ".xlsx", ".pptx")
MAX_BYTES = 100_000_000
_BOMS = ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"))


def decode(raw: bytes) -> str | None:
    """By byte order mark, else UTF-8, else cp1252; bytes with a NUL are no text."""
    for bom, name in _BOMS:
        if raw.startswith(bom):
            try:
                return raw.decode(name)
            except UnicodeDecodeError:
                return None
    if b"\0" in raw:
        return None
    for name in ("utf-8", "cp1252"):
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            continue
    return None


def docx_text(raw: bytes) -> str:
    """The paragraphs of a DOCX, divided by blank lines."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    return "\n\n".join("".join(t.text or "" for t in p.iter(f"{w}t")) for p in root.iter(f"{w}p"))


def pdf_text(raw: bytes) -> str:
    from pypdf import PdfReader  # optional: without it the file is an error row

    return "\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(raw)).pages)


def _extract(path: str, raw: bytes) -> tuple[str | None, str | None]:
    suffix = re.search(r"\.[^./]*$", path.lower())
    kind = suffix[0] if suffix else ""
    try:
        if kind in UNSUPPORTED:
            return None, f"unsupported document type {kind}"
        if kind == ".docx":
            text = docx_text(raw)
        elif kind == ".pdf":
            text = pdf_text(raw)
        else:
            text = decode(raw)
        if text is None:
            return None, "not a text file"
        return (text, None) if text or not raw else (None, "no text found")
    except ModuleNotFoundError as e:
        return None, f"media_channel_unavailable: {e.name}"
    except Exception as e:  # noqa: BLE001  whatever a broken file raises, it is that file's error
        return None, f"unreadable: {type(e).__name__}"


def read_folder(spark: SparkSession, path: str, extensions: tuple[str, ...] | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, text, error, kind) of the files below a folder, or of one file, whatever its suffix; hidden files and ``__pycache__``
    aside.

    A directory that can't be listed and a file beyond ``max_bytes`` or that fails are rows of kind ``unreadable``. Files outside
    the extensions are rows too: ``filtered_default`` where no extensions were chosen (that scope was imposed),
    ``filtered_chosen`` where they were. Only what is wanted is opened, one file at a time, in tasks to which the list is dealt
    by path.
    """
    store, root = open_store(path)
    one = store.get_file_info(root).type == pafs.FileType.File
    listed = list_folder(spark, path)
    wanted = F.lit(one) | F.col("suffix").isin(*(extensions or DEFAULT_EXTENSIONS))
    skipped = "filtered_chosen" if extensions else "filtered_default"
    kind = F.when(F.col("error").isNotNull() | (wanted & (F.col("bytes") > max_bytes)), "unreadable").when(~wanted, skipped)
    error = F.coalesce("error", F.when(kind == skipped, "outside the extensions").when(F.col("bytes") > max_bytes, "file too large"))
    marked = listed.select("path", error.alias("error"), kind.alias("kind"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, _ = open_store(path)
        for batch in batches:
            for row in batch.to_pylist():
                text, error = None, row["error"]
                if error is None:
                    try:
                        with where.open_input_stream(row["path"]) as f:
                            text, error = _extract(row["path"], f.read())
                    except OSError as e:
                        error = f"unreadable: {type(e).__name__}"
                yield pa.RecordBatch.from_pylist([{"path": row["path"], "text": text, "error": error, "kind": row["kind"] or ("unreadable" if error else None)}], _READ)

    return marked.repartition("path").mapInArrow(run, "path string, text string, error string, kind string")


_READ = pa.schema([(c, pa.string()) for c in ("path", "text", "error", "kind")])


def read_text(spark: SparkSession, *texts: str) -> DataFrame:
    return spark.createDataFrame([(f"<text {i}>", t) for i, t in enumerate(texts)], "path string, text string")


def write_overlays(df: DataFrame, path: str, name: str = "path", overlay: str = "overlay", residual: str = "residual") -> None:
    """Overlays as a table at a new place. Nothing is written if two names are equal but for case or the place exists;
    an overlay in which a value still stands is withheld."""
    twice = df.groupBy(F.lower(name)).count().filter("count > 1")
    if not twice.isEmpty():
        raise FileExistsError("two overlays would have one name")
    df.select(name, F.when(F.col(residual) == 0, F.col(overlay)).alias(overlay), (F.col(residual) > 0).alias("withheld")).write.mode("errorifexists").parquet(path)


def integrity(entry: Column) -> Column:
    return F.substring(F.sha2(F.to_json(entry), 256), 1, 16)


def append_audit(entries: DataFrame, path: str, by: str | None = None) -> None:
    """Entries with their integrity hash, appended as JSON lines, in a folder per value of ``by``."""
    out = entries.withColumn("integrity", integrity(F.struct(*entries.columns))).write.mode("append")
    (out.partitionBy(by) if by else out).json(path)


# What a metadata tag tells.
TAG_KINDS = [
    ("gps", r"(?i)gps|location|latitude|longitude|iso6709"),
    ("name", r"(?i)artist|author|creator|owner|composer|lastmodifiedby|by-?line"),
    ("organization", r"(?i)company|organi[sz]ation|publisher|credit"),
    ("device_id", r"(?i)serial|uniqueid|imei|deviceid|make|model"),
    ("datetime", r"(?i)date|time"),
    ("embedded_payload", r"(?i)thumbnail|preview|embedded|attachment"),
]


def tag_kind(tag: Column) -> Column:
    """What kind of personal data a media tag holds; ``content`` if nothing special."""
    out = F
    for kind, pattern in TAG_KINDS:
        out = out.when(tag.rlike(pattern), kind)
    return out.otherwise("content")


def iso6709(value: Column) -> Column:
    """struct(lat, lon) of +DD.DDDD+DDD.DDDD/"""
    part = lambda i: F.regexp_extract(value, r"([+-]\d{2}(?:\.\d+)?)([+-]\d{3}(?:\.\d+)?)", i).try_cast("double")
    return F.struct(part(1).alias("lat"), part(2).alias("lon"))
