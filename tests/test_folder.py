"""Folders as tables."""

import pyarrow.fs as pafs
import pytest
from pyspark.sql.datasource import EqualTo, GreaterThan, In

from spanveil.sources import folder
from spanveil.sources.files import read_folder


@pytest.fixture
def tree(tmp_path):
    files = {"a.txt": b"hello", "B.TXT": "é".encode("utf-16"), "c.bin": b"x", "sub/deep/d.md": b"# t", "sub/e.txt": b"", ".hidden/f.txt": b"no", "sub/.g.txt": b"no", "__pycache__/h.txt": b"no", "big/i.txt": b"x" * 500}
    for name, raw in files.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(raw)
    return tmp_path


def name(path, tree):
    return path.removeprefix(f"{tree}/")


def test_list(spark, tree):
    rows = {name(r.path, tree): r for r in folder.list_folder(spark, str(tree)).collect()}
    assert set(rows) == {"a.txt", "B.TXT", "c.bin", "sub/deep/d.md", "sub/e.txt", "big/i.txt"}
    assert rows["B.TXT"].suffix == ".txt" and rows["big/i.txt"].bytes == 500 and rows["a.txt"].modified
    flat = folder.list_folder(spark, str(tree), recursive=False)
    assert {name(r.path, tree) for r in flat.collect()} == {"a.txt", "B.TXT", "c.bin"}
    assert folder.list_folder(spark, str(tree)).filter("suffix IN ('.md', '.bin')").count() == 2
    assert folder.list_folder(spark, f"file://{tree}").count() == 6
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")  # and where conditions aren't handed over
    assert folder.list_folder(spark, str(tree)).filter("suffix = '.md'").count() == 1
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def test_conditions_on_the_suffix_are_taken_over(tree):
    reader = folder.PushedReader(str(tree), True)
    other = GreaterThan(("bytes",), 3)
    assert list(reader.pushFilters([In(("suffix",), (".txt", ".md")), EqualTo(("suffix",), ".md"), other])) == [other]
    assert {name(r[0], tree) for p in reader.partitions() for r in reader.read(p)} == {"sub/deep/d.md"}


def test_a_directory_that_cannot_be_listed_is_a_row(tree, monkeypatch):
    real = pafs.LocalFileSystem()

    class Store:
        def get_file_info(self, what):
            if isinstance(what, pafs.FileSelector) and what.base_dir.endswith("/sub"):
                raise PermissionError(13, "locked")
            return real.get_file_info(what)

    monkeypatch.setattr(folder, "open_store", lambda address: (Store(), address))
    reader = folder.FolderReader(str(tree), True)
    rows = {name(r[0], tree): r[4] for p in reader.partitions() for r in reader.read(p)}
    assert rows["sub"] == "unlistable: PermissionError" and "big/i.txt" in rows and not any(k.startswith("sub/") for k in rows)


def test_read(spark, tree):
    got = {name(r.path, tree): (r.text, r.error, r.kind) for r in read_folder(spark, str(tree), max_bytes=100).collect()}
    assert got == {
        "a.txt": ("hello", None, None), "B.TXT": ("é", None, None), "c.bin": (None, "outside the extensions", "filtered_default"), "sub/deep/d.md": ("# t", None, None), "sub/e.txt": ("", None, None),
        "big/i.txt": (None, "file too large", "unreadable"),
    }
    chosen = {name(r.path, tree): r.kind for r in read_folder(spark, str(tree), (".md",)).collect()}
    assert chosen["a.txt"] == "filtered_chosen" and chosen["sub/deep/d.md"] is None
    # a file by itself is read whatever its suffix
    assert [(r.text, r.kind) for r in read_folder(spark, str(tree / "c.bin")).collect()] == [("x", None)]
