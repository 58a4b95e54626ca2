"""Files are listed and read in tasks; the driver holds no list of them."""

import os

import pytest

from lakesift.sources import files as source
from lakesift.sources.files import files_below, read_files

NAMES = ["a.md", "x/b.md", "x/deep/c.md", "x/deep/d.txt", "y1/e #1%20.md", "y1/é ?.md", "y2/f.md", ".git/g.md", "_tmp/h.md", "x/.hidden.md", "y1/_i.md", "k=1/_j=2.md"]


@pytest.fixture
def folder(tmp_path):
    for k, name in enumerate(NAMES):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(f"text {k}\r\nof {name}".encode())
        os.utime(tmp_path / name, ns=(10**18 + k * 10**9 + 1_999_999, 10**18 + k * 10**9 + 1_999_999))
    return str(tmp_path)


def by_spark(spark, root, pattern, ignore):
    """As Spark's own reader of files gives them, listed by the driver."""
    raw = spark.read.option("recursiveFileLookup", True).format("binaryFile").load(root).selectExpr(f"replace(path, 'file:{root}/') as path", "replace(decode(content, 'UTF-8'), '\\r\\n', '\\n') as text", "modificationTime as modified_at", "replace(path, 'file:') as source_uri")
    return sorted((r["path"], r["source_uri"], r["text"], r["modified_at"]) for r in source.fitting(raw, pattern, ignore).collect())


@pytest.mark.parametrize("pattern", ["*.md", "**/*.md", "x/*.md", "y?/*.md", "y?/**", "x/deep/?.*", "*", "k=1/*"])
@pytest.mark.parametrize("ignore", [[], ["y1"], ["x/deep/", "f.md"]])
def test_files_are_those_of_spark(spark, folder, pattern, ignore):
    found = sorted((r["path"], r["source_uri"], r["text"], r["modified_at"]) for r in read_files(spark, folder, pattern, ignore).collect())
    assert found == by_spark(spark, folder, pattern, ignore)


def test_the_driver_lists_no_files(spark, folder):
    """What is read are tables that tasks wrote: Spark's index of files, which lies on the driver, has none of the folder's."""
    assert not [f for f in read_files(spark, folder).inputFiles() if f.endswith(".md")]
    assert [r["path"] for r in source.listing(spark, folder, "y1/*").collect()] == ["y1/e #1%20.md", "y1/é ?.md"]


def test_one_file_none_and_many_at_once(spark, folder, tmp_path, monkeypatch):
    assert [(r["path"], r["text"]) for r in read_files(spark, f"{folder}/x/b.md", "*.txt").collect()] == [("b.md", "text 1\nof x/b.md")]
    assert read_files(spark, folder, "*.rst").count() == 0
    with pytest.raises(FileNotFoundError):
        files_below(spark, f"{folder}/none")
    monkeypatch.setattr(source, "FILES_AT_ONCE", 2)
    monkeypatch.setattr(source, "READ_BYTES", 5)
    assert read_files(spark, folder, "**").count() == 8
