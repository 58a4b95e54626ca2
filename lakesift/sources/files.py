"""Files as rows."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesift.blocks import materialise
from lakesift.functions.text import newlines

#: Bytes that opening a small file is taken to cost, against those that are read.
OPEN_COST = 16 << 10
#: Bytes that a task reads of files, files that a task lists at once, and bytes of files that it gives away at once.
TASK_BYTES, FILES_AT_ONCE, READ_BYTES = 128 << 20, 10_000, 4 << 20
_LOCAL = fs.LocalFileSystem()
FILES = "path string, source_uri string, text string, modified_at timestamp"


def glob_pattern(pattern: str) -> str:
    """A regular expression of the relative paths that fit a glob: ** stands for any folders, * and ? stay within a name."""
    out, k = "", 0
    while k < len(pattern):
        if pattern.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
        elif pattern.startswith("**", k):
            out, k = out + ".*", k + 2
        elif pattern[k] == "[" and "]" in pattern[k + 2:]:
            end = pattern.index("]", k + 2)
            inner = pattern[k + 1:end].replace("\\", "\\\\")
            out, k = out + "[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]", end + 1
        else:
            out, k = out + {"*": "[^/]*", "?": "[^/]"}.get(pattern[k], re.escape(pattern[k])), k + 1
    return f"^{out}$"


def fitting(files: DataFrame, pattern: str, ignore: list[str] | None = None, path: str = "path") -> DataFrame:
    """The rows whose path fits the pattern and none of ``ignore``. A pattern without a folder holds for the names of files at all depths."""
    def fits(p: str):
        return F.col(path).rlike(glob_pattern(p if "/" in p else f"**/{p}"))

    out = files.where(fits(pattern))
    for p in ignore or []:
        # a folder's name stands for what lies in it
        out = out.where(~(fits(p) | fits(f"{p.rstrip('/')}/**")))
    return out


def _listed(place: str, base: str) -> Iterator[tuple[str, bool, int, int]]:
    """Path below ``base``, whether it is a folder, length, and time in milliseconds of each entry of a folder, but of hidden ones."""
    where, path = _raw(place)
    if isinstance(where, fs.LocalFileSystem):  # one entry at a time, however many there are
        with os.scandir(path) as entries:
            own = ((e.name, e.is_dir(), e.stat()) for e in entries if e.is_dir() or e.is_file())
            rows = ((name, folder, stat.st_size, stat.st_mtime_ns // 1_000_000) for name, folder, stat in own)
            yield from ((f"{base}{name}", *rest) for name, *rest in rows if not _hidden(name))
    else:
        for e in where.get_file_info(fs.FileSelector(path)):
            if not _hidden(e.base_name):
                yield f"{base}{e.base_name}", e.type == fs.FileType.Directory, e.size or 0, (e.mtime_ns or 0) // 1_000_000


def _hidden(name: str) -> bool:
    """Names that Spark's readers pass over."""
    return name[0] == "." or (name[0] == "_" and "=" not in name) or name.endswith("._COPYING_")


def _may_hold(folder: str, pattern: str, ignore: list[str]) -> bool:
    """Whether files below a folder can fit the pattern, and are not all ignored."""
    if any(re.match(glob_pattern(p.rstrip("/")), folder) for p in ignore):
        return False
    parts, depth = pattern.split("/"), folder.count("/") + 1
    return "/" not in pattern or "**" in pattern or (depth < len(parts) and re.match(glob_pattern("/".join(parts[:depth])), folder) is not None)


def files_below(spark: SparkSession, root: str, pattern: str = "*.md", ignore: list[str] | None = None) -> DataFrame:
    """path (below ``root``), source_uri, modified_at, length of each file under ``root`` that fits the pattern, and no pattern of ``ignore``.

    Tasks list the folders, level by level, and write what they find: the driver holds no list of files. Folders that can't hold a fitting
    file aren't looked into. A root that is a file is that file alone, whatever the pattern.
    """
    where, out = spark._jvm.org.apache.hadoop.fs.Path(root), set(ignore or [])
    system, base = where.getFileSystem(spark._jsc.hadoopConfiguration()), re.sub("^file:/+", "/", qualified(spark, root)).rstrip("/")
    if not system.exists(where):
        raise FileNotFoundError(f"no file or folder {root}")
    if system.isFile(where):
        status = system.getFileStatus(where)
        one = spark.createDataFrame([(base.rsplit("/", 1)[1], base, status.getModificationTime(), status.getLen())], "path string, source_uri string, at long, length long")
        return one.select("path", "source_uri", F.timestamp_millis("at").alias("modified_at"), "length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                rows = _listed(f"{base}/{folder}", f"{folder}/" if folder else "")
                rows = (r for r in rows if not r[1] or _may_hold(r[0], pattern, sorted(out)))
                while few := list(islice(rows, FILES_AT_ONCE)):
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*few, strict=True), (pa.string(), pa.bool_(), pa.int64(), pa.int64()), strict=True)], ["path", "folder", "length", "at"])

    found, folders, n = None, spark.createDataFrame([("",)], "path string"), 1
    while n:
        level = materialise(folders.repartition(min(n, spark.sparkContext.defaultParallelism * 4)).mapInArrow(run, "path string, folder boolean, length long, at long"), "listed")
        found = level if found is None else found.unionAll(level)
        folders = level.where("folder").select("path")
        n = folders.count()
    own = found.where("not folder").select("path", F.concat(F.lit(f"{base}/"), "path").alias("source_uri"), F.timestamp_millis("at").alias("modified_at"), "length")
    return fitting(own, pattern, ignore)


def with_contents(files: DataFrame) -> DataFrame:
    """path, source_uri, text, modified_at of ``files`` (as by ``files_below``), which are dealt out by their paths and read in tasks, thousands of small ones in each."""
    spark = files.sparkSession
    n, size = files.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).head()
    tasks = max(1, min(n, spark.sparkContext.defaultParallelism), (size + n * OPEN_COST) // TASK_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, first, size = [], 0, 0
            for k, place in enumerate(batch.column("source_uri").to_pylist()):
                where, path = _raw(place)
                with where.open_input_stream(path) as f:
                    held.append(f.read())
                size += len(held[-1])
                if size >= READ_BYTES or k + 1 == batch.num_rows:
                    own = batch.slice(first, len(held))
                    yield pa.RecordBatch.from_arrays([own.column("path"), own.column("source_uri"), pa.array(held, pa.binary()), own.column("modified_at")], ["path", "source_uri", "content", "modified_at"])
                    held, first, size = [], k + 1, 0

    read = files.select("path", "source_uri", "modified_at").repartition(int(tasks), "path").mapInArrow(run, "path string, source_uri string, content binary, modified_at timestamp")
    return read.select("path", "source_uri", newlines(F.decode("content", "UTF-8")).alias("text"), "modified_at")


def read_files(spark: SparkSession, root: str, pattern: str = "*.md", ignore: list[str] | None = None) -> DataFrame:
    """path (below ``root``), source_uri, text, modified_at of each file under ``root`` that fits the pattern, and no pattern of ``ignore``.

    A root that is a file is that file alone, whatever the pattern.
    """
    return with_contents(files_below(spark, root, pattern, ignore))


@contextmanager
def many_files(spark: SparkSession) -> Iterator[None]:
    """What is read inside has thousands of small files in a task: by the session's default each counts as 4 MB, so that a task has 32."""
    key = "spark.sql.files.openCostInBytes"
    was = spark.conf.get(key)
    spark.conf.set(key, str(OPEN_COST))
    try:
        yield
    finally:
        spark.conf.set(key, was)


def listing(spark: SparkSession, root: str, pattern: str = "*.md", ignore: list[str] | None = None) -> DataFrame:
    """Paths alone, in order, without reading contents."""
    return files_below(spark, root, pattern, ignore).select("path", "source_uri", "modified_at").orderBy("path")


def qualified(spark: SparkSession, path: str) -> str:
    """A path with the file system that Spark takes it to be on."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(own).toString()


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a place and its path there, in a task."""
    scheme, _, rest = uri.partition(":")
    return fs.FileSystem.from_uri(f"s3:{rest}" if scheme in ("s3a", "s3n") else f"file://{rest}" if scheme == "file" and not rest.startswith("//") else uri)


def _raw(place: str) -> tuple[fs.FileSystem, str]:
    """As ``_at``, for a place whose names are taken as they are, whatever letters they have."""
    scheme, there, rest = place.partition("://")
    if not there or scheme == "file":
        return _LOCAL, "/" + re.sub("^file:", "", rest if there else place).lstrip("/")
    host, _, path = rest.partition("/")
    where, base = _system(scheme, host)
    return where, f"{base.rstrip('/')}/{path}"


@lru_cache(maxsize=16)
def _system(scheme: str, host: str) -> tuple[fs.FileSystem, str]:
    return _at(f"{scheme}://{host}/")


def write_file(uri: str, data: bytes) -> str:
    """Write a file from a task, by renaming, so that no half file is seen; its place."""
    where, path = _at(uri)
    folder, name = path.rsplit("/", 1)
    where.create_dir(folder, recursive=True)
    draft = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with where.open_output_stream(draft) as f:
        f.write(data)
    where.move(draft, path)
    return uri


def read_file(uri: str) -> bytes | None:
    """What a file holds, read in a task; None where there is none."""
    where, path = _at(uri)
    if where.get_file_info(path).type != fs.FileType.File:
        return None
    with where.open_input_stream(path) as f:
        return f.read()
