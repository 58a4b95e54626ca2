"""Tables as lists of Parquet parts: writes append, deletions are kept as keys, and a manifest names what counts."""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesift.blocks import CODEC
from lakesift.schema import KEYS, SUMMED, TABLES

#: Parts of one kind and level that are put together as one of the next: a table of n writes has fewer of a kind than this for each digit
#: of n to this base, and each row is written as often as there are digits.
PARTS = 6


class Draft(NamedTuple):
    """A part that is written and that no manifest names yet, and its rows."""

    part: dict
    rows: DataFrame


class Store:
    """Tables below one folder. A write adds parts to the tables it changes, then a manifest with the next number.

    A part holds rows, or keys that are gone: they hide the rows of earlier parts. Parts are put together level by level, the youngest first, so
    that their number grows as the logarithm of the number of writes, and old rows are seldom written again. Readers see the parts of one manifest; a write
    that fails leaves the last manifest in place. One writer at a time. What no manifest names any more stays on disk until ``vacuum``.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm_path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._jvm_path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        if not self.versions():
            self._publish({name: [] for name in TABLES}, 0)

    # ------------------------------------------------------------------------------- manifests
    def versions(self) -> list[int]:
        folder = self._jvm_path(f"{self.path}/versions")
        if not self.fs.exists(folder):
            return []
        return sorted(int(x.getPath().getName().removesuffix(".json")) for x in self.fs.listStatus(folder))

    @property
    def version(self) -> int:
        return self.versions()[-1]

    def parts(self, version: int | None = None) -> dict[str, list[dict]]:
        """The parts of each table, oldest first: path and gone (whether it holds keys)."""
        stream = self.fs.open(self._jvm_path(f"{self.path}/versions/{self.version if version is None else version}.json"))
        try:
            return {name: [] for name in TABLES} | json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, parts: dict[str, list[dict]], n: int) -> int:
        draft, target = (self._jvm_path(f"{self.path}/{x}") for x in (f"drafts/{uuid.uuid4().hex}", f"versions/{n}.json"))
        stream = self.fs.create(draft)
        stream.write(bytearray(json.dumps(parts).encode()))
        stream.close()
        self.fs.mkdirs(self._jvm_path(f"{self.path}/versions"))
        if self.fs.exists(target) or not self.fs.rename(draft, target):
            raise RuntimeError(f"version {n} of {self.path} is there already: another writer")
        return n

    # ------------------------------------------------------------------------------- reading
    def table(self, name: str, version: int | None = None) -> DataFrame:
        return self._read(name, self.parts(version)[name])

    def _read(self, name: str, parts: list[dict]) -> DataFrame:
        out, paths = None, []

        def flush():
            nonlocal out, paths
            if paths:
                own = self.spark.read.schema(TABLES[name]).parquet(*paths)
                out, paths = own if out is None else out.unionAll(own), []

        for part in parts:
            if not part["gone"]:
                paths.append(part["path"])
                continue
            flush()
            if out is not None:
                out = out.join(self.spark.read.parquet(part["path"]), KEYS[name], "left_anti").select(*out.columns)
        flush()
        return self.spark.createDataFrame([], TABLES[name]) if out is None else out

    # ------------------------------------------------------------------------------- writing
    def _write(self, name: str, df: DataFrame, n: int, gone: bool, level: int = 0) -> dict:
        path = f"{self.path}/tables/{name}/{n}-{uuid.uuid4().hex}"
        if gone:
            df.select(KEYS[name]).distinct().write.option("compression", CODEC).parquet(path)
        else:
            columns = self.spark.createDataFrame([], TABLES[name]).schema
            df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in columns]).write.option("compression", CODEC).parquet(path)
        return {"path": path, "gone": gone, "level": level}

    def draft(self, name: str, df: DataFrame) -> Draft:
        """Write rows of a table that are read before they count: ``append`` takes the part as it is."""
        part = self._write(name, df, self.version + 1, False)
        return Draft(part, self._read(name, [part]))

    def append(self, rows: dict[str, DataFrame | Draft] | None = None, gone: dict[str, DataFrame] | None = None) -> int:
        """Hide the rows whose keys are in ``gone``, then add ``rows``, as one version. A row that replaces another has its key in both."""
        n, parts, rows, gone = self.version + 1, self.parts(), rows or {}, gone or {}
        for name in gone.keys() | rows.keys():
            if name in gone and parts[name]:
                parts[name].append(self._write(name, gone[name], n, True))
            if name in rows:
                parts[name].append(rows[name].part if isinstance(rows[name], Draft) else self._write(name, rows[name], n, False))
        done = self._publish(parts, n)
        return self.merge(*(gone.keys() | rows.keys())) or done

    def merge(self, *names: str) -> int | None:
        """Put together the youngest parts of tables, down from those of a level that has PARTS of a kind; the new version, if there is one.

        Rows that a part of the run hides go; keys that are gone stay as long as there are older parts, before the run's rows.
        """
        parts, n = self.parts(), self.version + 1
        changed = False
        for name in names:
            level = 0
            while level <= max((p.get("level", 0) for p in parts[name]), default=-1):
                own = parts[name]
                first = next((i + 1 for i in range(len(own) - 1, -1, -1) if own[i].get("level", 0) > level), 0)
                run = own[first:]
                if max(sum(p.get("level", 0) == level and p["gone"] == gone for p in run) for gone in (False, True)) >= PARTS:
                    made = [self._write(name, self._together(name, self._read(name, run)), n, False, level + 1)]
                    keys = [p["path"] for p in run if p["gone"]]
                    if first and keys:
                        made.insert(0, self._write(name, self.spark.read.parquet(*keys), n, True, level + 1))
                    parts[name], changed = own[:first] + made, True
                level += 1
        return self._publish(parts, n) if changed else None

    def compact(self, *names: str) -> int:
        """Write tables anew as one part each, without what is gone."""
        n, parts = self.version + 1, self.parts()
        for name in names or TABLES:
            parts[name] = [self._write(name, self._together(name, self.table(name)), n, False, max(p.get("level", 0) for p in parts[name]) + 1)] if parts[name] else []
        return self._publish(parts, n)

    @staticmethod
    def _together(name: str, rows: DataFrame) -> DataFrame:
        """Rows as they are put together: deltas are added up, and the index is in the order of its terms."""
        if name in SUMMED:
            by, sums = SUMMED[name]
            total = rows.groupBy(*by).agg(*[F.sum(c).alias(c) for c in sums])
            return total.where(" or ".join(f"{c} != 0" for c in sums)).repartitionByRange(by[0]).sortWithinPartitions(*by)
        if name == "postings":
            order = [F.col("term"), F.desc("level")]
            return rows.repartitionByRange(*order, F.xxhash64("chunk_id")).sortWithinPartitions(*order)
        return rows

    def vacuum(self, keep: int = 1) -> int:
        """Delete all versions but the last ``keep``, and the parts that none of those names; how many parts went."""
        last = self.versions()[-keep:]
        held = {p["path"].rsplit("/", 1)[1] for v in last for own in self.parts(v).values() for p in own}
        went = 0
        for v in self.versions()[:-keep]:
            self.fs.delete(self._jvm_path(f"{self.path}/versions/{v}.json"), False)
        for name in TABLES:
            folder = self._jvm_path(f"{self.path}/tables/{name}")
            for part in self.fs.listStatus(folder) if self.fs.exists(folder) else []:
                if part.getPath().getName() not in held:
                    went += self.fs.delete(part.getPath(), True)
        return went
