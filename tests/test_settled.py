"""Bursts of changes as a stream with state by path."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from lakesift.operators import ingest
from lakesift.store import Store
from lakesift.streaming.watch import CHANGES, settled, sync_folder, watch

NAMES = ("collection", "path", "kind", "text", "ts", "event_id")


def put(folder, name, *rows):
    folder.mkdir(exist_ok=True)
    draft = folder.parent / f"{name}.draft"
    draft.write_text("\n".join(json.dumps(dict(zip(NAMES, ("default", *r), strict=True))) for r in rows))
    draft.rename(folder / name)


def doc(store, path):
    row = store.table("documents").where("active").where(F.col("path") == path).join(store.table("content"), "hash").head()
    return row and row["doc"]


def until(found, seconds=90):
    end = time.time() + seconds
    while not found():
        assert time.time() < end
        time.sleep(0.5)


def test_late_and_repeated_changes_are_dropped(spark, tmp_path):
    store, folder = Store(spark, str(tmp_path / "s")), tmp_path / "log"
    run = lambda: watch(spark, store, str(folder), str(tmp_path / "cp")).awaitTermination()
    put(folder, "0.json", ("x.md", "added", "first", "2024-01-02T00:00:00", 1), ("x.md", "modified", "second", "2024-01-02T00:00:00", 2), ("y.md", "added", "kept", None, None))
    run()
    assert doc(store, "x.md") == "second" and doc(store, "y.md") == "kept"
    version = store.version
    # earlier than what was applied, in a later batch; and the same once more
    put(folder, "1.json", ("x.md", "deleted", None, "2024-01-01T00:00:00", 9), ("x.md", "modified", "second", "2024-01-02T00:00:00", 2), ("x.md", "modified", "none", None, 7))
    run()
    assert doc(store, "x.md") == "second" and store.version == version
    put(folder, "2.json", ("x.md", "deleted", None, "2024-01-03T00:00:00", 3), ("y.md", "modified", "new", "2024-01-01T00:00:00", None))
    run()
    assert doc(store, "x.md") is None and doc(store, "y.md") == "new"
    put(folder, "3.json", ("x.md", "added", "again", "2024-01-03T00:00:00", 4))
    run()
    assert doc(store, "x.md") == "again"


def test_a_burst_is_one_row_and_survives_a_restart(spark, tmp_path):
    folder, out, checkpoint = tmp_path / "log", tmp_path / "out", tmp_path / "cp"
    rows = lambda: sorted((r["path"], r["text"], r["event_id"]) for r in spark.read.schema(CHANGES).json(str(out)).collect()) if out.exists() else []

    def start(quiet):
        each = lambda batch, _: batch.write.mode("append").json(str(out))
        found = settled(spark.readStream.schema(CHANGES).json(str(folder)), quiet)
        return found.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", str(checkpoint)).trigger(processingTime="1 second").start()

    put(folder, "0.json", ("a.md", "added", "one", "2024-01-01T00:00:00", 1), ("b.md", "added", "b", "2024-01-01T00:00:00", 2))
    running = start(12)
    until(lambda: running.lastProgress and running.lastProgress["batchId"] >= 0 and running.recentProgress[0]["numInputRows"] == 2)
    put(folder, "1.json", ("a.md", "modified", "two", "2024-01-01T00:00:01", 3))
    put(folder, "2.json", ("a.md", "modified", "three", "2024-01-01T00:00:02", 4), ("a.md", "modified", "older", "2024-01-01T00:00:01", 9))
    until(lambda: sum(p["numInputRows"] for p in running.recentProgress) == 5)
    running.stop()
    assert rows() == []  # all wait, in the checkpoint
    running = start(12)
    until(lambda: len(rows()) >= 2)
    running.stop()
    assert rows() == [("a.md", "three", 4), ("b.md", "b", 2)]


def test_quiet_needs_a_stream_that_goes_on(spark, tmp_path):
    with pytest.raises(ValueError):
        watch(spark, Store(spark, str(tmp_path / "s")), str(tmp_path), str(tmp_path / "cp"), once=True, quiet=2)


def test_files_that_are_being_written_wait(spark, tmp_path):
    store, folder = Store(spark, str(tmp_path / "s")), tmp_path / "files"
    folder.mkdir()
    (folder / "a.md").write_text("a text")
    os.utime(folder / "a.md", (1704103200, 1704103200))  # 2024-01-01 10:00:00
    ingest.register_collection(store, "c", str(folder))
    assert sync_folder(store, "c", "2024-01-01 10:00:01", quiet=5) == {"changed": 0, "gone": 0}
    assert sync_folder(store, "c", "2024-01-01 10:00:05", quiet=5) == {"changed": 1, "gone": 0}
    (folder / "a.md").write_text("a newer text")
    os.utime(folder / "a.md", (1704103300, 1704103300))
    assert sync_folder(store, "c", "2024-01-01 10:01:41", quiet=5) == {"changed": 0, "gone": 0} and doc(store, "a.md") == "a text"
