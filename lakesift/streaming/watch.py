"""Changes of files as a stream into the store."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lakesift.operators import ingest, lifecycle
from lakesift.providers import Embedder
from lakesift.schema import Settings
from lakesift.sources.files import files_below, with_contents
from lakesift.store import Store

CHANGES = "collection string, path string, kind string, text string, ts timestamp, event_id bigint"

#: What the stream keeps of a path: the last change that was passed on, and the last that waits, with its text until it goes.
WAITING = "done_at bigint, done_no bigint, at bigint, no bigint, kind string, text string"
SETTLED = "collection string, path string, kind string, text string, at bigint, no bigint"
#: Stand for nothing yet, and for a null time or number: before all others.
NEVER, NULL = -(2**63), -(2**63) + 1


def settled(changes: DataFrame, quiet: int = 0) -> DataFrame:
    """A stream of changes (CHANGES) with one row for each burst: the last change of a path by (ts, event_id), nulls first, once no other has
    come for it for ``quiet`` seconds; with 0, the last of each batch.

    State is kept by collection and path. Changes that are not later than the last one passed on are dropped, in whatever
    batch they come: a log that is read again, or out of order, changes nothing. What waits is in the checkpoint, and
    goes after a restart. The text of a change is held only while it waits; a few numbers stay for each path.
    """

    def gather(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done_at, done_no, at, no, kind, text = state.get if state.exists else (NEVER, NEVER, NEVER, NEVER, None, None)
        late = state.hasTimedOut
        for part in parts:
            for a, n, k, t in zip(part["at"], part["no"], part["kind"], part["text"], strict=True):
                if (a, n) > (done_at, done_no) and (kind is None or (a, n) >= (at, no)):
                    at, no, kind, text = int(a), int(n), k if isinstance(k, str) else "", t if isinstance(t, str) else None
        if kind is not None and (late or not quiet):
            yield pd.DataFrame({"collection": [key[0]], "path": [key[1]], "kind": [kind], "text": [text], "at": [at], "no": [no]})
            done_at, done_no, at, no, kind, text = at, no, NEVER, NEVER, None, None
        state.update((done_at, done_no, at, no, kind, text))
        if kind is not None:
            state.setTimeoutDuration(quiet * 1000)

    numbered = changes.select("collection", "path", "kind", "text", F.coalesce(F.unix_micros("ts"), F.lit(NULL)).alias("at"), F.coalesce("event_id", F.lit(NULL)).alias("no"))
    timeout = GroupStateTimeout.ProcessingTimeTimeout if quiet else GroupStateTimeout.NoTimeout
    found = numbered.groupBy("collection", "path").applyInPandasWithState(gather, SETTLED, WAITING, "update", timeout)
    number = lambda c: F.when(F.col(c) != NULL, F.col(c))
    return found.select("collection", "path", "kind", "text", F.timestamp_micros(number("at")).alias("ts"), number("no").alias("event_id"))


def last_changes(batch: DataFrame) -> DataFrame:
    """The last change of each path in a batch: earlier ones make no difference to the state."""
    return lifecycle.latest(batch, ["collection", "path"], "ts", "event_id")


def apply_changes(store: Store, batch: DataFrame, model: Embedder | None, settings: Settings, now: str) -> None:
    """Upsert added and modified paths, deactivate deleted ones, then index what is new. The same batch again changes nothing."""
    last = last_changes(batch).persist()
    try:
        for row in last.select("collection").distinct().toLocalIterator():
            name = row["collection"]
            own = last.where(F.col("collection") == name)
            files = own.where("kind <> 'deleted' and text is not null").select("path", F.concat(F.lit("stream:"), "path").alias("source_uri"), "text", F.col("ts").alias("modified_at"))
            if files.limit(1).count():
                ingest.add_documents(store, files, name, now)
            gone = own.where("kind = 'deleted'").select("collection", "path")
            ingest.remove_all(store, gone, now)
        if model is not None:
            ingest.index_documents(store, model, settings, now)
    finally:
        last.unpersist()


def watch(spark: SparkSession, store: Store, folder: str, checkpoint: str, model: Embedder | None = None, settings: Settings | None = None, once: bool = True, quiet: int = 0):
    """Apply the change log in ``folder`` (JSON lines of CHANGES) to the store, as it grows; bursts of changes of a path as one, ``quiet`` seconds
    after their last (``settled``). With ``once`` what is there is applied without waiting. A checkpoint belongs to one choice of ``quiet`` being 0 or not."""
    if once and quiet:
        raise ValueError("what is there once has no later changes to wait for: quiet is for a stream that goes on")
    changes = settled(spark.readStream.schema(CHANGES).json(folder), quiet)
    each = lambda batch, _: apply_changes(store, batch, model, settings or Settings(), datetime.now(UTC).strftime("%Y-%m-%d %H:%M:%S"))
    writer = changes.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{min(quiet, 5) or 5} seconds")).start()


def sync_folder(store: Store, collection: str, now: str, model: Embedder | None = None, settings: Settings | None = None, quiet: int = 0) -> dict[str, int]:
    """Bring a collection to the state of its folder: files that are new or have another time are read, documents whose file is gone are
    deactivated; how many of each. Paths and times are compared; only what changed is read. A file that was written less than ``quiet`` seconds
    before ``now`` waits for a later sync, so that a burst of writes is read once."""
    row = store.table("store_collections").where(F.col("name") == collection).head()
    if row is None:
        raise ValueError(f"no collection {collection}")
    there = files_below(store.spark, row["path"], row["pattern"], row["ignore_patterns"] or [])
    held = store.table("documents").where("active").where(F.col("collection") == collection)
    resting = there.where(F.col("modified_at") <= F.lit(now).cast("timestamp") - F.make_dt_interval(secs=F.lit(quiet))) if quiet else there
    changed = resting.join(held.select("path", "modified_at"), ["path", "modified_at"], "left_anti").select("path").persist()
    try:
        n = changed.count()
        if n:
            ingest.add_documents(store, with_contents(there.join(changed, "path", "left_semi")), collection, now)
        gone = ingest.remove_all(store, held.select("collection", "path").join(there.select("path"), "path", "left_anti"), now)
        if model is not None and n:
            ingest.index_documents(store, model, settings or Settings(), now)
        return {"changed": n, "gone": gone}
    finally:
        changed.unpersist()


def watch_folder(spark: SparkSession, store: Store, collection: str, checkpoint: str, model: Embedder | None = None, settings: Settings | None = None, seconds: int = 5, quiet: int = 0):
    """Sync a collection with its folder every few seconds, as a streaming query. Files may be changed or deleted in place, which a
    stream of files would not see, so each batch compares the folder with the store; the same state again changes nothing."""
    each = lambda batch, _: sync_folder(store, collection, datetime.now(UTC).strftime("%Y-%m-%d %H:%M:%S"), model, settings, quiet)
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()
