"""The store's writes as DataFrame merges: contents, documents, removal, collection of garbage, caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    """One row for each key: the last in ``order`` (given best first).

    For a single descending order without ties to keep apart this is a max_by, combined before the shuffle.
    """
    best = F.max(F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rows.columns if c not in (*order, *keys)]))
    merged = rows.groupBy(*keys).agg(best.alias("__best"))
    return merged.select(*[F.col(c) if c in keys else F.col(f"__best.{c}") for c in rows.columns])


def insert_ignore(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``existing`` and those of ``new`` whose key it doesn't have, once each."""
    return existing.unionByName(new.dropDuplicates([key]).join(existing.select(key), key, "left_anti"))


def statuses(incoming: DataFrame, existing: DataFrame, keys: list[str], hashed: str = "hash") -> DataFrame:
    """``incoming`` with added, updated or unchanged, by the hash stored under the same key."""
    old = existing.select(*keys, F.col(hashed).alias("__old"))
    state = F.when(F.col("__old").isNull(), "added").when(F.col("__old") == F.col(hashed), "unchanged").otherwise("updated")
    return incoming.join(old, keys, "left").withColumn("status", state).drop("__old")


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], kept: list[str]) -> DataFrame:
    """The merge of one row for each key: incoming values win, but ``kept`` columns stay as they first were.

    Rows that come in are active again, whatever they were.
    """
    old = existing.select(*keys, *[F.col(c).alias(f"old_{c}") for c in existing.columns if c not in keys])
    joined = old.join(incoming.withColumn("__new", F.lit(True)), keys, "full_outer")
    out = []
    for c in existing.columns:
        if c in keys:
            out.append(F.col(c))
        elif c == "active":
            out.append(F.when(F.col("__new"), True).otherwise(F.col("old_active")).alias(c))
        elif c == "deleted_at":
            out.append(F.when(F.col("__new").isNull(), F.col("old_deleted_at")).alias(c))
        elif c in kept or c not in incoming.columns:
            out.append((F.coalesce(f"old_{c}", c) if c in incoming.columns else F.col(f"old_{c}")).alias(c))
        else:
            out.append(F.when(F.col("__new"), F.col(c)).otherwise(F.col(f"old_{c}")).alias(c))
    return joined.select(*out)


def path_ends(path: Column, suffix: str) -> Column:
    """Whether a path ends so, whatever the case of its letters; % and _ are letters as others."""
    return F.endswith(F.lower(path), F.lit(suffix.lower()))


def soft_delete(documents: DataFrame, where: Column, at: Column) -> DataFrame:
    """``documents`` with the active rows under ``where`` marked as deleted."""
    hit = F.col("active") & F.coalesce(where, F.lit(False))
    return documents.withColumn("deleted_at", F.when(hit, at).otherwise(F.col("deleted_at"))).withColumn("active", F.col("active") & ~hit)


def purge(documents: DataFrame, content: DataFrame, chunks: DataFrame, cutoff: Column) -> dict[str, DataFrame]:
    """What stays, and what goes, when documents deleted before ``cutoff`` are purged with all that only they use."""
    doomed = documents.where(~F.col("active") & (F.col("deleted_at") < cutoff))
    kept = documents.where(~F.coalesce(~F.col("active") & (F.col("deleted_at") < cutoff), F.lit(False)))
    orphans = doomed.select("hash").distinct().join(kept.select("hash"), "hash", "left_anti")
    return {
        "doomed": doomed, "orphans": orphans,
        "documents": kept, "content": content.join(orphans, "hash", "left_anti"),
        "chunks": chunks.join(orphans, chunks.content_hash == orphans.hash, "left_anti"),
        "doomed_chunks": chunks.join(orphans, chunks.content_hash == orphans.hash, "left_semi"),
    }


def unreferenced(content: DataFrame, documents: DataFrame) -> DataFrame:
    """Contents that no document has any more, superseded ones among them."""
    return content.join(documents.select("hash").distinct(), "hash", "left_anti")


def stale(wanted: DataFrame, indexed: DataFrame, by: list[str]) -> DataFrame:
    """Hashes of ``wanted`` (content_hash and the columns ``by``) that aren't indexed just so: to be indexed."""
    return wanted.join(indexed.select("content_hash", *by).distinct(), ["content_hash", *by], "left_anti")


# ------------------------------------------------------------------------------- caches
def cache_valid(cache: DataFrame, now: Column) -> DataFrame:
    """Entries without an end, or whose end lies after ``now``."""
    return cache.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))


def cache_put(cache: DataFrame, new: DataFrame) -> DataFrame:
    """``cache`` with the entries of ``new`` in the place of those with the same key."""
    return cache.join(new.select("hash"), "hash", "left_anti").unionByName(new)


def longest_expired(cache: DataFrame, now: Column, limit: int = 100) -> DataFrame:
    """Keys of the ``limit`` longest expired entries."""
    return cache.where(F.col("expires_at") <= now).orderBy("expires_at", "hash").limit(limit).select("hash")


def cache_evict(cache: DataFrame, now: Column, limit: int = 100) -> DataFrame:
    """``cache`` without its ``limit`` longest expired entries."""
    return cache.join(longest_expired(cache, now, limit), "hash", "left_anti")


def last_per_key(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row for each key by a window, where the order mixes directions."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
