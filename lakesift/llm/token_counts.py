"""Token counts through a digest cache."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesift.llm import vocabulary
from lakesift.llm.common import fresh, small_batches, text_of, work_dir

CACHE_SCHEMA = "content_digest binary, tokenizer_digest string, n_tokens long"


def _count_misses(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = vocabulary.encoder(path)
        for batch in batches:
            for part in vocabulary.slices(batch, "content"):
                n = enc.counts(part.column("content"))
                yield pa.RecordBatch.from_arrays([part.column("content_digest"), pa.array(n.astype(np.int64))], ["content_digest", "n_tokens"])

    return run


def normalised(column: str = "text"):
    """The content that is counted: a null is the empty text; no other change, so counts stay those of the text."""
    return text_of(column)


def count_tokens(docs: DataFrame, tokenizer: str | None = None, cache: str | None = None, text: str = "text", limit: int = 2048) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit, through the Parquet cache at ``cache``.

    Contents are known by digest: those with a stored count for this tokenizer version are not
    encoded, the others are encoded once each and appended. A new folder stands in for no cache.
    An append that a lost driver repeats only repeats rows, which reading drops.

    Null text: as empty, 0 tokens. Repeated texts: encoded once, every row gets the count. An empty
    table gives an empty result. Columns of ``docs`` named like the new ones are replaced by them;
    names of inner columns cannot clash.
    """
    spark = docs.sparkSession
    path = tokenizer or vocabulary.default_path()
    version = vocabulary.version_of(path)
    cache = cache or work_dir(spark, "token-cache")
    content = small_batches(docs).select(F.unhex(F.sha2(normalised(text), 256)).alias("content_digest"), normalised(text).alias("content"))
    # one row for each digest before texts move: the partial aggregate already combines copies
    distinct = content.groupBy("content_digest").agg(F.first("content").alias("content"))
    known = read_cache(spark, cache)
    if known is not None:
        known = known.where(F.col("tokenizer_digest") == version)
        distinct = distinct.join(known, "content_digest", "left_anti")
    counted = distinct.mapInArrow(_count_misses(path), "content_digest binary, n_tokens long")
    counted.select("content_digest", F.lit(version).alias("tokenizer_digest"), "n_tokens").write.mode("append").parquet(cache)
    key, size, of, n = (fresh(c, docs.columns) for c in ("__key", "__bytes", "__digest", "__n"))
    counts = read_cache(spark, cache).where(F.col("tokenizer_digest") == version).groupBy(F.col("content_digest").alias(of)).agg(F.max("n_tokens").alias(n))
    kept = [c for c in docs.columns if c not in ("n_bytes", "n_tokens", "over_limit")]
    keyed = docs.select("*", F.unhex(F.sha2(normalised(text), 256)).alias(key), F.octet_length(normalised(text)).cast("long").alias(size))
    return keyed.join(counts, F.col(key) == F.col(of), "left").select(*kept, F.col(size).alias("n_bytes"), F.col(n).alias("n_tokens"), (F.col(n) > limit).alias("over_limit"))


def read_cache(spark, cache: str) -> DataFrame | None:
    """The stored counts, or None where nothing is stored yet."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    return spark.read.schema(CACHE_SCHEMA).parquet(cache)
