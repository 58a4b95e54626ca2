"""Replies of a language model to many prompts, kept in the store's cache."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesift.blocks import forget, materialise, work_dir
from lakesift.operators import lifecycle, retrieval
from lakesift.providers import Writer, loaded
from lakesift.sources.files import qualified, read_file, write_file
from lakesift.store import Store

REPHRASE = "Give four other wordings of this search query, one on each line, without numbers or punctuation.\n\nQuery: {query}\n"
ANSWER = "Answer this question in one factual paragraph of three to five sentences.\n\nQuestion: {query}\n"
#: Seconds before a request is made again; twice as many each time.
PAUSE = 0.2


def key_of(value: object) -> str:
    return hashlib.sha256(json.dumps(value, ensure_ascii=False).encode()).hexdigest()


def _reply(model: Writer, prompt: str, tries: int) -> str:
    for k in range(tries):
        try:
            return model.reply(prompt)
        except (OSError, ValueError):  # no connection, a time that ran out, or half an answer
            if k == tries - 1:
                raise
            time.sleep(PAUSE * 2**k)
    raise ValueError("a request needs at least one try")


def asked(prompts: DataFrame, model: Writer | Callable[[], Writer], folder: str, in_flight: int = 8, tries: int = 3) -> DataFrame:
    """key, reply of each row of ``prompts`` (key, prompt), asked for in the tasks, ``in_flight`` at a time in each.

    The replies to those that were asked together are stored in ``folder`` before the next are asked. A task that is run again finds
    them there, as it reads the same rows in the same order: ``prompts`` has to be a written table. A request that fails is made
    again, ``tries`` times in all; then the task fails.
    """
    target = qualified(prompts.sparkSession, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = loaded(model)
        with ThreadPoolExecutor(in_flight) as pool:
            for batch in batches:
                for a in range(0, batch.num_rows, in_flight):
                    keys, texts = (batch.slice(a, in_flight).column(k).to_pylist() for k in (0, 1))
                    place = f"{target}/{key_of(keys)}"
                    held = read_file(place)
                    found = json.loads(held) if held is not None else list(pool.map(lambda t: _reply(own, t or "", tries), texts))
                    if held is None:
                        write_file(place, json.dumps(found).encode())
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(found, pa.string())], ["key", "reply"])

    return prompts.select("key", "prompt").mapInArrow(run, "key string, reply string")


def replies(store: Store, prompts: DataFrame, model: Writer | Callable[[], Writer], now: str, in_flight: int = 8, tries: int = 3) -> DataFrame:
    """query_id, reply of each row of ``prompts`` (query_id, prompt): from the cache, or asked for and kept there for ever.

    Prompts meet the cache by the digest of the model's name and the prompt, the key of ``search.ask``. Of equal prompts one is sent, and only
    those that the cache lacks. A null prompt has no reply. Repeated query_ids are rows.
    """
    name = loaded(model).name

    @F.pandas_udf("string")
    def digest(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else key_of([name, t]))

    own = materialise(prompts.select("query_id", F.col("prompt").cast("string").alias("prompt")).withColumn("key", digest("prompt")), "prompts")
    different = own.where("key is not null").groupBy("key").agg(F.min("prompt").alias("prompt"))
    valid = lifecycle.cache_valid(store.table("cache").where("type = 'llm'"), F.lit(now).cast("timestamp"))
    held = valid.select(F.col("hash").alias("key"), F.col("result").alias("reply")).join(different.select("key"), "key", "left_semi")
    # spread over all cores, however few they are: what takes time is the model
    todo = materialise(different.join(held.select("key"), "key", "left_anti").repartition(store.spark.sparkContext.defaultParallelism, "key").sortWithinPartitions("key"), "todo")
    if todo.head(1):
        folder = work_dir(store.spark, "replies")
        fresh = materialise(asked(todo, model, folder, in_flight, tries), "fresh")
        rows = fresh.select(F.col("key").alias("hash"), F.lit("llm").alias("type"), F.col("reply").alias("result"), F.lit(now).cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("expires_at"))
        store.append({"cache": rows}, {"cache": rows.select("hash")})
        where = store._jvm_path(folder)
        where.getFileSystem(store.spark._jsc.hadoopConfiguration()).delete(where, True)
        held = held.unionByName(fresh)
    out = materialise(own.join(held, "key", "left").select("query_id", "reply"), "replied")
    forget(own, todo)
    return out


def widened(store: Store, queries: DataFrame, model: Writer | Callable[[], Writer], now: str, in_flight: int = 8) -> DataFrame:
    """query_id, kind, words, asked of each row of ``queries`` (query_id, query): what to look for by text, and what to embed.

    A question is answered, and the answer is embedded in its place (an empty answer isn't); any other query gets up to four
    other wordings, whose words are looked for too. A null query counts as an empty one, for which nothing is asked.
    """
    query = F.coalesce(F.col("query"), F.lit(""))
    kind = F.when(F.trim(query) == "", "none").otherwise(retrieval.query_kind(query))
    fill = lambda template: F.concat(*[x for k, part in enumerate(template.split("{query}")) for x in ([query] if k else []) + [F.lit(part)]])
    own = queries.select("query_id", query.alias("query"), kind.alias("kind"), F.when(kind == "hyde", fill(ANSWER)).when(kind == "rephrase", fill(REPHRASE)).alias("prompt"))
    found = own.join(replies(store, own, model, now, in_flight), "query_id")
    reply = F.coalesce("reply", F.lit(""))
    lines = F.slice(F.filter(F.transform(F.split(reply, r"\R"), lambda x: F.trim(x)), lambda x: x != ""), 1, 4)
    return found.select("query_id", "kind", F.when(F.col("kind") == "rephrase", F.concat_ws(" ", F.col("query"), lines)).otherwise(F.col("query")).alias("words"),
                        F.when((F.col("kind") == "hyde") & (reply != ""), reply).otherwise(F.col("query")).alias("asked"))
