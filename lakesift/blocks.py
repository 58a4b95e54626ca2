"""The shared work folder, and tables in numbered blocks that are sent to tasks one at a time."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: How tables are compressed that are written here, and in the store.
CODEC = "zstd"
#: Keys that ``picked`` sends to the tasks at most, as hashes of eight bytes.
MOST_KEYS = 1 << 20


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Where the setting is unset a temporary folder stands in for it on one machine (tests); on a cluster that is an error,
    as no folder of one machine can be shared.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: it has to name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage ends there."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.option("compression", CODEC).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*written: DataFrame) -> None:
    """Delete what ``materialise`` wrote, once nothing reads it any more."""
    for df in written:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path(folder).getFileSystem(spark._jsc.hadoopConfiguration()).delete(path(folder), True)


def picked(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(the rows whose keys are those of a row of ``wanted``, a written table that they read): a semi-join in which rows stay where they are.

    What moves are keys. Hashes of those that are wanted, or of those that aren't, whichever are fewer, then go to all tasks. Rows are joined
    where both are more than MOST_KEYS, or one hash stands for keys of both kinds. Null keys are equal.
    """
    own, number = wanted.select(*[F.col(k).alias(f"__{k}") for k in keys]), F.xxhash64(*keys)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    told = rows.select(*keys).join(own.withColumn("__in", F.lit(True)), same, "left").select(number.alias("__number"), F.col("__in").isNotNull().alias("__in"))
    marks = materialise(told.groupBy("__number").agg(F.bool_or("__in").alias("some"), F.bool_and("__in").alias("every")), "marks")
    some, rest, both = marks.agg(F.count_if("some"), F.count_if(~F.col("every")), F.count_if(F.col("some") & ~F.col("every"))).head()
    if not rest:
        return rows, marks
    if both or min(some, rest) > MOST_KEYS:
        return rows.join(own, same, "left_semi"), marks
    few = marks.where("some" if some <= rest else "not some").select("__number")
    return rows.withColumn("__number", number).join(F.broadcast(few), "__number", "left_semi" if some <= rest else "left_anti").select(*rows.columns), marks


def pieces(batch: pa.RecordBatch, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``most`` bytes: what a task makes of its rows is held for one of them at a time."""
    step = max(1, batch.num_rows * most // max(batch.nbytes, 1))
    for a in range(0, batch.num_rows, step):
        yield batch.slice(a, step)


#: Tables of fewer bytes are dealt out to all cores before work on them: they may lie in one row group, which is one task.
DEALT_BYTES = 64 << 20


def dealt(df: DataFrame) -> DataFrame:
    """``df``, over all cores if it comes from few and small files; any other is read in as many tasks as it has parts."""
    cores, files = df.sparkSession.sparkContext.defaultParallelism, df.inputFiles()
    if not files or len(files) >= cores:
        return df
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path
    sizes = [path(f).getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).getFileStatus(path(f)).getLen() for f in files]
    return df.repartition(cores) if sum(sizes) < DEALT_BYTES else df


def in_blocks(rows: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
    """``rows`` in the shared folder with their ``__block`` of at most ``size`` rows, in their order; how many blocks."""
    placed = materialise(rows.withColumn("__at", F.monotonically_increasing_id()), name)
    # the id is the partition above 33 bits that count its rows
    placed = placed.withColumn("__part", F.shiftright("__at", 33))
    until = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = placed.groupBy("__part").agg(F.count("*").alias("__n")).select("__part", F.coalesce(F.sum("__n").over(until), F.lit(0)).alias("__before"))
    number = F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = placed.join(F.broadcast(before), "__part").withColumn("__block", F.floor(number / size).cast("long")).select(*rows.columns, "__block")
    path = work_dir(rows.sparkSession, name)
    numbered.write.partitionBy("__block").parquet(path)
    blocks = rows.sparkSession.read.schema(numbered.schema).parquet(path)
    return blocks, (blocks.agg(F.max("__block")).head()[0] + 1 if blocks.head(1) else 0)


def by_blocks(rows: DataFrame, size: int, name: str, prepare: Callable, scan: Callable, schema: str) -> DataFrame:
    """What ``scan`` gives for each block of ``rows``, in the shared folder.

    ``scan`` gets a broadcast of ``prepare(the block's rows)`` and returns a DataFrame of ``schema``. The driver
    holds one block at a time: a pass has been written before the next block is read.
    """
    spark = rows.sparkSession
    blocks, n = in_blocks(rows, size, name)
    path = work_dir(spark, f"{name}-found")
    for k in range(n):
        own = blocks.where(F.col("__block") == k).select(*rows.columns).collect()
        held = spark.sparkContext.broadcast(prepare([tuple(r) for r in own]))
        scan(held).write.mode("append").parquet(path)
        held.destroy()
    return spark.read.schema(schema).parquet(path) if n else spark.createDataFrame([], schema)
