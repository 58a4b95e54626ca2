"""The shared folder, and tables that are dealt out."""

import os
from types import SimpleNamespace

import pytest

from lakesift.blocks import dealt, forget, materialise, work_dir


def test_a_cluster_needs_a_shared_folder():
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError):
        work_dir(session, "x")
    told = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: "hdfs://shared/"), sparkContext=SimpleNamespace(master="spark://host:7077"))
    assert work_dir(told, "x").startswith("hdfs://shared/x-") and work_dir(told, "x") != work_dir(told, "x")


def test_written_tables_are_forgotten(spark):
    kept, gone = materialise(spark.range(5), "kept"), materialise(spark.range(7), "gone")
    folder = os.path.dirname(gone.inputFiles()[0].removeprefix("file://").removeprefix("file:"))
    assert os.path.isdir(folder) and gone.count() == 7
    forget(gone)
    assert not os.path.exists(folder) and kept.count() == 5


def test_small_tables_of_few_files_are_dealt(spark, tmp_path):
    rows = spark.range(1000)
    rows.coalesce(1).write.parquet(str(tmp_path / "one"))
    rows.repartition(9).write.parquet(str(tmp_path / "nine"))
    cores = spark.sparkContext.defaultParallelism
    one, nine = spark.read.parquet(str(tmp_path / "one")), spark.read.parquet(str(tmp_path / "nine"))
    assert dealt(one).rdd.getNumPartitions() == cores and sorted(r[0] for r in dealt(one).collect()) == list(range(1000))
    assert dealt(nine) is nine and dealt(rows) is rows
