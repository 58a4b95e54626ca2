"""Small files are read many to a task."""

from lakesift.operators import ingest
from lakesift.sources.files import many_files, read_files
from lakesift.store import Store


def test_a_task_reads_many_small_files(spark, tmp_path, monkeypatch):
    folder = tmp_path / "v"
    folder.mkdir()
    for k in range(400):
        (folder / f"{k}.md").write_text(f"text {k}")
    key, tasks = "spark.sql.files.openCostInBytes", []
    was = spark.conf.get(key)
    added = ingest.add_documents
    monkeypatch.setattr(ingest, "add_documents", lambda store, files, *a: tasks.append(files.rdd.getNumPartitions()) or added(store, files, *a))
    store = Store(spark, str(tmp_path / "s"))
    ingest.register_collection(store, "c", str(folder), "*.md")
    assert ingest.update_collection(store, "c", "2024-01-02 00:00:00") == {"added": 400, "updated": 0, "unchanged": 0}
    assert tasks[0] <= spark.sparkContext.defaultParallelism + 1 and spark.conf.get(key) == was
    with many_files(spark):
        assert {r["text"] for r in read_files(spark, str(folder)).collect()} == {f"text {k}" for k in range(400)}
