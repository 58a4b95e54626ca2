"""The media column is stored, and what is stored is read back."""

import hashlib

from lakesift.llm import queries

SF = "/root/testdata/sf0.001"


def test_media_query_reads_stored_files(spark):
    out = queries.op8_media_columns(spark, SF)
    files = out.inputFiles()
    assert files and all("/shared/media-" in f for f in files)
    stored = {(r["doc_id"], hashlib.sha256(r["media"]).hexdigest()) for r in spark.read.parquet(*files).collect()}
    assert stored == {(r["doc_id"], r["media_sha256"]) for r in out.collect()} and len(stored) == spark.read.parquet(f"{SF}/documents.parquet").count()
