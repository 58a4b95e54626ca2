"""The ledger of secret scans, and masking."""

from lakesift.llm import secrets


def test_secrets_ledger_holds_no_text(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    docs = spark.createDataFrame([(1, "password = hunter2222"), (1, "password = hunter2222"), (2, None), (3, "no finding")], "doc_id long, text string")
    assert secrets.scan_rows(docs, ledger).where("n_assign = 1").count() == 2
    for f in (tmp_path / "ledger").rglob("*"):
        assert not f.is_file() or b"hunter2222" not in f.read_bytes()
    assert {p.name for p in (tmp_path / "ledger").iterdir()} == {"findings", "scanned"}
    assert spark.read.parquet(f"{ledger}/scanned").where("rule_version = '" + secrets.RULE_VERSION + "'").count() == 3
    # other rules: everything is scanned again, under their version
    before = secrets.RULE_VERSION
    secrets.RULE_VERSION = "other"
    try:
        secrets.scan_rows(docs, ledger).count()
        assert spark.read.parquet(f"{ledger}/scanned").count() == 6
    finally:
        secrets.RULE_VERSION = before


def test_mask_rows_keeps_other_columns(spark):
    docs = spark.createDataFrame([(1, "a token: abcdefgh b", 7, "s", "r"), (2, None, 8, None, None)], "doc_id long, text string, n_hex long, spans string, blob string")
    assert [tuple(r) for r in secrets.mask_rows(docs).orderBy("doc_id").collect()] == [(1, "a [SECRET] b", 7, "s", "r"), (2, None, 8, None, None)]
