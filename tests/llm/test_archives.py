"""Packages that other tools made, names that no attempt shares, and paths with and without a scheme."""

import gzip
import io
import json
import zipfile

import pytest

from lakesift.llm import warc


def foreign_record(uri, body, kind="response"):
    block = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n" + body if kind == "response" else body
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {uri}\r\nWARC-Record-ID: <urn:uuid:{uri}>\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def package(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


def test_packages_made_elsewhere(spark, tmp_path):
    own = [foreign_record("info", b"software: x", "warcinfo"), foreign_record("a", b"<p>one</p>"), foreign_record("b", b"two\r\n\r\nthree" * 5000)]
    packed = [gzip.compress(x) for x in own]
    entries, at = [], 0
    for uri, x in zip("iab", packed, strict=True):
        entries.append(f"{uri} 20200101000000 " + json.dumps({"url": uri, "offset": str(at), "length": str(len(x)), "filename": "first.warc.gz"}))
        at += len(x)
    plain = foreign_record("c", b"plain") + foreign_record("d", b"") + foreign_record("x", b"a=b", "request")
    data = package({
        "archive/first.warc.gz": b"".join(packed), "archive/more/second.warc": plain, "archive/third.warc.gz": b"".join(gzip.compress(foreign_record(u, u.encode())) for u in "ef"),
        "indexes/index.cdx.gz": gzip.compress(("!meta 0 {}\n" + "\n".join(entries)).encode()), "pages/pages.jsonl": "{}", "archive/readme.txt": "no records",
    })
    (tmp_path / "other.wacz").write_bytes(data)
    rows = warc.read_archives(spark.createDataFrame([(f"file:{tmp_path}/other.wacz",)], "path string"), with_payload=True).collect()
    assert {r["uri"]: bytes(r["payload"]) for r in rows} == {"a": b"<p>one</p>", "b": b"two\r\n\r\nthree" * 5000, "c": b"plain", "d": b"", "e": b"e", "f": b"f"}
    assert all(r["page_id"] is None and r["record_type"] == "response" and r["payload_bytes"] == len(r["payload"]) for r in rows)


def test_names_are_an_attempts_own(spark, tmp_path):
    folder = warc.qualified(spark, str(tmp_path / "w"))
    assert folder.startswith("file:/") and warc.qualified(spark, folder) == folder
    one, two = (warc._publish(folder, "part-000001-0000", x) for x in (b"one", b"two"))
    assert one != two and {p.read_bytes() for p in (tmp_path / "w").iterdir()} == {b"one", b"two"}
    where, path = warc.file_system(one)
    assert where.open_input_file(path).read() == b"one"


def test_only_listed_packages_count(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"text {i}") for i in range(50)], "page_id long, url string, html string").repartition(3)
    listed = warc.write_archives(pages, str(tmp_path / "w"))
    again = warc.write_archives(pages, str(tmp_path / "w"))  # as an attempt that was done twice
    assert warc.read_archives(listed).count() == warc.read_archives(again).count() == 50


def test_damage_is_found(spark, tmp_path):
    path = warc.write_archives(spark.createDataFrame([(1, "u", "some text")], "page_id long, url string, html string"), str(tmp_path / "w")).head()["path"]
    where, own = warc.file_system(path)
    data = where.open_input_file(own).read()
    with pytest.raises(ValueError):
        warc.zip_members(lambda at, n: data[at:at + n], len(data) - 30)
