import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from assetlytics.llm import files, warc

PAGES = "page_id long, url string, html string"


@pytest.fixture()
def pages(spark):
    body = "é" * 60  # 120 bytes
    rows = [(5, "http://a.example/", body), (3, "http://b.example/\r\nX: y", body), (9, None, body), (1, "u", "short"), (2, "u", "short"), (4, "u", None),
            (6, "u", ""), (None, "u", body), (7, "u", "WARC/1.1\r\n\r\n" * 3000), (3, "again", body)]
    return spark.createDataFrame(rows, PAGES).withColumn("payload", F.lit(1)).withColumn("first_id", F.lit(1)).withColumn("headers", F.lit(1))


@pytest.mark.parametrize("zipped", ["none", "gzip"])
def test_round_trip(spark, pages, zipped):
    path = warc.write_pages(pages, compression=zipped, fileBytes="2000")
    back = spark.read.format("warc").option("path", path).load().withColumn("page_id", warc.page_id_of("record_id")).collect()
    assert len(back) == 10
    body = ("é" * 60).encode()
    for r in back:
        if r.record_type == "revisit":
            assert (r.page_id, r.refers_to, r.payload_bytes, bytes(r.payload)) in {(5, "urn:x-page:3", 120, b""), (9, "urn:x-page:3", 120, b"")}
            assert r.payload_digest == hashlib.sha256(body).hexdigest()
        else:
            assert r.payload_digest == hashlib.sha256(r.payload).hexdigest() and r.payload_bytes == len(r.payload)
    assert sorted((r.page_id or 0) for r in back if r.record_type == "revisit") == [5, 9]
    assert {r.target_uri for r in back if r.page_id == 9} == {None}
    assert any(r.target_uri == "http://b.example/%0D%0AX: y" for r in back)


def test_pushdown_skips_payloads(spark, pages):
    path = warc.write_pages(pages)
    df = spark.read.format("warc").option("path", path).load()
    one = df.where("record_type = 'revisit' AND target_uri = 'http://a.example/'")
    assert [r.payload_bytes for r in one.collect()] == [120]
    bare = spark.read.format("warc").option("path", path).option("payload", "false").load()
    assert bare.where("payload IS NOT NULL").count() == 0 and bare.count() == 10

    class Counting(io.BytesIO):
        got = 0

        def read(self, *a):
            out = super().read(*a)
            self.got += len(out)
            return out
    data = b"".join(warc.record(k, "urn:x", "u", "d", b"p" * 9000, 9000, "x", "r") for k in ("response", "revisit", "response"))
    f = Counting(data)
    assert [h["warc-type"] for _, h, _, _ in warc.scan(f, [lambda h: h["warc-type"] == "revisit"], True)] == ["revisit"]
    assert f.got == 0


def test_uncommitted_files_are_not_read(spark, pages):
    path = warc.write_pages(pages)
    files.put(path, "left-by-a-lost-task.warc", b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 0\r\n\r\n\r\n\r\n")
    assert spark.read.format("warc").option("path", path).load().count() == 10


def test_foreign_archive(spark, tmp_path):
    text = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\nWARC/1.0\r\nWARC-Type: resource\r\nX: a\r\n b\r\ncontent-length: 2\r\n\r\nhi\r\n\r\n"
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(text))
    rows = spark.read.format("warc").option("path", str(tmp_path)).load().orderBy("offset").collect() if warc.register(spark) is None else None
    assert [(r.record_type, bytes(r.payload), r.payload_bytes) for r in rows] == [("warcinfo", b"abcd", 4), ("resource", b"hi", 2)]
    assert rows[1].headers["x"] == "a b"


def test_payload_bytes_of_foreign_responses(spark, tmp_path):
    """The block says how long a payload is, not an HTTP header that is absent or wrong."""
    def one(kind, http, body):
        return (b"WARC/1.1\r\nWARC-Type: %s\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: %d\r\n\r\n" % (kind, len(http + body))
                + http + body + b"\r\n\r\n")
    (tmp_path / "x.warc").write_bytes(one(b"response", b"HTTP/1.1 200 OK\r\n\r\n", b"twelve bytes") + one(b"response", b"HTTP/1.1 200 OK\r\nContent-Length: 99\r\n\r\n", b"four")
                                      + one(b"revisit", b"HTTP/1.1 200 OK\r\nContent-Length: 99\r\n\r\n", b""))
    warc.register(spark)
    rows = spark.read.format("warc").option("path", str(tmp_path)).load().orderBy("offset").collect()
    assert [(r.record_type, r.payload_bytes, bytes(r.payload)) for r in rows] == [("response", 12, b"twelve bytes"), ("response", 4, b"four"), ("revisit", 99, b"")]


def test_empty_table(spark, pages):
    path = warc.write_pages(pages.where("false"))
    assert spark.read.format("warc").option("path", path).load().count() == 0
