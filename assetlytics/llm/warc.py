"""WARC archives as a PySpark data source, ``format("warc")``.

The reader plans one partition a file, takes record-type and header predicates
from Spark, parses a record's headers first and seeks past payloads that no
one wants. The writer makes files that count only once the job commits.
"""

from __future__ import annotations

import gzip
import io
import json
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition,
                                    StringStartsWith, WriterCommitMessage)

from . import files
from .common import maybe_in, scratch_path, small_batches, write_table

SCHEMA = ("file string, offset long, record_type string, record_id string, target_uri string, date string, refers_to string, "
          "payload_digest string, payload_bytes long, headers map<string,string>, payload binary")
#: Least payload that a revisit record replaces.
REVISIT_BYTES = 100
#: A file is closed when it has grown to this size.
FILE_BYTES = 128 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Columns that are read from one header each.
FIELDS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date",
          "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}
MANIFEST = "_files.json"


def _clean(value: str) -> str:
    """A header value: control characters are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(kind: str, record_id: str, uri: str | None, date: str, payload: bytes, size: int, digest: str, refers_to: str | None = None) -> bytes:
    """One record. A revisit has the HTTP headers of the full payload, whose
    size they tell, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if uri is not None:
        head.append(f"WARC-Target-URI: {_clean(uri)}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if kind == "revisit":
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_headers(f) -> dict | None:
    """Headers of the record at f, names in lower case; None at the end."""
    line = f.readline()
    while line in (b"\r\n", b"\n"):
        line = f.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no WARC record at {line[:40]!r}")
    out: dict = {}
    last = None
    for line in iter(f.readline, b""):
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if not text:
            break
        if text[0] in " \t" and last:
            out[last] += " " + text.strip()
        else:
            last, _, value = text.partition(":")
            last = last.strip().lower()
            out[last] = value.strip()
    return out


def _field(headers: dict, name: str):
    value = headers.get(FIELDS[name])
    if value is not None and name in ("record_id", "refers_to"):
        value = value.strip("<>")
    if value is not None and name == "payload_digest":
        value = value.split(":", 1)[-1]
    return value


def scan(f, tests: list, want_payload: bool):
    """(offset, headers, HTTP headers' size of the payload, payload or None) of
    the records that pass ``tests``, which look at headers only. The blocks of
    others, and unwanted payloads, are not read but sought past."""
    while True:
        offset = f.tell()
        h = read_headers(f)
        if h is None:
            return
        length, begin = int(h.get("content-length", 0)), f.tell()
        if all(t(h) for t in tests):
            size, payload, body = length, None, begin
            if h.get("content-type", "").startswith("application/http"):
                line = f.readline()
                size, revisit = 0, h.get("warc-type", "").lower() == "revisit"
                for line in iter(f.readline, b""):
                    if line in (b"\r\n", b"\n"):
                        break
                    if revisit and line.lower().startswith(b"content-length:"):
                        size = int(line.split(b":", 1)[1])
                body = f.tell()
                if not revisit:  # the block says how long the payload is, whatever the HTTP headers say
                    size = max(0, begin + length - body)
            if want_payload:
                payload = f.read(max(0, begin + length - body))
            yield offset, h, size, payload
        f.seek(begin + length)


class WarcPart(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.want_payload = str(options.get("payload", "true")).lower() == "true"
        self.wanted: list = []

    def pushFilters(self, filters):
        """Equality, membership and prefix tests on columns that are one header."""
        for x in filters:
            name = x.attribute[0] if len(getattr(x, "attribute", ())) == 1 else None
            if name in FIELDS and isinstance(x, (EqualTo, In, StringStartsWith)):
                kind = "starts" if isinstance(x, StringStartsWith) else "in"
                self.wanted.append((name, kind, x.value if kind == "starts" else tuple(x.value) if isinstance(x, In) else (x.value,)))
            else:
                yield x

    def partitions(self):
        fs, root = files.open_fs(self.path)
        scheme = self.path[:len(self.path) - len(root)] if self.path.endswith(root) else ""
        import pyarrow.fs as pafs
        if fs.get_file_info(root).type == pafs.FileType.File:
            return [WarcPart(self.path)]
        info = {x.path.rsplit("/", 1)[1]: x for x in fs.get_file_info(pafs.FileSelector(root)) if x.is_file}
        names = json.loads(files.get(f"{self.path}/{MANIFEST}")) if MANIFEST in info else sorted(
            n for n in info if re.search(r"\.warc(\.gz)?$", n))
        return [WarcPart(f"{scheme}{root}/{n}") for n in names] or [WarcPart("")]

    def read(self, partition):
        if not partition.value:
            return
        tests = [(lambda h, n=n, v=v: (_field(h, n) or "").startswith(v)) if kind == "starts" else (lambda h, n=n, v=v: _field(h, n) in v)
                 for n, kind, v in self.wanted]
        fs, path = files.open_fs(partition.value)
        f = fs.open_input_file(path)
        if path.endswith(".gz"):
            f = io.BufferedReader(gzip.GzipFile(fileobj=f))
        schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), *((n, pa.string()) for n in FIELDS), ("payload_bytes", pa.int64()),
                            ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
        rows, held = [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
        with f:
            f = f if path.endswith(".gz") else io.BufferedReader(f, 1 << 16)
            for offset, h, size, payload in scan(f, tests, self.want_payload):
                rows.append((partition.value, offset, *(_field(h, n) for n in FIELDS), size, list(h.items()), payload))
                held += len(payload or b"")
                if len(rows) >= 1000 or held > 16 << 20:
                    yield batch()
                    rows, held = [], 0
            if rows:
                yield batch()


class WarcCommit(WriterCommitMessage):
    def __init__(self, names: list):
        self.names = names


class WarcWriter(DataSourceArrowWriter):
    """Rows (record_type, record_id, target_uri, refers_to, payload_digest,
    payload_bytes, payload) to files; commit names the files that count."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.date = options.get("date", "1970-01-01T00:00:00Z")
        self.zip = options.get("compression", "none") == "gzip"
        self.most = int(options.get("fileBytes", FILE_BYTES))

    def write(self, iterator):
        names, out, held = [], [], 0

        def flush():
            nonlocal out, held
            if out:
                name = f"{uuid.uuid4().hex}.warc{'.gz' * self.zip}"
                files.put(self.path, name, b"".join(out))
                names.append(name)
                out, held = [], 0
        for b in iterator:
            cols = [b.column(c).to_pylist() for c in ("record_type", "record_id", "target_uri", "payload", "payload_bytes", "payload_digest", "refers_to")]
            for kind, rid, uri, payload, size, digest, refers in zip(*cols):
                one = record(kind, rid, uri, self.date, payload or b"", size, digest, refers)
                out.append(gzip.compress(one, 6) if self.zip else one)
                held += len(out[-1])
                if held >= self.most:
                    flush()
        flush()
        return WarcCommit(names)

    def commit(self, messages):
        files.put(self.path, MANIFEST, json.dumps(sorted(n for m in messages if m for n in m.names)).encode())

    def abort(self, messages):
        """Files without a manifest entry are never read."""


class WarcDataSource(DataSource):
    """Options: path; payload (reading: false leaves payloads null); date,
    compression (none or gzip) and fileBytes (writing)."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite):
        return WarcWriter(dict(self.options))


def register(spark) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                 least: int = REVISIT_BYTES) -> DataFrame:
    """Pages -> rows for the writer. Of pages with equal payloads (UTF-8 html,
    null: empty) of at least ``least`` bytes that with the smallest id is a
    response, the others revisit it; rows that repeat the smallest id are
    responses all, smaller payloads and pages of a null id too (a null id is
    written as ``null`` and never revisited).

    Payloads are shuffled only where a digest occurs twice: digests are counted
    alone, and a bitmap of the repeated ones keeps the other pages in place. A
    payload that half of the pages share is split by Spark's skew join."""
    html = F.coalesce(F.col(f"`{html_col}`"), F.lit(""))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("target_uri"),
                        html.cast("binary").alias("payload"), F.sha2(html.cast("binary"), 256).alias("payload_digest"),
                        F.octet_length(html).cast("long").alias("payload_bytes"))
    twice = write_table(rows.where((F.col("payload_bytes") >= least) & F.col("page_id").isNotNull()).groupBy("payload_digest")
                        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n"), "warc-repeats")
    marked = maybe_in(rows, "payload_digest", twice.select("payload_digest"))
    rest = (marked.where("maybe_").drop("maybe_")
            .join(twice.withColumnRenamed("payload_digest", "twice_digest"), F.col("payload_digest") == F.col("twice_digest"), "left")
            .drop("twice_digest"))
    rows = marked.where("NOT maybe_").drop("maybe_").withColumn("first_id", F.lit(None).cast("long")).unionByName(rest)
    again = F.coalesce(F.col("page_id") > F.col("first_id"), F.lit(False))
    name = F.concat(F.lit("urn:x-page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")))
    return rows.select(F.when(again, "revisit").otherwise("response").alias("record_type"), name.alias("record_id"), "target_uri",
                       F.when(again, F.concat(F.lit("urn:x-page:"), F.col("first_id").cast("string"))).alias("refers_to"),
                       "payload_digest", "payload_bytes", F.when(~again, F.col("payload")).alias("payload"))


def write_pages(pages: DataFrame, path: str | None = None, **options) -> str:
    """Write an archive of ``pages``; returns its path."""
    spark = pages.sparkSession
    register(spark)
    small_batches(spark)
    path = path or scratch_path(spark, "warc")
    page_records(pages).write.format("warc").mode("append").options(path=path, **options).save()
    return path


def page_id_of(record_id) -> F.Column:
    return F.expr(f"try_cast(regexp_extract({record_id}, '^urn:x-page:(.*)$', 1) as bigint)")
