"""WARC archives as a Spark data source: format("warc") writes and reads .warc and .warc.gz files."""

from __future__ import annotations

import gzip
import io
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, StringStartsWith, WriterCommitMessage

from phasegrid.llm.common import new_path, stored, table

#: What a WARC file holds of a record; named headers come as columns, all of them in headers (names lower-cased).
READ_SCHEMA = "record_type string, record_id string, target_uri string, warc_date string, content_type string, content_length long, payload_digest string, refers_to string, headers map<string,string>, payload binary"
#: What the writer takes; other headers in headers.
WRITE_SCHEMA = "record_type string, record_id string, target_uri string, warc_date string, headers map<string,string>, payload binary"
_COLUMNS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "warc_date": "warc-date", "content_type": "content-type", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_MANIFEST = "_MANIFEST"
#: Files are read in groups of about so many bytes, and written and read in pieces of about so many.
GROUP_BYTES, BUFFER = 128 << 20, 1 << 20


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in path and path.startswith("file:"):
        path = path[5:]
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


@dataclass
class Wrote(WriterCommitMessage):
    files: list


@dataclass
class Files(InputPartition):
    paths: list


class WarcSource(DataSource):
    """Options: path; compression ("none" or "gzip", one member a record); payload ("false": payloads are left out)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options, schema)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


class WarcWriter(DataSourceArrowWriter):
    """A file for each task attempt; the commit's manifest, written at the end, names those that count, so failed attempts leave no records. An append adds a manifest."""

    def __init__(self, options) -> None:
        self.path, self.gzip = options["path"].rstrip("/"), options.get("compression", "none") == "gzip"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Wrote:
        fs, base = _open(self.path)
        fs.create_dir(base, recursive=True)
        name, out = f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.gzip, None
        for batch in iterator:
            for r in batch.to_pylist():
                if out is None:
                    out = fs.open_output_stream(f"{base}/{name}", compression=None, buffer_size=BUFFER)
                    out.write(self.member(record_bytes({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": "1970-01-01T00:00:00Z", "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n")))
                out.write(self.member(to_record(r)))
        if out is None:
            return Wrote([])
        out.close()
        return Wrote([name])

    def member(self, record: bytes) -> bytes:
        if not self.gzip:
            return record
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        return z.compress(record) + z.flush()

    def commit(self, messages) -> None:
        fs, base = _open(self.path)
        fs.create_dir(base, recursive=True)
        # one for each commit, so that an append names its files beside the earlier ones
        with fs.open_output_stream(f"{base}/{_MANIFEST}-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(sorted(f for m in messages if m for f in m.files)).encode())

    def abort(self, messages) -> None:
        fs, base = _open(self.path)
        for m in messages:
            for f in m.files if m else ():
                fs.delete_file(f"{base}/{f}")


def _plain(value: str) -> str:
    """A header value on one line: line ends, per cent signs before hex digits stay as they are, control characters are escaped."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record_bytes(headers: dict[str, str], block: bytes) -> bytes:
    head = "".join(f"{k}: {_plain(v)}\r\n" for k, v in headers.items() if v is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def to_record(r: dict) -> bytes:
    """A row of WRITE_SCHEMA as bytes; a response's payload follows an HTTP head, a record without payload has an empty block."""
    head = {"WARC-Type": r["record_type"], "WARC-Record-ID": r["record_id"], "WARC-Date": r["warc_date"], "WARC-Target-URI": r["target_uri"]} | dict(r["headers"] or ())
    if r["payload"] is None:
        return record_bytes(head, b"")
    if r["record_type"] == "response":
        return record_bytes(head | {"Content-Type": "application/http;msgtype=response"}, _HTTP + r["payload"])
    return record_bytes(head, r["payload"])


class _Input:
    """Bytes of an archive in order; plain files skip by seeking."""

    def __init__(self, fs: pafs.FileSystem, path: str) -> None:
        self.raw = fs.open_input_file(path)
        self.seeks = not path.endswith(".gz")
        self.file = io.BufferedReader(self.raw, BUFFER) if self.seeks else gzip.GzipFile(fileobj=self.raw)

    def skip(self, n: int) -> None:
        if self.seeks:
            self.file.seek(n, 1)
            return
        while n > 0 and (x := len(self.file.read(min(n, BUFFER)))):
            n -= x


def _headers(file) -> dict[str, str] | None:
    """The next record's headers; None at the end. Blank lines before a record are passed over."""
    line = file.readline()
    while line in (b"\r\n", b"\n"):
        line = file.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {line[:40]!r}")
    out, last = {}, None
    while (line := file.readline()) not in (b"\r\n", b"\n", b""):
        if line[:1] in b" \t" and last:
            out[last] += " " + line.decode("utf-8", "replace").strip()
            continue
        k, _, v = line.decode("utf-8", "replace").partition(":")
        last = k.strip().lower()
        out[last] = v.strip()
    return out


class WarcReader(DataSourceReader):
    """Plans groups of whole files. Header predicates are checked on parsed headers, before a payload is read; of records that fail, and without payloads, blocks are skipped."""

    def __init__(self, options, schema) -> None:
        self.path, self.payload, self.tests = options["path"].rstrip("/"), options.get("payload", "true") != "false", []
        self.fields = [f.name for f in schema.fields]
        self.payload &= "payload" in self.fields

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column not in _COLUMNS or not isinstance(f, EqualTo | EqualNullSafe | In | IsNotNull | IsNull | StringStartsWith):
                yield f
            else:
                self.tests.append((type(f).__name__, _COLUMNS[column], getattr(f, "value", None)))

    def partitions(self) -> list[Files]:
        fs, base = _open(self.path)
        folder = fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)) if fs.get_file_info(base).type == pafs.FileType.Directory else []
        manifests, names = [i for i in folder if i.base_name.startswith(_MANIFEST)], []
        for info in manifests:
            with fs.open_input_stream(info.path) as x:
                names += json.loads(x.read())
        if manifests:
            sizes = {i.path: i.size for i in fs.get_file_info([f"{base}/{n}" for n in names])}
        elif fs.get_file_info(base).type == pafs.FileType.File:
            sizes = {base: 0}
        else:
            sizes = {i.path: i.size for i in fs.get_file_info(pafs.FileSelector(base, recursive=True)) if i.path.endswith((".warc", ".warc.gz"))}
        groups: list[Files] = []
        size = GROUP_BYTES
        for p in sorted(sizes):
            if size + sizes[p] > GROUP_BYTES:
                groups.append(Files([]))
                size = 0
            groups[-1].paths.append(p)
            size += sizes[p]
        return groups or [Files([])]

    def passes(self, h: dict[str, str]) -> bool:
        for kind, name, value in self.tests:
            x = h.get(name)
            if kind == "IsNull" or (kind == "EqualNullSafe" and value is None):
                ok = x is None
            elif x is None:
                ok = False
            else:
                ok = kind == "IsNotNull" or (kind in ("EqualTo", "EqualNullSafe") and x == value) or (kind == "In" and x in value) or (kind == "StringStartsWith" and x.startswith(value))
            if not ok:
                return False
        return True

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = _open(self.path)
        rows, held = [], 0
        for path in partition.paths:
            source = _Input(fs, path)
            while (h := _headers(source.file)) is not None:
                n, body = int(h.get("content-length", 0)), None
                if not self.passes(h) or not self.payload:
                    keep = self.passes(h)
                    source.skip(n)
                    if not keep:
                        continue
                else:
                    body = source.file.read(n)
                    if len(body) < n:
                        raise ValueError(f"{path} ends within a record")
                    if h.get("content-type", "").startswith("application/http"):
                        body = body.partition(b"\r\n\r\n")[2]
                    elif n == 0:
                        body = None
                rows.append((h, n, body))
                held += len(body or b"") + 200
                if held > 16 * BUFFER or len(rows) >= 2000:
                    yield self.batch(rows)
                    rows, held = [], 0
        if rows:
            yield self.batch(rows)

    def batch(self, rows: list) -> pa.RecordBatch:
        made = {
            "content_length": lambda: pa.array([n for _, n, _ in rows], pa.int64()),
            "headers": lambda: pa.array([list(h.items()) for h, _, _ in rows], pa.map_(pa.string(), pa.string())),
            "payload": lambda: pa.array([b for _, _, b in rows], pa.binary()),
        }
        return pa.RecordBatch.from_arrays([made[f]() if f in made else pa.array([h.get(_COLUMNS[f]) for h, _, _ in rows], pa.string()) for f in self.fields], self.fields)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def write_warc(records: DataFrame, path: str, compression: str = "none") -> None:
    records.sparkSession.dataSource.register(WarcSource)
    records.write.format("warc").option("compression", compression).mode("append").save(path)




def archive_pages(pages: DataFrame, path: str, least: int = 1000, compression: str = "none") -> None:
    """Writes a record for each row of pages (page_id, url, html) to path.

    Payload: html in UTF-8 (null: empty). Of rows with equal payloads of at least `least` bytes, those with the
    largest page_id are responses and others revisits of it; smaller payloads are all responses. Null ids count as smaller than
    any (all null: responses); rows repeated with the largest id are all responses; a null url leaves its header out. An empty table writes no
    records; a path that holds an archive keeps it, and gets these records, too.
    Only ids and digests are shuffled: which pages are revisits is stored first, and Spark joins it to the rows by its real size.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), "url", body.alias("payload")).withColumns({"digest": F.sha1("payload"), "n": F.octet_length("payload").cast("long")})
    slim = rows.filter(F.col("n") >= least).select("page_id", "digest")
    kept = slim.groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("k")).filter((F.col("k") > 1) & F.col("first").isNotNull())
    # the key is wrapped, so that both sides are dealt out for the join alone and a hot digest can be split
    twins = slim.join(kept.select(F.concat("digest", F.lit("")).alias("_d"), "first"), F.col("digest") == F.col("_d")).filter(~F.col("page_id").eqNullSafe(F.col("first")))
    revisits = stored(twins.select(F.col("page_id").alias("_p"), F.col("digest").alias("_d"), "first").distinct(), "revisits")
    out = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("_p")) & (F.col("digest") == F.col("_d")), "left")
    urn = lambda i: F.concat(F.lit("<urn:page:"), F.coalesce(i.cast("string"), F.lit("null")), F.lit(":"), F.col("digest"), F.lit(">"))
    again = F.col("first").isNotNull()
    headers = F.map_filter(
        F.create_map(
            F.lit("WARC-Payload-Digest"), F.concat(F.lit("sha1:"), F.col("digest")),
            F.lit("X-Page-Id"), F.col("page_id").cast("string"),
            F.lit("X-Payload-Length"), F.col("n").cast("string"),
            F.lit("WARC-Profile"), F.when(again, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            F.lit("WARC-Refers-To"), F.when(again, urn(F.col("first"))),
            F.lit("X-Refers-To-Page-Id"), F.col("first").cast("string"),
        ), lambda _, v: v.isNotNull())
    records = out.select(F.when(again, "revisit").otherwise("response").alias("record_type"), urn(F.col("page_id")).alias("record_id"), F.col("url").alias("target_uri"), F.lit("2024-01-01T00:00:00Z").alias("warc_date"), headers.alias("headers"), F.when(~again, F.col("payload")).alias("payload"))
    write_warc(records, path, compression)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    archive_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    page = F.col("headers")["x-page-id"].cast("long").alias("page_id")
    # digests and lengths of responses come from the payloads read back; of revisits, whose payloads aren't there, from headers
    first = read_warc(spark, path).filter(F.col("record_type") == "response")
    first = first.select(page, F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    again = read_warc(spark, path, payload=False).filter(F.col("record_type") == "revisit")
    again = again.select(page, F.col("headers")["x-payload-length"].cast("long").alias("payload_bytes"), F.substring_index("payload_digest", ":", -1).alias("payload_digest"), "record_type", F.col("headers")["x-refers-to-page-id"].cast("long").alias("refers_to"))
    return first.unionByName(again)


QUERIES = {"op1_warc": op1_warc}
ORACLES = {
    "op1_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN first END AS refers_to FROM m"""
}
