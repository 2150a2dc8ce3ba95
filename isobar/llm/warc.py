"""WARC archives as a PySpark data source, written and read back.

``spark.read.format("warc")`` plans one partition a file (files are bounded by
the writer's ``max_bytes``).  A reader parses each record's headers first; the
predicates it is given (equality or IN on ``record_type``, ``record_id``,
``target_uri``, ``payload_digest``, ``refers_to``) are decided there, and so is whether
the payload is wanted at all (option ``payload``).  Each record is a gzip member
whose header says how long it is, compressed and not (the extra field "sl"), so
that unwanted payloads are stepped over without being decompressed; members
without that field are decompressed and thrown away.

Writers put each task's records into files of their own and name them in the
commit message; the driver's commit lists them in a manifest, and only listed
files are read.  Tasks that fail, or run twice, leave nothing that is read.

Paths go through ``pyarrow.fs`` where they have a scheme, so that local, HDFS
and object stores are alike.  Archives lie below ``spark.checkpoint.dir``.

Defined results: null payloads are empty; of records with equal payloads of
``least_bytes`` or more the largest id is the response, the others revisit it;
an empty table gives an empty archive; a repeated id with an equal payload is a
response each time it is the largest.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from isobar.llm.text import table
from isobar.session import materialize, new_folder

SCHEMA = "record_id string, record_type string, target_uri string, payload_digest string, payload_bytes long, refers_to string, payload binary"
#: Header lines and the columns that they fill.
HEADERS = {"WARC-Record-ID": "record_id", "WARC-Type": "record_type", "WARC-Target-URI": "target_uri", "WARC-Payload-Digest": "payload_digest", "X-Payload-Length": "payload_bytes", "WARC-Refers-To": "refers_to"}
DATE = "2024-01-01T00:00:00Z"
MAX_BYTES, LEVEL, CHUNK = 256 << 20, 3, 1 << 16


def _fs(path: str):
    """A pyarrow file system and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


# --- records ------------------------------------------------------------------


def record(fields: dict, payload: bytes) -> bytes:
    """A WARC/1.1 record; ``fields`` by column name, None left out."""
    lines = ["WARC/1.1", f"WARC-Date: {DATE}"]
    for header, column in HEADERS.items():
        if fields.get(column) is not None:
            value = str(fields[column]).replace("\r", "%0D").replace("\n", "%0A")
            lines.append(f"{header}: {'sha1:' if column == 'payload_digest' else ''}{value}")
    lines += ["Content-Type: application/octet-stream", f"Content-Length: {len(payload)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member with its compressed and plain lengths in the extra field "sl"."""
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    total = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + (8).to_bytes(2, "little") + total.to_bytes(4, "little") + (len(data) & 0xFFFFFFFF).to_bytes(4, "little")
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + len(extra).to_bytes(2, "little") + extra + body + zlib.crc32(data).to_bytes(4, "little") + (len(data) & 0xFFFFFFFF).to_bytes(4, "little")


def parse_headers(head: bytes) -> dict:
    """Columns from the header lines of a record (without the empty line)."""
    out: dict = {"content_length": 0}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        value = value.strip()
        if name == "Content-Length":
            out["content_length"] = int(value)
        elif (column := HEADERS.get(name)) == "payload_digest":
            out[column] = value.removeprefix("sha1:")
        elif column == "payload_bytes":
            out[column] = int(value)
        elif column:
            out[column] = value
    return out


def read_records(f, wanted, payloads: bool) -> Iterator[tuple[dict, bytes | None]]:
    """Headers and payloads of the gzip members of a seekable file.

    wanted: decides on the headers; only records that it takes are returned, and
    only their payloads are decompressed (none if ``payloads`` is false).
    """
    begin = 0
    while True:
        f.seek(begin)
        start = f.read(12)
        if len(start) < 12:
            return
        if start[:3] != b"\x1f\x8b\x08":
            raise ValueError(f"no gzip member at byte {begin}")
        length = None
        if start[3] & 4:
            extra = f.read(int.from_bytes(start[10:12], "little"))
            at = 0
            while at + 4 <= len(extra):
                n = int.from_bytes(extra[at + 2 : at + 4], "little")
                if extra[at : at + 2] == b"sl" and n == 8:
                    length = int.from_bytes(extra[at + 4 : at + 8], "little")
                at += 4 + n
        f.seek(begin)
        unpack, plain, used, head = zlib.decompressobj(31), bytearray(), 0, None
        keep = True
        while not unpack.eof:
            if head is None and (end := plain.find(b"\r\n\r\n")) >= 0:
                head = parse_headers(bytes(plain[:end]))
                keep = wanted(head)
                del plain[: end + 4]
                if length is not None and not (keep and payloads):
                    break
            # The first piece is small: headers alone fit in it.
            data = f.read(512 if head is None else CHUNK)
            if not data:
                raise ValueError(f"cut off member at byte {begin}")
            used += len(data)
            got = unpack.decompress(data)
            if head is None or (keep and payloads):
                plain += got
        if head is None:
            end = plain.find(b"\r\n\r\n")
            head = parse_headers(bytes(plain[:end]))
            keep = wanted(head)
            del plain[: end + 4]
        if keep:
            yield head, bytes(plain[: head["content_length"]]) if payloads else None
        begin += length if length is not None else used - len(unpack.unused_data)


# --- the data source ----------------------------------------------------------


@dataclass
class FilePartition(InputPartition):
    path: str


class WarcReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.payloads = options["path"], options.get("payload", "true") == "true"
        self.equal: list[tuple[str, frozenset]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for x in filters:
            name = x.attribute[0] if isinstance(x, EqualTo | In) and len(x.attribute) == 1 else None
            if name in ("record_id", "record_type", "target_uri", "payload_digest", "refers_to"):
                self.equal.append((name, frozenset([x.value] if isinstance(x, EqualTo) else x.value)))
            else:
                yield x

    def partitions(self) -> list[InputPartition]:
        fs, path = _fs(self.path)
        with fs.open_input_stream(f"{path}/manifest.json") as f:
            names = json.loads(f.read())
        return [FilePartition(x) for x in names] or [FilePartition("")]

    def read(self, partition: FilePartition) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        schema = pa.schema(list(zip(names, kinds, strict=True)))
        if not partition.path:
            return
        fs, path = _fs(self.path)
        wanted = lambda head: all(head.get(name) in values for name, values in self.equal)
        rows: list[dict] = []
        held = 0
        with fs.open_input_file(f"{path}/{partition.path}") as f:
            for head, payload in read_records(f, wanted, self.payloads):
                rows.append({n: head.get(n) for n in names[:-1]} | {"payload": payload})
                held += len(payload or b"") + 200
                if held > (4 << 20):
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


@dataclass
class Written(WriterCommitMessage):
    names: list


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict) -> None:
        self.path, self.most = options["path"], int(options.get("max_bytes", MAX_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, path = _fs(self.path)
        fs.create_dir(path, recursive=True)
        names: list[str] = []
        out, size = None, 0
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None or size >= self.most:
                        if out is not None:
                            out.close()
                        names.append(f"{uuid.uuid4().hex}.warc.gz")
                        out, size = fs.open_output_stream(f"{path}/{names[-1]}", compression=None), 0
                    data = member(record(row, row.get("payload") or b""))
                    out.write(data)
                    size += len(data)
        finally:
            if out is not None:
                out.close()
        return Written(names)

    def commit(self, messages: list) -> None:
        self._manifest([x for m in messages if m for x in m.names])

    def abort(self, messages: list) -> None:
        fs, path = _fs(self.path)
        for m in messages:
            for x in m.names if m else ():
                fs.delete_file(f"{path}/{x}")

    def _manifest(self, names: list[str]) -> None:
        fs, path = _fs(self.path)
        fs.create_dir(path, recursive=True)
        with fs.open_output_stream(f"{path}/manifest.json.tmp", compression=None) as f:
            f.write(json.dumps(sorted(names)).encode())
        fs.move(f"{path}/manifest.json.tmp", f"{path}/manifest.json")


class WarcDataSource(DataSource):
    """Format "warc"; options path, payload ("true" or "false"), max_bytes (of a file)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known and lets Spark push predicates into it."""
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


# --- pages --------------------------------------------------------------------


def payload_digests(pages: DataFrame) -> DataFrame:
    """(page_id, bytes, whole): size and SHA-256 of each payload."""
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.octet_length(payload).cast("long").alias("bytes"), F.sha2(payload, 256).alias("whole"))


def write_pages(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Writes a record for each row of ``pages`` (page_id, url, html).

    Digests are found and grouped without the payloads.  These take part in one
    join only, with the pages that revisit, on page_id and digest, so that equal
    payloads are never gathered.
    """
    spark = pages.sparkSession
    register(spark)
    found = materialize(payload_digests(pages), "payloads")
    groups = found.where(F.col("bytes") >= least_bytes).groupBy("whole").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = materialize(groups.select("whole", "last"), "repeated-payloads")
    # One row for each page that revisits: few columns, joined on the digest; adaptive execution splits hot digests.
    revisits = found.join(groups, "whole").where(~F.col("last").eqNullSafe(F.col("page_id"))).select(F.col("page_id").alias("_id"), "last", F.col("whole").alias("_whole")).distinct()
    revisits = materialize(revisits, "revisits")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("whole", F.sha2("payload", 256))
    joined = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("whole") == F.col("_whole")), "left")
    again = F.col("_whole").isNotNull()
    records = joined.select(
        urn(F.col("page_id")).alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        sha1_base32(F.sha1("payload")).alias("payload_digest"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when(again, urn(F.col("last"))).alias("refers_to"),
        F.when(again, F.lit(b"")).otherwise(F.col("payload")).alias("payload"),
    )
    records.write.format("warc").mode("append").option("path", path).save()


def urn(page_id):
    return F.concat(F.lit("<urn:isobar:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def page_of(record_id):
    return F.regexp_extract(record_id, r"<urn:isobar:page:(-?\d+)>", 1)


def sha1_base32(digest):
    """Base32 of a hexadecimal SHA-1: eight groups of 20 bits, four letters each."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    out = []
    for i in range(8):
        bits = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        out += [F.substring(letters, F.shiftright(bits, shift).bitwiseAND(31) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*out)


def read_pages(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of an archive; ``payload`` false steps over the payloads."""
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def described(spark: SparkSession, path: str) -> DataFrame:
    """Records with the size and digest of the payloads as read; revisits have none and keep their headers'."""
    columns = ["record_id", "record_type", "refers_to", "payload_bytes", "payload_digest"]
    read = read_pages(spark, path).where("record_type = 'response'")
    read = read.select(*columns[:3], F.octet_length("payload").cast("long").alias("payload_bytes"), sha1_base32(F.sha1("payload")).alias("payload_digest"))
    return read.unionByName(read_pages(spark, path, payload=False).where("record_type <> 'response'").select(*columns))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "warc")
    write_pages(table(spark, sf_dir, "pages"), path)
    rows = described(spark, path)
    number = lambda c: F.when(F.length(page_of(c)) > 0, page_of(c).cast("long"))
    return rows.select(number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", number(F.col("refers_to")).alias("refers_to"))


_LETTER = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((b >> {0}) & 31 AS INTEGER), 1)"
SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS x FROM pages),
h AS (SELECT page_id, octet_length(x) AS n, sha1(x) AS s, sha256(x) AS w FROM p),
g AS (SELECT page_id, i, CAST('0x' || substr(s, 5 * i + 1, 5) AS BIGINT) AS b FROM h, range(8) AS r(i)),
e AS (SELECT page_id, string_agg({' || '.join(_LETTER.format(k) for k in (15, 10, 5, 0))}, '' ORDER BY i) AS d FROM g GROUP BY page_id),
m AS (SELECT w, max(page_id) AS last FROM h GROUP BY w)
SELECT h.page_id, CAST(h.n AS BIGINT) AS payload_bytes, e.d AS payload_digest,
  CASE WHEN m.last = h.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN m.last <> h.page_id THEN m.last END AS refers_to
FROM h JOIN m USING (w) JOIN e ON e.page_id = h.page_id
"""

QUERIES = {"op6_warc": op6_warc}
ORACLE = {"op6_warc": SQL}
