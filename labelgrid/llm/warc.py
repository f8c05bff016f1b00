"""WARC archives: writing, reading, and revisit resolution by payload digest.

Records are gzip members of their own. Archives are written by the tasks into the shared
folder, each attempt under a name of its own; only files that a finished task reports are
read. Resolution moves headers alone: they are shuffled by digest, the record with the
largest id stays the response of a payload, the others become revisit records that refer to
it, and each archive is copied once with fresh headers.

Defined cases: a null payload is an empty one, and a null url an empty target; a null id is
below all others; of equal ids with equal payloads the one written last stays; payloads
shorter than ``least`` bytes are always responses; a payload of any length is one record,
written and read whole; signs that a header cannot hold are percent-encoded; an empty table
gives no archives and no rows; other columns of the input, whatever their names, are not
read or written.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

LEAST, FILE_BYTES, LEVEL, SALTS, DATE = 1000, 64 << 20, 1, 16, "2020-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADERS = pa.schema([("id", pa.int64()), ("file", pa.string()), ("at", pa.int64()), ("size", pa.int64()), ("payload_bytes", pa.int64()), ("digest", pa.string())])
HEADERS_SPARK = "id long, file string, at long, size long, payload_bytes long, digest string"
READ = pa.schema([("id", pa.int64()), ("type", pa.string()), ("payload_bytes", pa.int64()), ("digest", pa.string()), ("refers_to", pa.int64()), ("uri", pa.string()), ("payload", pa.binary())])
READ_SPARK = "id long, type string, payload_bytes long, digest string, refers_to long, uri string, payload binary"


def record_id(page: int | None) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def page_of(name: str) -> int | None:
    number = name.rsplit(":", 1)[-1].rstrip(">")
    return int(number) if number else None


def header_value(s: str | None) -> str:
    """A string as a header may hold it."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in s or "")


def to_base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def to_hex(base32: str) -> str:
    return base64.b32decode(base32).hex()


def record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    raw = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    return packer.compress(raw) + packer.flush()


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and block of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


def payload_of(fields: dict[str, str], block: bytes) -> bytes:
    return block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block


def records(stream, chunk: int = 1 << 16):
    """Records of an archive, one in memory at a time."""
    data = stream.read(chunk)
    while data:
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof:
            if not data:
                raise ValueError("the archive ends inside a record")
            parts.append(unpacker.decompress(data))
            data = unpacker.unused_data if unpacker.eof else stream.read(chunk)
        yield parse(b"".join(parts))
        data = data or stream.read(chunk)


class Archive:
    """Files of one task, a new one after ``FILE_BYTES``."""

    def __init__(self, folder: str, name: str):
        self.fs, self.folder = pyarrow.fs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.name, self.out, self.files = name, None, []

    def add(self, raw: bytes) -> tuple[str, int, int]:
        """Appends a record: file, position, size."""
        if self.out is None or self.at + len(raw) > FILE_BYTES and self.at:
            self.close()
            self.files.append(f"{self.folder}/{self.name}-{uuid.uuid4().hex}.warc.gz")
            self.out, self.at = self.fs.open_output_stream(self.files[-1], compression=None), 0
        self.out.write(raw)
        self.at += len(raw)
        return self.files[-1], self.at - len(raw), len(raw)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def response(page: int | None, url: str | None, payload: bytes, digest: str) -> bytes:
    fields = [("WARC-Record-ID", record_id(page)), ("WARC-Date", DATE), ("WARC-Target-URI", header_value(url)), ("WARC-Payload-Digest", "sha1:" + to_base32(digest)), ("Content-Type", "application/http; msgtype=response")]
    return record("response", fields, HTTP % len(payload) + payload)


def revisit(page: int | None, url: str, digest: str, refers: int | None) -> bytes:
    fields = [("WARC-Record-ID", record_id(page)), ("WARC-Date", DATE), ("WARC-Target-URI", url), ("WARC-Payload-Digest", "sha1:" + to_base32(digest)), ("WARC-Refers-To", record_id(refers)), ("WARC-Profile", PROFILE), ("Content-Type", "application/http; msgtype=response")]
    return record("revisit", fields, b"HTTP/1.1 200 OK\r\n\r\n")


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes a response record per row under ``folder``; the headers, with the place of each record."""

    def task(batches):
        archive = Archive(folder, "raw")
        for batch in batches:
            rows = []
            for page, link, payload in zip(*(batch.column(c).to_pylist() for c in ("id", "url", "html"))):
                payload = (payload or "").encode()
                digest = hashlib.sha1(payload).hexdigest()
                rows.append((page, *archive.add(response(page, link, payload, digest)), len(payload), digest))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), HEADERS)] if rows else [pa.array([], f.type) for f in HEADERS], schema=HEADERS)
        archive.close()

    shared.bounded(pages.sparkSession)
    src = pages.select(F.col(key).cast("long").alias("id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    return shared.written(src.mapInArrow(task, HEADERS_SPARK), "warc-headers")


def resolve(headers: DataFrame, least: int = LEAST) -> DataFrame:
    """Headers with ``revisit`` and ``refers_to``: by digest, the largest id keeps its payload."""
    long = headers.where(F.col("payload_bytes") >= least)
    last = long.groupBy("digest", "payload_bytes").agg(F.max(F.struct("id", "file", "at")).alias("last"), F.count("*").alias("c")).where("c > 1").drop("c")
    # one row a repeated payload, told to each salt: a payload that a third of all pages share is joined in parts
    last = last.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = headers.withColumn("salt", F.pmod(F.xxhash64("file", "at"), F.lit(SALTS)).cast("int"))
    found = salted.join(last, ["digest", "payload_bytes", "salt"], "left")
    is_revisit = F.col("last").isNotNull() & ~((F.col("last.file") == F.col("file")) & (F.col("last.at") == F.col("at")))
    return found.select("file", "at", "size", "id", "digest", is_revisit.alias("revisit"), F.when(is_revisit, F.col("last.id")).alias("refers_to"))


def deduplicate(headers: DataFrame, folder: str, least: int = LEAST) -> DataFrame:
    """Copies the archives under ``folder`` with revisit records instead of repeated payloads: the new files."""

    def copy(key: tuple, table: pa.Table) -> pa.Table:
        archive = Archive(folder, "dedup")
        fs, _ = pyarrow.fs.FileSystem.from_uri(folder)
        order = table.sort_by("at").to_pydict()
        with fs.open_input_file(key[0].as_py()) as f:
            for at, size, page, digest, again, refers in zip(*(order[c] for c in ("at", "size", "id", "digest", "revisit", "refers_to"))):
                f.seek(at)
                raw = f.read(size)
                if again:
                    fields, _ = parse(zlib.decompress(raw, 31))
                    archive.add(revisit(page, fields["warc-target-uri"], digest, refers))
                else:
                    fields, block = parse(zlib.decompress(raw, 31))
                    archive.add(response(page, fields["warc-target-uri"], payload_of(fields, block), digest))
        archive.close()
        return pa.table({"file": pa.array(archive.files, pa.string())})

    # headers are small, so without a number of its own the exchange would put many archives into one task
    found = resolve(headers, least)
    made = found.repartition(max(1, headers.select("file").distinct().count()), "file").groupBy("file").applyInArrow(copy, "file string")
    return shared.written(made, "warc-files")


def read(files: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """Records of the archives named in ``files``: id, type, payload bytes, digest of what was read, target.

    A revisit has the digest its header names and no payload bytes of its own."""

    def task(batches):
        fs, _ = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows = []
                with fs.open_input_stream(name, compression=None) as stream:
                    for fields, block in records(stream):
                        page, kind = page_of(fields["warc-record-id"]), fields["warc-type"]
                        if kind == "revisit":
                            rows.append((page, kind, None, to_hex(fields["warc-payload-digest"].partition(":")[2]), page_of(fields["warc-refers-to"]), fields["warc-target-uri"], None))
                        else:
                            payload = payload_of(fields, block)
                            rows.append((page, kind, len(payload), hashlib.sha1(payload).hexdigest(), None, fields["warc-target-uri"], payload if payloads else None))
                        if len(rows) == 512:
                            yield _batch(rows)
                            rows = []
                yield _batch(rows)

    return files.mapInArrow(task, READ_SPARK)


def _batch(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), READ)] if rows else [pa.array([], f.type) for f in READ], schema=READ)


def joined(found: DataFrame) -> DataFrame:
    """Revisit records with the payload bytes of the response they refer to."""
    found = found.drop("payload", "uri")
    again = found.where("type = 'revisit'").withColumn("salt", F.pmod(F.xxhash64("id", "digest"), F.lit(SALTS)).cast("int"))
    origin = found.where("type = 'response'").join(again.select("digest").distinct(), "digest", "left_semi")
    origin = origin.groupBy(F.col("id").alias("origin"), "digest").agg(F.max("payload_bytes").alias("full")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    told = again.drop("payload_bytes").alias("r").join(origin.alias("o"), F.expr("r.refers_to <=> o.origin and r.digest = o.digest and r.salt = o.salt"), "left")
    told = told.select("r.id", "r.type", F.col("o.full").alias("payload_bytes"), "r.digest", "r.refers_to")
    return found.where("type = 'response'").select("id", "type", "payload_bytes", "digest", "refers_to").unionByName(told)


def op6(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    folder = shared.fresh(spark, "warc")
    files = deduplicate(write(pages, f"{folder}/raw"), f"{folder}/dedup")
    # one archive a task, and its records written before the join reads them twice
    found = shared.written(read(files.repartition(max(1, files.count()), "file"), folder), "warc-records")
    return joined(found).select(F.col("id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")

