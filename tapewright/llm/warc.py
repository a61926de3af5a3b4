"""WARC archives: a deterministic sharded writer, and a reader that checks digests."""

from __future__ import annotations

import base64
import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.llm.common import ship

MANIFEST = "_manifest"
MANIFEST_SCHEMA = "file string, records long, bytes long, sha256 string, first_id long, last_id long"
#: Fixed values of the format.
VERSION = b"WARC/1.1\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
CHUNK = 1 << 20


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    """The same for the same page and payload, whoever writes it."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(headers: dict[str, str], block: bytes) -> bytes:
    """One record as a gzip member of its own, without a time, so that equal records have equal bytes."""
    headers = headers | {"WARC-Block-Digest": f"sha1:{base32_sha1(block)}", "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(VERSION + lines.encode() + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """The response of a page, or its revisit of the page ``refers_to`` with the same payload."""
    digest = base32_sha1(payload)
    uri = "".join(c for c in url or "" if c.isprintable() and c != " ") or f"urn:page:{page_id}"
    headers = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": record_id(page_id, digest), "WARC-Date": DATE}
    headers |= {"WARC-Target-URI": uri, "WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http; msgtype=response"}
    headers |= {"X-Page-ID": "" if page_id is None else str(page_id), "X-Payload-Length": str(len(payload))}
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is not None:
        headers |= {"WARC-Profile": REVISIT, "WARC-Refers-To": record_id(refers_to, digest), "X-Refers-To-Page": str(refers_to)}
        return record(headers, http)
    return record(headers, http + payload)


def file_system(path: str):
    """(file system, path in it) of a URI or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class Rolling:
    """Writes records to files of about ``roll`` bytes, each under a temporary name until it is whole."""

    def __init__(self, folder: str, roll: int):
        task = TaskContext.get()
        self.fs, self.root = file_system(folder)
        self.part, self.attempt, self.roll = task.partitionId(), task.taskAttemptId(), roll
        self.number, self.out, self.done = 0, None, []

    def write(self, data: bytes, page_id: int | None) -> None:
        if self.out is None:
            self.name = f"part-{self.part:05d}-{self.number:05d}.warc.gz"
            self.temporary = posixpath.join(self.root, "_temporary", f"{self.name}.{self.attempt}")
            self.fs.create_dir(posixpath.join(self.root, "_temporary"), recursive=True)
            self.out, self.size, self.records, self.hash = self.fs.open_output_stream(self.temporary), 0, 0, hashlib.sha256()
            self.first = page_id
            info = {"WARC-Type": "warcinfo", "WARC-Record-ID": record_id(None, self.name), "WARC-Date": DATE, "WARC-Filename": self.name, "Content-Type": "application/warc-fields"}
            self.put(record(info, b"format: WARC File Format 1.1\r\n"))
        self.put(data)
        self.records, self.last = self.records + 1, page_id
        if self.size >= self.roll:
            self.close()

    def put(self, data: bytes) -> None:
        self.out.write(data)
        self.hash.update(data)
        self.size += len(data)

    def close(self) -> None:
        if self.out is None:
            return
        self.out.close()
        name = posixpath.join(self.root, self.name)
        try:
            self.fs.move(self.temporary, name)
        except OSError:  # an earlier attempt of this task got as far; its bytes are the same
            self.fs.delete_file(name)
            self.fs.move(self.temporary, name)
        self.done.append((self.name, self.records, self.size, self.hash.hexdigest(), self.first, self.last))
        self.out, self.number = None, self.number + 1


def revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, digest, refers_to) of the pages whose payload a page of smaller id has too, from (page_id, digest, bytes).

    Payloads under ``least_bytes`` and pages of null id take no part. Groups of equal payloads are first reduced to
    their smallest id, and only digests and ids are joined.
    """
    own = pages.where(F.col("page_id").isNotNull() & (F.col("bytes") >= least_bytes)).select("page_id", "digest")
    firsts = own.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    return own.join(firsts, "digest").where("page_id > refers_to").select("page_id", "digest", "refers_to")


def write(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0, roll_bytes: int = 64 << 20) -> DataFrame:
    """Writes a record per row to ``folder`` and returns the manifest, which is written last.

    Rows are sorted by id over all shards; a shard's task streams them to files of about ``roll_bytes`` compressed
    bytes. The first row of the smallest id of those with equal payloads (of at least ``least_bytes``) is a response,
    the others are revisits. Rows of null id are responses always. Null payloads are empty; texts are written in UTF-8.
    A file has its name only once it is whole; a file that the manifest doesn't name is none of the archive, so that
    what lost tasks leave is never read. A second attempt of a task writes the same bytes. Other columns are ignored.
    """
    spark = pages.sparkSession
    ship(spark)
    body = F.coalesce(F.col(f"`{payload}`"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.unhex(F.sha1(body)).alias("digest"), F.col(f"`{url}`").cast("string").alias("url"), body.alias("payload"))
    narrow = rows.select("page_id", "digest", F.octet_length("payload").alias("bytes"))
    told = revisits(narrow, least_bytes).distinct()
    told = told.select("page_id", "digest", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "refers_to", F.lit(0).alias("kind"))
    all_rows = told.unionByName(rows.withColumn("refers_to", F.lit(None).cast("long")).withColumn("kind", F.lit(1)))
    dealt = all_rows.repartitionByRange("page_id").sortWithinPartitions("page_id", "digest", "kind", "url")

    def write_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, told_of, target, written = Rolling(folder, roll_bytes), None, None, None
        for batch in batches:
            columns = (batch.column(c) for c in ("page_id", "digest", "url", "payload", "refers_to", "kind"))
            for at, digest, uri, data, refers_to, kind in zip(*columns, strict=True):
                key = (at.as_py(), digest.as_py())
                if kind.as_py() == 0:
                    told_of, target = key, refers_to.as_py()
                    continue
                content = data.as_py()
                if key == told_of:
                    to = target
                else:  # a repeated row of the response refers to that
                    to = key[0] if key == written and key[0] is not None and len(content) >= least_bytes else None
                    written = key
                files.write(page_record(key[0], uri.as_py(), content, to), key[0])
        files.close()
        names = ["file", "records", "bytes", "sha256", "first_id", "last_id"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        columns = list(zip(*files.done, strict=True)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    dealt.mapInArrow(write_rows, MANIFEST_SCHEMA).write.mode("overwrite").parquet(f"{folder}/{MANIFEST}")
    return spark.read.schema(MANIFEST_SCHEMA).parquet(f"{folder}/{MANIFEST}")


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a file, one gzip member after another."""
    unpacker, parts, data = zlib.decompressobj(31), [], b""
    while True:
        data = data or stream.read(CHUNK)
        if not data:
            return
        parts.append(unpacker.decompress(data))
        data = unpacker.unused_data
        if unpacker.eof:
            head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
            headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            yield headers, rest[: int(headers["Content-Length"])]
            unpacker, parts = zlib.decompressobj(31), []


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The pages of an archive: page_id, url, payload (null for revisits), and what the headers say of it.

    Files are those that the manifest names. A block or payload that doesn't have its digest, or a file of another
    number of records than the manifest has, is an error.
    """
    ship(spark)
    manifest = spark.read.schema(MANIFEST_SCHEMA).parquet(f"{folder}/{MANIFEST}")
    files = manifest.repartitionByRange(max(1, manifest.count()), "file").select("file", "records")
    schema = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        for batch in batches:
            for name, count in zip(batch.column("file").to_pylist(), batch.column("records").to_pylist(), strict=True):
                found, rows, held = 0, [], 0
                with fs.open_input_stream(posixpath.join(root, name), compression=None) as stream:
                    for headers, block in records(stream):
                        if headers["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
                            raise ValueError(f"{name}: a block of {headers['WARC-Record-ID']} is damaged")
                        if headers["WARC-Type"] == "warcinfo":
                            continue
                        digest, to = headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers.get("X-Refers-To-Page")
                        payload = block.partition(b"\r\n\r\n")[2] if headers["WARC-Type"] == "response" else None
                        if payload is not None and (base32_sha1(payload) != digest or len(payload) != int(headers["X-Payload-Length"])):
                            raise ValueError(f"{name}: the payload of {headers['WARC-Record-ID']} is damaged")
                        page = headers["X-Page-ID"]
                        rows.append((int(page) if page else None, headers["WARC-Target-URI"], payload, int(headers["X-Payload-Length"]), digest, headers["WARC-Type"], int(to) if to else None))
                        found, held = found + 1, held + len(payload or b"")
                        if held > 8 << 20 or len(rows) >= 5000:
                            yield batch_of(rows)
                            rows, held = [], 0
                if found != count:
                    raise ValueError(f"{name}: {found} records, of {count} in the manifest")
                if rows:
                    yield batch_of(rows)

    return files.mapInArrow(read_files, schema)
