"""WARC archives compressed record by record with a shared Zstandard dictionary.

A bounded sample of the payloads trains a dictionary. Every archive file starts with a skippable
frame that holds it (the layout of ``.warc.zst`` files), and each record is a Zstandard frame of
its own, so a record can be read alone. Of records with equal payloads, by SHA-1 and of at least
``least_bytes``, the one with the largest page id is the response and the others are revisits
without a body that refer to it.

Tasks write whole files into a shared folder through Arrow's file systems, under names no other
attempt uses, and return a manifest that is written as a table. Readers follow the manifest, so
what a lost or repeated attempt has left is never read. One record at a time is in memory.

A null html is an empty payload. Repeated rows are written each; if several have the largest
page id, all of those are responses. A null page id is written as "null" and reads back as
null; it is smaller than any other. A null url leaves out the target header. An empty table
gives no files and no rows. Long payloads take part in the dictionary by slices, and so do few or
alike ones, by their contents; only a table without any payload gives files without a dictionary.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitlog.llm.common import bounded_sample, folder, keep, small_batches

DICTIONARY_BYTES = 110 * 1024
SAMPLE_RECORDS = 1_000
SAMPLE_RECORD_BYTES = 64 * 1024
FILE_BYTES = 256 * 1024 * 1024
DIGESTS_BROADCAST = 200_000
LEVEL = 6
DATE = "1970-01-01T00:00:00Z"

# Fixed values of the formats.
SKIPPABLE = 0x184D2A5D
VERSION = b"WARC/1.1"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE = "urn:x-page:"

_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> bytes:
    return f"<{PAGE}{'null' if page_id is None else page_id}>".encode()


def _page(name: bytes) -> int | None:
    text = name.decode().strip("<>").removeprefix(PAGE)
    return None if text == "null" else int(text)


def _record(headers: list[tuple[bytes, bytes]], block: bytes) -> bytes:
    lines = [VERSION, *[k + b": " + v for k, v in headers], b"Content-Length: %d" % len(block), b"", b""]
    return b"\r\n".join(lines) + block + b"\r\n\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, is_revisit: bool) -> bytes:
    """A response, or a revisit whose block has only the header of the response."""
    http = (
        b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    )
    headers = [
        (b"WARC-Type", b"revisit" if is_revisit else b"response"),
        (b"WARC-Record-ID", _name(page_id)),
        (b"WARC-Date", DATE.encode()),
    ]
    if url is not None:
        safe = _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url)
        headers.append((b"WARC-Target-URI", safe.encode("utf-8", "surrogatepass")))
    headers.append((b"WARC-Payload-Digest", b"sha1:" + digest(payload).encode()))
    if is_revisit:
        headers += [(b"WARC-Refers-To", _name(refers_to)), (b"WARC-Profile", PROFILE)]
    headers.append((b"Content-Type", b"application/http; msgtype=response"))
    return _record(headers, http if is_revisit else http + payload)


def parse(data: bytes) -> dict[str, bytes]:
    """Headers of a record by lower-case name, and its block under ``""``."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if first != VERSION:
        raise ValueError("not a WARC record")
    out = {}
    for one in lines:
        name, _, value = one.partition(b":")
        out[name.strip().lower().decode()] = value.strip()
    size = int(out["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("the record's length is wrong")
    return out | {"": rest[:size]}


def sliced(payload: Column, slices: int = 4, most: int = SAMPLE_RECORD_BYTES) -> Column:
    """A payload of at most ``most`` bytes whole; of a longer one evenly placed slices of that size together."""
    size, each = F.length(payload), most // slices
    parts = [
        F.substring(payload, (F.floor((size - each) * i / (slices - 1)) + 1).cast("int"), F.lit(each))
        for i in range(slices)
    ]
    return F.when(size <= most, payload).otherwise(F.concat(*parts))


def train_dictionary(pages: DataFrame, payload: str = "payload", by: str = "digest") -> bytes:
    """A dictionary of bounded size from a bounded sample of records; empty without any payload.

    The sample has one record of each digest; of long ones it has slices. Where the trainer finds
    the samples too few or too alike, their contents are the dictionary as they are.
    """
    some = pages.where((F.length(payload) > 0) & ~F.coalesce("revisit", F.lit(False)))
    some = some.select(by, sliced(F.col(payload)).alias(payload))
    chosen = bounded_sample(some, by, SAMPLE_RECORDS).dropDuplicates([by]).orderBy(by)
    samples = [bytes(r[payload]) for r in chosen.collect()]
    if not samples:
        return b""
    size = min(DICTIONARY_BYTES, max(256, sum(map(len, samples)) // 8))
    try:
        return zstandard.train_dictionary(size, samples, threads=1).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


class Writer:
    """Archive files in a folder; a new one is begun when one is full."""

    def __init__(self, path: str, dictionary: bytes):
        self.store, self.path = fs.FileSystem.from_uri(path)
        self.dictionary = dictionary
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_checksum=True)
        self.out, self.done = None, []

    def _open(self) -> None:
        self.name = f"{self.path}/{uuid.uuid4().hex}.warc.zst"
        self.out = self.store.open_output_stream(self.name, compression=None)
        self.records = self.bytes = 0
        if self.dictionary:
            held = zstandard.ZstdCompressor(level=LEVEL).compress(self.dictionary)
            self._put(struct.pack("<II", SKIPPABLE, len(held)) + held)
        info = [
            (b"WARC-Type", b"warcinfo"),
            (b"WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>".encode()),
            (b"WARC-Date", DATE.encode()),
            (b"Content-Type", b"application/warc-fields"),
        ]
        self._put(self.compressor.compress(_record(info, b"format: WARC File Format 1.1\r\n")))

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def add(self, data: bytes) -> None:
        if self.out is None:
            self._open()
        self._put(self.compressor.compress(data))
        self.records += 1
        if self.bytes >= FILE_BYTES:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.name, self.records, self.bytes))
            self.out = None


def frames(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The decompressed frames of an archive; its dictionary is in the first, skippable frame."""
    buffer = stream.read(8)
    known = None
    if len(buffer) == 8:
        magic, size = struct.unpack("<II", buffer)
        if magic == SKIPPABLE:
            held = zstandard.ZstdDecompressor().decompress(stream.read(size))
            known, buffer = zstandard.ZstdCompressionDict(held), b""
    reader = zstandard.ZstdDecompressor(dict_data=known)
    while True:
        buffer = buffer or stream.read(chunk)
        if not buffer:
            return
        one, parts = reader.decompressobj(), []
        while not one.eof:
            if not buffer:
                buffer = stream.read(chunk)
                if not buffer:
                    raise ValueError("the archive ends inside a record")
            parts.append(one.decompress(buffer))
            buffer = one.unused_data if one.eof else b""
        yield b"".join(parts)


def _row(found: dict[str, bytes]) -> dict:
    http, _, payload = found[""].partition(b"\r\n\r\n")
    kind = found["warc-type"].decode()
    size = int(re.search(rb"(?im)^content-length: *(\d+)", http)[1])
    said = found["warc-payload-digest"].decode().removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or digest(payload) != said):
        raise ValueError("a payload differs from its digest")
    return {
        "page_id": _page(found["warc-record-id"]),
        "url": found["warc-target-uri"].decode() if "warc-target-uri" in found else None,
        "payload": payload if kind == "response" else None,
        "payload_bytes": size,
        "payload_digest": said,
        "record_type": kind,
        "refers_to": _page(found["warc-refers-to"]) if kind == "revisit" else None,
    }


def write(
    pages: DataFrame,
    path: str | None = None,
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
    least_bytes: int = 0,
) -> DataFrame:
    """Write an archive record for each row; returns the manifest (path, records, bytes)."""
    spark = pages.sparkSession
    path = path or f"{folder(spark)}/archive-{uuid.uuid4().hex}"
    payload = F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).cast("binary")
    at = pages.select(
        F.col(f"`{key}`").cast("bigint").alias("page_id"),
        F.col(f"`{url}`").cast("string").alias("url"),
        payload.alias("payload"),
        F.sha1(payload).alias("digest"),
    )
    several = (
        at.where(F.length("payload") >= least_bytes)
        .groupBy("digest")
        .agg(F.count("*").alias("n"), F.max("page_id").alias("response"))
        .where("n > 1")
    )
    several = keep(several.select(F.col("digest").alias("shared"), "response"), "archive-digests")
    if several.count() <= DIGESTS_BROADCAST:
        several = F.broadcast(several)
    marked = at.join(several, F.col("digest") == F.col("shared"), "left").select(
        "page_id",
        "url",
        "payload",
        "response",
        (F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))).alias("revisit"),
        "digest",
    )
    small_batches(spark)
    store, base = fs.FileSystem.from_uri(path)
    store.create_dir(base, recursive=True)
    shared = spark.sparkContext.broadcast(train_dictionary(marked))
    marked = marked.drop("digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Writer(path, shared.value)
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                out.add(record(*row))
        out.close()
        names, records, sizes = zip(*out.done) if out.done else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array(records, pa.int64()), pa.array(sizes, pa.int64())],
            names=["path", "records", "bytes"],
        )

    return keep(marked.mapInArrow(run, "path string, records bigint, bytes bigint"), "archive-manifest")


RECORD = (
    "page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, "
    "record_type string, refers_to bigint"
)
_KINDS = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
BATCH_BYTES = 8 * 1024 * 1024


def read(manifest: DataFrame, payloads: bool = True, where: str | None = None) -> DataFrame:
    """The page records of the archives of a manifest, digests checked.

    ``where`` is the address of the file system if the manifest's paths are not local ones.
    """
    where = where or folder(manifest.sparkSession)
    # A stated number, or adaptive execution would put the few rows of the manifest into one task.
    files = manifest.select("path").repartition(max(1, manifest.count()), "path")

    def batch(rows: list[dict]) -> pa.RecordBatch:
        names = list(rows[0])
        columns = [pa.array([r[n] for r in rows], type=k) for n, k in zip(names, _KINDS)]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(where)
        rows, size = [], 0
        for b in batches:
            for path in b.column(0).to_pylist():
                with store.open_input_stream(path, compression=None) as stream:
                    for data in frames(stream):
                        found = parse(data)
                        if found["warc-type"] == b"warcinfo":
                            continue
                        row = _row(found)
                        size += row["payload_bytes"] + 200 if payloads else 200
                        rows.append(row if payloads else row | {"payload": None})
                        if size >= BATCH_BYTES:
                            yield batch(rows)
                            rows, size = [], 0
        if rows:
            yield batch(rows)

    return files.mapInArrow(run, RECORD)
