"""WARC archives in Zstandard: one frame for each record, the dictionary in a leading skippable frame.

Writing: each page is a ``response`` record, or a ``revisit`` of the page with the smallest id among equal payloads.
Reading: the dictionary comes from the skippable frame (magic 0x184D2A5D), each later frame must hold exactly one
record, and the version line, required headers, lengths and digests are validated; a bad frame raises ``WarcError``.

Each attempt of a writing task has file names of its own, and the names that count are the rows which Spark keeps of the
attempt that succeeded (the manifest). Files that a lost or a speculative attempt leaves behind are never read.

A null html is an empty payload, repeated page ids stay separate rows, a null id is written as -1 and comes first, an
empty table gives no archive and no rows. Very long pages are written and read whole, one record in memory at a time. Of
equal payloads with one id all are responses. Columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import io
import re
import struct
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import mapped, scratch_path, stored

# Fixed values of the file formats.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
CRLF = b"\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")


class WarcError(ValueError):
    """An archive that breaks the format."""


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: int, url: str, payload: bytes, digest: str, refers_to: int | None, date: str = "2025-01-01T00:00:00Z") -> bytes:
    """One WARC record; a revisit has no payload of its own, only the length and digest of the full one."""
    url = urllib.parse.quote(url, safe=":/?#[]@!$&'()*+,;=%~")
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{page_id}>"), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if refers_to is not None:
        head += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", REVISIT_PROFILE)]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    head += [("Content-Type", "application/http; msgtype=response"), ("WARC-Block-Digest", f"sha1:{payload_digest(block)}"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + CRLF + block + CRLF + CRLF


def _headers(raw: bytes) -> dict[str, str]:
    out = {}
    for line in raw.split(CRLF):
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise WarcError(f"not a header: {line[:60]!r}")
        out[name.strip().decode().lower()] = value.strip().decode()
    return out


def parse_record(data: bytes) -> dict:
    """The record that fills ``data``, validated."""
    if not data.startswith((b"WARC/1.0\r\n", b"WARC/1.1\r\n")):
        raise WarcError(f"no version line: {data[:20]!r}")
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise WarcError("headers do not end")
    head = _headers(data[10:end])
    if missing := [k for k in REQUIRED if k.lower() not in head]:
        raise WarcError(f"missing {', '.join(missing)}")
    if not re.fullmatch(r"[0-9]+", head["content-length"]):
        raise WarcError("Content-Length is no number")
    length = int(head["content-length"])
    block, tail = data[end + 4 : end + 4 + length], data[end + 4 + length :]
    if len(block) != length or tail != CRLF + CRLF:
        raise WarcError(f"Content-Length {length} does not fit a frame of {len(data)} bytes")
    if "warc-block-digest" in head and head["warc-block-digest"] != f"sha1:{payload_digest(block)}":
        raise WarcError("the block's digest differs")
    http_end = block.find(b"\r\n\r\n")
    if http_end < 0:
        raise WarcError("the HTTP headers do not end")
    _, _, http = block[:http_end].partition(CRLF)
    stated, payload = _headers(http).get("content-length", ""), block[http_end + 4 :]
    kind = head["warc-type"]
    if kind not in ("response", "revisit") or not stated.isdigit():
        raise WarcError(f"type {kind!r}, HTTP length {stated!r}")
    if kind == "response" and (len(payload) != int(stated) or head.get("warc-payload-digest") != f"sha1:{payload_digest(payload)}"):
        raise WarcError("the payload's length or digest differs")
    if kind == "revisit" and (payload or "warc-refers-to" not in head):
        raise WarcError("a revisit has no payload and names its original")
    return {"headers": head, "record_type": kind, "payload": payload, "payload_bytes": int(stated)}


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary


def read_archive(source: io.BufferedIOBase) -> Iterator[dict]:
    """Records of a ``.warc.zst`` stream, one frame at a time; only one record is in memory."""
    lead = source.read(8)
    dictionary, carry = None, lead
    if len(lead) == 8 and struct.unpack("<I", lead[:4])[0] == DICTIONARY_MAGIC:
        size = struct.unpack("<I", lead[4:])[0]
        raw = source.read(size)
        if len(raw) != size:
            raise WarcError("the dictionary frame is cut short")
        if raw[:4] == FRAME_MAGIC:
            raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        dictionary, carry = zstandard.ZstdCompressionDict(raw), b""
    reader = zstandard.ZstdDecompressor(**({"dict_data": dictionary} if dictionary else {}))
    while chunk := carry or source.read(1 << 16):
        if not FRAME_MAGIC.startswith(chunk[:4]) and chunk[:4] != FRAME_MAGIC:
            raise WarcError(f"no Zstandard frame: {chunk[:4]!r}")
        frame, parts = reader.decompressobj(), []
        while True:
            try:
                parts.append(frame.decompress(chunk))
            except zstandard.ZstdError as e:
                raise WarcError(f"bad frame: {e}") from e
            if frame.eof:
                carry = frame.unused_data
                break
            if not (chunk := source.read(1 << 16)):
                raise WarcError("the last frame is cut short")
        yield parse_record(b"".join(parts))


#: Schemes of Hadoop's file systems by the names that Arrow has for the same stores.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfss", "abfs": "abfs", "hdfs": "hdfs", "viewfs": "viewfs", "gs": "gs", "s3": "s3", "file": "file"}


def arrow_uri(path: str) -> str:
    """A Hadoop path as Arrow reads it: ``s3a://b/k`` is ``s3://b/k``, ``file:/x`` is ``file:///x``; no scheme is local."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return "file://" + path
    if scheme not in SCHEMES:
        raise ValueError(f"archives cannot be written to {scheme}: (known are {', '.join(SCHEMES)})")
    return f"{SCHEMES[scheme]}://" + ("/" + rest.lstrip("/") if scheme == "file" else rest.removeprefix("//"))


@functools.cache
def _sink(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    uri = arrow_uri(folder)
    if uri.startswith("file://"):
        return pyarrow.fs.LocalFileSystem(), uri.removeprefix("file://")
    try:
        return pyarrow.fs.FileSystem.from_uri(uri)
    except (OSError, ValueError, NotImplementedError) as e:
        raise ValueError(f"Arrow on this worker has no file system for {uri}: {e}") from e


def train_dictionary(pages: DataFrame, samples: int = 256, sample_bytes: int = 8192, size: int = 16384) -> bytes:
    """A dictionary from at most ``samples`` pages' leading ``sample_bytes`` characters: a bounded sample, which only
    helps compression. It is chosen by a hash of the id, so archives are the same whenever they are written. Too few pages
    to learn from give none."""
    # About twice the samples pass the share, so the lowest hashes are looked for among few rows.
    drawn = F.pmod(F.xxhash64("page_id", "url", F.lit(10)), F.lit(1 << 30))
    share = min(1.0, 2 * samples / max(pages.count(), 1))
    some = pages.where("html <> ''").where(drawn < int(share * (1 << 30)) + 1).select(drawn.alias("r"), "page_id", F.substring("html", 1, sample_bytes).alias("t"))
    got = [r.t.encode("utf-8", "surrogatepass") for r in some.orderBy("r", "page_id", "t").limit(samples).collect()]
    try:
        return zstandard.train_dictionary(size, got).as_bytes() if len(got) >= 16 else b""
    except zstandard.ZstdError:
        return b""


def described(pages: DataFrame, common: int = 10_000) -> DataFrame:
    """``page_id, url, html, digest, refers_to``: the smallest page id of each payload is the original.

    The smallest ids are found with partial aggregates over (digest, page_id) alone. A payload that more than one page in
    ``common`` has is looked up in a broadcast table of at most ``common`` rows, so no task gathers its pages; the others
    join on the digest."""
    slim = pages.select(F.coalesce(F.col("page_id").cast("long"), F.lit(-1)).alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    slim = slim.withColumn("digest", F.sha1("html"))
    first = stored(slim.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")), "payloads")
    total = first.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = F.col("n") > max(1000, total // common)
    looked_up = slim.join(F.broadcast(first.where(often).select("digest", F.col("first_id").alias("common_id"))), "digest", "left")
    rest = looked_up.where("common_id is null").join(first.where(~often).select("digest", "first_id"), "digest").drop("common_id")
    both = rest.unionByName(looked_up.where("common_id is not null").withColumnRenamed("common_id", "first_id"))
    return both.withColumn("refers_to", F.when(F.col("page_id") != F.col("first_id"), F.col("first_id"))).drop("first_id")


def write_archives(pages: DataFrame, folder: str, roll_bytes: int = 16 << 20, level: int = 3) -> DataFrame:
    """Writes ``pages (page_id, url, html)`` as ``*.warc.zst`` files of about ``roll_bytes`` each in the shared folder and
    returns their manifest, ``path, records``, kept in the shared store."""
    spark = pages.sparkSession
    dictionary = train_dictionary(pages)
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(where)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _sink(folder)
        made = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        packer = zstandard.ZstdCompressor(level=level, write_content_size=True, **({"dict_data": made} if made else {}))
        attempt, out, size, files = uuid.uuid4().hex, None, 0, []
        for b in batches:
            columns = [b.column(c) for c in ("page_id", "url", "html", "refers_to")]
            for at in range(b.num_rows):
                page, url, html, refers = (c[at].as_py() for c in columns)
                payload = html.encode("utf-8", "surrogatepass")
                frame = packer.compress(record_bytes(page, url, payload, payload_digest(payload), refers))
                if out is not None and size + len(frame) > roll_bytes:
                    out.close()
                    out = None
                if out is None:
                    files.append([f"part-{attempt}-{len(files):05d}.warc.zst", 0])
                    out, size = store.open_output_stream(f"{base}/{files[-1][0]}", compression=None), 0
                    out.write(dictionary_frame(dictionary) if dictionary else b"")
                out.write(frame)
                size += len(frame)
                files[-1][1] += 1
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{n}" for n, _ in files], pa.string()), pa.array([n for _, n in files], pa.int64())], names=["path", "records"])

    return stored(mapped(described(pages).select("page_id", "url", "html", "refers_to"), write, "path string, records long"), "manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """``page_id, payload, payload_bytes, payload_digest, record_type, refers_to`` of each record in the archives of
    ``manifest (path, records)``; a file with another number of records is an error."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        types = [pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for b in batches:
            for path, records in zip(b.column("path").to_pylist(), b.column("records").to_pylist(), strict=True):
                store, name = _sink(path)
                rows, held, n = [], 0, 0
                with store.open_input_stream(name, compression=None) as source:
                    for r in read_archive(source):
                        h = r["headers"]
                        page, refers = (int(x.rpartition(":")[2].rstrip(">")) if x else None for x in (h["warc-record-id"], h.get("warc-refers-to")))
                        rows.append((page, r["payload"], r["payload_bytes"], h["warc-payload-digest"].removeprefix("sha1:"), r["record_type"], refers))
                        held, n = held + len(r["payload"]), n + 1
                        if held > 4 << 20 or len(rows) >= 1000:
                            yield out(rows)
                            rows, held = [], 0
                if n != records:
                    raise WarcError(f"{path} has {n} records and not {records}")
                if rows:
                    yield out(rows)

    schema = "page_id long, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
    # Only names are read here; tasks stream the files, so dealing them out evenly costs nothing.
    count = max(1, min(manifest.sparkSession.sparkContext.defaultParallelism * 4, manifest.count()))
    return mapped(manifest.repartition(count), read, schema)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes archives to the shared store and reads them back."""
    return read_archives(write_archives(pages, scratch_path(spark, "warc")))
