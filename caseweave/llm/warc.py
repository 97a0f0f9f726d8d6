"""WARC archives with a Zstandard dictionary of their own.

An archive starts with a skippable frame that holds the dictionary (magic 0x184D2A5D, length,
dictionary); then each record is a frame of its own, compressed with it. Equal payloads of at
least MIN_REVISIT bytes are stored once: the smallest page id is the response, others revisit it.

Defined cases: a null payload is empty; a null url leaves its header out; a null page id is
kept as such and is never referred to while its payload has another id; rows with equal ids
and payloads are all responses; an empty table writes no archive. Without enough records for
Zstandard's trainer the dictionary is their raw content; without any content there is none.
"""
from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..plans.lineage import cut, scratch_path

MIN_REVISIT = 100
#: The dictionary is built from the records of at most so many pages, of different payloads, those with the smallest hash.
SAMPLE_PAGES = 500
SAMPLE_PAGE_BYTES = 1 << 16
DICTIONARY_BYTES = 1 << 16
ARCHIVE_BYTES = 32 << 20
LEVEL = 3
DICTIONARY_FRAME = 0x184D2A5D


def classify(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, payload, digest, refers_to): refers_to is null for responses."""
    payload = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), payload.cast("binary").alias("payload"),
                        F.sha2(payload, 256).alias("digest"))
    long = F.octet_length("payload") >= MIN_REVISIT
    first = rows.where(long).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    other = F.when(long & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return rows.join(first.drop("n"), "digest", "left").select("page_id", "url", "payload", "digest", other.alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has no body and states its payload's length in a header."""
    revisit = refers_to is not None
    http = b"" if revisit else b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>",
            "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"X-Payload-Length: {len(payload)}",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    else:
        head.append("Content-Type: application/http; msgtype=response")
    body = http + (b"" if revisit else payload)
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def dictionary(rows: DataFrame) -> bytes:
    """Built from a bounded sample of the records as they are archived."""
    import zstandard
    fit = rows.where(F.col("refers_to").isNull() & (F.octet_length("payload") <= SAMPLE_PAGE_BYTES)).withColumn("_h", F.xxhash64("digest"))
    least = fit.select("_h").distinct().orderBy("_h").limit(SAMPLE_PAGES).agg(F.max("_h")).first()[0]  # numbers first, then few pages
    some = [] if least is None else fit.where(F.col("_h") <= least).dropDuplicates(["_h"]).collect()
    some.sort(key=lambda r: r["digest"])
    samples = [record(r["page_id"], r["url"], bytes(r["payload"]), r["digest"], None) for r in some]
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def write(rows: DataFrame, folder: str) -> DataFrame:
    """Archives in ``folder`` (of any store pyarrow opens); returns (file, records, bytes).

    A task writes under a name of its own attempt and renames it when complete, so a lost or
    repeated task leaves no half archive.
    """
    trained = dictionary(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        store, root = _open(folder)
        store.create_dir(root, recursive=True)
        context = TaskContext.get()
        codec = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True, **(
            {"dict_data": zstandard.ZstdCompressionDict(trained)} if trained else {}))
        out, number, count = None, 0, 0

        def done() -> pa.RecordBatch:
            nonlocal out, number, count
            size = out.tell()
            out.close()
            name = f"{root}/pages-{context.partitionId():06d}-{number:04d}.warc.zst"
            store.move(f"{name}.{context.taskAttemptId()}.part", name)
            result = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count]), pa.array([size])], names=["file", "records", "bytes"])
            out, number, count = None, number + 1, 0
            return result

        for batch in batches:
            for r in range(batch.num_rows):
                if out is None:
                    out = store.open_output_stream(f"{root}/pages-{context.partitionId():06d}-{number:04d}.warc.zst.{context.taskAttemptId()}.part")
                    if trained:
                        out.write(struct.pack("<II", DICTIONARY_FRAME, len(trained)) + trained)
                page_id, url, payload, digest, refers_to = (c[r].as_py() for c in batch.columns)
                out.write(codec.compress(record(page_id, url, payload, digest, refers_to)))
                count += 1
                if out.tell() >= ARCHIVE_BYTES:
                    yield done()
        if out is not None:
            yield done()

    return cut(rows.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, "file string, records long, bytes long"), "manifest")


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of the records of one archive."""
    import zstandard
    known, at = None, 0
    if len(content) >= 8 and struct.unpack_from("<I", content)[0] == DICTIONARY_FRAME:
        size = struct.unpack_from("<I", content, 4)[0]
        known, at = content[8:8 + size], 8 + size
    codec = zstandard.ZstdDecompressor(**({"dict_data": zstandard.ZstdCompressionDict(known)} if known else {}))
    stream = io.BufferedReader(codec.stream_reader(io.BytesIO(memoryview(content)[at:]), read_across_frames=True), 1 << 16)
    while line := stream.readline():
        if line.rstrip() != b"WARC/1.1":
            raise ValueError(f"not a record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.partition(b": ")
            headers[name.decode().lower()] = value.decode()
        block = stream.read(int(headers["content-length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record does not end with two line breaks")
        yield headers, block


def _page(urn: str) -> int | None:
    text = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if text == "None" else int(text)


def read(spark, folder: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to), from the archives alone; digests of responses are checked."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for head, block in parse(content.as_py()):
                    digest = head["warc-payload-digest"].removeprefix("sha256:")
                    kind = head["warc-type"]
                    if kind == "response":
                        payload = block[block.index(b"\r\n\r\n") + 4:]
                        if hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"payload of {head['warc-record-id']} does not match its digest")
                        size, refers = len(payload), None
                    else:
                        size, refers = int(head["x-payload-length"]), _page(head["warc-refers-to"])
                    rows.append((_page(head["warc-record-id"]), head.get("warc-target-uri"), size, digest, kind, refers))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[f.split()[0] for f in schema.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").schema(
        "path string, modificationTime timestamp, length long, content binary").load(folder)
    return files.select("content").mapInArrow(run, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive ``pages`` in the shared folder and read them back."""
    spark = pages.sparkSession
    folder = f"{scratch_path(spark, 'warc')}-{uuid.uuid4().hex}"
    manifest = write(cut(classify(pages), "records"), folder)
    if manifest.first() is None:
        return spark.createDataFrame([], "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return read(spark, folder)
