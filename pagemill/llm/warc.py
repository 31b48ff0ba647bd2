"""WARC archives: pages written as records, whole-file gzip streams turned into one member per record, and reading.

`write_archives` gives each task's records one gzip stream, as crawlers without record compression leave it.
`normalise` inflates such a stream once, from front to back, and writes each record as a gzip member of its own beside
an index of offsets; `read_records` opens archives at those offsets. Tasks hold one record at a time. Every attempt of
a task writes files under names of its own, and only the names in the table that Spark commits count, so a lost or
repeated task leaves at most files that nobody reads.

Null payloads are empty; null urls and null ids are left out of the record and read back as null. Rows with the same
id are records of their own; where their payloads are equal too, both are the response. Columns beyond the named ones
are not looked at.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import re
import zlib
from collections.abc import Iterable, Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import shared_folder, written

#: Payloads from this size on are stored once.
MIN_SHARED = 1000
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:pagemill:page:"


class Record(NamedTuple):
    headers: dict[str, str]
    block: bytes


def _record(headers: dict[str, str | None], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers.items() if v is not None), f"Content-Length: {len(block)}"]
    return b"\r\n".join([*(line.encode() for line in lines), b"", block, b"", b""])


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response with its payload, or a revisit with the HTTP header alone."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<{URN}{'' if page_id is None else page_id}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Refers-To": f"<{URN}{refers_to}>" if revisit else None,
        "WARC-Profile": PROFILE if revisit else None,
        "Content-Type": "application/http;msgtype=response",
    }
    return _record(headers, http if revisit else http + payload)


def parse_records(stream: BinaryIO) -> Iterator[Record]:
    """The records of an uncompressed stream, one at a time."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record starts with {line[:40]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            headers[name.strip()] = value.strip()
        size = int(headers["Content-Length"])
        block = stream.read(size)
        if len(block) < size:
            raise ValueError("a record is cut off")
        yield Record(headers, block)


def _place(folder: str, suffix: str) -> tuple[fs.FileSystem, str, str]:
    """A file of this attempt of this task: its file system, path there, and address."""
    task = TaskContext.get()
    system, root = fs.FileSystem.from_uri(folder)
    name = f"{task.partitionId():06d}-{task.taskAttemptId()}{suffix}"
    system.create_dir(root, recursive=True)
    return system, f"{root}/{name}", f"{folder}/{name}"


def shared_payloads(pages: DataFrame, min_shared: int = MIN_SHARED) -> DataFrame:
    """Pages (`page_id`, `url`, `html`) as `page_id`, `url`, `payload`, `digest` and `refers_to`, the page that holds
    the payload. Copies are counted per task before they meet; a payload with many copies is split in the join."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    own = pages.select("page_id", "url", payload.cast("binary").alias("payload"), F.sha1(payload).alias("digest"))
    narrow = pages.select("page_id", F.sha1(payload).alias("digest")).filter(F.octet_length(payload) >= min_shared)
    holders = narrow.groupBy("digest").agg(F.max("page_id").alias("holder"), F.count("*").alias("n")).filter("n > 1").drop("n")
    refers_to = F.when(F.col("page_id") < F.col("holder"), F.col("holder"))
    return own.join(holders, "digest", "left").select("page_id", "url", "payload", "digest", refers_to.alias("refers_to"))


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Writes the rows of `shared_payloads`, each task's as one gzip stream; `path` and `n_records` of the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path, address = _place(folder, ".warc.gz")
        n, squeeze = 0, zlib.compressobj(LEVEL, wbits=31)
        with system.open_output_stream(path, compression=None) as out:
            for batch in batches:
                columns = [batch[c] for c in ("page_id", "url", "payload", "digest", "refers_to")]
                for row in zip(*columns, strict=True):
                    out.write(squeeze.compress(page_record(*(value.as_py() for value in row))))
                    n += 1
            out.write(squeeze.flush())
        yield pa.RecordBatch.from_pydict({"path": [address], "n_records": [n]})

    return records.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, "path string, n_records bigint")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrites archives (`path`), whole-file streams or not, with a gzip member for each record, and beside each an
    index with a JSON line per record: `offset`, `length`, `type` and `id`. Gives `path`, `index` and `n_records`."""

    def rewrite(address: str, out: BinaryIO, index: BinaryIO) -> int:
        system, path = fs.FileSystem.from_uri(address)
        at = n = 0
        with system.open_input_stream(path, compression=None) as raw, gzip.GzipFile(fileobj=io.BufferedReader(raw)) as stream:
            for n, (headers, block) in enumerate(parse_records(stream), 1):
                member = gzip.compress(_record({k: v for k, v in headers.items() if k != "Content-Length"}, block), LEVEL, mtime=0)
                out.write(member)
                line = {"offset": at, "length": len(member), "type": headers["WARC-Type"], "id": headers["WARC-Record-ID"]}
                index.write(json.dumps(line).encode() + b"\n")
                at += len(member)
        return n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, address in enumerate(a.as_py() for batch in batches for a in batch["path"]):
            system, path, new = _place(folder, f"-{k}.warc.gz")
            with system.open_output_stream(path, compression=None) as out, system.open_output_stream(f"{path}.index") as index:
                n = rewrite(address, out, index)
            yield pa.RecordBatch.from_pydict({"path": [new], "index": [f"{new}.index"], "n_records": [n]})

    return archives.select("path").mapInArrow(run, "path string, index string, n_records bigint")


def _page_id(urn: str | None) -> int | None:
    digits = (urn or "").removeprefix(f"<{URN}").removesuffix(">")
    return int(digits) if digits else None


READ = "page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def _read(index: Iterable[bytes], archive: BinaryIO) -> Iterator[tuple]:
    for line in index:
        entry = json.loads(line)
        archive.seek(entry["offset"])
        (record,) = parse_records(io.BytesIO(gzip.decompress(archive.read(entry["length"]))))
        headers = record.headers
        http, _, payload = record.block.partition(b"\r\n\r\n")
        revisit = headers["WARC-Type"] == "revisit"
        size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
        if not revisit and (size != len(payload) or digest != hashlib.sha1(payload).hexdigest()):
            raise ValueError(f"the payload of {headers['WARC-Record-ID']} is not the one that was written")
        refers_to = _page_id(headers.get("WARC-Refers-To"))
        yield (
            _page_id(headers["WARC-Record-ID"]), headers.get("WARC-Target-URI"), None if revisit else payload, size, digest, headers["WARC-Type"], refers_to
        )


def read_records(archives: DataFrame, batch_rows: int = 512) -> DataFrame:
    """The records of normalised archives (`path`, `index`), each read at its offset; revisits have no payload."""
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = [field.split()[0] for field in READ.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            for path, index in zip(batch["path"].to_pylist(), batch["index"].to_pylist(), strict=True):
                system, place = fs.FileSystem.from_uri(path)
                rows: list[tuple] = []
                with system.open_input_stream(fs.FileSystem.from_uri(index)[1]) as lines, system.open_input_file(place) as archive:
                    for row in _read(io.BufferedReader(lines), archive):
                        rows.append(row)
                        if len(rows) == batch_rows:
                            yield out(rows)
                            rows = []
                yield out(rows)

    return archives.select("path", "index").mapInArrow(run, READ)


def round_trip(pages: DataFrame, min_shared: int = MIN_SHARED) -> DataFrame:
    """Pages written, normalised and read back. Each file is a task of the later steps."""
    spark = pages.sparkSession
    folder = shared_folder(spark, "warc")
    files = written(write_archives(shared_payloads(pages, min_shared), f"{folder}/whole"), "warc-files")
    parts = max(1, files.count())
    normal = written(normalise(files.repartition(parts), f"{folder}/members"), "warc-members")
    return read_records(normal.repartition(parts))
