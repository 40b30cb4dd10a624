"""WARC archives of individually compressed records with an embedded Zstandard dictionary, and their reader."""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stillwell.llm.shared import hot_join, shared_folder, staged

#: Fixed values of the format: the skippable frame that holds a dictionary, a Zstandard dictionary's first bytes.
SKIPPABLE = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAME = "urn:page:"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

MANIFEST = "path string, records long, bytes long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One record; a revisit has the HTTP head alone and names the record that holds the payload."""
    block = HTTP if revisit else HTTP + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{NAME}{'' if page is None else page}>",
            f"WARC-Date: {date}", "WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
            f"WARC-Payload-Length: {len(payload)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="%/:=&?~#+!$,;'@()*[]"))
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{NAME}{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes], size: int) -> zstandard.ZstdCompressionDict:
    """A dictionary trained on records; too few or too small records give one of their own bytes."""
    try:
        return zstandard.train_dictionary(size, [r[:1 << 17] for r in records])
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(r[:4096] for r in records)[:size] or b"\0" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class Archive:
    """Writes one archive: the dictionary in a skippable frame, then one frame per record."""

    def __init__(self, store: fs.FileSystem, path: str, sample: list[bytes], dictionary_bytes: int, level: int):
        trained = dictionary(sample, dictionary_bytes)
        self.path, self.count, self.bytes = path, 0, 0
        self.file = store.open_output_stream(path, compression=None)
        self.codec = zstandard.ZstdCompressor(level=level, dict_data=trained)
        self._put(struct.pack("<II", SKIPPABLE, len(trained.as_bytes())) + trained.as_bytes())

    def _put(self, data: bytes) -> None:
        self.file.write(data)
        self.bytes += len(data)

    def add(self, data: bytes) -> None:
        self._put(self.codec.compress(data))
        self.count += 1


def writer(folder: str, sample_bytes: int, dictionary_bytes: int, archive_bytes: int, level: int, date: str):
    """Write the pages of one task to archives of about ``archive_bytes``; a row per archive.

    The first ``sample_bytes`` of records of an archive train its dictionary. File names are unique to an
    attempt, so a lost or repeated attempt leaves nothing that a manifest names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        archive, waiting, held, done = None, [], 0, []

        def start() -> Archive:
            made = Archive(store, f"{root}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.zst", waiting, dictionary_bytes, level)
            for data in waiting:
                made.add(data)
            waiting.clear()
            return made

        def finish(made: Archive) -> None:
            made.file.close()
            done.append((made.path, made.count, made.bytes))

        for part in batches:
            for page, url, payload, digest, last in zip(*(part[c] for c in ("page_id", "url", "payload", "payload_digest", "last"))):
                page, last = page.as_py(), last.as_py()
                data = record(page, url.as_py(), payload.as_py(), digest.as_py(), last, last is not None and last != page, date)
                if archive:
                    archive.add(data)
                    if archive.bytes > archive_bytes:
                        finish(archive)
                        archive = None
                else:
                    waiting.append(data)
                    held += len(data)
                    if held > sample_bytes:
                        archive, held = start(), 0
        if waiting:
            archive = start()
        if archive:
            finish(archive)
        yield pa.RecordBatch.from_pylist([{"path": p, "records": n, "bytes": b} for p, n, b in done],
                                         schema=pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return run


def read_archive(file) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an open archive."""
    magic, size = struct.unpack("<II", file.read(8))
    if magic != SKIPPABLE:
        raise ValueError("the archive has no leading dictionary frame")
    codec = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(file.read(size)))
    plain = io.BufferedReader(codec.stream_reader(file, read_across_frames=True), 1 << 20)
    while line := plain.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError("a record must start with the version line")
        fields = {}
        while (line := plain.readline()) != b"\r\n":
            name, _, value = line.decode().partition(":")
            fields[name] = value.strip()
        block = plain.read(int(fields["Content-Length"]))
        if plain.read(4) != b"\r\n\r\n":
            raise ValueError("a record must end with two line ends")
        yield fields, block


def named(text: str) -> int | None:
    number = text.strip("<>").removeprefix(NAME)
    return int(number) if number else None


def reader(folder: str):
    """Rows of the archives named by a manifest; payloads are checked against their digests."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for part in batches:
            for path in part["path"].to_pylist():
                rows = []
                with store.open_input_stream(path, compression=None) as file:
                    for fields, block in read_archive(file):
                        digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        size, revisit = int(fields["WARC-Payload-Length"]), fields["WARC-Type"] == "revisit"
                        payload = block.partition(b"\r\n\r\n")[2]
                        if not revisit and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                            raise ValueError(f"damaged payload in {path}")
                        rows.append((named(fields["WARC-Record-ID"]), size, digest, fields["WARC-Type"], named(fields["WARC-Refers-To"]) if revisit else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def write_archives(pages: DataFrame, folder: str, revisit_bytes: int = 1000, sample_bytes: int = 4 << 20, dictionary_bytes: int = 32 << 10,
                   archive_bytes: int = 32 << 20, level: int = 3, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Archive ``pages`` (page_id, url, html) below ``folder``; returns the manifest (path, records, bytes).

    Of pages with equal payloads of at least ``revisit_bytes``, the one with the largest page_id is a response and
    the others revisit it. A null html is an empty payload, a null url is left out, a null page_id gives an unnamed
    record and never owns a payload that a named page has. Repeated rows are written again, each as its twin.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha1("payload"))
    light = rows.select("page_id", "payload_digest", F.length("payload").alias("n_bytes")).filter(F.col("n_bytes") >= revisit_bytes)
    groups = light.groupBy("payload_digest").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    typed = hot_join(rows, groups, ["payload_digest"], "copies", pages.count(), F.col("page_id"))
    return staged(typed.mapInArrow(writer(folder, sample_bytes, dictionary_bytes, archive_bytes, level, date), MANIFEST))


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per record of the archives: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    # as many tasks as archives: their names alone are too few bytes to be dealt out otherwise
    return manifest.repartition(max(1, manifest.count()), "path").mapInArrow(reader(folder), RECORDS)


def archived(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back."""
    folder = shared_folder(pages.sparkSession)
    return read_archives(write_archives(pages, folder), folder)
