"""Token files: frequency-ranked ids in a byte-aligned variable-length code with separate control bytes."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stillwell.llm.shared import shared_folder, staged
from stillwell.llm.tokens import BYTE_PIECES, encoder

MAGIC = b"RANKVB01"
HEAD = struct.Struct("<8sQQQQ")  # magic, documents, ids, ranked ids, data bytes

#: For a control byte, the data bytes of each of its four ranks: two bits a rank, first rank in the low bits.
SIZES = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.int64) + 1

MANIFEST = "path string, part int, start_in_part long, ids long, docs long"
DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit ranks."""
    code = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    data = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]]
    four = np.zeros(-(-len(ranks) // 4) * 4, dtype=np.uint8)
    four[:len(ranks)] = code
    four = four.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    return control.tobytes(), data.tobytes()


def decode_ranks(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The ranks again: sizes come from a table by control byte, bytes are gathered by place."""
    sizes = SIZES[np.frombuffer(control, dtype=np.uint8)].reshape(-1)[:count]
    starts = np.cumsum(sizes) - sizes
    raw = np.frombuffer(data, dtype=np.uint8)
    ranks = raw[starts].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(sizes > k)
        ranks[more] |= raw[starts[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return ranks


def pack_file(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """One file: head, the ids by falling frequency, document ids with a null mask, lengths, control, data."""
    counts = np.bincount(ids, minlength=1)
    values = np.flatnonzero(counts)
    order = np.lexsort((values, -counts[values]))
    rank = np.zeros(len(counts), dtype=np.uint32)
    rank[values[order]] = np.arange(len(values), dtype=np.uint32)
    control, data = encode_ranks(rank[ids])
    known = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    numbers = np.array([0 if d is None else d for d in doc_ids], dtype="<i8")
    return b"".join([HEAD.pack(MAGIC, len(doc_ids), len(ids), len(values), len(data)), values[order].astype("<u4").tobytes(),
                     known.tobytes(), numbers.tobytes(), np.array(lengths, dtype="<u8").tobytes(), control, data])


def unpack_file(file) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, lengths and all ids of an open file."""
    magic, docs, count, ranked, size = HEAD.unpack(file.read(HEAD.size))
    if magic != MAGIC:
        raise ValueError("not a token file")
    by_rank = np.frombuffer(file.read(4 * ranked), dtype="<u4")
    known = np.frombuffer(file.read(docs), dtype=np.uint8)
    numbers = np.frombuffer(file.read(8 * docs), dtype="<i8").tolist()
    lengths = np.frombuffer(file.read(8 * docs), dtype="<u8").astype(np.int64)
    control = file.read(-(-count // 4))
    ranks = decode_ranks(control, file.read(size), count)
    return [n if k else None for n, k in zip(numbers, known)], lengths, by_rank[ranks] if count else np.zeros(0, dtype="<u4")


def writer(folder: str, tokenizer: str, end_id: int, file_ids: int):
    """Encode a task's documents in the order given and write files of about ``file_ids`` ids; a row per file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        encode, end, part = encoder(tokenizer, BYTE_PIECES).encode, np.array([end_id], dtype="<u4").tobytes(), TaskContext.get().partitionId()
        docs: list = []
        lengths: list[int] = []
        held: list[bytes] = []
        before, waiting, done = 0, 0, []

        def put():
            nonlocal before, waiting
            path = f"{root}/{part:06d}-{uuid.uuid4().hex}.tokens"
            with store.open_output_stream(path, compression=None) as file:
                file.write(pack_file(docs, lengths, np.frombuffer(b"".join(held), dtype="<u4")))
            done.append({"path": path, "part": part, "start_in_part": before, "ids": waiting, "docs": len(docs)})
            before, waiting = before + waiting, 0
            docs.clear(), lengths.clear(), held.clear()

        for batch in batches:
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                ids = encode(text.as_py()) + end
                docs.append(doc), lengths.append(len(ids) // 4), held.append(ids)
                waiting += len(ids) // 4
                if waiting >= file_ids:
                    put()
        if docs:
            put()
        yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("path", pa.string()), ("part", pa.int32()), ("start_in_part", pa.int64()), ("ids", pa.int64()), ("docs", pa.int64())]))

    return run


def reader(folder: str):
    """A row per document of the files named: its place, length and checksum, from the decoded ids."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, start in zip(batch["path"].to_pylist(), batch["start"].to_pylist()):
                with store.open_input_file(path) as file:
                    docs, lengths, ids = unpack_file(file)
                ends = np.cumsum(lengths)
                raw = memoryview(np.ascontiguousarray(ids, dtype="<u4").tobytes())
                sums = [zlib.crc32(raw[4 * (e - n):4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(start + ends - lengths, pa.int64()),
                                                  pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())], schema=schema)

    return run


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, file_ids: int = 4_000_000) -> DataFrame:
    """Encode every whole text of ``docs`` (doc_id, text), end each with ``end_id``, and write files in doc_id order.

    Returns the manifest (path, part, start_in_part, ids, docs). Documents are dealt by ranges of doc_id and sorted
    inside them; a null doc_id comes first, rows with one doc_id follow each other by a hash of the text. A null text
    is empty. Each file ranks the ids by their counts over the whole file and carries the ranking, so it is encoded
    in one pass and can be read alone. File names are unique to an attempt; the manifest names the ones that count.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return staged(dealt.mapInArrow(writer(folder, tokenizer, end_id, file_ids), MANIFEST))


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range of doc_id: as many as the writing job had tasks
    parts = manifest.groupBy("part").agg(F.sum("ids").alias("part_ids"))
    parts = parts.select("part", F.coalesce(F.sum("part_ids").over(before), F.lit(0)).alias("before"))
    files = manifest.join(parts, "part").select("path", (F.col("before") + F.col("start_in_part")).alias("start"))
    # as many tasks as files: their names alone are too few bytes to be dealt out otherwise
    return files.repartition(max(1, manifest.count()), "path").mapInArrow(reader(folder), DOCUMENTS)


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write token files to the shared folder and read them back; an empty table writes no file and gives no rows."""
    folder = shared_folder(docs.sparkSession)
    return read_token_files(write_token_files(docs, folder, tokenizer), folder)
