"""Best-two-fit packing of documents into sequences of a fixed number of tokens."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stillwell.llm.tokens import WORD_PIECES, encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, lot int"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def cutter(tokenizer: str, end_id: int, capacity: int, lots: int):
    """Encode documents and cut only those longer than a sequence; each piece is dealt to one of ``lots`` lots in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer, WORD_PIECES).encode, np.array([end_id], dtype="<u4").tobytes()
        turn = 7919 * TaskContext.get().partitionId()
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                ids = memoryview(encode(text.as_py()) + end)
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    rows.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part), turn % lots))
                    turn += 1
            yield arrow(rows, PIECE_FIELDS)

    return run


PIECE_FIELDS = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("lot", pa.int32())])


def arrow(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def best_two_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices into ``lengths``, each at most ``capacity`` full.

    A bin takes the largest unpacked item that fits, again and again. Then, while it has a gap, its smallest item
    gives way to the two unpacked items that fill the gap it leaves most tightly, if they fill more than it did.
    """
    left = np.zeros(capacity + 1, dtype=np.int64)
    items: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i in sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True):
        items[lengths[i]].append(i)
        left[lengths[i]] += 1
    sizes = np.arange(capacity + 1)
    #: the largest length up to each that is still unpacked; 0 if there is none
    floor = np.maximum.accumulate(np.where(left > 0, sizes, 0))

    def take(size: int) -> None:
        left[size] -= 1
        if not left[size]:
            floor[size:np.searchsorted(floor, size, side="right")] = floor[size - 1]

    bins = []
    while floor[capacity]:
        bin_, gap = [], capacity
        while gap and (size := int(floor[gap])):
            take(size)
            bin_.append(size)
            gap -= size
        if gap and floor[capacity]:
            smallest = bin_[-1]
            room = gap + smallest
            first = np.unique(floor[1:room])
            first = first[first > 0]
            if len(first):
                second = floor[room - first]
                # the same length twice needs two items of it; else the next smaller one
                second = np.where((second == first) & (left[first] < 2), floor[np.maximum(first - 1, 0)], second)
                total = np.where(second > 0, first + second, 0)
                best = int(np.argmax(total))
                if total[best] > smallest:
                    bin_.pop()
                    a, b = int(first[best]), int(second[best])
                    take(a)
                    take(b)
                    left[smallest] += 1
                    upper = floor[smallest:]
                    upper[upper < smallest] = smallest
                    bin_ += [a, b]
        bins.append(bin_)
    # lengths stand for items until here; any item of a length will do
    return [[items[size].pop() for size in bin_] for bin_ in bins]


def packer(capacity: int):
    """Pack each lot of a partition; a lot's pieces are a few numbers each, so a partition's lots fit in memory."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot, rows = None, []

        def packed():
            out = []
            for number, bin_ in enumerate(best_two_fit([r[3] for r in rows], capacity)):
                offset = 0
                for i in bin_:
                    out.append((*rows[i][:5], (lot << 32) + number, offset))
                    offset += rows[i][3]
            return arrow(out, schema)

        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("doc_id", "piece", "start", "length", "ids_crc32", "lot"))):
                if row[5] != lot:
                    if rows:
                        yield packed()
                    lot, rows = row[5], []
                rows.append(row)
        if rows:
            yield packed()

    return run


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096, lot_pieces: int = 8192) -> DataFrame:
    """Pack all ``docs`` (doc_id, text) into sequences of at most ``capacity`` tokens; a row per piece of a document.

    A document is its ids and ``end_id``; a null or empty text is ``end_id`` alone. Only documents longer than a
    sequence are cut. Rows: doc_id, piece, start (ids of its document before it), length, ids_crc32, sequence_id,
    offset (its place there). Repeated rows and null ids are packed like any other; an empty table gives no rows.

    Pieces are dealt in turn to lots of about ``lot_pieces``, and each lot is packed by itself: a lot wastes at most
    one sequence that a common packing would fill, and no lot grows with the data, whatever repeats.
    """
    lots = max(1, -(-docs.count() // lot_pieces))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = rows.mapInArrow(cutter(tokenizer, end_id, capacity, lots), PIECES)
    return pieces.repartition("lot").sortWithinPartitions("lot", "doc_id", "piece").mapInArrow(packer(capacity), PACKED)
