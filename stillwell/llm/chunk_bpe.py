"""Byte-pair encoding with content-defined chunk reuse, and decoding."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stillwell.llm.tokens import BYTE_PIECES, UNUSUAL, PieceEncoder, byte_letters, encoder

CODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

WINDOW = 16
BLOCK = 1 << 17
MULTIPLIER = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def powers() -> list[np.ndarray]:
    """The multiplier's powers and those of its inverse, modulo 2**64."""
    if not _POWERS:
        for base in (MULTIPLIER, pow(MULTIPLIER, -1, 1 << 64)):
            values = np.full(BLOCK + WINDOW, base, dtype=np.uint64)
            values[0] = 1
            _POWERS.append(np.multiply.accumulate(values))
    return _POWERS


def rolling_cuts(data: bytes, bits: int) -> np.ndarray:
    """Places after which a rolling hash of the last WINDOW bytes has ``bits`` leading zeros and a character ends."""
    up, down = powers()
    raw = np.frombuffer(data, dtype=np.uint8)
    found = []
    for first in range(0, len(raw), BLOCK):
        low = max(0, first - WINDOW)
        part = raw[low:first + BLOCK].astype(np.uint64) + np.uint64(1)
        sums = np.cumsum(part * up[:len(part)])
        if len(sums) > WINDOW:
            sums[WINDOW:] -= sums[:-WINDOW].copy()
        cuts = np.flatnonzero((sums * down[:len(sums)]) >> np.uint64(64 - bits) == 0) + low + 1
        found.append(cuts[cuts > first])
    cuts = np.concatenate(found) if found else np.zeros(0, dtype=np.int64)
    cuts = cuts[cuts < len(raw)]
    return cuts[raw[cuts] & 0xC0 != 0x80]


def chunks(text: str, bits: int = 9, least: int = 64, most: int = 4096) -> list[str]:
    """Cut ``text`` where its content says so; chunks are ``least`` to ``most`` bytes but for the last."""
    data = text.encode("utf-8", "surrogatepass")
    out, start = [], 0
    for cut in [*rolling_cuts(data, bits).tolist(), len(data)]:
        while cut - start > most:
            end = start + most
            while data[end] & 0xC0 == 0x80:
                end -= 1
            out.append(data[start:end])
            start = end
        if cut - start >= least or cut == len(data):
            out.append(data[start:cut])
            start = cut
    return [c.decode("utf-8", "surrogatepass") for c in out if c]


class Coded:
    """An encoded chunk: its ids without the outer two pieces on each side, and those pieces."""

    __slots__ = ("head", "head_ids", "middle", "tail", "tail_ids")

    def __init__(self, pieces: list[str], encode: PieceEncoder):
        self.head, self.head_ids = pieces[0] + pieces[1], encode[pieces[1]]
        self.middle = b"".join(map(encode.__getitem__, pieces[2:-2]))
        self.tail, self.tail_ids = pieces[-2] + pieces[-1], encode[pieces[-2]]


class ChunkEncoder:
    """Encodes whole texts from chunks met before by this worker; each chunk is encoded the first time only.

    A chunk's first and last piece may have been cut anywhere. At a join the last two pieces of the left and the
    first two of the right are encoded together; the join is exact when that agrees with both chunks on the pieces
    that no cut touched. If it does not, or a chunk has no such pieces, the window takes in the whole chunk.
    Encoded chunks are remembered in two generations of at most ``limit``.
    """

    def __init__(self, path: str, limit: int):
        self.pieces, self.limit = encoder(path, BYTE_PIECES), limit
        self.newer: dict[str, Coded | None] = {}
        self.older: dict[str, Coded | None] = {}
        self.encoded = self.reused = 0

    def chunk(self, text: str) -> Coded | None:
        found = self.newer.get(text, False)
        if found is False:
            found = self.older.get(text, False)
            if found is False:
                pieces = BYTE_PIECES.findall(text)
                found = Coded(pieces, self.pieces) if len(pieces) > 4 else None
                self.encoded += 1
            else:
                self.reused += 1
            if len(self.newer) >= self.limit:
                self.older, self.newer = self.newer, {}
            self.newer[text] = found
        else:
            self.reused += 1
        return found

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if UNUSUAL.search(text):
            return self.pieces.whole(text)
        out, window, agreed = [], "", b""
        for text_ in chunks(text):
            coded = self.chunk(text_)
            joined = None if coded is None else self.pieces.encode(window + coded.head)
            if joined is None or not (joined.startswith(agreed) and joined.endswith(coded.head_ids)):
                window += text_
                continue
            out += (joined, coded.middle)
            window, agreed = coded.tail, coded.tail_ids
        last = self.pieces.encode(window)
        if not last.startswith(agreed):
            return self.pieces.whole(text)
        return b"".join([*out, last])


def token_bytes(path: str) -> list[bytes]:
    """The bytes that each id stands for, by the letters of byte-level vocabularies."""
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(path)
    alphabet = {c: b for b, c in byte_letters().items()}
    table = []
    for i in range(tokenizer.get_vocab_size(with_added_tokens=True)):
        token = tokenizer.id_to_token(i) or ""
        table.append(bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode())
    return table


_CODERS: dict[tuple, tuple[ChunkEncoder, list[bytes]]] = {}


def coder(path: str, limit: int = 20_000) -> tuple[ChunkEncoder, list[bytes]]:
    """This worker's encoder and decoding table."""
    if (path, limit) not in _CODERS:
        _CODERS[path, limit] = ChunkEncoder(path, limit), token_bytes(path)
    return _CODERS[path, limit]


def decode(ids: bytes, table: list[bytes]) -> str:
    return b"".join(map(table.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


def encode_column(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``docs`` (doc_id, text) with ``ids``, the little-endian 32-bit ids of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = coder(tokenizer)[0].encode
        for batch in batches:
            ids = pa.array([encode(t.as_py()) for t in batch["text"]], pa.binary())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text"], ids], ["doc_id", "text", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, text string, ids binary")


def decode_column(coded: DataFrame, tokenizer: str) -> DataFrame:
    """``coded`` (doc_id, ids) with ``decoded``, the text of the ids, special tokens included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = coder(tokenizer)[1]
        for batch in batches:
            texts = pa.array([None if i is None else decode(i, table) for i in batch["ids"].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["ids"], texts], ["doc_id", "ids", "decoded"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded string")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Encode and decode every whole text in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256.

    A null or empty text has no ids. Every row gives a row, repeated rows and null ids too; other columns are
    ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunked, table = coder(tokenizer)
        for batch in batches:
            counts, sums, texts = [], [], []
            for text in batch["text"]:
                ids = chunked.encode(text.as_py())
                counts.append(len(ids) // 4)
                sums.append(hashlib.sha256(ids).hexdigest())
                texts.append(hashlib.sha256(decode(ids, table).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(counts, pa.int64()), pa.array(sums, pa.string()), pa.array(texts, pa.string())],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, CODED)
