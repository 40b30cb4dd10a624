"""Repeated byte runs across documents: pieces by anchor, shard transforms merged, every later occurrence removed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stillwell.llm.pieces import CHUNK, Cut
from stillwell.llm.shared import staged
from stillwell.llm.shingles import mixed
from stillwell.llm.suffixes import Shard, as_letters, interleaved

WINDOW = 100
#: Bytes of pieces merged at once (an anchor's pieces are never parted), and bytes of a shard.
UNIT = 1 << 17
SHARD = 1 << 16
#: An anchor of more pieces goes window by window instead, so the pieces merged at once are bounded.
CROWD = 4096
#: Rows without doc_id come after all others.
LAST = (1 << 63) - 1

PIECES = "anchor long, content long, doc long, place long, size int, again boolean"
STRINGS = "kind int, anchor long, content long, doc long, place long, size int, bytes binary"
SPANS = "doc long, place long, size int"
REPORT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def placed(docs: DataFrame) -> DataFrame:
    """(doc, edition, text) beside each row: the doc_id, a hash that tells its texts apart, and the text without null."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.shiftright(F.xxhash64(text), 32).alias("edition"),
                       F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))


def edition() -> F.Column:
    return F.shiftright("place", 32)


def chunks(batch: pa.RecordBatch, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts of a batch by the CHUNK: bytes, where each text ends, its row, and how far into its text it begins.

    A longer text comes in several chunks that share window - 1 bytes, so each of its windows is in one of them.
    """
    held: list[bytes] = []
    rows: list[int] = []
    begins: list[int] = []

    def put():
        limits = np.cumsum([len(t) for t in held])
        return np.frombuffer(b"".join(held), dtype=np.uint8), limits, np.array(rows), np.array(begins)

    total = 0
    for row, text in enumerate(batch["text"]):
        data = text.as_py().encode("utf-8", "replace")
        for at in range(0, max(len(data) - window + 1, 0), CHUNK):
            held.append(data[at:at + CHUNK + window - 1]), rows.append(row), begins.append(at)
            total += len(held[-1])
            if total >= CHUNK:
                yield put()
                held, rows, begins, total = [], [], [], 0
    if held:
        yield put()


def cutter(window: int):
    """Pieces of all texts. Of equal pieces of a chunk the first goes by its anchor; the others are repeats, and dealt evenly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, editions = (batch[c].to_numpy(zero_copy_only=False) for c in ("doc", "edition"))
            for chunk, limits, rows, begins in chunks(batch, window):
                cut = Cut(chunk, limits, window)
                if not len(cut.start):
                    continue
                text = np.searchsorted(limits, cut.start, side="right")
                start = cut.start - np.concatenate([[0], limits[:-1]])[text] + begins[text]
                doc, place = docs[rows[text]], (editions[rows[text]] << 32) + start
                order = np.lexsort((place, doc, cut.content, cut.anchor))
                anchor, content, doc, place, size = cut.anchor[order], cut.content[order], doc[order], place[order], cut.size[order]
                same = np.concatenate([[False], (anchor[1:] == anchor[:-1]) & (content[1:] == content[:-1])])
                # a row given twice is one text: its pieces are no repeats of each other
                heads = np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))
                same &= (doc != doc[heads]) | (place != place[heads])
                anchor = np.where(same, mixed(content ^ place.view(np.uint64)), anchor)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), pa.array(doc), pa.array(place), pa.array(size, pa.int32()), pa.array(same)],
                                                 ["anchor", "content", "doc", "place", "size", "again"])

    return run


def fetcher(window: int, crowd: int):
    """The bytes of wanted pieces (kind 1), or hashes of each of their windows where too many share an anchor (kind 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("kind", pa.int32()), ("anchor", pa.int64()), ("content", pa.int64()), ("doc", pa.int64()), ("place", pa.int64()), ("size", pa.int32()), ("bytes", pa.binary())])
        for batch in batches:
            out: list[tuple] = []
            held = 0
            for doc, edition_, text, wanted in zip(*(batch[c].to_pylist() for c in ("doc", "edition", "text", "wanted"))):
                data = text.encode("utf-8", "replace")
                for piece in wanted:
                    start, size = piece["place"] - (edition_ << 32), piece["size"]
                    if piece["sharers"] <= crowd:
                        out.append((1, piece["anchor"], 0, doc, piece["place"], size, data[start:start + size + window - 1]))
                        held += size + window
                        continue
                    for k in range(size):
                        one, two = np.frombuffer(hashlib.blake2b(data[start + k:start + k + window], digest_size=16).digest(), dtype=np.int64).tolist()
                        out.append((0, one, two, doc, piece["place"] + k, 1, None))
                        held += 100
                    if held > CHUNK:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                        out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return run


def later_windows(strings: list[bytes], docs: np.ndarray, places: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (doc, place, size) of the windows of some strings that one of them holds at an earlier doc or place.

    The strings are dealt to shards, each sorted by itself; their transforms are merged as far as a window reaches,
    and the windows of a repeated interval are those that did not part by then.
    """
    for stride in (s for s in (4, 2, 1) if window % s == 0):
        try:
            text, at = as_letters(strings, stride)
            break
        except OverflowError:
            continue
    sizes = np.fromiter(map(len, strings), dtype=np.int64, count=len(strings))
    starts = np.cumsum(sizes) - sizes
    # cut behind the last phase of a string, about every SHARD bytes
    last = np.flatnonzero(np.diff(starts // SHARD, append=-1))
    cuts = [0, *(np.flatnonzero(at < 0)[(last + 1) * stride - 1] + 1).tolist()]
    shards = [Shard(text[a:b]) for a, b in zip(cuts, cuts[1:])]
    entry, begins, _ = interleaved(shards, window // stride)
    many = ~begins | np.concatenate([~begins[1:], [False]])
    block = np.cumsum(begins)[many]
    where = at[np.concatenate([s.sa + a for s, a in zip(shards, cuts)])[entry[many]]]
    string = np.searchsorted(starts, where, side="right") - 1
    doc, place = docs[string], places[string] + where - starts[string]
    order = np.lexsort((place, doc, block))
    block, doc, place = block[order], doc[order], place[order]
    head = np.maximum.accumulate(np.where(np.concatenate([[True], block[1:] != block[:-1]]), np.arange(len(block)), 0))
    later = (doc != doc[head]) | (place != place[head])
    doc, place = doc[later], place[later]
    order = np.lexsort((place, doc))
    doc, place = doc[order], place[order]
    gap = (doc[1:] != doc[:-1]) | (place[1:] - place[:-1] > 1)
    first = np.flatnonzero(np.concatenate([[True], gap])) if len(doc) else np.zeros(0, dtype=np.int64)
    final = np.concatenate([first[1:] - 1, [len(doc) - 1]]) if len(doc) else first
    return doc[first], place[first], place[final] - place[first] + 1


def merger(window: int):
    """Spans of later windows of rows that come sorted by (kind, anchor, content, doc, place)."""

    def spans(doc, place, size) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(place, pa.int64()), pa.array(size, pa.int32())], ["doc", "place", "size"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        total, last, first = 0, None, None

        def put() -> pa.RecordBatch:
            docs, places = (np.array([h[k] for h in held], dtype=np.int64) for k in (0, 1))
            return spans(*later_windows([h[2] for h in held], docs, places, window))

        for batch in batches:
            windows: list[tuple[int, int, int]] = []
            for kind, anchor, content, doc, place, data in zip(*(batch[c].to_pylist() for c in ("kind", "anchor", "content", "doc", "place", "bytes"))):
                key = (kind, anchor, content)
                if kind == 0:
                    if key != last:
                        first = (doc, place)
                    elif (doc, place) != first:
                        windows.append((doc, place, 1))
                    last = key
                    continue
                if key != last and total >= UNIT:
                    yield put()
                    held, total = [], 0
                held.append((doc, place, data))
                total += len(data)
                last = key
            if windows:
                yield spans(*zip(*windows))
        if held:
            yield put()

    return run


def removed_spans(docs: DataFrame, window: int = WINDOW, crowd: int = CROWD) -> DataFrame:
    """(doc, place, size): runs of windows of ``placed`` rows that start earlier elsewhere; place is edition * 2**32 + start.

    A piece whose bytes occur earlier is one run. Of the first occurrences, those whose anchor other pieces share are
    compared by merging transforms; the rest hold no window that occurs twice.
    """
    source = placed(docs)
    pieces = source.select("doc", "edition", "text").mapInArrow(cutter(window), PIECES).repartition("anchor")
    of_piece, of_anchor = Window.partitionBy("anchor", "content"), Window.partitionBy("anchor")
    spot = F.struct("doc", "place")
    seen = pieces.select("*", F.min(spot).over(of_piece).alias("first"), F.min("content").over(of_anchor).alias("low"),
                         F.max("content").over(of_anchor).alias("high"), F.count(F.lit(1)).over(of_anchor).cast("int").alias("sharers"))
    repeat = F.col("again") | (spot != F.col("first"))
    seen = seen.select("doc", "place", "size", "anchor", "sharers", repeat.alias("repeat"), (~repeat & (F.col("low") != F.col("high"))).alias("shared"))
    found = staged(seen.filter("repeat OR shared"))
    wanted = found.filter("shared").groupBy("doc", edition().alias("edition")).agg(F.collect_set(F.struct("place", "size", "anchor", "sharers")).alias("wanted"))
    texts = source.select("doc", "edition", "text").join(wanted.hint("shuffle_hash"), ["doc", "edition"])
    strings = texts.mapInArrow(fetcher(window, crowd), STRINGS).repartition("kind", "anchor", "content")
    merged = strings.sortWithinPartitions("kind", "anchor", "content", "doc", "place").mapInArrow(merger(window), SPANS)
    return found.filter("repeat").select("doc", "place", "size").union(merged)


def covered(spans: list, edition_: int, window: int) -> list[tuple[int, int]]:
    """The bytes under the windows of some spans as disjoint runs, in order."""
    out: list[tuple[int, int]] = []
    for place, size in sorted((s["place"] - (edition_ << 32), s["size"]) for s in spans or ()):
        end = place + size + window - 1
        if out and place <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((place, end))
    return out


def left_over(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    edges = [0, *(e for run in runs for e in run), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))


def reporter(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for edition_, text, spans in zip(batch["edition"].to_pylist(), batch["text"], batch["spans"].to_pylist()):
                data = text.as_py().encode("utf-8", "replace")
                runs = covered(spans, edition_, window)
                rows.append((len(data), sum(b - a for a, b in runs), len(runs), hashlib.sha256(left_over(data, runs)).hexdigest()))
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string())],
                                             ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def with_spans(rows: DataFrame, docs: DataFrame, window: int, crowd: int) -> DataFrame:
    """``rows`` (doc, edition and others) with the spans of each."""
    spans = removed_spans(docs, window, crowd).groupBy("doc", edition().alias("edition")).agg(F.collect_list(F.struct("place", "size")).alias("spans"))
    return rows.join(spans.hint("shuffle_hash"), ["doc", "edition"], "left")


def repeat_report(docs: DataFrame, window: int = WINDOW, crowd: int = CROWD) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A text counts as its UTF-8 bytes, null as none. A byte goes when a string of ``window`` bytes that covers it also
    starts earlier: in a document with a smaller doc_id, or earlier in its own. Strings are judged on the input, may
    overlap, and never cross documents; texts shorter than ``window`` keep all. Rows without doc_id come last. Rows of
    one doc_id with different texts are ordered by a hash of the text; equal rows are one document, and each gets its
    result. Long texts are cut by the chunk. Other columns are ignored; an empty table gives no rows.
    """
    rows = with_spans(placed(docs), docs, window, crowd)
    return rows.select("doc_id", "edition", "text", "spans").mapInArrow(reporter(window), REPORT)


def drop_repeats(docs: DataFrame, window: int = WINDOW, crowd: int = CROWD) -> DataFrame:
    """``docs`` without the repeated bytes of their texts, as ``repeat_report`` counts them.

    Texts that lose nothing, null ones too, are passed on as they are; bytes that a cut leaves as part of a letter go.
    """
    @F.udf("string", useArrow=True)
    def kept(text, edition_, spans):
        if spans is None:
            return text
        return left_over(text.encode("utf-8", "replace"), covered(spans, edition_, window)).decode("utf-8", "ignore")

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keys = [F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.shiftright(F.xxhash64(text), 32).alias("edition")]
    rows = with_spans(docs.select(F.struct(*docs.columns).alias("row"), *keys), docs, window, crowd)
    return rows.withColumn("row", F.col("row").withField("text", kept("row.text", "edition", "spans"))).select("row.*")
