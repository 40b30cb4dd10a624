"""Exact dedup, archives, tokens, token files, packing and chunk reuse against plain versions."""

import hashlib
import io
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stillwell.llm import chunk_bpe, token_files, warc
from stillwell.llm.exact_dedup import Trie, exact_groups, owners
from stillwell.llm.packing import best_two_fit, pack_documents
from stillwell.llm.shared import hot_join, shared_folder
from stillwell.llm.tokens import BYTE_PIECES, WORD_PIECES, encoder

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LONG = "the quick brown fox, jumps over. " * 6000
TEXTS = ["", None, "a", "a b", "a\t\n b", "a b ", "Été́ ça va? ÊTRE!! İstanbul ΣΑΣ", "x  y z \x1c\x85", "<|endoftext|> in <|startoftext|> text",
         "don't we'll 's", "日本語 текст 🙂🙂 ²½", "word" * 3000, LONG, "a b"]
MIXED = st.text(st.sampled_from("ab Zé\n\t.,!'<|>endoftx5²́ 日\x1c🙂"), max_size=80)


def frame(spark, texts, ids=None, **extra):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, *(v[k] for v in extra.values())) for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, "doc_id long, text string" + "".join(f", {n} string" for n in extra))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=6), st.integers(0, 99))))
def test_trie_holds_strings_counts_and_smallest_ids(rows):
    trie, plain = Trie(), defaultdict(list)
    for data, i in rows:
        trie.insert(data, i, 1, i)
        plain[data].append(i)
    assert {d: (n.owner, n.count, sorted(n.members)) for d, n in trie.terminals()} == {d: (min(v), len(v), sorted(v)) for d, v in plain.items()}
    while trie.root.kids:
        for _ in trie.cut(trie.heaviest()):
            pass
    assert trie.held <= 40 * len(plain[b""])


def test_spilled_subtrees_are_merged():
    import pyarrow as pa
    bodies = [bytes([65 + k % 7]) + b"x" * 300 + bytes([k % 5]) for k in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array(bodies), pa.array(range(200)), pa.array([1] * 200), pa.array(range(200))], ["body", "owner", "copies", "token"])
    found = {r["token"]: (r["keep_id"], r["group_size"]) for out in owners(2000)(iter([batch])) for r in out.to_pylist()}
    groups = defaultdict(list)
    for i, b in enumerate(bodies):
        groups[b].append(i)
    assert found == {i: (v[0], len(v)) for v in groups.values() for i in v}


@pytest.mark.parametrize("memory", [500, 1 << 28])
def test_exact_groups_against_plain_grouping(spark, memory):
    import re
    ids = [9, 8, 7, 6, 5, 4, 3, None, 1, 0, 12, 11, 13, 14]
    texts = TEXTS[:12] + ["same  text", "same\ttext"]
    got = exact_groups(frame(spark, texts + ["same text"] * 40, ids + [100 + k % 20 for k in range(40)], kept=["z"] * 54), memory).collect()
    plain = defaultdict(list)
    for i, t in zip(ids + [100 + k % 20 for k in range(40)], texts + ["same text"] * 40):
        plain[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    want = []
    for t, members in plain.items():
        keep = min((m for m in members if m is not None), default=None)
        want += [(m, keep, len(members), m == keep, hashlib.sha256(t.encode()).hexdigest()) for m in members]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_exact_groups_of_nothing(spark):
    assert exact_groups(frame(spark, [])).collect() == []


def test_hot_join_matches_plain_join(spark):
    left = spark.createDataFrame([(1 if k % 3 else k, k) for k in range(3000)], "key long, v long")
    right = left.groupBy("key").count().withColumnRenamed("count", "n").filter("key % 2 = 1")
    from pyspark.sql import functions as F
    for how in ("left", "inner"):
        got = hot_join(left, right, ["key"], "n", 3000, F.col("v"), how)
        assert sorted(map(str, got.collect())) == sorted(map(str, left.join(right, "key", how).select("key", "v", "n").collect()))


def test_archives_round_trip(spark):
    big, small = "é" * 700, "tiny"
    rows = [(1, "http://a/ü x", big, "s"), (2, None, big, "s"), (3, "u", big, None), (4, "u\r\nX: y", small, "s"), (5, "u", small, "s"), (6, "u", None, "s"), (7, "u", "", "s"), (None, "u", big, "s"), (8, "u", "\r\n\r\nWARC/1.1\r\n" * 90, "s"), (8, "u", "\r\n\r\nWARC/1.1\r\n" * 90, "s")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string")
    got = sorted(map(tuple, warc.archived(pages).collect()), key=str)
    want = []
    for i, _, html, _ in rows:
        data = (html or "").encode()
        last = max(p for p, _, h, _ in rows if h == html and p is not None) if len(data) >= 1000 else i
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "response" if i == last else "revisit", None if i == last else last))
    assert got == sorted(want, key=str)
    assert warc.archived(pages.limit(0)).collect() == []


def test_archive_starts_with_its_dictionary(tmp_path):
    from pyarrow import fs
    records = [f"record {k} with much common text in it, again and again".encode() * 20 for k in range(300)]
    archive = warc.Archive(fs.LocalFileSystem(), str(tmp_path / "a.zst"), records, 2048, 3)
    for r in records:
        archive.add(r)
    archive.file.close()
    data = (tmp_path / "a.zst").read_bytes()
    assert int.from_bytes(data[:4], "little") == warc.SKIPPABLE
    size = int.from_bytes(data[4:8], "little")
    # a frame alone can be read with the dictionary
    rest = io.BytesIO(data[8 + size:])
    codec = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8:8 + size]))
    assert codec.stream_reader(rest, read_across_frames=True).read() == b"".join(records)


def library(path, texts):
    tokenizer = Tokenizer.from_file(path)
    return [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("path, pieces", [(BYTES, BYTE_PIECES), (WORDS, WORD_PIECES)])
def test_pieces_encode_as_the_library(path, pieces):
    encode = encoder(path, pieces, limit=50)
    assert [np.frombuffer(encode.encode(t), dtype="<u4").tolist() for t in TEXTS] == library(path, TEXTS)


@settings(max_examples=300, deadline=None)
@given(MIXED)
def test_pieces_and_chunks_encode_any_text_as_the_library(text):
    for path, pieces in ((BYTES, BYTE_PIECES), (WORDS, WORD_PIECES)):
        assert np.frombuffer(encoder(path, pieces).encode(text), dtype="<u4").tolist() == library(path, [text])[0]
    assert chunk_bpe.coder(BYTES)[0].encode(text) == encoder(BYTES, BYTE_PIECES).whole(text)


@settings(max_examples=40, deadline=None)
@given(st.lists(MIXED, min_size=1, max_size=4), st.integers(1, 60), st.integers(1, 5))
def test_chunks_meet_exactly_wherever_they_are_cut(parts, times, bits):
    text = "".join(p * times for p in parts)
    pieces = chunk_bpe.chunks(text, bits, least=4, most=40)
    assert "".join(pieces) == text and all(len(p.encode()) <= 40 for p in pieces)
    coder = chunk_bpe.ChunkEncoder(BYTES, 10)
    assert coder.encode(text) == coder.pieces.whole(text)


def test_shared_chunks_are_encoded_once():
    coder = chunk_bpe.ChunkEncoder(BYTES, 1000)
    rng = np.random.default_rng(3)
    passage = " ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(900))
    coder.encode("One start. " + passage)
    first = coder.encoded
    coder.encode("Another beginning of it, longer! " + passage)
    assert coder.encoded - first < 4 < coder.reused


def test_chunk_round_trip(spark):
    got = {r.doc_id: r for r in chunk_bpe.round_trip(frame(spark, TEXTS, decoded_sha256=TEXTS), BYTES).collect()}
    decode = Tokenizer.from_file(BYTES).decode
    for i, ids in enumerate(library(BYTES, TEXTS)):
        assert got[i][1:] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert chunk_bpe.round_trip(frame(spark, []), BYTES).collect() == []
    coded = chunk_bpe.decode_column(chunk_bpe.encode_column(frame(spark, TEXTS), BYTES), BYTES).collect()
    assert {r.doc_id: r.decoded for r in coded} == {i: t or "" for i, t in enumerate(TEXTS)}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([0, 1, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1]), max_size=40))
def test_rank_code_round_trip(values):
    ranks = np.array(values, dtype=np.uint32)
    control, data = token_files.encode_ranks(ranks)
    assert len(control) == -(-len(values) // 4) and token_files.decode_ranks(control, data, len(values)).tolist() == values


def test_token_file_ranks_by_count():
    ids = np.array([7] * 5 + [300] * 9 + [2] * 5, dtype="<u4")
    raw = token_files.pack_file([1, None], [10, 9], ids)
    docs, lengths, back = token_files.unpack_file(io.BytesIO(raw))
    assert docs == [1, None] and lengths.tolist() == [10, 9] and back.tolist() == ids.tolist()
    assert np.frombuffer(raw[token_files.HEAD.size:], dtype="<u4", count=3).tolist() == [300, 2, 7]


def test_token_files_round_trip(spark):
    ids = [5, 3, 9, 1, 0, 2, 4, 6, 7, 8, 10, 11, 12, 13]
    docs = frame(spark, TEXTS, ids, start=TEXTS).repartition(5)
    folder = shared_folder(spark)
    manifest = token_files.write_token_files(docs, folder, BYTES, file_ids=100)
    got = {r.doc_id: r[1:] for r in token_files.read_token_files(manifest, folder).collect()}
    start = 0
    for i, coded in sorted(zip(ids, library(BYTES, TEXTS))):
        raw = np.array([*coded, 2], dtype="<u4")
        assert got[i] == (start, len(raw), zlib.crc32(raw.tobytes()))
        start += len(raw)
    assert manifest.count() >= 3
    assert token_files.round_trip(frame(spark, []), BYTES).collect() == []
    assert len(token_files.round_trip(frame(spark, ["a", "b", "b"], [None, 1, 1]), BYTES).collect()) == 3


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_best_two_fit_packs_everything_once(lengths):
    bins = best_two_fit(lengths, 40)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 40 for b in bins)
    # no two bins could be one
    fills = sorted(sum(lengths[i] for i in b) for b in bins)
    assert len(fills) < 2 or fills[0] + fills[1] > 40


def test_best_two_fit_replaces_the_smallest():
    # 6 then 3 leaves a gap of 1; the 3 gives way to 2 and 2
    assert sorted(sorted([6, 3, 2, 2][i] for i in b) for b in best_two_fit([6, 3, 2, 2], 10)) == [[2, 2, 6], [3]]


def test_packing_covers_whole_documents(spark):
    ids = [3, None, 3, *range(10, 10 + len(TEXTS) - 3)]
    rows = pack_documents(frame(spark, TEXTS, ids, offset=TEXTS), WORDS, capacity=64, lot_pieces=5).collect()
    want = defaultdict(list)
    for i, coded in zip(ids, library(WORDS, TEXTS)):
        coded = np.array([*coded, 1], dtype="<u4")
        for k, at in enumerate(range(0, len(coded), 64)):
            want[i].append((k, at, len(coded[at:at + 64]), zlib.crc32(coded[at:at + 64].tobytes())))
    got, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        got[r.doc_id].append(tuple(r)[1:5])
        bins[r.sequence_id].append((r.offset, r.length))
    assert {i: sorted(v) for i, v in got.items()} == {i: sorted(v) for i, v in want.items()}
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert pack_documents(frame(spark, []), WORDS).collect() == []
