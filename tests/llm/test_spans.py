"""Repeated runs of bytes: the merge of transforms and the whole operator against plain versions."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from stillwell.llm import pieces
from stillwell.llm.span_dedup import drop_repeats, later_windows, repeat_report
from stillwell.llm.suffixes import Shard, as_letters, interleaved


@pytest.mark.parametrize("seed", range(40))
def test_merged_transforms_are_the_order_of_all_suffixes(seed):
    rng = np.random.default_rng(seed)
    stride, depth = int(rng.integers(1, 4)), int(rng.integers(1, 6))
    shards = [[bytes(rng.integers(97, 99, rng.integers(0, 14)).tolist()) for _ in range(rng.integers(1, 4))] for _ in range(rng.integers(1, 5))]
    text, _ = as_letters([s for shard in shards for s in shard], stride)
    ends = np.flatnonzero(text == 0)
    cuts = [0, *(int(ends[c - 1]) + 1 for c in np.cumsum([len(s) * stride for s in shards]))]
    built = [Shard(text[a:b]) for a, b in zip(cuts, cuts[1:])]
    entry, begins, prefix = interleaved(built, depth)

    def suffix(p):
        end = p + int(np.flatnonzero(text[p:] == 0)[0])
        return tuple(text[p:end].tolist())

    own = [suffix(p) for p in np.concatenate([s.sa + a for s, a in zip(built, cuts)])]
    ordered = [own[e] for e in entry]
    assert [o[:depth] for o in ordered] == sorted(o[:depth] for o in own)
    for j in range(1, len(ordered)):
        shared = next((k for k in range(depth) if ordered[j][k:k + 1] != ordered[j - 1][k:k + 1] or len(ordered[j]) <= k), depth)
        assert prefix[j] == shared and begins[j] == (shared < depth)


def plain(rows, window):
    """Every window of every text, in order of (doc, text), looked up in a set of the earlier ones."""
    first, out = {}, []
    texts = sorted({(i is None, i, (t or "").encode()) for i, t in rows}, key=lambda r: (r[0], r[1] or 0))
    for _, i, data in texts:
        for k in range(len(data) - window + 1):
            first.setdefault(data[k:k + window], (i, data, k))
    for i, t in rows:
        data = (t or "").encode()
        gone = np.zeros(len(data), dtype=bool)
        for k in range(len(data) - window + 1):
            if first[data[k:k + window]] != (i, data, k):
                gone[k:k + window] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((i, len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def texts(seed, count=60):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdefghij é")) for _ in range(rng.integers(2, 9))) for _ in range(400)]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    shared = [prose(30) for _ in range(6)] + ["ab" * 150, "x" * 260]
    out = []
    for _ in range(count):
        parts = [prose(int(rng.integers(0, 60))) for _ in range(rng.integers(1, 4))]
        for _ in range(rng.integers(0, 3)):
            s = shared[rng.integers(len(shared))]
            parts.insert(int(rng.integers(len(parts) + 1)), s[int(rng.integers(20)):])
        out.append(" ".join(parts))
    return out + out[:8] + ["", None, "short", prose(20)[:99], prose(40)[:100]]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 3, 4, "p") for i, t in rows], "doc_id long, text string, doc int, edition int, place string")


@pytest.mark.parametrize("seed, window, crowd", [(1, 100, 4096), (2, 100, 2), (3, 36, 4096), (4, 35, 8)])
def test_report_against_every_window(spark, seed, window, crowd):
    rows = list(enumerate(texts(seed)))[::-1]
    rows = rows + rows[:5] + [(None, "x" * 150)]
    got = repeat_report(frame(spark, rows).repartition(5), window, crowd).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows, window)


def test_long_texts_are_cut_and_still_compared(spark, monkeypatch):
    monkeypatch.setattr(pieces, "CHUNK", 1 << 20)
    rng = np.random.default_rng(9)
    long = "".join(rng.choice(list("abcdefghijklmnop"), (1 << 20) + 5000))
    rows = [(2, long), (1, long[(1 << 20) - 300:(1 << 20) + 900]), (3, long[500:1500] + "é" + long[-400:])]
    got = sorted(map(tuple, repeat_report(frame(spark, rows)).collect()))
    assert [r[2:4] for r in got] == [(0, 0), (1200, 1), (1400, 2)]
    assert got == plain(rows, 100)


def test_one_doc_id_with_several_texts(spark):
    body = texts(5)[0] * 3
    got = repeat_report(frame(spark, [(1, body), (1, body + " end"), (2, body)])).collect()
    by = sorted((r["doc_id"], r["n_bytes"] - r["n_removed"]) for r in got)
    assert by[-1] == (2, 0) and sorted(k for i, k in by if i == 1)[0] < 100


def test_nothing_and_short_texts(spark):
    assert repeat_report(frame(spark, [])).collect() == []
    assert [tuple(r)[1:4] for r in repeat_report(frame(spark, [(1, "a" * 99), (2, "a" * 99)])).collect()] == [(99, 0, 0)] * 2


def test_texts_without_their_repeats(spark):
    body = "".join(chr(97 + k * 7 % 26) + str(k) for k in range(60))
    got = {r["doc_id"]: tuple(r)[1:] for r in drop_repeats(frame(spark, [(1, body), (2, "é" + body + "é"), (3, None)])).collect()}
    assert got == {1: (body, 3, 4, "p"), 2: ("éé", 3, 4, "p"), 3: (None, 3, 4, "p")}


def test_units_of_many_shards():
    rng = np.random.default_rng(2)
    strings = [bytes(rng.integers(97, 101, 4000).tolist()) for _ in range(60)] + [b"q" * 130, b"q" * 130]
    strings[40] = strings[3][100:700] + strings[40]
    docs, places = np.arange(62), np.zeros(62, dtype=np.int64)
    got = sorted(zip(*(v.tolist() for v in later_windows(strings, docs, places, 100))))
    assert got == [(40, 0, 501), (60, 1, 30), (61, 0, 31)]
