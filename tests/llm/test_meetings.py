"""Pairs of lines that share buckets against all pairs, edit tests side by side, and what a search leaves on disk."""

from __future__ import annotations

import random
from itertools import count

import numpy as np
import pyarrow as pa
import pytest

from stillwell.llm import line_dedup, meetings, minhash, shared
from stillwell.llm.anchors import line_keys
from stillwell.llm.edits import within, within_each


def family(rng, size, versions):
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(size)]
    for _ in range(versions):
        line = list(" ".join(words))
        for _ in range(rng.randint(0, len(line) // 12)):
            line[rng.randrange(len(line))] = rng.choice("abcdefgh")
        yield "".join(line)


def members(lines, nodes, keys):
    """Rows of ``shared`` over two packed halves, with signs, sorted by unit."""
    slices = {}
    for half in (slice(0, None, 2), slice(1, None, 2)):
        for s, entries in meetings.packed(keys[half], nodes[half], 3):
            slices.setdefault(s, []).append(entries)
    rows = [(s, e) for s in sorted(slices) for e in slices[s]]
    batch = pa.RecordBatch.from_pydict({"slice": [s for s, _ in rows], "entries": [e for _, e in rows]})
    table = pa.Table.from_batches(meetings.shared(iter([batch])))
    marks = meetings.signs(lines, line_keys(lines)[1])
    at = {n: k for k, n in enumerate(nodes.tolist())}
    table = table.append_column("signs", pa.array([marks[at[n]].tobytes() for n in table["node"].to_pylist()], pa.binary()))
    return table.sort_by([(c, "ascending") for c in ("bucket", "block_a", "block_b")])


def groups(pairs):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[root(a)] = root(b)
    return {frozenset(y for y in parent if root(y) == root(x)) for x in parent}


def pairs_of(batches):
    rows = [r for b in batches for r in b.to_pylist()]
    return [(r["a"], r["b"], r["tree"]) for r in rows if r["bucket"] is None], [r for r in rows if r["bucket"] is not None]


@pytest.mark.parametrize("block, small, spare", [(2048, 64, 100), (16, 4, 100), (7, 3, 0)])
def test_pairs_are_all_that_the_bounds_allow(monkeypatch, block, small, spare):
    """Buckets are cut into blocks and batches anywhere; no pair is lost, and the trees connect what all pairs connect."""
    for name, value in {"BLOCK": block, "SMALL": small, "SPARE": spare, "ROWS_AT_ONCE": 50}.items():
        monkeypatch.setattr(meetings, name, value)
    rng = random.Random(block)
    lines = list(dict.fromkeys(x for size, versions in ((12, 40), (30, 25), (50, 9), (20, 2), (25, 1)) for x in family(rng, size, versions)))
    nodes = np.arange(len(lines)) * 1_000_003 - 7
    keys, bits = line_keys(lines)
    near = set()
    for i in range(len(lines)):
        for j in range(i):
            apart = int(np.bitwise_count((bits[i] ^ bits[j]).view(np.uint64)).sum())
            allowed = max(len(lines[i]), len(lines[j])) // 10
            more = [max(0, lines[x].count(c) - lines[y].count(c)) for x, y in ((i, j), (j, i)) for c in "abcdefgh "]
            if set(keys[i].tolist()) & set(keys[j].tolist()) and apart <= 48 and abs(len(lines[i]) - len(lines[j])) <= allowed and max(sum(more[:9]), sum(more[9:])) <= allowed:
                near.add((min(nodes[i], nodes[j]), max(nodes[i], nodes[j])))
    assert len(near) > 300
    table = members(lines, nodes, keys)
    found, dense = pairs_of(meetings.likely_pairs(48, 90)(iter(table.to_batches(max_chunksize=13))))
    assert {p[:2] for p in found} <= near and groups(p[:2] for p in found if p[2]) == groups(near)
    assert dense or {p[:2] for p in found} == near
    assert bool(dense) == (spare == 0)
    own = table.append_column("component", table["node"])
    every, _ = pairs_of(meetings.cross_pairs(48, 90, None)(iter(own.to_batches(max_chunksize=29))))
    assert {p[:2] for p in every} == near
    one = own.set_column(own.column_names.index("component"), "component", pa.array([0] * len(own), pa.int64()))
    assert not pairs_of(meetings.cross_pairs(48, 90, 4)(iter(one.to_batches())))[0]
    few, _ = pairs_of(meetings.cross_pairs(48, 90, 1)(iter(own.to_batches())))
    assert {p[:2] for p in few} == near


def test_within_each_is_within():
    rng = random.Random(3)
    ones, twos, limits = [], [], []
    for _ in range(1500):
        one = "".join(rng.choice("abcdef é\U0001F600") for _ in range(rng.choice([0, 1, 9, 31, 64, 65, 200, 330, 700])))
        two = list(one)
        for _ in range(rng.randint(0, 1 + len(one) // 7)):
            at = rng.randint(0, len(two))
            two[at:at + rng.randint(0, 2)] = rng.choice(["", "x", "é", "ab"])
        ones.append(one), twos.append("".join(two)), limits.append(rng.choice([len(one) // 10, rng.randint(0, 40)]))
    assert within_each(ones, twos, limits).tolist() == [within(*x) for x in zip(ones, twos, limits)]
    assert within_each([], [], []).tolist() == []


def test_a_search_leaves_only_what_its_result_reads(spark, tmp_path, monkeypatch):
    made = count()
    monkeypatch.setattr(shared, "shared_folder", lambda _: f"file://{tmp_path}/{next(made)}")
    rng = random.Random(9)
    docs = spark.createDataFrame([(k, "\n".join(family(rng, 20, 3))) for k in range(20)], "doc_id long, text string")
    lines = line_dedup.repeated_lines(docs, search="letters")
    left = sorted(p.name for p in tmp_path.iterdir())
    assert next(made) > 8 and len(left) == 2
    assert lines.count() == 60 and lines.filter("NOT kept").count() > 0


def test_a_search_for_near_copies_leaves_only_what_its_result_reads(spark, tmp_path, monkeypatch):
    made = count()
    monkeypatch.setattr(shared, "shared_folder", lambda _: f"file://{tmp_path}/{next(made)}")
    rng = random.Random(8)
    texts = [x for _ in range(8) for x in family(rng, 60, 1) for x in (x, x + " end")]
    found = minhash.near_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    left = list(tmp_path.iterdir())
    assert next(made) > 4 and len(left) == 2
    assert {r.doc_id: r.component_id for r in found.collect()} == {k: k - k % 2 for k in range(16)}
