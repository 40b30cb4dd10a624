"""Sketches refuse no pair that reaches the similarity, and refuse most pairs far below it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from stillwell.llm import minhash
from stillwell.llm.linkage import bucket_links


def verdicts(spark, pairs):
    rows = [tuple([int(v) for v in minhash.bit_planes(*minhash.min_max(s))] for s in pair) for pair in pairs]
    both = spark.createDataFrame(rows, "one array<long>, two array<long>")
    return [r[0] for r in both.select(minhash.alike(F.col("one"), F.col("two"))).collect()]


def pairs_at(rng, similarity, count, sizes):
    for _ in range(count):
        size = int(rng.choice(sizes))
        shared = int(np.ceil(similarity * size))
        rest = size - shared
        values = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        cut = int(rng.integers(0, rest + 1))
        yield np.unique(values[:shared + cut]), np.unique(np.concatenate([values[:shared], values[shared + cut:]]))


def test_linked_pairs_are_alike_at_every_size(spark):
    rng = np.random.default_rng(75)
    assert all(verdicts(spark, pairs_at(rng, 0.75, 2000, [1, 2, 3, 4, 5, 8, 20, 100, 400, 3000])))


def test_far_pairs_are_not_alike(spark):
    assert np.mean(verdicts(spark, pairs_at(np.random.default_rng(5), 0.4, 300, [50, 400]))) < 0.05


def test_no_pair_is_verified_twice(spark):
    """Twenty nodes share thirty buckets and nothing links: each pair is looked at once."""
    seen = []

    def verify(pairs):
        seen.extend(map(tuple, pairs.collect()))
        return pairs.filter("false")

    members = spark.createDataFrame([(b, n) for b in range(30) for n in range(20) if (n + b) % 7], "bucket long, node long")
    bucket_links(members, verify)
    assert sorted(seen) == sorted({(a, b) for a in range(20) for b in range(a + 1, 20)})


def families(rng):
    """Two texts of 80 words, 24 edited copies of each, and texts that share one long passage: word lists by doc_id."""
    words = [f"w{i}" for i in range(400)]
    passage = list(rng.choice(words, 60))
    texts = []
    for _ in range(2):
        source = list(rng.choice(words, 80))
        for _ in range(25):
            copy = list(source)
            for place in rng.choice(80, int(rng.integers(0, 6)), replace=False):
                copy[place] = str(rng.choice(words))
            texts.append(copy)
    texts += [passage + list(rng.choice(words, int(rng.integers(5, 40)))) for _ in range(25)]
    return texts


def test_families_keep_every_link(spark):
    """Groups of families with links close to the similarity on both sides are those of all pairs."""
    rng = np.random.default_rng(11)
    texts = [" ".join(t) for t in families(rng)]
    sets = [set(minhash.shingle_set(t).tolist()) for t in texts]
    least = list(range(len(sets)))
    for _ in sets:
        for a in range(len(sets)):
            for b in range(a):
                if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    least[a] = least[b] = min(least[a], least[b])
    rows = minhash.near_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == dict(enumerate(least))


def test_shingles_of_one_node_alone(spark):
    """Counts are those of plain sets; a node of two texts has none but still shares."""
    texts = {1: ["a b c d e f g"], 2: ["a b c d e f x"], 3: ["q r s t u"], 4: ["h i j k l m", "q r s t u v"], 5: ["other words that are not asked for"]}
    packed = [(n, t) for n, ts in texts.items() for t in ts]
    rows = spark.createDataFrame(packed, "node long, text string").mapInArrow(minhash.squeezed, "node long, packed binary")
    nodes = spark.createDataFrame([(n,) for n in (1, 2, 3, 4)], "node long")
    found = dict(minhash.alone_counts(rows, nodes).select("node", "alone").collect())
    assert found == {1: 1, 2: 1, 3: 0}


def test_bound_refuses_no_pair_that_reaches(spark):
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(500):
        size_a, size_b = (int(v) for v in rng.integers(1, 60, 2))
        shared = int(rng.integers(0, min(size_a, size_b) + 1))
        rows.append(((size_a, int(rng.integers(shared, size_a + 1))), (size_b, int(rng.integers(shared, size_b + 1))), 100 * shared >= 75 * (size_a + size_b - shared)))
    df = spark.createDataFrame(rows, "one struct<size: long, common: long>, two struct<size: long, common: long>, linked boolean")
    out = df.select("linked", minhash.can_reach(F.col("one"), F.col("two"), 75).alias("may")).collect()
    assert all(r["may"] for r in out if r["linked"]) and not all(r["may"] for r in out)
    blank = spark.createDataFrame([((4, None), (5, 0), False)], df.schema)
    assert blank.select(minhash.can_reach(F.col("one"), F.col("two"), 75)).first()[0]
