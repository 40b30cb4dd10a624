"""Maps of shingles refuse no pair that reaches the similarity, and the pairs of a family stay far below all of them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from test_alike import pairs_at

from stillwell.llm import minhash


def side(shingles):
    coarse, fine = minhash.shingle_map(shingles, minhash.COARSE_BITS), minhash.shingle_map(shingles)
    slack = [len(shingles) - int(np.bitwise_count(m.view(np.uint64)).sum()) for m in (fine, coarse)]
    return (len(shingles), fine.tolist(), *slack, *coarse.tolist())


def verdicts(spark, pairs, similarity=75):
    kind = f"struct<size: long, {', '.join(': '.join(c.split()) for c in minhash.MAPS.split(', ')[1:])}>"
    both = spark.createDataFrame([(side(a), side(b)) for a, b in pairs], f"one {kind}, two {kind}")
    return [r[0] for r in both.select(minhash.may_overlap(F.col("one"), F.col("two"), similarity)).collect()]


def test_pairs_that_reach_may_overlap(spark):
    rng = np.random.default_rng(6)
    assert all(verdicts(spark, pairs_at(rng, 0.75, 1000, [1, 2, 3, 4, 5, 8, 20, 100, 400, 3000])))


def test_pairs_somewhat_below_may_not(spark):
    """At 0.65 the sketches alone let most pairs pass; the maps let few."""
    rng = np.random.default_rng(7)
    assert np.mean(verdicts(spark, pairs_at(rng, 0.65, 300, [50, 150]))) < 0.1


def test_a_family_of_copies_compares_few_pairs(spark, monkeypatch):
    """Eighty copies of a text whose edits keep most pairs between 0.55 and 0.7: few of the 3,160 are compared in full."""
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(300)]
    source = list(rng.choice(words, 150))
    texts = []
    for _ in range(80):
        copy = list(source)
        for place in rng.choice(150, 6, replace=False):
            copy[place] = str(rng.choice(words))
        texts.append(" ".join(copy))
    compared = []
    plain = minhash.with_packed
    monkeypatch.setattr(minhash, "with_packed", lambda pairs, texts, at: (compared.append(pairs.count()) if at == "b" else None) or plain(pairs, texts, at))
    minhash.near_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sum(compared) < 600
