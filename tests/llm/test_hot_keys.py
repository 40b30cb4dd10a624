"""Hot keys are never one task; closing marks after letters that lower case makes longer."""

from __future__ import annotations

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from stillwell.llm import shared
from stillwell.llm.shared import hot_join
from stillwell.llm.tokens import BYTE_PIECES, WORD_PIECES, encoder


def test_a_hot_key_is_split(spark):
    """Half of the rows have one key; without adaptive execution no task may hold more than its share."""
    plain = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in plain}
    try:
        for k, v in plain.items():
            spark.conf.set(k, v)
        left = spark.range(40_000, numPartitions=16).select(F.when(F.col("id") % 2 == 0, -1).otherwise(F.col("id")).alias("key"), F.col("id").alias("v"))
        right = left.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("last"))
        got = hot_join(left, right, ["key"], "n", 40_000)
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert sum(sizes) == 40_000 and max(sizes) < 3_000
        assert got.filter("key = -1 AND last = 39998 AND n = 20000").count() == 20_000
        assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_hot_join_keeps_rows_without_a_key(spark, monkeypatch):
    monkeypatch.setattr(shared, "LEAST_HOT", 0)
    left = spark.createDataFrame([(None, 1), (1, 2), (1, 3), (2, 4), (3, 5)], "key long, v long")
    right = spark.createDataFrame([(1, 2, "x"), (2, 1, "y")], "key long, n long, w string")
    got = hot_join(left, right, ["key"], "n", 1500).select("key", "v", "w").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(None, 1, None), (1, 2, "x"), (1, 3, "x"), (2, 4, "y"), (3, 5, None)]))


ODD = ["İ", "i̇", "ẞ", "ß", "Σ", "ͅ", "À", "ﬁ", "ǅ", "Ⅰ", "ª", "ำ", "İİ", " ", "　", "<|", "‍", "؀", "'s", "'S", "42", "½"]


@pytest.mark.parametrize("name, pieces", [("word_bpe_49k.json", WORD_PIECES), ("byte_bpe_50k.json", BYTE_PIECES)])
def test_odd_letters_before_marks_encode_as_the_library_does(name, pieces):
    rng = random.Random(7)
    parts = ODD + list("aZ.,!?- \n\t'") + ["the", "Word", ", ", ". "]
    coder = encoder(public_tokenizers.path(name), pieces)
    for text in ["İ.", "ALİ, VELİ."] + ["".join(rng.choices(parts, k=rng.randint(1, 9))) for _ in range(20_000)]:
        assert coder.encode(text) == coder.whole(text), ascii(text)
