"""Toxicity as an ordered severity: cumulative-link regression on sparse text features."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stillwell.llm.shared import staged

WORDS = re.compile(r"[^\W\d_]+")
#: Grades: 0 clean; a toxic document has grade 1, 2 or 3 by how many different marker features it has.
GRADE_ENDS = (2, 5)
GRADES = 4
PREFIXES = (4, 5)
#: A document is toxic from this chance of any grade above 0.
LEAST = 0.7

SCORED = "doc_id long, severity double, grade int, p_toxic double, toxic boolean"


def features_of(word: str) -> list[str]:
    """A word and its marked beginnings."""
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) >= n)]


def feature_set(text: str | None) -> set[str]:
    """The different features of the different lower-case words of a whole text."""
    return {f for word in set(WORDS.findall((text or "").lower())) for f in features_of(word)}


@dataclass
class Model:
    """Weights shared by all thresholds, and the rising thresholds: P(grade <= k) = 1 / (1 + exp(score - threshold k))."""

    weights: dict[str, float]
    thresholds: np.ndarray

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        """One column per grade."""
        below = 1 / (1 + np.exp(np.clip(scores[:, None] - self.thresholds, -60, 60)))
        return np.diff(below, axis=1, prepend=0, append=1)


def fit_ordinal(rows: np.ndarray, columns: np.ndarray, grades: np.ndarray, width: int, steps: int = 400, rate: float = 0.1, ridge: float = 2e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by Adam on the full likelihood of a sparse 0/1 matrix (row and column of each one).

    Thresholds are the first one and the logarithms of the steps between them, so they stay in order. Grades count
    alike however rare they are.
    """
    docs = len(grades)
    share = np.bincount(grades, minlength=GRADES) / docs
    each = 1 / np.maximum(share[grades], 1e-9)
    each /= each.sum()
    params = np.concatenate([np.zeros(width), [1.0], np.zeros(GRADES - 2)])
    first, second = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1):
        weights, gaps = params[:width], np.exp(params[width + 1:])
        cuts = params[width] + np.concatenate([[0], np.cumsum(gaps)])
        scores = np.bincount(rows, weights=weights[columns], minlength=docs)
        edges = np.concatenate([[-np.inf], cuts, [np.inf]])
        upper = 1 / (1 + np.exp(np.clip(scores - edges[grades + 1], -60, 60)))
        lower = 1 / (1 + np.exp(np.clip(scores - edges[grades], -60, 60)))
        # d log P / d score and by the two edges of each grade
        chance = np.maximum(upper - lower, 1e-12)
        high, low = upper * (1 - upper) / chance, lower * (1 - lower) / chance
        slope = each * (low - high)
        by_edge = np.bincount(grades, weights=each * high, minlength=GRADES)[:-1] - np.bincount(grades, weights=each * low, minlength=GRADES)[1:]
        by_gap = gaps * np.cumsum(by_edge[::-1])[::-1][1:]
        gradient = np.concatenate([np.bincount(columns, weights=slope[rows], minlength=width) - ridge * weights, [by_edge.sum()], by_gap])
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient ** 2
        params = params + rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    gaps = np.exp(params[width + 1:])
    return params[:width], params[width] + np.concatenate([[0], np.cumsum(gaps)])


def sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = pa.array([sorted(feature_set(t.as_py())) for t in batch["text"]], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["toxic"], found], ["doc_id", "toxic", "features"])


def fit(docs: DataFrame, labels: DataFrame, toxic_rows: int = 2000, clean_rows: int = 4000, most_features: int = 1024) -> Model | None:
    """Fit on a bounded sample of labelled documents: at most ``toxic_rows`` and ``clean_rows``, by a hash of doc_id.

    The ``most_features`` features whose shares among toxic and clean documents differ most are used. A marker is a
    feature that at least five sampled toxic documents have and nine tenths of its documents are toxic. Without labels
    of both kinds there is no model.
    """
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    order = F.xxhash64("doc_id", F.lit(5))
    some = [named.filter(f"toxic = {k}").orderBy(order, "doc_id").limit(n) for k, n in ((1, toxic_rows), (0, clean_rows))]
    chosen = F.broadcast(some[0].union(some[1]))  # at most toxic_rows + clean_rows rows
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = staged(texts.join(chosen, "doc_id").mapInArrow(sample_features, "doc_id long, toxic int, features array<string>"))
    sizes = dict(sample.groupBy("toxic").count().collect())
    if len(sizes) < 2:
        return None
    counts = sample.select("toxic", F.explode("features").alias("feature")).groupBy("feature").agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("all"))
    counts = counts.filter("all >= 3")
    bad, good = (F.col("bad") + 0.5) / (sizes[1] + 1), (F.col("all") - F.col("bad") + 0.5) / (sizes[0] + 1)
    strength = (bad - good) * F.log(bad / good)
    top = counts.orderBy(strength.desc(), "feature").limit(most_features)
    marker = (F.col("bad") >= 5) & (F.col("bad") >= 0.9 * F.col("all"))
    table = top.select("feature", marker.alias("marker")).collect()
    place = {r["feature"]: i for i, r in enumerate(table)}
    marks = np.array([r["marker"] for r in table])
    used = F.broadcast(sample.sparkSession.createDataFrame([(f, i) for f, i in place.items()], "feature string, place int"))
    ones = sample.select("doc_id", "toxic", F.explode_outer("features").alias("feature")).join(used, "feature", "left")
    ones = ones.groupBy("doc_id", "toxic").agg(F.collect_set("place").alias("places")).orderBy("doc_id", "toxic").collect()
    rows = np.repeat(np.arange(len(ones)), [len(r["places"]) for r in ones])
    columns = np.array([p for r in ones for p in sorted(r["places"])], dtype=np.int64)
    hits = np.bincount(rows, weights=marks[columns], minlength=len(ones))
    grades = np.array([r["toxic"] for r in ones]) * (1 + np.searchsorted(GRADE_ENDS, hits, side="left"))
    weights, thresholds = fit_ordinal(rows, columns, grades, len(place))
    return Model({f: float(weights[i]) for f, i in place.items() if abs(weights[i]) > 1e-3}, thresholds)


class WordScores(dict):
    """The weights of words, remembered up to ``limit`` words."""

    def __init__(self, weights: dict[str, float], limit: int = 500_000):
        super().__init__()
        self.weights, self.limit = weights, limit

    def __missing__(self, word: str) -> float:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = self.weights.get(word, 0.0)
        return value


def text_scores(model: Model):
    """A function from texts to scores, for use in one worker."""
    words = WordScores(model.weights)
    marked = {n: {f: w for f, w in model.weights.items() if f.endswith("*") and len(f) == n + 1} for n in PREFIXES}

    def one(text: str | None) -> float:
        found = set(WORDS.findall((text or "").lower()))
        total = sum(map(words.__getitem__, found))
        for n, table in marked.items():
            total += sum(map(table.__getitem__, table.keys() & {w[:n] + "*" for w in found if len(w) >= n}))
        return total

    return one


def score(docs: DataFrame, model: Model | None, least: float = LEAST) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, severity (expected grade), grade (likeliest), p_toxic, toxic.

    toxic is p_toxic >= ``least``, the chance of any grade above 0. Whole texts are read. A null or empty text has no
    features and the score 0; without a model every row has severity 0. Repeated rows and rows without doc_id are
    scored like any other; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = text_scores(model) if model else None
        for batch in batches:
            if one:
                chances = model.probabilities(np.array([one(t.as_py()) for t in batch["text"]], dtype=np.float64))
            else:
                chances = np.eye(1, GRADES).repeat(len(batch), axis=0)
            toxic = 1 - chances[:, 0]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(chances @ np.arange(GRADES)), pa.array(chances.argmax(axis=1).astype(np.int32)),
                                              pa.array(toxic), pa.array(toxic >= least)], ["doc_id", "severity", "grade", "p_toxic", "toxic"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCORED)


def drop_toxic(docs: DataFrame, labels: DataFrame, least: float = LEAST) -> DataFrame:
    """``docs`` without the rows whose text the model calls toxic; rows are judged where they are read."""
    model = fit(docs, labels)
    if model is None:
        return docs

    @F.pandas_udf("boolean")
    def clean(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = text_scores(model)
        for texts in parts:
            yield pd.Series(1 - model.probabilities(np.array([one(t) for t in texts], dtype=np.float64))[:, 0] < least)

    return docs.filter(clean(F.col("text").cast("string")))
