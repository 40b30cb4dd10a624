"""Models with one contract: ``needs`` names the columns they read, ``score`` adds their expectation to rows.

``score(rows, name, changed)`` may put other values in the place of columns (a scaled or edited driver), so effect,
step table, audit and summary ask any model the same two questions: as it was, and as it would be. Fitted models are
compiled to column expressions; scoring starts no job and has no Python in it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from operator import add

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, functions as F

from ..operators import encode
from . import expected

#: Features that grow in proportion when every day of the driver does.
PROPORTIONAL = re.compile(r"interval_mm|interval_per_day|mm_\d+d|monsoon_mm|max_day_mm")


def scaled(model, factor: Column) -> dict[str, Column]:
    """What ``score`` needs to see the driver times ``factor``."""
    return {c: F.col(c) * factor for c in model.needs if PROPORTIONAL.fullmatch(c)}


def as_model(model):
    """A table of season lines counts as the model it describes."""
    return Line(model) if isinstance(model, DataFrame) else model


class Line:
    """Intercept and slope on one driver column per season of the year. Rows of a season without a line are left out."""

    def __init__(self, lines: DataFrame, x: str = "interval_mm"):
        self.lines, self.x = lines, x
        self.needs = [x, "season"]

    def score(self, rows: DataFrame, name: str = "expected", changed: dict[str, Column] | None = None) -> DataFrame:
        return expected.apply_line(rows, self.lines, (changed or {}).get(self.x, F.col(self.x)), name)


@dataclass(frozen=True)
class Numeric:
    """How a number enters a model: its training median where it is missing, then standardised."""

    median: float
    mean: float
    std: float

    def value(self, x: Column) -> Column:
        known = F.coalesce(F.nanvl(x.cast("double"), F.lit(None)), F.lit(self.median))
        return (known - F.lit(self.mean)) / F.lit(self.std)


def level(c: str, changed: dict[str, Column]) -> Column:
    return F.coalesce(changed.get(c, F.col(c)), F.lit("unknown"))


def pick(levels: Column, values: dict[str, float], other: float) -> Column:
    """The value of a level, by a literal map that Spark folds once."""
    if not values:
        return F.lit(other)
    return F.coalesce(F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[levels], F.lit(other))


@dataclass
class Linear:
    """A weighted sum of standardised numbers and category effects, and of one effect per group where it was fitted so.

    A level or group that training rows never showed has the effect 0. Groups may be many: their effects are a table.
    """

    intercept: float
    numbers: dict[str, Numeric]
    weights: dict[str, float]
    effects: dict[str, dict[str, float]] = field(default_factory=dict)
    group: str | None = None
    group_effects: DataFrame | None = None

    @property
    def needs(self) -> list[str]:
        return [*self.numbers, *self.effects, *([self.group] if self.group else [])]

    def column(self, changed: dict[str, Column] | None = None) -> Column:
        """The expectation without the group's effect."""
        changed = changed or {}
        terms = [F.lit(self.weights[c]) * n.value(changed.get(c, F.col(c))) for c, n in self.numbers.items()]
        terms += [pick(level(c, changed), values, 0.0) for c, values in self.effects.items()]
        return reduce(add, terms, F.lit(self.intercept))

    def score(self, rows: DataFrame, name: str = "expected", changed: dict[str, Column] | None = None) -> DataFrame:
        if self.group is None:
            return rows.withColumn(name, self.column(changed))
        effects = self.group_effects.select(F.col(self.group).alias("_group"), F.col("effect").alias("_effect"))
        joined = rows.join(effects, F.col(self.group).eqNullSafe(F.col("_group")), "left")
        return joined.withColumn(name, self.column(changed) + F.coalesce("_effect", F.lit(0.0))).drop("_group", "_effect")


def kept_levels(rows: DataFrame, categories: list[str], fewest: int) -> dict[str, list[list[str]]]:
    """Per category the sets of levels that share an effect: each frequent one alone, all rare ones together."""
    if not categories:
        return {}
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), level(c, {}).alias("l")) for c in categories])).alias("x")
    counts = rows.select(each).groupBy("x.c", "x.l").agg(F.count(F.lit(1)).alias("n")).collect()
    out: dict[str, list[list[str]]] = {}
    for c in categories:
        own = sorted((r["l"], r["n"]) for r in counts if r["c"] == c)
        rare = [n for n, k in own if k < fewest]
        out[c] = [[n] for n, k in own if k >= fewest] + ([rare] if rare else [])
    return out


class _Equations:
    """The normal equations of a ridge as aggregates: sums per group and, from those, the equations without the groups.

    A group's own coefficient is (what is left of the sum of its targets) / (its rows + alpha), so it is eliminated
    exactly; what remains has a row for the intercept and one for each of ``width`` columns x0, x1, ...
    """

    def __init__(self, table: DataFrame, width: int, alpha: float, group: str | None = None, by: list[str] | None = None):
        self.width, self.alpha, self.by = width, alpha, by or []
        names = [f"x{i}" for i in range(width)]
        keys = [*self.by, *([group] if group else [])]
        sums = [F.count(F.lit(1)).alias("n"), F.sum("y").alias("sy"), *[F.sum(n).alias(f"s{i}") for i, n in enumerate(names)],
                *[F.sum(F.col(n) * F.col("y")).alias(f"c{i}") for i, n in enumerate(names)],
                *[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"g{i}_{j}") for i in range(width) for j in range(i + 1)]]
        self.parts = table.groupBy(*keys).agg(*sums)
        self.share = F.lit(1.0) / (F.col("n") + F.lit(float(alpha))) if group else F.lit(0.0)
        self.totals = [F.col("n").cast("double"), *[F.col(f"s{i}") for i in range(width)]]
        self.places = [(i, j) for i in range(width + 1) for j in range(i + 1)]

    def solved(self) -> dict[tuple, list[float]]:
        """Intercept and coefficients per value of ``by``, solved on the driver."""
        s, y = self.totals, [F.col("sy"), *[F.col(f"c{i}") for i in range(self.width)]]

        def product(i: int, j: int) -> Column:
            return s[i] if j == 0 else F.col(f"g{i - 1}_{j - 1}")

        left = [F.sum(product(i, j) - s[i] * s[j] * self.share).alias(f"a{i}_{j}") for i, j in self.places]
        right = [F.sum(y[i] - s[i] * F.col("sy") * self.share).alias(f"b{i}") for i in range(self.width + 1)]
        out = {}
        for one in self.parts.groupBy(*self.by).agg(F.sum("n").alias("rows"), *left, *right).collect():
            if not one["rows"]:
                continue
            a = np.zeros((self.width + 1, self.width + 1))
            for i, j in self.places:
                a[i, j] = a[j, i] = one[f"a{i}_{j}"]
            a[np.arange(1, self.width + 1), np.arange(1, self.width + 1)] += self.alpha
            # the smallest solution where equations repeat each other, as groups of one row and no penalty make them
            w = np.linalg.lstsq(a, np.array([one[f"b{i}"] for i in range(self.width + 1)]), rcond=None)[0]
            out[tuple(one[k] for k in self.by)] = w.tolist()
        if not out:
            raise ValueError("there are no rows to fit on")
        return out

    def effects(self, weights: list[Column]) -> DataFrame:
        """The groups' coefficients: one row per value of ``by`` and group, for weights that are literals or columns."""
        left = reduce(lambda acc, i: acc - weights[i] * self.totals[i], range(self.width + 1), F.col("sy"))
        return self.parts.withColumn("effect", left * self.share)


def fit_linear(rows: DataFrame, numeric: list[str], categories: list[str], train: Column, alpha: float = 1.0, fewest: int = 20,
               target: str = "delta", group: str | None = None) -> Linear:
    """Ridge with the penalty ``alpha`` on the coefficients of standardised numbers, levels and groups, none on the intercept.

    One aggregate gives the sums of products of all columns. With ``group`` its coefficients, however many, are
    eliminated, so the equations that are solved on the driver have one row per number and level only, and the
    groups' effects stay a distributed table. Rows without target are left out. Categories are held by the driver;
    one with many levels belongs into ``group``.
    """
    seen = rows.where(train & F.col(target).isNotNull())
    stats = encode.saved(encode.numeric_stats(seen, numeric, F.lit(True))) if numeric else {}
    numbers = {c: Numeric(stats[c]["median"], stats[c]["mean"], stats[c]["std"]) for c in numeric}
    levels = kept_levels(seen, categories, fewest)
    design = [n.value(F.col(c)) for c, n in numbers.items()]
    design += [level(c, {}).isin(own).cast("double") for c, sets in levels.items() for own in sets]
    keys = [F.col(group).alias("_group")] if group else []
    table = seen.select(*keys, F.col(target).cast("double").alias("y"), *[d.alias(f"x{i}") for i, d in enumerate(design)])
    equations = _Equations(table, len(design), alpha, "_group" if group else None)
    w = equations.solved()[()]
    effects, at = {}, 1 + len(numeric)
    for c, sets in levels.items():
        effects[c] = {name: w[at + k] for k, own in enumerate(sets) for name in own}
        at += len(sets)
    own = equations.effects([F.lit(v) for v in w]).select(F.col("_group").alias(group), "effect") if group else None
    return Linear(w[0], numbers, dict(zip(numeric, w[1:])), effects, group, own)


def expected_by(rows: DataFrame, by: str, numeric: list[str], group: str, alpha: float = 1.0, target: str = "delta",
                name: str = "expected") -> DataFrame:
    """Rows with the fit of a ridge with group effects made for each value of ``by`` alone, all from one aggregate.

    Numbers are standardised within ``by``, whose values are few (methods, say). Rows that lack a number or the target
    are left out.
    """
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*numeric, target]])
    seen = rows.where(known)
    facts = seen.groupBy(by).agg(*[f(c).alias(f"_{n}{i}") for i, c in enumerate(numeric) for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    # one row per value of ``by``
    table = seen.join(F.broadcast(facts), by)
    design = [(F.col(c) - F.col(f"_m{i}")) / F.when(F.col(f"_s{i}") < 1e-6, 1.0).otherwise(F.col(f"_s{i}")) for i, c in enumerate(numeric)]
    table = table.select(*rows.columns, F.col(target).cast("double").alias("y"), *[d.alias(f"x{i}") for i, d in enumerate(design)])
    equations = _Equations(table, len(numeric), alpha, group, [by])
    solved = equations.solved()
    weights = F.create_map(*[x for (k,), w in solved.items() for x in (F.lit(k), F.array(*map(F.lit, w)))])[F.col(by)]
    parts = [F.get(weights, F.lit(i)) for i in range(len(numeric) + 1)]
    effects = equations.effects(parts).select(by, group, "effect")
    linear = reduce(lambda acc, i: acc + parts[i + 1] * F.col(f"x{i}"), range(len(numeric)), parts[0])
    joined = table.join(effects, [by, group])
    return joined.select(*rows.columns, (linear + F.col("effect")).alias(name))


#: A node of a tree: the feature it asks for, the largest value that goes left or the set of codes that do (a bit
#: each), its children, and the value of a leaf (whose children are -1).
NODE = "array<struct<f:int,t:double,m:bigint,l:int,r:int,v:double>>"
_CONDITION = re.compile(r"(If|Else) \(feature (\d+) (<=|>|in|not in) (.+)\)$")


def _codes(text: str) -> int:
    return sum(1 << int(float(c)) for c in text.strip("{}").split(",") if c)


def _read_trees(text: str, weights: list[float]) -> tuple[list[dict], list[int], int]:
    """Nodes, roots and depth from the printed form of an ensemble; a leaf's value is times the weight of its tree."""
    nodes: list[dict] = []
    roots: list[int] = []
    depth, lines = 0, [x.strip() for x in text.splitlines()]
    at = 0

    def read(level_: int) -> int:
        nonlocal at, depth
        depth = max(depth, level_)
        own = len(nodes)
        if lines[at].startswith("Predict:"):
            nodes.append({"f": 0, "t": 0.0, "m": 0, "l": -1, "r": -1, "v": float(lines[at].split(":")[1]) * weights[len(roots)]})
            at += 1
            return own
        kind, feature, how, value = _CONDITION.match(lines[at]).groups()
        node = {"f": int(feature), "t": 0.0, "m": 0, "l": 0, "r": 0, "v": 0.0}
        nodes.append(node)
        if how == "<=":
            node["t"] = float(value)
        else:
            node["m"] = _codes(value)
        at += 1
        node["l"] = read(level_ + 1)
        at += 1                                                   # the line of the other branch
        node["r"] = read(level_ + 1)
        return own

    while at < len(lines):
        if lines[at].startswith(("If", "Predict")):
            roots.append(read(0))
        else:
            at += 1
    return nodes, roots, depth


@dataclass
class Trees:
    """A tree ensemble as one literal array of nodes, walked by array functions: as large a plan for any number of trees."""

    inputs: dict[str, Callable[[dict[str, Column]], Column]]
    nodes: list[dict]
    roots: list[int]
    depth: int

    @property
    def needs(self) -> list[str]:
        return list(self.inputs)

    def score(self, rows: DataFrame, name: str = "expected", changed: dict[str, Column] | None = None) -> DataFrame:
        changed = changed or {}
        nodes = F.from_json(F.lit(json.dumps(self.nodes)), NODE)
        values = F.array(*[make(changed) for make in self.inputs.values()])
        table = rows.withColumn("_x", values)

        def down(node: Column, _: Column) -> Column:
            here = F.get(nodes, node)
            x = F.get(F.col("_x"), here["f"])
            left = F.when(here["m"] != 0, F.getbit(here["m"], F.least(x, F.lit(63)).cast("int")) == 1).otherwise(x <= here["t"])
            return F.when(here["l"] < 0, node).when(left, here["l"]).otherwise(here["r"])

        def leaf(root: Column) -> Column:
            steps = F.sequence(F.lit(1), F.lit(self.depth)) if self.depth else F.array().cast("array<int>")
            return F.get(nodes, F.aggregate(steps, root, down))["v"]

        roots = F.from_json(F.lit(json.dumps(self.roots)), "array<int>")
        return table.withColumn(name, F.aggregate(roots, F.lit(0.0), lambda total, root: total + leaf(root))).drop("_x")


def compile_trees(model: PipelineModel, stats: dict[str, dict[str, float]]) -> Trees:
    """The expression of a fitted pipeline of indexers and a tree ensemble, on rows before their numbers are encoded.

    ``stats`` are the training statistics of the numbers (``encode.saved``). Codes follow the fitted indexers: levels
    they do not know get the code after the last one.
    """
    codes: dict[str, tuple[str, dict[str, float]]] = {}
    order: list[str] = []
    for stage in model.stages:
        if hasattr(stage, "labelsArray"):
            for c, out, labels in zip(stage.getInputCols(), stage.getOutputCols(), stage.labelsArray):
                codes[out] = c, {n: float(k) for k, n in enumerate(labels)}
        elif hasattr(stage, "getInputCols"):
            order = stage.getInputCols()
    last = model.stages[-1]
    inputs: dict[str, Callable] = {}
    for c in order:
        if c in codes:
            source, values = codes[c]
            # the indexers saw the column as it is, and count a missing level as unknown to them
            inputs[source] = lambda changed, s=source, v=values: pick(changed.get(s, F.col(s)), v, float(len(v)))
        else:
            number = Numeric(stats[c]["median"], stats[c]["mean"], stats[c]["std"])
            inputs[c] = lambda changed, c=c, n=number: n.value(changed.get(c, F.col(c)))
    averaged = "RandomForest" in type(last).__name__
    weights = [1 / last.getNumTrees] * last.getNumTrees if averaged else list(last.treeWeights)
    return Trees(inputs, *_read_trees(last.toDebugString, weights))
