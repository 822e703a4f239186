"""Gradient-boosted trees over binned features, grown by aggregates: many classes at once, quantiles, Shapley values.

Features are cut into bins by approximate quantiles, missing values having a bin of their own, and kept as bytes. To
grow a level every task adds up, for each node, feature and bin, the gradients of its rows, having scored them with the
trees so far; what is shuffled is those sums, and what comes to the driver is bounded by nodes x features x bins x
classes, however many rows there are. Nothing is remembered from level to level but the trees, so a lost task is
computed again from its rows. A quantile's leaves take the quantile of their residuals from Spark's sketch.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bins of a feature besides that of missing values; weight of the prior on a leaf; rows that a leaf holds at least.
BINS, SHRINK, LEAST = 31, 1.0, 5


@dataclass(frozen=True)
class Tree:
    """A complete binary tree: node k's children are 2k + 1 (bin at most the cut) and 2k + 2. feature is -1 in leaves
    and what is below them; cover is the number of rows that came by."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    cover: np.ndarray

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        node = np.zeros(len(bins), np.int64)
        while True:
            inner = np.flatnonzero(self.feature[node] >= 0)
            if not len(inner):
                return node
            at = node[inner]
            node[inner] = 2 * at + 1 + (bins[inner, self.feature[at]] > self.cut[at])


@dataclass
class Model:
    """features with their cuts; for each output its start and its trees."""

    features: list[str]
    cuts: list[np.ndarray]
    start: np.ndarray
    trees: list[list[Tree]] = field(default_factory=list)
    classes: list | None = None

    def binned(self, values: np.ndarray) -> np.ndarray:
        """0 for a missing value, else 1 + how many cuts lie below it."""
        out = np.zeros(values.shape, np.int64)
        for j, cuts in enumerate(self.cuts):
            out[:, j] = np.where(np.isnan(values[:, j]), 0, 1 + np.searchsorted(cuts, values[:, j], side="left"))
        return out

    def raw(self, bins: np.ndarray) -> np.ndarray:
        out = np.tile(self.start, (len(bins), 1))
        for k, own in enumerate(self.trees):
            for tree in own:
                out[:, k] += tree.value[tree.leaves(bins)]
        return out

    def scores(self) -> Column:
        """The outputs of a row, an array, before any link."""
        return self._applied(lambda bins: list(self.raw(bins)))

    def shapley(self) -> Column:
        """One array per output of the features' Shapley values, laid end to end; they add up to the output less base()."""
        return self._applied(lambda bins: list(self.contributions(bins).reshape(len(bins), -1)))

    def _applied(self, f) -> Column:
        @F.pandas_udf("array<double>")
        def run(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            return pd.Series(f(self.binned(np.array([list(r) for r in x], float))))

        return run(F.array(*[F.col(c).cast("double") for c in self.features]))

    def base(self) -> np.ndarray:
        """What each output is on average over the rows that the trees were grown on."""
        out = self.start.astype(float).copy()
        for k, own in enumerate(self.trees):
            out[k] += sum(_mean(tree) for tree in own)
        return out

    def contributions(self, bins: np.ndarray) -> np.ndarray:
        """rows x outputs x features. Along a leaf's path a feature that is known lets the row through or not, and one
        that is unknown lets through the share of rows that its nodes let through; a leaf's part of a feature's value is
        the mean, over the orders in which the path's features become known, of what knowing it changes."""
        out = np.zeros((len(bins), len(self.trees), len(self.features)))
        for k, own in enumerate(self.trees):
            for tree in own:
                for path, value in _paths(tree):
                    names = list(path)
                    known = {f: np.logical_and.reduce([(bins[:, f] > c) == right for c, right, _ in path[f]]) for f in names}
                    share = {f: float(np.prod([s for *_, s in path[f]])) for f in names}
                    for f in names:
                        others = [g for g in names if g != f]
                        total = np.zeros(len(bins))
                        for size in range(len(others) + 1):
                            weight = 1 / (len(names) * comb(len(others), size))
                            for some in combinations(others, size):
                                part = np.full(len(bins), weight)
                                for g in others:
                                    part = part * (known[g] if g in some else share[g])
                                total += part
                        out[:, k, f] += value * (known[f] - share[f]) * total
        return out


def _paths(tree: Tree, node: int = 0, path: dict | None = None):
    """(feature: its (cut, right, share of rows) along the path, value) of every leaf with rows."""
    path = path or {}
    if tree.feature[node] < 0:
        yield path, tree.value[node]
        return
    f = int(tree.feature[node])
    for right, child in ((False, 2 * node + 1), (True, 2 * node + 2)):
        if tree.cover[child]:
            yield from _paths(tree, child, {**path, f: [*path.get(f, []), (tree.cut[node], right, tree.cover[child] / tree.cover[node])]})


def _mean(tree: Tree) -> float:
    return sum(value * np.prod([s for own in path.values() for *_, s in own]) for path, value in _paths(tree))


@dataclass(frozen=True)
class Loss:
    """start: the outputs before any tree, from a summary of y. slopes: gradient and curvature of each output, from raw
    outputs and y. quantile: the share that a leaf's value takes of its residuals, else leaves take Newton's step."""

    slopes: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
    quantile: float | None = None


def _softmax(raw: np.ndarray) -> np.ndarray:
    e = np.exp(raw - raw.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def softmax(classes: int) -> Loss:
    def slopes(raw, y):
        p = _softmax(raw)
        return p - (y[:, None].astype(int) == np.arange(classes)), p * (1 - p)

    return Loss(slopes)


SQUARED = Loss(lambda raw, y: (raw - y[:, None], np.ones_like(raw)))


def pinball(share: float) -> Loss:
    return Loss(lambda raw, y: (np.where(y[:, None] < raw, 1 - share, -share), np.ones_like(raw)), share)


def spread(df: DataFrame) -> DataFrame:
    """df over twice as many tasks as there are cores at least: growing trees costs time by the row, not by the byte, and
    Spark would put rows as narrow as these into a few tasks."""
    spark = df.sparkSession
    return df.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def cuts_of(df: DataFrame, features: list[str], bins: int = BINS) -> list[np.ndarray]:
    """The inner edges of each feature's bins."""
    found = df.approxQuantile(features, [k / bins for k in range(1, bins)], 1e-3)
    return [np.unique(c) for c in found]


def fit(df: DataFrame, features: list[str], y: str, loss: Loss, start: list[float], cuts: list[np.ndarray], rounds: int = 10, depth: int = 3, rate: float = 0.3) -> Model:
    """Trees for each output, a round at a time: all outputs grow their trees together, a job a level."""
    return fit_folds(df, features, y, loss, start, cuts, rounds, depth, rate)[0]


def fit_folds(df: DataFrame, features: list[str], y: str, loss: Loss, start: list[float], cuts: list[np.ndarray], rounds: int = 10, depth: int = 3, rate: float = 0.3, fold: str | None = None, folds: int = 0) -> list[Model]:
    """The model of fit on all rows, then for each value of fold, 0 to folds - 1, the one on the rows that have another.
    They grow together, so that a level stays one job however many they are."""
    models = [Model(features, cuts, np.array(start, float), [[] for _ in start]) for _ in range(1 + folds)]
    n_out, n_feat, n_bin = len(start), len(features), max((len(c) for c in cuts), default=0) + 2
    data = df.filter(F.col(y).isNotNull()).select(F.array(*[F.col(c).cast("double") for c in features]).alias("x"), F.col(y).cast("double").alias("y"), (F.col(fold) if fold else F.lit(-1)).cast("int").alias("fold"))

    def rows(batches):
        for batch in batches:
            if batch.num_rows:
                yield models[0].binned(batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)), batch.column("y").to_numpy(), batch.column("fold").to_numpy()

    def sums(grown: list[Tree], level: int):
        width, first = 1 << level, (1 << level) - 1
        cells = width * n_feat * n_bin

        def run(batches):
            total = np.zeros((len(grown), 3, cells))
            for every, target, own_fold in rows(batches):
                for g, model in enumerate(models):
                    taken = np.flatnonzero(own_fold != g - 1) if g else slice(None)
                    bins = every[taken]
                    slope, curve = loss.slopes(model.raw(bins), target[taken])
                    for k, tree in enumerate(grown[g * n_out : (g + 1) * n_out]):
                        node = tree.leaves(bins)
                        own = np.flatnonzero(node >= first)
                        spot = (((node[own] - first)[:, None] * n_feat + np.arange(n_feat)) * n_bin + bins[own]).ravel()
                        for m, weight in enumerate((slope[own, k], curve[own, k], np.ones(len(own)))):
                            total[g * n_out + k, m] += np.bincount(spot, np.repeat(weight, n_feat), minlength=cells)
            k, at = np.nonzero(total[:, 2])
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(at.astype(np.int64)), *[pa.array(total[k, m, at]) for m in range(3)]], names=["k", "at", "g", "h", "n"])

        out = np.zeros((len(grown), 3, width, n_feat, n_bin))
        flat = out.reshape(len(grown), 3, cells)
        got = data.mapInArrow(run, "k int, at long, g double, h double, n double").groupBy("k", "at").agg(*[F.sum(c).alias(c) for c in "ghn"]).toArrow()
        k, at, *totals = (got.column(c).to_numpy() for c in ("k", "at", *"ghn"))
        flat[k, :, at] = np.column_stack(totals)
        return out

    def quantiles(grown: list[Tree]) -> dict[tuple[int, int], float]:
        def run(batches):
            for bins, target, _ in rows(batches):
                raw = models[0].raw(bins)
                for k, tree in enumerate(grown):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bins), k, np.int32)), pa.array(tree.leaves(bins)), pa.array(target - raw[:, k])], names=["k", "leaf", "r"])

        residuals = data.mapInArrow(run, "k int, leaf long, r double")
        return {(r.k, r.leaf): r.q for r in residuals.groupBy("k", "leaf").agg(F.percentile_approx("r", loss.quantile, 10_000).alias("q")).collect()}

    for _ in range(rounds):
        size = (2 << depth) - 1
        grown = [Tree(np.full(size, -1), np.zeros(size, np.int64), np.zeros(size), np.zeros(size)) for _ in models for _ in start]
        for level in range(depth + 1):
            found = sums(grown, level)
            split = False
            for k, tree in enumerate(grown):
                for at in range(1 << level):
                    node = (1 << level) - 1 + at
                    g, h, n = found[k, :, at]
                    whole = [x[0].sum() for x in (g, h, n)]
                    if not whole[2]:
                        continue
                    tree.cover[node] = whole[2]
                    tree.value[node] = -rate * whole[0] / (whole[1] + SHRINK)
                    if level == depth:
                        continue
                    below = [np.cumsum(x, axis=1)[:, :-1] for x in (g, h, n)]
                    above = [w - b for w, b in zip(whole, below)]
                    gain = below[0] ** 2 / (below[1] + SHRINK) + above[0] ** 2 / (above[1] + SHRINK) - whole[0] ** 2 / (whole[1] + SHRINK)
                    gain = np.where((below[2] >= LEAST) & (above[2] >= LEAST), gain, -np.inf)
                    best = int(np.argmax(np.round(gain, 9)))
                    if gain.flat[best] > 1e-9:
                        tree.feature[node], tree.cut[node] = divmod(best, n_bin - 1)
                        split = True
            if not split:
                break
        if loss.quantile is not None:
            for (k, leaf), q in quantiles(grown).items():
                grown[k].value[leaf] = rate * q
        for k, tree in enumerate(grown):
            models[k // n_out].trees[k % n_out].append(tree)
    return models


def _share(*parts: Column) -> Column:
    from tallyspark.operators.evaluation import share_of_hash

    return share_of_hash(*parts)


def stratified(df: DataFrame, label: str, key: list[str], held_out: float = 0.25, seed: int = 42) -> DataFrame:
    """df with is_test: in every class the share of rows with the smallest hashes of their keys. Where a class's cut lies
    comes from a sketch, so its share is met to within a ten-thousandth and the rows that tie at it."""
    hashed = df.withColumn("__share", _share(F.lit(seed), *[F.col(k) for k in key]))
    cut = hashed.groupBy(label).agg(F.percentile_approx("__share", held_out, 10_000).alias("__cut"))
    return hashed.join(cut, label).withColumn("is_test", F.col("__share") <= F.col("__cut")).drop("__share", "__cut")


@dataclass
class Classifier:
    """A model on all training rows; folds: for each fold the model on the others and a step function for each class
    that turns its probabilities into shares; none where a class is too small to calibrate."""

    model: Model
    classes: list[str]
    folds: list[tuple[Model, list[tuple[np.ndarray, np.ndarray]]]]

    def probabilities(self) -> Column:
        """An array by class, adding up to 1: the mean over folds of calibrated probabilities, or the model's own."""
        parts = self.folds or [(self.model, None)]

        @F.pandas_udf("array<double>")
        def run(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            values = np.array([list(r) for r in x], float)
            total = np.zeros((len(values), len(self.classes)))
            for model, steps in parts:
                p = _softmax(model.raw(model.binned(values)))
                if steps:
                    p = np.column_stack([np.interp(p[:, k], *steps[k]) for k in range(p.shape[1])])
                    whole = p.sum(axis=1, keepdims=True)
                    p = np.where(whole > 0, p / np.where(whole > 0, whole, 1), 1 / p.shape[1])
                total += p
            return pd.Series(list(total / len(parts)))

        return run(F.array(*[F.col(c).cast("double") for c in self.model.features]))


def isotonic(x: np.ndarray, hits: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The non-decreasing steps nearest to hits / n at x, by pooling neighbours that are out of order."""
    blocks: list[list[float]] = []
    for at, h, m in sorted(zip(x.tolist(), hits.tolist(), n.tolist())):
        blocks.append([at, at, h, m])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            _, last, h, m = blocks.pop()
            blocks[-1][1], blocks[-1][2], blocks[-1][3] = last, blocks[-1][2] + h, blocks[-1][3] + m
    edges = [e for low, high, _, _ in blocks for e in ((low,) if low == high else (low, high))]
    levels = [h / m for low, high, h, m in blocks for _ in ((low,) if low == high else (low, high))]
    return np.array(edges), np.array(levels)


def classifier(train: DataFrame, features: list[str], label: str, key: list[str], folds: int = 3, least: int = 3, rounds: int = 8, depth: int = 3, seed: int = 42) -> Classifier:
    """Boosted trees for all classes at once, with calibrators fitted on what each fold's model has not seen. A class
    with fewer than `least` rows in training, or a single class, means no calibration. Probabilities are rounded to
    thousandths before they are pooled, so what comes to the driver is a thousand counts a class and fold at most."""
    counts = {r[0]: r[1] for r in train.filter(F.col(label).isNotNull()).groupBy(F.col(label).cast("string")).agg(F.count("*")).collect()}
    classes = sorted(counts)
    if not classes:
        raise ValueError("no labelled rows")
    place = F.array_position(F.lit(classes), F.col(label).cast("string")) - 1
    data = train.filter(F.col(label).isNotNull()).select(*[F.col(c).cast("double").alias(c) for c in features], place.cast("double").alias("__y"), F.floor(_share(F.lit(seed + 1), *[F.col(k) for k in key]) * folds).cast("int").alias("__fold"))
    data = spread(data).persist()
    cuts = cuts_of(data, features)
    whole = sum(counts.values())
    start = [float(np.log(counts[c] / whole)) for c in classes]
    calibrated = folds if len(classes) > 1 and min(counts.values()) >= least else 0
    model, *others = fit_folds(data, features, "__y", softmax(len(classes)), start, cuts, rounds, depth, fold="__fold", folds=calibrated)
    found = Classifier(model, classes, [])
    for fold, model in enumerate(others):
        raw = Classifier(model, classes, []).probabilities()
        seen = data.filter(F.col("__fold") == fold).select("__y", F.posexplode(raw).alias("k", "p"))
        tally = seen.groupBy("k", F.round("p", 3).alias("p")).agg(F.sum((F.col("__y") == F.col("k")).cast("long")).alias("hits"), F.count("*").alias("n")).collect()
        if not tally:
            continue
        steps = []
        for k in range(len(classes)):
            own = [r for r in tally if r.k == k]
            steps.append(isotonic(*[np.array([r[c] for r in own], float) for c in ("p", "hits", "n")]))
        found.folds.append((model, steps))
    data.unpersist()
    return found


def classified(df: DataFrame, found: Classifier) -> DataFrame:
    """df with p (by class), predicted and confidence; of equal probabilities the first class by name."""
    out = df.withColumn("p", found.probabilities())
    best = F.array_position("p", F.array_max("p")).cast("int") - 1
    return out.withColumn("predicted", F.get(F.lit(found.classes), best)).withColumn("confidence", F.array_max("p"))


def importance(df: DataFrame, model: Model, top: int | None = None) -> DataFrame:
    """feature, mean_abs_shap: the mean size of each feature's Shapley values over rows and outputs, largest first."""
    n = len(model.features)
    each = df.select(F.posexplode(model.shapley()).alias("at", "v")).groupBy((F.col("at") % n).alias("j")).agg(F.avg(F.abs("v")).alias("mean_abs_shap"))
    ranked = each.select(F.get(F.lit(model.features), F.col("j").cast("int")).alias("feature"), "mean_abs_shap").orderBy(F.desc("mean_abs_shap"), "feature")
    return ranked.limit(top) if top else ranked


def bounds(train: DataFrame, features: list[str], y: str, shares: tuple[float, float, float] = (0.05, 0.5, 0.95), rounds: int = 15, depth: int = 3, rate: float = 0.2) -> list[Model]:
    """A model for each share of the distribution of y, under its own pinball loss."""
    data = spread(train.select(*features, y)).persist()
    cuts = cuts_of(data, features)
    starts = data.approxQuantile(y, list(shares), 1e-3)
    found = [fit(data, features, y, pinball(s), [q], cuts, rounds, depth, rate) for s, q in zip(shares, starts)]
    data.unpersist()
    return found


def banded(df: DataFrame, models: list[Model]) -> DataFrame:
    """df with low, predicted and high: the pair is put in order where it crosses, and the middle is kept inside."""
    low, middle, high = (m.scores()[0] for m in models)
    out = df.withColumns({"low": low, "predicted": middle, "high": high})
    out = out.withColumns({"low": F.least("low", "high"), "high": F.greatest("low", "high")})
    return out.withColumn("predicted", F.greatest(F.col("low"), F.least("predicted", "high")))
