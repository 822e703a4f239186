"""Boosted trees: what they learn, Shapley values against all subsets, quantile coverage, calibration."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.operators import boosting as B

RNG = np.random.default_rng(1)


def frame(spark, columns, names):
    return spark.createDataFrame([tuple(map(float, r)) for r in np.column_stack(columns)], ", ".join(f"{n} double" for n in names)).repartition(4)


@pytest.fixture(scope="module")
def regression(spark):
    x = RNG.normal(size=(1500, 3))
    y = 2 * (x[:, 0] > 0) + x[:, 0] * (x[:, 1] > 0.5) + 0.1 * RNG.normal(size=1500)
    df = frame(spark, [np.arange(1500), x, y], ["id", "a", "b", "c", "y"]).withColumn("b", F.when(F.col("id") % 9 != 0, F.col("b")))
    return df, B.fit(df, ["a", "b", "c"], "y", B.SQUARED, [0.0], B.cuts_of(df, ["a", "b", "c"]), rounds=6, depth=3)


def test_trees_learn_and_take_missing_values(regression):
    df, model = regression
    got = df.select("y", model.scores()[0].alias("p")).agg(F.avg((F.col("y") - F.col("p")) ** 2), F.var_pop("y")).first()
    assert got[0] < 0.12 * got[1]


def test_fit_is_the_same_however_rows_are_dealt(regression):
    df, model = regression
    again = B.fit(df.repartition(7), ["a", "b", "c"], "y", B.SQUARED, [0.0], model.cuts, rounds=2, depth=3)
    for one, two in zip(model.trees[0], again.trees[0]):
        assert (one.feature == two.feature).all() and (one.cut == two.cut).all() and one.value == pytest.approx(two.value)


def expected(tree, bins, known, node=0):
    """What a tree gives if only some features are known: unknown ones follow the rows that it was grown on."""
    if tree.feature[node] < 0:
        return tree.value[node]
    left, right = 2 * node + 1, 2 * node + 2
    if tree.feature[node] in known:
        return expected(tree, bins, known, right if bins[tree.feature[node]] > tree.cut[node] else left)
    return sum(tree.cover[c] / tree.cover[node] * expected(tree, bins, known, c) for c in (left, right) if tree.cover[c])


def test_shapley_values_equal_all_subsets_and_add_up(regression):
    df, model = regression
    rows = df.select("a", "b", "c", model.shapley().alias("phi"), model.scores()[0].alias("p")).collect()
    base = model.base()[0]
    assert all(sum(r.phi) == pytest.approx(r.p - base, abs=1e-9) for r in rows)
    for r in rows[:40]:
        bins = model.binned(np.array([[np.nan if v is None else v for v in (r.a, r.b, r.c)]], float))[0]
        for j in range(3):
            others, want = [k for k in range(3) if k != j], 0.0
            for size in range(3):
                for some in combinations(others, size):
                    weight = factorial(size) * factorial(2 - size) / factorial(3)
                    want += weight * sum(expected(t, bins, {*some, j}) - expected(t, bins, set(some)) for t in model.trees[0])
            assert r.phi[j] == pytest.approx(want, abs=1e-9)
    ranked = [r.feature for r in B.importance(df, model).collect()]
    assert ranked == ["a", "b", "c"]


def test_quantile_bounds_cover_what_they_say(spark):
    def made(n, first):
        x = RNG.uniform(-1, 1, size=(n, 2))
        return frame(spark, [np.arange(first, first + n), x, x[:, 0] + (1 + x[:, 1]) * RNG.normal(size=n)], ["id", "a", "b", "y"])

    models = B.bounds(made(6000, 0), ["a", "b"], "y")
    unseen = B.banded(made(4000, 10_000), models)
    got = unseen.agg(F.avg(((F.col("y") >= F.col("low")) & (F.col("y") <= F.col("high"))).cast("int")), F.min(F.col("predicted") - F.col("low")), F.min(F.col("high") - F.col("predicted")), F.stddev(F.col("high") - F.col("low"))).first()
    assert abs(got[0] - 0.9) <= 0.02 and got[1] >= 0 and got[2] >= 0 and got[3] > 0.5


@pytest.fixture(scope="module")
def classes(spark):
    centre = np.array([[0, 0], [2, 0], [0, 2.5]])
    label = RNG.choice(3, p=[0.6, 0.3, 0.1], size=1600)
    x = centre[label] + RNG.normal(size=(1600, 2))
    df = frame(spark, [np.arange(1600), x, label], ["id", "a", "b", "k"])
    return df.withColumn("name", F.get(F.array(F.lit("back"), F.lit("mid"), F.lit("wing")), F.col("k").cast("int")))


def test_classifier_splits_by_class_and_is_calibrated(classes):
    split = B.stratified(classes, "name", ["id"])
    shares = split.groupBy("name").agg(F.avg(F.col("is_test").cast("int")).alias("s"), F.count("*").alias("n")).collect()
    assert all(abs(r.s - 0.25) <= 1.5 / r.n + 1e-3 for r in shares)
    found = B.classifier(split.filter("not is_test"), ["a", "b"], "name", ["id"])
    assert found.classes == ["back", "mid", "wing"] and len(found.folds) == 3
    out = B.classified(split.filter("is_test"), found).cache()
    whole = F.aggregate("p", F.lit(0.0), lambda s, x: s + x)
    assert out.filter(F.abs(whole - 1) > 1e-9).count() == 0
    got = out.agg(F.avg((F.col("name") == F.col("predicted")).cast("int")), F.avg("confidence")).first()
    assert got[0] > 0.8 and abs(got[0] - got[1]) < 0.06


def test_a_class_too_small_is_not_calibrated(classes):
    some = classes.filter("name <> 'wing'").unionByName(classes.filter("name = 'wing'").limit(2))
    found = B.classifier(some, ["a", "b"], "name", ["id"], rounds=2)
    assert found.folds == [] and found.classes == ["back", "mid", "wing"]
    one = B.classifier(classes.filter("name = 'mid'"), ["a", "b"], "name", ["id"], rounds=1)
    assert one.folds == [] and B.classified(classes, one).filter("predicted <> 'mid' or confidence <> 1").count() == 0


def test_isotonic_pools_what_is_out_of_order():
    x, level = B.isotonic(np.array([0.1, 0.2, 0.3, 0.4]), np.array([1.0, 0, 4, 2]), np.array([2.0, 2, 4, 2]))
    assert x.tolist() == [0.1, 0.2, 0.3, 0.4] and level.tolist() == [0.25, 0.25, 1.0, 1.0]


def test_folds_that_grow_together_equal_those_grown_apart_in_as_many_jobs_as_one(spark):
    rows = spark.range(600).select((F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 11).cast("double").alias("b"), ((F.col("id") * 5 + 2) % 7 % 3).cast("double").alias("y"), (F.col("id") % 3).cast("int").alias("f")).persist()
    cuts, loss, start = B.cuts_of(rows, ["a", "b"]), B.softmax(3), [-1.0, -1.0, -1.0]
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("together", "")
    together = B.fit_folds(rows, ["a", "b"], "y", loss, start, cuts, 2, 2, fold="f", folds=3)
    spark.sparkContext.setJobGroup("alone", "")
    apart = [B.fit(rows, ["a", "b"], "y", loss, start, cuts, 2, 2)]
    assert len(tracker.getJobIdsForGroup("together")) == len(tracker.getJobIdsForGroup("alone"))
    apart += [B.fit(rows.filter(F.col("f") != f), ["a", "b"], "y", loss, start, cuts, 2, 2) for f in range(3)]
    for one, other in zip(together, apart):
        for trees, others in zip(one.trees, other.trees):
            for t, o in zip(trees, others):
                assert t.feature.tolist() == o.feature.tolist() and t.cut.tolist() == o.cut.tolist() and t.cover.tolist() == o.cover.tolist()
                assert t.value.tolist() == pytest.approx(o.value.tolist())
