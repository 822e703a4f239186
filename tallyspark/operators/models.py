"""Models on Spark ML: team strengths, outcomes, positions, values. Their figures are this library's own."""

from __future__ import annotations

from math import exp

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression, IsotonicRegression, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.operators.evaluation import split_by_key
from tallyspark.sources.tables import saved


def _assembled(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="raw", handleInvalid="skip").transform(df)


def outcome_model(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Rows with p_* per class: standardised multinomial logistic regression fitted on rows where is_test is false. Rows are
    written first, so that the fits and the prediction don't make them again; the training rows are kept for both fits."""
    data = _assembled(saved(df, "rows"), features)
    train = data.filter("not is_test").persist()
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(train)
    model = LogisticRegression(labelCol=label, maxIter=50, regParam=0.01).fit(scaler.transform(train))
    train.unpersist()
    return model.transform(scaler.transform(data)).withColumn("p", vector_to_array("probability")).drop("raw", "features", "rawPrediction", "probability")


def classify(df: DataFrame, features: list[str], label: str, key: str, least: int = 10, held_out: float = 0.25, seed: int = 42) -> DataFrame:
    """Rows of classes with at least `least` rows, with is_test, predicted class, confidence and p (an array by class in
    order of name). A share of keys is held out whole; the forest is fitted on the other rows. Each class's probability
    is calibrated by an isotonic regression that a further fifth of the training keys, which the forest does not see,
    is put aside for; what is calibrated is brought back to a sum of 1. df is written first and read from there, as its
    classes, their index and the rows come from it."""
    df = saved(df, "classed")
    common = df.groupBy(label).count().filter(F.col("count") >= least).select(label)
    data = _assembled(df.join(common, label, "left_semi"), features).withColumnRenamed("raw", "features")
    data = data.withColumn("is_test", split_by_key(F.col(key), held_out, seed)).withColumn("__aside", split_by_key(F.col(key), 0.2, seed + 1))
    indexer = StringIndexer(inputCol=label, outputCol="__y", stringOrderType="alphabetAsc").fit(data)
    data = indexer.transform(data).persist()
    model = RandomForestClassifier(labelCol="__y", numTrees=20, maxDepth=6, seed=seed).fit(data.filter("not is_test and not __aside"))
    out = model.transform(data).withColumn("p", vector_to_array("probability"))
    aside = out.filter("not is_test and __aside").persist()
    for k in range(len(indexer.labels)):
        pairs = aside.select(F.when(F.col("__y") == k, 1.0).otherwise(0.0).alias("label"), F.col("p")[k].alias("features"))
        fitted = IsotonicRegression(predictionCol=f"__c{k}").fit(pairs)
        out = fitted.transform(out.drop("features").withColumn("features", F.col("p")[k]))
    aside.unpersist()
    calibrated = F.array(*[F.greatest(F.col(f"__c{k}"), F.lit(1e-9)) for k in range(len(indexer.labels))])
    whole = F.aggregate(calibrated, F.lit(0.0), lambda s, x: s + x)
    out = out.withColumn("p", F.transform(calibrated, lambda x: x / whole))
    names = F.array(*[F.lit(x) for x in indexer.labels])
    best = F.array_position(F.col("p"), F.array_max("p")).cast("int") - 1
    out = out.withColumn("predicted", F.get(names, best)).withColumn("confidence", F.array_max("p"))
    return out.drop("features", "rawPrediction", "probability", "__y", "prediction", "__aside", *[f"__c{k}" for k in range(len(indexer.labels))])


def shortlist(p: Column, names: list[str], top: int = 3) -> Column:
    """The top classes of an array of probabilities: name and p, likeliest first, equal ones by name."""
    each = F.zip_with(p, F.array(*map(F.lit, names)), lambda x, n: F.struct((-x).alias("down"), n.alias("name"), x.alias("p")))
    return F.transform(F.slice(F.array_sort(each), 1, top), lambda s: F.struct(s["name"].alias("name"), s["p"].alias("p")))


def importance(df: DataFrame, features: list[str], label: str, seed: int = 42) -> DataFrame:
    """feature, importance: how much each feature lowers a forest's impurity. Not Shapley values, which Spark lacks."""
    data = StringIndexer(inputCol=label, outputCol="__y", stringOrderType="alphabetAsc").fit(df).transform(_assembled(df, features).withColumnRenamed("raw", "features"))
    found = RandomForestClassifier(labelCol="__y", numTrees=20, maxDepth=6, seed=seed).fit(data).featureImportances.toArray().tolist()
    return df.sparkSession.createDataFrame(list(zip(features, found)), "feature string, importance double").orderBy(F.desc("importance"), "feature")


def team_strengths(goals: DataFrame, shrink: float = 1e-3) -> tuple[DataFrame, float]:
    """team, played, attack, defence, strongest attack first, and the factor that playing at home puts on goals: a
    Poisson regression of goals on the side's team, the other's and the place, from rows (team, opponent, goals,
    is_home). Attack and defence are differences to the mean team; a good defence is above 0. Rows are added up by sides
    and place and written first: the fit needs no more of them than how many there are and their mean, so its turns read
    pairs of teams and not matches. What comes to the driver is a coefficient per team; Spark fits up to 4096 of them."""
    sides = [F.col("team").cast("string").alias("team"), F.col("opponent").cast("string").alias("opponent"), F.col("is_home").cast("double").alias("home")]
    at = saved(goals.groupBy(*sides).agg(F.count("*").cast("double").alias("n"), F.avg("goals").alias("label")), "pairs")
    teams = at.select("team").unionByName(at.select(F.col("opponent").alias("team"))).distinct()
    indexer = StringIndexer(inputCol="team", outputCol="i", stringOrderType="alphabetAsc").fit(teams)
    coded = indexer.setInputCol("team").setOutputCol("a").transform(at)
    coded = indexer.setInputCol("opponent").setOutputCol("d").transform(coded)
    n = len(indexer.labels)
    encoder = OneHotEncoder(inputCols=["a", "d"], outputCols=["av", "dv"], dropLast=False).fit(indexer.setInputCol("team").setOutputCol("a").transform(teams).withColumn("d", F.col("a")))
    data = VectorAssembler(inputCols=["av", "dv", "home"], outputCol="features").transform(encoder.transform(coded)).select("features", "label", "n").persist()
    model = GeneralizedLinearRegression(family="poisson", link="log", weightCol="n", regParam=shrink, maxIter=50).fit(data)
    data.unpersist()
    c = model.coefficients.toArray()
    attack, defence = c[:n] - c[:n].mean(), -(c[n : 2 * n] - c[n : 2 * n].mean())
    found = goals.sparkSession.createDataFrame([(t, float(x), float(y)) for t, x, y in zip(indexer.labels, attack, defence)], "team string, attack double, defence double")
    played = at.groupBy("team").agg(F.sum("n").cast("long").alias("played"))
    return found.join(played, "team").orderBy(F.desc("attack"), "team"), exp(float(c[2 * n]))


_STRENGTH = [T.StructField("team", T.StringType()), T.StructField("played", T.LongType()), *[T.StructField(n, T.DoubleType()) for n in ("attack", "defence", "home")]]


def strengths_by_scope(goals: DataFrame, scope: str, shrink: float = 1e-3, turns: int = 50) -> DataFrame:
    """scope, team, played, attack, defence, home: a Poisson regression as team_strengths, in each scope by itself, all
    scopes at once. Rows (scope, team, opponent, goals, is_home) are first added up by sides and place, as the fit needs
    no more of them, so what meets in a task are a scope's pairs of teams and not its matches. It minimises the mean
    deviance / 2 plus shrink / 2 times the squares of all coefficients but the intercept, by Newton's method, which the
    penalty gives one lowest point. attack and defence are differences to the scope's mean team; home is the factor on
    goals. Rows without a scope, team or opponent have no part."""
    named = goals.select(F.col(scope).alias("scope"), *[F.col(c).cast("string").alias(c) for c in ("team", "opponent")], F.col("is_home").cast("double").alias("home"), F.col("goals").cast("double").alias("goals"))
    pairs = named.dropna(subset=["scope", "team", "opponent", "goals"]).groupBy("scope", "team", "opponent", "home").agg(F.count("*").cast("double").alias("n"), F.sum("goals").alias("y"))
    kind = pairs.schema["scope"]

    def fitted(key, table):
        names = sorted({*table.column("team").to_pylist(), *table.column("opponent").to_pylist()})
        at, t = {name: k for k, name in enumerate(names)}, len(names)
        rows, (n, y) = np.arange(table.num_rows), (table.column(c).to_numpy() for c in ("n", "y"))
        own = np.array([at[x] for x in table.column("team").to_pylist()])
        x = np.zeros((table.num_rows, 2 * t + 2))
        x[rows, own] = 1
        x[rows, t + np.array([at[o] for o in table.column("opponent").to_pylist()])] = 1
        x[:, 2 * t], x[:, 2 * t + 1] = table.column("home").to_numpy(), 1
        ridge = np.full(2 * t + 2, shrink)
        ridge[-1] = 0
        b = np.zeros(2 * t + 2)
        b[-1] = np.log(max(y.sum(), 0.5) / n.sum())
        cost = lambda b: (n @ np.exp(np.minimum(x @ b, 50)) - y @ (x @ b)) / n.sum() + ridge @ (b * b) / 2
        for _ in range(turns):
            mean = n * np.exp(np.minimum(x @ b, 50))
            slope = x.T @ (mean - y) / n.sum() + ridge * b
            step = np.linalg.solve((x.T * mean) @ x / n.sum() + np.diag(ridge + 1e-12), slope)
            size = 1.0
            while size > 1e-6 and cost(b - size * step) > cost(b):
                size /= 2
            b = b - size * step
            if np.abs(size * step).max() < 1e-10:
                break
        played = np.bincount(own, n, minlength=t)
        keep = np.flatnonzero(played)
        attack, defence = b[:t] - b[:t].mean(), -(b[t : 2 * t] - b[t : 2 * t].mean())
        count = len(keep)
        return pa.table({"scope": pa.array([key[0].as_py()] * count, table.column("scope").type), "team": [names[k] for k in keep], "played": pa.array(played[keep].astype(np.int64)), "attack": attack[keep], "defence": defence[keep], "home": np.full(count, np.exp(b[2 * t]))})

    return pairs.groupBy("scope").applyInArrow(fitted, T.StructType([kind, *_STRENGTH]))


def value_model(df: DataFrame, features: list[str], value: str, key: str, held_out: float = 0.25, seed: int = 42) -> DataFrame:
    """Rows with is_test, predicted, predicted_low, predicted_high and residual: boosted trees on log1p, fitted on the
    keys that are not held out. The bounds add the 5 and 95 percentiles of residuals of a fifth of the training keys
    which the trees don't see, so a band covers nine in ten of what is alike; bounds never cross the prediction."""
    data = _assembled(df.withColumn("__y", F.log1p(value)), features).withColumnRenamed("raw", "features")
    data = data.withColumn("is_test", split_by_key(F.col(key), held_out, seed)).withColumn("__aside", split_by_key(F.col(key), 0.2, seed + 1)).persist()
    out = GBTRegressor(labelCol="__y", maxIter=10, maxDepth=4, seed=seed).fit(data.filter("not is_test and not __aside")).transform(data)
    spread = out.filter("not is_test and __aside").select((F.col("__y") - F.col("prediction")).alias("r"))
    low, high = spread.approxQuantile("r", [0.05, 0.95], 0.001) or (0.0, 0.0)
    at = lambda shift: F.bround(F.greatest(F.expm1(F.col("prediction") + shift), F.lit(0.0)), 0)
    out = out.withColumns({"predicted": at(0.0), "predicted_low": at(min(low, 0.0)), "predicted_high": at(max(high, 0.0))})
    return out.withColumn("residual", F.col(value) - F.col("predicted")).drop("features", "__y", "prediction", "__aside")


def linear_fit(df: DataFrame, x: str, y: str) -> LinearRegression:
    return LinearRegression(labelCol=y).fit(VectorAssembler(inputCols=[x], outputCol="features").transform(df))
