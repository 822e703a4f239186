"""Window operators: first rows, weighted scores, running form, splits in time, similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import scalars as S
from tallyspark.operators.peers import standardised


def weighted_score(percentiles: dict[str, Column], weights: dict[str, float]) -> Column:
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + F.coalesce(percentiles[name], F.lit(0.0)) * F.lit(weight)
    return total


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in an order that the caller makes total."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def ranked(df: DataFrame, score: Column, order: list[Column], top: int) -> DataFrame:
    return df.withColumn("score", score).orderBy(F.desc("score"), *order).limit(top)


def running_means(sides: DataFrame, by: list[str], order: list[str], values: list[str], least: int) -> DataFrame:
    """Means of a side's earlier rows only; sides with fewer than least of them are dropped."""
    earlier = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = sides.withColumn("prior", F.count("*").over(earlier))
    for v in values:
        out = out.withColumn(f"mean_{v}", F.sum(v).over(earlier).cast("double") / F.col("prior"))
    return out.filter(F.col("prior") >= least)


def time_split(df: DataFrame, by: list[str], at: str, keys: list[str], share: float = 0.7) -> DataFrame:
    """df with is_test: from the share-th row of each group on, in order of the time at, then of keys.

    Rows are counted by day; the day in which a group's share ends follows from a sum over its days, and only rows of
    that day are put in order, so no group is sorted.
    """
    dated = df.withColumn("__day", F.to_date(at))
    days = dated.groupBy(*by, "__day").agg(F.count("*").alias("n"))
    upto = Window.partitionBy(*by).orderBy("__day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    days = days.withColumn("upto", F.sum("n").over(upto)).withColumn("cut", F.floor(F.sum("n").over(Window.partitionBy(*by)) * F.lit(share)))
    last = days.filter("upto > cut and upto - n <= cut").select(*by, F.col("__day").alias("__last"), (F.col("cut") - F.col("upto") + F.col("n")).alias("__rest"))
    joined = dated.join(last, by, "left").withColumn("__cut", F.coalesce(F.col("__day") == F.col("__last"), F.lit(False)))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(at, *keys)) - 1  # of the rows of one day
    cut = joined.filter("__cut").withColumn("is_test", place >= F.col("__rest"))
    other = joined.filter("not __cut").withColumn("is_test", F.coalesce(F.col("__day") > F.col("__last"), F.lit(False)))
    return cut.unionByName(other).drop("__day", "__last", "__rest", "__cut")


def similar(df: DataFrame, target: Column, keys: list[str], features: list[str], by: list[str], top: int, minutes: str) -> DataFrame:
    """Rows of the target's group by cosine of standard scores. The target is the row with most minutes of those that
    target names, the first by keys on a tie; its own key's rows and repeats of a key drop out."""
    scored = standardised(df, features, by)
    scored = scored.select(*keys, *by, minutes, target.alias("__target"), F.array(*[F.col(f"z_{f}") for f in features]).alias("__v"))
    one = scored.filter("__target").orderBy(F.desc(minutes), *keys).limit(1).select(*by, F.col("__v").alias("__t"), F.col(keys[0]).alias("__key"))
    near = scored.join(F.broadcast(one), by).filter(F.col(keys[0]) != F.col("__key"))  # one row
    near = first_by(near.withColumn("similarity", S.cosine(F.col("__t"), F.col("__v"))), keys[:1], [F.desc("similarity"), *map(F.col, keys)])
    return near.select(*keys, "similarity").orderBy(F.desc("similarity"), *keys).limit(top)
