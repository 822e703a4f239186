"""How good rankings, retrieval and models are: resampling, agreement, hits among the first k."""

from __future__ import annotations

from itertools import accumulate
from math import exp, factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import scalars as S


def share_of_hash(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone: the first eight hexadecimal digits of their MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def poisson_weight(share: Column, most: int = 8) -> Column:
    """How often a row is drawn by a resampling with replacement, from a number in [0, 1): Poisson of rate 1."""
    out = F.lit(0)
    for upto in accumulate(exp(-1) / factorial(k) for k in range(most)):
        out = out + (share >= F.lit(upto)).cast("int")
    return out


def bootstrap_mean(rows: DataFrame, key: str, value: str, draws: int = 200, seed: int = 42) -> DataFrame:
    """mean, low, high: a mean with its 2.5 and 97.5 percentiles over draws. Every row has a seeded Poisson weight in
    every draw, so draws are sums that are combined before they are shuffled and no row is looked up by a place."""
    spread = rows.select(key, F.col(value).cast("double").alias("v"), F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    weighed = spread.withColumn("w", poisson_weight(share_of_hash(F.lit(seed), F.col("draw"), F.col(key))))
    means = weighed.groupBy("draw").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("m"), F.avg("v").alias("mean"))
    return means.agg(F.max("mean").alias("mean"), F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))


def corrected(r: Column) -> Column:
    """A split-half correlation at full length, by Spearman and Brown."""
    return 2 * r / (1 + r)


def nearest_per_query(pool: DataFrame, queries: DataFrame, key: str, vector: str, top: int) -> DataFrame:
    """query, key, similarity, place: for each of a few stated queries (query, q) its first top rows of the pool, its own
    left out. Queries are broadcast, a stated set; every task keeps its own first rows of each before any are shuffled."""
    scored = pool.crossJoin(F.broadcast(queries)).filter(F.col(key) != F.col("query")).withColumn("similarity", S.cosine(F.col(vector), F.col("q"))).drop(vector, "q")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), key))
    return scored.withColumn("place", place).filter(F.col("place") <= top)


def split_by_key(key: Column, share: float, seed: int = 42) -> Column:
    """True for the share of keys that are held out, all rows of a key alike."""
    return share_of_hash(F.lit(seed), key) < F.lit(share)


def question_bank(templates: DataFrame, words: DataFrame, template: str, word: str, order: list[str]) -> DataFrame:
    """text and its order: every template with every word, the first of equal texts. Templates are a short written
    list and go to wherever the words are."""
    made = words.crossJoin(F.broadcast(templates)).withColumn("text", F.replace(F.col(template), F.lit("{}"), F.col(word)))
    first = F.row_number().over(Window.partitionBy("text").orderBy(*order))
    return made.withColumn("__n", first).filter("__n = 1").select("text", *order)
