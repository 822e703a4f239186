"""Ranks and standard scores within peer groups, without a window over a group.

Groups are few and large, so no task may hold one. Equal values of a group are counted first; the distinct values are
cut into BUCKETS by approximate quantiles, which any value falls into by comparison alone, so ranks are exact however
rough the cuts are. A value's rank is what its group has in lower buckets (a sum over at most BUCKETS + 1 rows) and
what its bucket has below it (a window over one bucket). Ranks go back to the rows by group and value. The rows, the
counted values and the cuts are each written once and read from there: what the rows come from is computed once, and
both halves of a rank see the same buckets. A sketch's cuts depend on the order in which its parts arrive, so computing
them twice may give two.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.sources.tables import saved

BUCKETS = 128


def average_percentile(below: Column, ties: Column, known: Column) -> Column:
    """Average-rank percentile, 0 to 100."""
    return (below + 1 + (ties - 1) / 2) / known * 100


def below_percentile(below: Column, ties: Column, known: Column) -> Column:
    """Share of the group strictly below, 0 to 100."""
    return below / known * 100


def average_rank(below: Column, ties: Column, known: Column) -> Column:
    return below + 1 + (ties - 1) / 2


def _joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Null keys meet null keys."""
    named = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(named[f"__{k}"])
    return left.join(named, condition, how).drop(*[f"__{k}" for k in keys])


def _long(df: DataFrame, columns: list[str], values: list[str]) -> DataFrame:
    each = F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("value")) for v in values])
    return df.select(*columns, F.explode(each).alias("__m")).select(*columns, "__m.*")


def value_ranks(df: DataFrame, values: list[str], by: list[str]) -> DataFrame:
    """by, metric, value, below (rows of the group under it), ties (rows that share it), known (rows with a value)."""
    group = [*by, "metric"]
    counted = saved(_long(df, by, values).filter("value is not null").groupBy(*group, "value").agg(F.count("*").alias("ties")), "counted")
    cuts = saved(counted.groupBy(*group).agg(F.percentile_approx("value", [k / BUCKETS for k in range(1, BUCKETS)], 10_000).alias("cuts")), "cuts")
    placed = _joined(counted, cuts, group).withColumn("bucket", F.size(F.filter("cuts", lambda c: c < F.col("value")))).drop("cuts")
    lower = Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*group, "bucket").agg(F.sum("ties").alias("n"))
    totals = totals.select(*group, "bucket", F.coalesce(F.sum("n").over(lower), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy(*group)).alias("known"))
    inside = Window.partitionBy(*group, "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    within = placed.withColumn("within", F.coalesce(F.sum("ties").over(inside), F.lit(0)))
    return _joined(within, totals, [*group, "bucket"]).select(*group, "value", (F.col("before") + F.col("within")).alias("below"), "ties", "known")


def ranked(df: DataFrame, keys: list[str], values: dict[str, str], by: list[str], measure: Callable[[Column, Column, Column], Column] = average_percentile) -> DataFrame:
    """df with a column (key of values) for each value column (its value): a measure of its rank within by; null for
    null. keys tell rows apart and are never null."""
    names, rows = list(values.values()), saved(df, "peers")
    ranks = value_ranks(rows, names, by).select(*by, "metric", "value", measure(F.col("below"), F.col("ties"), F.col("known")).alias("measured"))
    whole = rows.withColumn("__row", F.struct(*df.columns))
    found = _joined(_long(whole, [*keys, *by, "__row"], names), ranks, [*by, "metric", "value"], "left")
    wide = found.groupBy(*keys).agg(F.any_value("__row").alias("__row"), *[F.max(F.when(F.col("metric") == v, F.col("measured"))).alias(new) for new, v in values.items()])
    return wide.select("__row.*", *values)


def standardised(df: DataFrame, values: list[str], by: list[str]) -> DataFrame:
    """df with z_<value>: (x - mean) / population deviation within the group; a deviation of 0 counts as 1. What is
    joined has a row per group and is broadcast: dealt by group, few tasks would sort all rows."""
    stats = df.groupBy(*by).agg(*[f(v).alias(f"__{n}_{v}") for v in values for n, f in (("mean", F.avg), ("dev", F.stddev_pop))])
    joined = _joined(df, F.broadcast(stats), by)
    scores = {f"z_{v}": (F.col(v) - F.col(f"__mean_{v}")) / F.when(F.col(f"__dev_{v}") == 0, 1.0).otherwise(F.col(f"__dev_{v}")) for v in values}
    return joined.withColumns(scores).drop(*[f"__{n}_{v}" for v in values for n in ("mean", "dev")])


def top_of(df: DataFrame, by: list[str], order: list[Column], top: int, parts: int = 64) -> DataFrame:
    """The first rows of each group in an order that the caller makes total. Each of parts of a group keeps its own
    first rows before these meet, so no task sorts a group."""
    spread = df.withColumn("__part", F.pmod(F.xxhash64(*df.columns), F.lit(parts)))
    some = spread.withColumn("__n", F.row_number().over(Window.partitionBy(*by, "__part").orderBy(*order))).filter(F.col("__n") <= top)
    return some.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("__n") <= top).drop("__n", "__part")
