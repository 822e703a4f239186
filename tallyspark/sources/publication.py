"""Publishing a set of tables as one: written aside, audited, and made visible together by one manifest."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.sources.tables import artifact

_MANIFEST = "number long, run string, pool long, model string, built timestamp, tables array<struct<name: string, rows: long>>"


class Refused(ValueError):
    """An audit found rows that break a rule, or a table without rows."""


@dataclass(frozen=True)
class Artifact:
    """A table to publish. rules: name of a rule to what must hold in every row (null counts as broken); empty tables
    are refused unless they may be."""

    rows: DataFrame
    rules: dict[str, Column] = field(default_factory=dict)
    may_be_empty: bool = False


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Every set that was published, none if there is none: number, run, pool, model, built and tables (name, rows)."""
    found = artifact(spark, f"{folder}/manifest")
    return spark.createDataFrame([], _MANIFEST) if found is None else found


def current(spark: SparkSession, folder: str):
    """The last manifest as a row, None before the first. Of two that were published at once under one number the
    larger run counts, for every reader alike."""
    return manifest(spark, folder).orderBy(F.desc("number"), F.desc("run")).first()


def publish(spark: SparkSession, folder: str, artifacts: dict[str, Artifact], pool: int, model: str) -> str:
    """Writes the tables below a run's own folder, audits what was written, and then appends one manifest of one row,
    which is one file and appears by one rename. Until then, and if anything fails, readers see the set before it.
    pool is the number of rows that the set was made from."""
    last = current(spark, folder)
    run, sizes = uuid.uuid4().hex, []
    for name, made in artifacts.items():
        path = f"{folder}/runs/{run}/{name}"
        made.rows.write.parquet(path)
        broken = [F.count(F.when(F.coalesce(rule, F.lit(False)), None).otherwise(1)).alias(f"__{k}") for k, rule in enumerate(made.rules.values())]
        found = spark.read.schema(made.rows.schema).parquet(path).agg(F.count("*").alias("__rows"), *broken).first()
        bad = {rule: found[f"__{k}"] for k, rule in enumerate(made.rules) if found[f"__{k}"]}
        if bad or (not found["__rows"] and not made.may_be_empty):
            raise Refused(f"{name}: {bad or 'no rows'}")
        sizes.append((name, found["__rows"]))
    row = spark.createDataFrame([(0 if last is None else last.number + 1, run, pool, model, None, sizes)], _MANIFEST)
    row.withColumn("built", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{folder}/manifest")
    return run


def published(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """A table of the current set, None if nothing is published or the set has no such table."""
    last = current(spark, folder)
    if last is None or name not in {t.name for t in last.tables}:
        return None
    return spark.read.parquet(f"{folder}/runs/{last.run}/{name}")


def changed(pool: Column, fitted_on: Column) -> Column:
    """Whether a pool differs from the one a set was made from by more than five rows and a fiftieth of it."""
    return F.coalesce(F.abs(pool - fitted_on) > F.greatest(F.lit(5.0), pool * 0.02), F.lit(True))


def stale(spark: SparkSession, folder: str, pool: DataFrame, model: str) -> DataFrame:
    """One row: pool (rows now), fitted_on, model (by which the set was made), stale and mismatched (made by another
    model). Without a set both are true."""
    last = manifest(spark, folder).orderBy(F.desc("number"), F.desc("run")).limit(1).select(F.col("pool").alias("fitted_on"), "model")
    both = pool.agg(F.count("*").alias("pool")).join(last, F.lit(True), "left")  # one row each
    return both.select("pool", "fitted_on", "model", changed(F.col("pool"), F.col("fitted_on")).alias("stale"), (~F.col("model").eqNullSafe(F.lit(model))).alias("mismatched"))
