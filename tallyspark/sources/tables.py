"""Tables in and out: parquet, CSV and JSON scans, keyed upserts, partition overwrite, guarded artifacts, vector
indexes, incremental loads, keyword columns."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def column_like(df: DataFrame, *keywords: str) -> str | None:
    """The first column whose name holds one of the keywords, in their order."""
    return next((c for k in keywords for c in df.columns if k in c.lower()), None)


def column_or(df: DataFrame, name: str, default) -> F.Column:
    return F.col(name) if name in df.columns else F.lit(default)


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new replace those of old with the same keys."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("__new")))
    return both.withColumn("__last", last).filter("__last = 1").drop("__new", "__last")


def overwrite_slices(df: DataFrame, path: str, by: list[str]) -> None:
    """Replaces the partitions that df has rows of and leaves the rest."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def artifact(spark: SparkSession, path: str) -> DataFrame | None:
    """A published table, None if it is absent or can't be read."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def unseen(incoming: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What an incremental load has still to do."""
    return incoming.join(done.select(*keys), keys, "left_anti")


def csv_table(spark: SparkSession, path: str, schema: str, dates: tuple[str, ...] = ()) -> DataFrame:
    """A CSV feed with a header; the columns of dates are read as text in the schema and become dates, null where their
    first ten characters are none."""
    read = spark.read.option("header", True).schema(schema).csv(path)
    return read.withColumns({c: F.substring(c, 1, 10).try_cast("date") for c in dates})


def valuations(players: DataFrame, values: DataFrame, key: str, at: str, reference: str, competitions: list[str]) -> DataFrame:
    """A row per player of the competitions: the valuation nearest to a date, the earlier of two as near, with what is
    known of the player, if anything is. values: key, at, value, competition; players: a row per key."""
    gap = F.abs(F.datediff(F.col(at), F.lit(reference).cast("date")))
    near = values.filter(F.col("competition").isin(competitions)).withColumn("__gap", gap)
    first = F.row_number().over(Window.partitionBy(key).orderBy("__gap", at, "value"))
    return near.withColumn("__n", first).filter("__n = 1").drop("__gap", "__n").join(players, key, "left")


def loaded(matches: DataFrame, competition: str, season: str, limit: int | None = None) -> DataFrame:
    """The matches of a competition and season, the first by id if a limit is given; an unknown pair is an error."""
    found = matches.filter((F.col("competition") == competition) & (F.col("season") == season))
    if found.isEmpty():
        raise ValueError(f"no matches of {competition} in {season}")
    return found if limit is None else found.orderBy("match_id").limit(limit)


def write_records(df: DataFrame, path: str) -> None:
    """A published table as JSON records, NaN as null."""
    plain = {f.name: F.when(~F.isnan(f.name), F.col(f.name)) for f in df.schema if f.dataType.typeName() in ("double", "float")}
    df.withColumns(plain).write.mode("overwrite").json(path)


def read_records(spark: SparkSession, path: str, schema) -> DataFrame | None:
    """Published records, None if there are none."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException:
        return None


def snapshot(spark: SparkSession, path: str) -> DataFrame | None:
    """One published JSON document, None if it is absent."""
    try:
        return spark.read.option("multiLine", True).json(path)
    except AnalysisException:
        return None


def vector_index(documents: DataFrame, key: str, text: str, embed, batch: int = 32) -> DataFrame:
    """documents with vector (array<float>): embed takes a list of texts and returns a vector for each, and is called
    with at most batch of them. It runs inside tasks, so it has to be something that can be sent there."""
    from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

    schema = StructType([*documents.schema.fields, StructField("vector", ArrayType(FloatType()))])

    def run(frames):
        for frame in frames:
            texts = frame[text].fillna("").tolist()
            frame["vector"] = [list(map(float, v)) for k in range(0, len(texts), batch) for v in embed(texts[k : k + batch])]
            yield frame

    return documents.mapInPandas(run, schema)


def save_index(index: DataFrame, path: str) -> None:
    """Replaces an index as a whole."""
    index.write.mode("overwrite").parquet(path)


def load_index(spark: SparkSession, path: str, rebuild=None) -> DataFrame | None:
    """An index of any age, attributes that its files lack being null; made anew by rebuild where there is none."""
    try:
        return spark.read.option("mergeSchema", True).parquet(path)
    except AnalysisException:
        return rebuild() if rebuild else None


def keep_loading(stream: DataFrame, path: str, checkpoint: str, by: list[str], replace: bool = True):
    """Loads what a file stream has not loaded yet and stops; the checkpoint remembers what is done.

    With replace a partition's rows come whole, as a match that is sent again does: each batch replaces the partitions
    that it has rows of, those of earlier batches too. Without it rows are added: a batch has a partition of its own
    (column load, its number) below each of by. Either way a batch that runs again leaves the same table."""

    def write(batch: DataFrame, number: int) -> None:
        if replace:
            overwrite_slices(batch, path, by)
        else:
            overwrite_slices(batch.withColumn("load", F.lit(number)), path, [*by, "load"])

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again, so that what is built on it neither repeats its work nor keeps
    its lineage."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, by spark.checkpoint.dir; one of our own only in local mode."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tallyspark-")
        sc.setCheckpointDir(found)
    return found
