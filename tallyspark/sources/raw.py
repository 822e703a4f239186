"""Raw event feeds: nested JSON read by a schema, records that don't parse set apart, and versions that supersede older
ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions import scalars as S

_NAMED = "struct<id: long, name: string>"
#: What is read of an event; everything else in it is skipped by the parser.
EVENT = f"""id string, index long, type {_NAMED}, player {_NAMED}, team {_NAMED}, location array<double>,
pass struct<type: {_NAMED}, outcome: {_NAMED}, end_location: array<double>>, carry struct<end_location: array<double>>,
shot struct<xg: double, type: {_NAMED}, outcome: {_NAMED}, body_part: {_NAMED}>"""
#: What the parser leaves of a record that it can't read.
CORRUPT = "corrupt"


def event_files(spark: SparkSession, path: str, schema: str = EVENT) -> DataFrame:
    """A folder of JSON lines by match_id and version (match_id=7/version=2/...), an event each, with corrupt: the line
    where it is no event, else null. Matches and versions that a filter excludes are not opened."""
    lines = spark.read.schema("value string, match_id long, version int").text(path)
    return event_texts(lines.withColumnRenamed("value", "__line"), "__line", schema)


def event_texts(lines: DataFrame, line: str, schema: str = EVENT) -> DataFrame:
    """The same for lines in a column: the other columns, the event's and corrupt. A null line is corrupt too, with
    the empty string."""
    parsed = F.from_json(F.coalesce(F.col(line), F.lit("")), f"{schema}, {CORRUPT} string", {"columnNameOfCorruptRecord": CORRUPT})
    rest = [F.col(c) for c in lines.columns if c != line]
    read = lines.withColumn("__event", parsed)
    unread = F.col("__event").isNull() | (F.coalesce(F.col(f"__event.{CORRUPT}"), F.lit("")) != "")
    broken = F.when(unread | (F.trim(F.coalesce(F.col(line), F.lit(""))) == ""), F.coalesce(F.col(line), F.lit("")))
    names = [f.name for f in read.schema["__event"].dataType.fields if f.name != CORRUPT]
    return read.select(*rest, *[F.col(f"__event.{n}") for n in names], broken.alias(CORRUPT))


def newest(records: DataFrame, key: str = "match_id", version: str = "version") -> DataFrame:
    """The records of each key's highest version. The versions of a key are counted first, so its records meet in no
    window; rows without a key or a version stand for nothing and go."""
    last = records.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(version).alias("__last"))
    return records.join(last, key).filter(F.col(version) == F.col("__last")).drop("__last")


def outdated(wanted: DataFrame, stored: DataFrame, version: int, key: str = "match_id") -> DataFrame:
    """The keys of wanted that have to be fetched: those that stored lacks or has by other versions only."""
    have = stored.filter(F.col("version") == version).select(key).distinct()
    return wanted.select(key).distinct().join(have, key, "left_anti")


def _place(at: Column) -> Column:
    """Whether a location has both its coordinates."""
    return F.coalesce(F.size(at) >= 2, F.lit(False)) & F.get(at, F.lit(0)).isNotNull() & F.get(at, F.lit(1)).isNotNull()


def actions(events: DataFrame, keys: list[str]) -> DataFrame:
    """Events with a player and a place as `matches.reduced_events` takes them: keys, player, team, seq, x, y, move and
    shot. A move is an open-play pass or a carry, completed if it arrives and its end is known; a shot has its chance
    (0 if unknown), outcome, penalty (0 or 1) and body part."""
    move = S.open_play_move(F.col("type.name"), F.col("pass.type.name"), F.col("pass.outcome"), F.col("pass.end_location"), F.col("carry.end_location"))
    ends = F.when(_place(F.col("__move.end")), F.col("__move.end"))
    struct = F.when(
        F.col("__move").isNotNull(),
        F.struct(F.get(ends, F.lit(0)).alias("end_x"), F.get(ends, F.lit(1)).alias("end_y"), F.col("__move.completed").alias("completed")),
    )
    shot = F.when(
        F.col("type.name") == "Shot",
        F.struct(
            F.coalesce(F.col("shot.xg"), F.lit(0.0)).alias("xg"),
            S.recoded(F.col("shot.outcome.name"), S.SHOT_OUTCOMES).alias("outcome"),
            F.coalesce(F.col("shot.type.name") == "Penalty", F.lit(False)).cast("int").alias("penalty"),
            S.recoded(F.col("shot.body_part.name"), S.BODY_PARTS).alias("body"),
        ),
    )
    usable = events.filter(F.col("player.id").isNotNull() & _place(F.col("location"))).withColumn("__move", move)
    return usable.select(
        *keys, F.col("player.id").alias("player"), F.col("team.id").alias("team"), F.col("index").alias("seq"),
        F.col("location")[0].alias("x"), F.col("location")[1].alias("y"), struct.alias("move"), shot.alias("shot"),
    )


def summed(reduced: DataFrame, keys: list[str]) -> DataFrame:
    """keys, actions, moves, completed, shots, goals, penalties, headers and chances: what `actions` add up to."""
    count = lambda c: F.count(F.when(c, 1))
    return reduced.groupBy(*keys).agg(
        F.count("*").alias("actions"), count(F.col("move").isNotNull()).alias("moves"), count(F.col("move.completed") & F.col("move.end_x").isNotNull()).alias("completed"),
        count(F.col("shot").isNotNull()).alias("shots"), count(F.col("shot.outcome") == "goal").alias("goals"), count(F.col("shot.penalty") == 1).alias("penalties"),
        count(F.col("shot.body") == "head").alias("headers"), F.coalesce(F.sum(F.bround("shot.xg", 3)), F.lit(0.0)).alias("chances"),
    )

