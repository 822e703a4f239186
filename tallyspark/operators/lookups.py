"""Joins that attach what is known of an entity: ages, genders, roles, names, and counts of what is not known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.operators.windows import first_by


def season_spans(matches: DataFrame, keys: list[str], at: str) -> DataFrame:
    """keys, first, last, midpoint (seconds): when a season was played."""
    seconds = F.unix_timestamp(F.col(at).cast("timestamp"))
    spans = matches.groupBy(*keys).agg(F.min(seconds).alias("first"), F.max(seconds).alias("last"))
    return spans.withColumn("midpoint", F.col("first") + (F.col("last") - F.col("first")) / 2)


def age_at_season(frame: DataFrame, spans: DataFrame, keys: list[str], birth: str) -> DataFrame:
    """frame with age: years of 365 days from a birth date to the middle of the season, to one decimal; null where
    either is unknown."""
    joined = frame.join(spans.select(*keys, "midpoint"), keys, "left")
    days = (F.col("midpoint") - F.unix_timestamp(F.col(birth).cast("timestamp"))) / 86400
    return joined.withColumn("age", F.bround(days / 365, 1)).drop("midpoint")


def one_value(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key and its smallest known value: one row per key where any would do."""
    return rows.groupBy(key).agg(F.min(value).alias(value))


def labelled(rows: DataFrame, names: DataFrame, key: str, name: str, default: Column) -> DataFrame:
    """rows with the name of their key, or a default where it has none."""
    return rows.join(names.select(key, name), key, "left").withColumn(name, F.coalesce(name, default))


def by_first_known_name(rows: DataFrame, lookup: DataFrame, nickname: str, name: str, value: str) -> DataFrame:
    """rows with the lookup's value for the nickname, else for the name. A nickname that the lookup has decides, even
    if its value is null. lookup: key, value, a row per key."""
    hit = lambda n: lookup.select(F.col("key").alias(f"__{n}"), F.col(value).alias(f"__{n}_value"), F.lit(True).alias(f"__{n}_hit"))
    joined = rows.join(hit("nick"), F.col(nickname) == F.col("__nick"), "left").join(hit("full"), F.col(name) == F.col("__full"), "left")
    found = F.when(F.col("__nick_hit"), F.col("__nick_value")).otherwise(F.col("__full_value"))
    return joined.withColumn(value, found).drop(*[f"__{n}{x}" for n in ("nick", "full") for x in ("", "_value", "_hit")])


def fill_report(players: DataFrame, known: DataFrame, key: str, column: str, check: Column, eligible: Column) -> DataFrame:
    """One row: matched (filled by a known value that passes its check), unmatched (null, eligible, nothing to fill it
    with) and outside (null and not eligible)."""
    right = known.select(F.col(key).alias("__key"), F.when(check, F.col(column)).alias("__known"))
    empty = players.filter(F.col(column).isNull()).join(right, F.col(key) == F.col("__key"), "left")
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    return empty.agg(
        count(eligible & F.col("__known").isNotNull()).alias("matched"), count(eligible & F.col("__known").isNull()).alias("unmatched"), count(~eligible).alias("outside")
    )


def role_of_busiest(seasons: DataFrame, player: str, minutes: str, order: list[str], position: str, role: Column) -> DataFrame:
    """player, role: of the season with most minutes; no role where its position is unknown."""
    busiest = first_by(seasons, [player], [F.desc(minutes), *map(F.col, order)])
    return busiest.select(player, F.when(F.col(position).isNotNull(), role).alias("role"))


def unknown_dropped(index: DataFrame, unknown: dict[str, Column]) -> DataFrame:
    """attribute, n: rows of the whole index that lack it, for attributes that some row has and some row lacks."""
    counts = index.agg(F.count("*").alias("__all"), *[F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).alias(n) for n, c in unknown.items()])
    each = F.array(*[F.struct(F.lit(n).alias("attribute"), F.col(n).alias("n")) for n in unknown])
    return counts.select("__all", F.explode(each).alias("x")).select("__all", "x.*").filter("n > 0 and n < __all").drop("__all")


def played_in(matches: DataFrame, order: list[str]) -> DataFrame:
    """team, competition: of its last match, an away match overriding any at home."""
    side = lambda c, rank: matches.select(F.col(c).alias("team"), "competition", F.lit(rank).alias("__rank"), *order)
    both = side("home", 0).unionByName(side("away", 1))
    return both.groupBy("team").agg(F.max_by("competition", F.struct("__rank", *order)).alias("competition"))
