"""Filling what players lack from the line-ups of matches, by a scan that visits where most is missing first, stops when
nothing is, and goes on where it was ended."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.sources.tables import artifact, overwrite_slices, saved


@dataclass(frozen=True)
class Scan:
    """What a run of the scan did: matches read, players seen and those left that no read match lists."""

    matches: int
    seen: int
    pending: int


def lacking(players: DataFrame, fields: list[str]) -> DataFrame:
    """player of those with a null among fields."""
    return players.filter(F.greatest(*[F.col(c).isNull() for c in fields], F.lit(False))).select("player")


def _portions(matches: DataFrame, portion: int) -> dict:
    """Upper ends of match_id for each competition's portions of about `portion` matches, the last one open. They only
    cut the work, so that approximate quantiles do."""
    sizes = matches.groupBy("competition").agg(F.count("*").alias("n"))
    most = sizes.agg(F.max(F.ceil(F.col("n") / portion))).first()[0] or 0
    if most < 2:
        return {r.competition: [None] for r in sizes.select("competition").collect()}
    steps = [k / most for k in range(1, most)]
    ends = matches.groupBy("competition").agg(F.count("*").alias("n"), F.percentile_approx("match_id", steps, 10000).alias("at"))
    cuts = {r.competition: (r.n, r["at"]) for r in ends.collect()}  # a row per competition
    out = {}
    for competition, (n, at) in cuts.items():
        parts = -(-n // portion)
        out[competition] = [*sorted({at[k * most // parts - 1] for k in range(1, parts)}), None]
    return out


def scan_by_need(players: DataFrame, appearances: DataFrame, matches: DataFrame, read: Callable[[DataFrame], DataFrame], fields: list[str], path: str, portion: int = 50) -> Scan:
    """Writes to path what line-ups say of players who lack one of fields: player, fields, competition and match_id of
    the first match that lists them, matches by competition (most lacking players first, then the smallest), then
    by id. Who is seen is done with, filled or not, as another match lists the same.

    players: player, fields. appearances: player, competition. matches: match_id, competition. read takes a frame of
    match_id and competition and returns the line-ups of those alone: match_id, player, fields; a match it has none
    for is as good as empty. A portion is read at a time, and no more once everybody is seen. Each portion's players
    are written before the next is read; a run that finds path goes on with those whom it lacks. Portions change how
    much is read at a time, never a run's result; each is a few jobs, so they should grow with the matches. Blank
    texts count as unknown. Null keys match nothing."""
    spark = players.sparkSession
    before = artifact(spark, path)
    wanted = lacking(players, fields).filter("player is not null").distinct()
    if before is not None:
        wanted = wanted.join(before.select("player"), "player", "left_anti")
    pending = saved(wanted, "pending")
    left = pending.count()
    need = appearances.select("competition", "player").distinct().join(pending, "player").groupBy("competition").agg(F.count("*").alias("need"))
    order = matches.select("competition").filter("competition is not null").distinct().join(need, "competition", "left")
    order = [r.competition for r in order.orderBy(F.coalesce("need", F.lit(0)).desc(), "competition").collect()]  # competitions, few
    portions = _portions(matches.filter("competition is not null and match_id is not null"), portion) if left else {}
    step = 0 if before is None else before.agg(F.coalesce(F.max("step"), F.lit(-1))).first()[0] + 1
    visited, seen = 0, 0
    for competition in order:
        low = None
        for high in portions.get(competition, []):
            if not left:
                break
            part = matches.filter(F.col("competition") == competition)
            part = part if low is None else part.filter(F.col("match_id") > low)
            part = part if high is None else part.filter(F.col("match_id") <= high)
            part, low = part.select("match_id", "competition").distinct(), high
            rows = read(part).join(pending, "player", "left_semi")
            rows = rows if step == 0 else rows.join(spark.read.schema(f"player {dict(rows.dtypes)['player']}").parquet(path), "player", "left_anti")
            known = [F.when(F.trim(c) != "", F.trim(c)).alias(c) if t == "string" else F.col(c) for c, t in rows.select(*fields).dtypes]
            first = F.min_by(F.struct(*known), F.struct("match_id", *[F.col(c).isNull() for c in fields], *fields))
            found = rows.groupBy("player").agg(first.alias("__first"), F.min("match_id").alias("match_id"))
            found = found.select("player", "__first.*", "match_id", F.lit(competition).alias("competition"), F.lit(step).alias("step"))
            overwrite_slices(found, path, ["step"])
            written = spark.read.schema(found.schema).parquet(path).filter(F.col("step") == step).count()
            visited, seen, left, step = visited + part.count(), seen + written, left - written, step + 1
    return Scan(visited, seen, left)


def filled_from_scan(players: DataFrame, scanned: DataFrame | None, fields: list[str]) -> DataFrame:
    """players with what is null in fields taken from the scan's table; what is there already stays."""
    if scanned is None:
        return players
    right = scanned.select(F.col("player").alias("__player"), *[F.col(c).alias(f"__{c}") for c in fields])
    joined = players.join(right, F.col("player") == F.col("__player"), "left")
    return joined.select(*[F.coalesce(c, f"__{c}").alias(c) if c in fields else F.col(c) for c in players.columns])
