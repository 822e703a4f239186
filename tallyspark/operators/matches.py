"""Matches: what both sides had done before, tables by season, and what players did on the pitch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import scalars as S
from tallyspark.sources.tables import saved

#: What a side's earlier matches add up to: points, and goals, expected goals and shots for and against.
RUNNING = ("points", "gf", "ga", "xgf", "xga", "sf", "sa")


def points(scored: Column, conceded: Column) -> Column:
    return F.when(scored > conceded, 3).when(scored == conceded, 1).otherwise(0)


def sides(games: DataFrame) -> DataFrame:
    """Two rows a match, one for each side, with RUNNING of that match. games: match_id, season, at, home, away and
    goals, xg and shots of either side."""

    def side(own: str, other: str) -> DataFrame:
        pairs = {f"{short}{way}": f"{who}_{long}" for short, long in (("g", "goals"), ("xg", "xg"), ("s", "shots")) for way, who in (("f", own), ("a", other))}
        named = [F.col(column).cast("double").alias(name) for name, column in pairs.items()]
        won = points(F.col(f"{own}_goals"), F.col(f"{other}_goals")).cast("double").alias("points")
        return games.select("match_id", "season", "at", F.lit(own).alias("side"), F.col(own).alias("team"), won, *named)

    return side("home", "away").unionByName(side("away", "home"))


def form_features(games: DataFrame, least: int = 4) -> DataFrame:
    """A row per match of which both sides have played least earlier ones in the season: means of RUNNING over strictly
    earlier matches (h_ and a_), their differences (d_), the difference of net expected goals, and y (0 home won, 1
    draw, 2 away won). A team's season is what a window holds. games is written first and read from there, as both
    sides and the result come from it."""
    games = saved(games, "games")
    earlier = Window.partitionBy("season", "team").orderBy("at", "match_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = sides(games)
    means = rows.select("match_id", "side", F.count("*").over(earlier).alias("played"), *[(F.sum(c).over(earlier) / F.count("*").over(earlier)).alias(c) for c in RUNNING])
    either = means.filter(F.col("played") >= least)
    pick = lambda who, c: F.max(F.when(F.col("side") == who, F.col(c)))
    wide = either.groupBy("match_id").agg(F.count("*").alias("__n"), *[pick(who, c).alias(f"{who[0]}_{c}") for who in ("home", "away") for c in ("played", *RUNNING)])
    wide = wide.filter("__n = 2").drop("__n").withColumns({f"d_{c}": F.col(f"h_{c}") - F.col(f"a_{c}") for c in RUNNING})
    wide = wide.withColumn("d_xg_net", (F.col("h_xgf") - F.col("h_xga")) - (F.col("a_xgf") - F.col("a_xga")))
    y = F.when(F.col("home_goals") > F.col("away_goals"), 0).when(F.col("home_goals") == F.col("away_goals"), 1).otherwise(2)
    return wide.join(games.select("match_id", "season", y.alias("y")), "match_id")


def league_tables(shots: DataFrame, results: DataFrame) -> DataFrame:
    """season, team, played, points, xpts, gf, ga, xgf, xga, luck. shots: match_id, home_xg, away_xg (arrays of
    chances); results: match_id, season, home, away, home_goals, away_goals."""
    both = results.join(shots, "match_id").withColumn("h", S.goal_distribution(F.col("home_xg"))).withColumn("a", S.goal_distribution(F.col("away_xg")))
    win, draw = S.win_draw(F.col("h"), F.col("a"))
    whole = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    both = both.select("season", "home", "away", "home_goals", "away_goals", win.alias("win"), draw.alias("draw"), whole("home_xg").alias("home_xg"), whole("away_xg").alias("away_xg"))
    lose = F.greatest(F.lit(0.0), 1 - F.col("win") - F.col("draw"))

    def side(own: str, other: str, chance: Column) -> Column:
        g = lambda who: F.col(f"{who}_goals")
        return F.struct(
            F.col(own).alias("team"), points(g(own), g(other)).alias("points"), (3 * chance + F.col("draw")).alias("xpts"), g(own).alias("gf"), g(other).alias("ga"),
            F.col(f"{own}_xg").alias("xgf"), F.col(f"{other}_xg").alias("xga"),
        )

    rows = both.select("season", F.explode(F.array(side("home", "away", F.col("win")), side("away", "home", lose))).alias("s")).select("season", "s.*")
    out = rows.groupBy("season", "team").agg(F.count("*").alias("played"), *[F.sum(c).alias(c) for c in ("points", "xpts", "gf", "ga", "xgf", "xga")])
    return out.withColumn("luck", F.col("points") - F.col("xpts"))


def reduced_events(actions: DataFrame, keys: list[str]) -> dict[str, DataFrame]:
    """What keys did: cells (keys, cell, n), moves_from (attempted, keys, cell, n), moves (completed, keys, from_cell,
    to_cell, n) and shots (keys, seq, x, y, xg, outcome). All are counts and lists in long form, so a season is the
    same reduction over more rows.

    actions: keys, seq, x, y, move (struct of end_x, end_y, completed; null for what is no move) and shot (struct of xg,
    outcome; null for what is no shot).
    """
    placed = actions.withColumn("cell", S.cell(F.col("x"), F.col("y")))
    count = F.count("*").alias("n")
    moved = placed.filter("move is not null")
    to = S.cell(F.col("move.end_x"), F.col("move.end_y")).alias("to_cell")
    return {
        "cells": placed.groupBy(*keys, "cell").agg(count),
        "moves_from": moved.groupBy(*keys, "cell").agg(count),
        "moves": moved.filter("move.completed and move.end_x is not null").groupBy(*keys, F.col("cell").alias("from_cell"), to).agg(count),
        "shots": placed.filter("shot is not null").select(*keys, "seq", F.bround("x", 1).alias("x"), F.bround("y", 1).alias("y"), F.bround("shot.xg", 3).alias("xg"), "shot.outcome"),
    }


def maps(reduced: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """keys, grid (array of 96 counts), actions, shots (array in order of seq), moves (map from "from-to" to a count):
    one row each, made of the long form at the end. Cells and pairs of cells bound the first and the last; the shots
    are those of one player and season."""
    n = S.COLUMNS * S.ROWS
    cells = reduced["cells"].groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("cell", "n"))).alias("c"), F.sum("n").alias("actions"))
    grid = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.coalesce(F.try_element_at("c", k), F.lit(0)))
    shots = reduced["shots"].groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("seq", "x", "y", "xg", "outcome"))).alias("shots"))
    pair = F.concat_ws("-", "from_cell", "to_cell")
    moves = reduced["moves"].groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(pair, "n")))).alias("moves"))
    return cells.select(*keys, grid.alias("grid"), "actions").join(shots, keys, "left").join(moves, keys, "left")
