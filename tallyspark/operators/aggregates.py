"""Rollups: events to matches, matches to seasons, coverage, grids, tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import scalars as S
from tallyspark.operators.windows import first_by
from tallyspark.sources.tables import column_or


def rollup(rows: DataFrame, keys: list[str], sums: list[str], match: str) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums], F.count_distinct(match).alias("matches"))


def most_played(rows: DataFrame, keys: list[str], position: str, minutes: str) -> DataFrame:
    """The position with most minutes; of equals the first by name, null before others."""
    total = rows.groupBy(*keys, position).agg(F.sum(minutes).alias("minutes"))
    return first_by(total, keys, [F.desc("minutes"), F.col(position).asc_nulls_first()])


def event_flags(events: DataFrame) -> DataFrame:
    """Counting flags of one event; a pass without outcome is complete, only complete ones can be progressive. Columns
    that the feed leaves out count as null."""
    at = lambda name: column_or(events, name, None)
    kind, done = F.col("type"), at("pass_outcome").isNull()
    flag = lambda c: F.when(c, 1).otherwise(0)

    def moved(end: str, least: float):
        if "location" not in events.columns or end not in events.columns:
            return F.lit(False)
        x = lambda c, k: F.get(F.col(c), F.lit(k))
        return S.progress(x("location", 0), x("location", 1), x(end, 0), x(end, 1)) >= least

    single = {"shots": "Shot", "passes": "Pass", "dribbles": "Dribble", "carries": "Carry", "interceptions": "Interception", "blocks": "Block", "clearances": "Clearance", "ball_recoveries": "Ball Recovery", "pressures": "Pressure"}
    return events.withColumns(
        {name: flag(kind == value) for name, value in single.items()}
        | {
            "goals": flag((kind == "Shot") & (at("shot_outcome") == "Goal")),
            "assists": flag(F.coalesce(at("pass_goal_assist").cast("boolean"), F.lit(False))),
            "xg": F.when(kind == "Shot", F.coalesce(at("shot_xg").cast("double"), F.lit(0.0))).otherwise(0.0),
            "passes_completed": flag((kind == "Pass") & done),
            "progressive_passes": flag((kind == "Pass") & done & moved("pass_end", S.PASS_PROGRESS)),
            "dribbles_completed": flag((kind == "Dribble") & (at("dribble_outcome") == "Complete")),
            "progressive_carries": flag((kind == "Carry") & moved("carry_end", S.CARRY_PROGRESS)),
            "tackles": flag((kind == "Duel") & (at("duel_type") == "Tackle")),
        }
    )


#: What a player's events of a match add up to.
COUNTED = [
    "goals", "assists", "shots", "xg", "passes", "passes_completed", "progressive_passes", "dribbles", "dribbles_completed", "carries", "progressive_carries",
    "tackles", "interceptions", "blocks", "clearances", "ball_recoveries", "pressures",
]


def match_minutes(events: DataFrame) -> DataFrame:
    """match_id, player_id, minutes, position: from 0 for who is in the lineup, else from the first event, to the way
    off (a red card before a substitution, the later of two) or the match's last minute. The position is the most
    frequent one, of equals the first by name.

    events: match_id, seq (order within the match), type, minute, player_id and, if there, position, card and lineup
    (ids). Only a row per player and match is joined.
    """
    at = lambda name: column_or(events, name, None)
    of = lambda c: F.max_by(F.when(c, F.col("minute")), F.when(c, F.col("seq")))
    own = (
        events.filter("player_id is not null")
        .groupBy("match_id", "player_id")
        .agg(
            F.min("minute").alias("first"),
            of(F.col("type") == "Substitution").alias("sub"),
            of((F.col("type") == "Bad Behaviour") & (at("card") == "Red Card")).alias("red"),
            F.mode(at("position").cast("string"), True).alias("position"),
        )
    )
    out = own.join(events.groupBy("match_id").agg(F.max("minute").alias("end")), "match_id").withColumn("start", F.col("first"))
    if "lineup" in events.columns:
        starters = events.filter("type = 'Starting XI'").select("match_id", F.explode("lineup").alias("player_id")).distinct().withColumn("starts", F.lit(True))
        out = out.join(starters, ["match_id", "player_id"], "left").withColumn("start", F.when(F.col("starts"), 0).otherwise(F.col("first")))
    return out.select("match_id", "player_id", F.greatest(F.lit(0), F.coalesce("red", "sub", "end") - F.col("start")).alias("minutes"), "position")


def match_totals(events: DataFrame) -> DataFrame:
    """A row per match and player: minutes, position and the sums of COUNTED; events of nobody drop out."""
    sums = event_flags(events).filter("player_id is not null").groupBy("match_id", "player_id").agg(*[F.sum(c).alias(c) for c in COUNTED])
    return sums.join(match_minutes(events), ["match_id", "player_id"])


def sides_of(matches: DataFrame) -> DataFrame:
    """season, team: each team once, whichever side it stood on; unknown sides are no team."""
    home, away = (matches.select("season", F.col(c).alias("team")) for c in ("home", "away"))
    return home.unionByName(away).filter("team is not null").distinct()


def season_coverage(matches: DataFrame) -> DataFrame:
    """season, n_matches, n_teams, focus, coverage: against a double round robin of all teams, or twice each other
    team where one team (focus) plays every match."""
    n = matches.groupBy("season").agg(F.count("*").alias("n_matches"))
    teams = sides_of(matches).groupBy("season").agg(F.count("*").alias("n_teams"))
    plays = matches.select("season", F.explode(F.array_distinct(F.array("home", "away"))).alias("team")).filter("team is not null")
    most = plays.groupBy("season", "team").agg(F.count("*").alias("played")).groupBy("season").agg(F.max("played").alias("most"))
    out = n.join(teams, "season").join(most, "season")
    focus = (F.col("most") == F.col("n_matches")) & (F.col("n_teams") > 2)
    expected = F.when(focus, 2 * (F.col("n_teams") - 1)).otherwise(F.col("n_teams") * (F.col("n_teams") - 1))
    share = F.when(expected > 0, F.least(F.col("n_matches") / expected, F.lit(1.0))).otherwise(F.lit(1.0))
    return out.select("season", "n_matches", "n_teams", focus.alias("focus"), share.alias("coverage"))


def without_fragments(rows: DataFrame, coverage: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Seasons of unknown coverage stay; a threshold of 0 or less keeps all."""
    return rows if threshold <= 0 else rows.join(coverage.filter(F.col("coverage") < threshold), "season", "left_anti")


def zone_features(grid: DataFrame, key: str) -> DataFrame:
    """Weighted means, deviations and shares over a grid's cells (key, cell, n); the sums are whole numbers."""
    at = grid.withColumn("cx", F.col("cell") % S.COLUMNS * 10 + 5).withColumn("cy", F.floor(F.col("cell") / S.COLUMNS) * 10 + 5)
    shares = {"final_third": "cx >= 80", "own_third": "cx < 40", "left_share": "cy < 26", "right_share": "cy > 54", "wide_share": "cy < 20 or cy >= 60"}
    total = lambda *factors: F.sum(F.col("n") * factors[0] * factors[-1] if len(factors) > 1 else F.col("n") * factors[0])
    moments = [x for c in ("cx", "cy") for x in (total(F.col(c)).alias(f"s_{c}"), total(F.col(c), F.col(c)).alias(f"ss_{c}"))]
    inside = [F.sum(F.when(F.expr(test), F.col("n")).otherwise(0)).alias(name) for name, test in shares.items()]
    sums = at.groupBy(key).agg(F.sum("n").alias("actions"), *moments, *inside)
    n = F.col("actions")
    mean = lambda c: F.col(f"s_{c}") / n
    spread = lambda c: F.sqrt((F.col(f"ss_{c}") * n - F.col(f"s_{c}") * F.col(f"s_{c}")) / (n * n))
    return sums.filter("actions > 0").select(
        key, "actions", mean("cx").alias("mean_x"), mean("cy").alias("mean_y"), spread("cx").alias("spread_x"), spread("cy").alias("spread_y"), *[(F.col(name) / n).alias(name) for name in shares]
    )


def expected_threat(cells: DataFrame, moves: DataFrame, iterations: int = 50) -> DataFrame:
    """cell, threat: the fixpoint of shot chance times goal chance plus move chance times what moves lead to.

    cells: cell, shots, goals, moves (attempts). moves: from_cell, to_cell, n (completed). The grid has 96 cells
    whatever the input, so its rows are folded as one array.
    """
    n = S.COLUMNS * S.ROWS
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    acts = F.col("shots") + F.col("moves")
    pays = cells.select("cell", (share(F.col("shots"), acts) * share(F.col("goals"), F.col("shots"))).alias("pay"), share(F.col("moves"), acts).alias("go"), F.col("moves").alias("tries"))
    leads = moves.groupBy("from_cell").agg(F.sort_array(F.collect_list(F.struct("to_cell", "n"))).alias("leads"))
    empty = F.array().cast(leads.schema["leads"].dataType)
    full = cells.sparkSession.range(n).select(F.col("id").cast("int").alias("cell"))
    rows = full.join(pays, "cell", "left").join(leads.withColumnRenamed("from_cell", "cell"), "cell", "left")
    rows = rows.select("cell", F.coalesce("pay", F.lit(0.0)).alias("pay"), F.coalesce("go", F.lit(0.0)).alias("go"), F.coalesce("tries", F.lit(0)).alias("tries"), F.coalesce("leads", empty).alias("leads"))
    grid = rows.groupBy().agg(F.sort_array(F.collect_list(F.struct("cell", "pay", "go", "tries", "leads"))).alias("g"))
    reach = lambda c, x: F.aggregate(c["leads"], F.lit(0.0), lambda s, m: s + m["n"] / c["tries"] * F.get(x, m["to_cell"]))
    step = lambda x, _: F.transform("g", lambda c: c["pay"] + F.when(c["tries"] > 0, c["go"] * reach(c, x)).otherwise(0.0))
    zeros = F.array_repeat(F.lit(0.0), n)
    folded = grid.select(F.aggregate(F.sequence(F.lit(1), F.lit(iterations)), zeros, step).alias("x"))
    return folded.select(F.posexplode("x").alias("cell", "threat"))


def threat_added(moves: DataFrame, threat: DataFrame, key: str) -> DataFrame:
    """key, added: what completed moves gained on the grid."""
    start = threat.select(F.col("cell").alias("from_cell"), F.col("threat").alias("before"))
    end = threat.select(F.col("cell").alias("to_cell"), F.col("threat").alias("after"))
    gained = moves.join(start, "from_cell").join(end, "to_cell")
    return gained.groupBy(key).agg(F.sum(F.col("n") * (F.col("after") - F.col("before"))).alias("added"))


def expected_table(shots: DataFrame, results: DataFrame) -> DataFrame:
    """team, played, points, xpts, luck: shots: match_id, home_xg, away_xg (arrays of chances); results: match_id,
    home, away, home_goals, away_goals."""
    both = results.join(shots, "match_id").withColumn("h", S.goal_distribution(F.col("home_xg"))).withColumn("a", S.goal_distribution(F.col("away_xg")))
    win, draw = S.win_draw(F.col("h"), F.col("a"))
    both = both.select("home", "away", "home_goals", "away_goals", win.alias("win"), draw.alias("draw"))
    points = lambda f, g: F.when(F.col(f) > F.col(g), 3).when(F.col(f) == F.col(g), 1).otherwise(0)
    lose = F.greatest(F.lit(0.0), 1 - F.col("win") - F.col("draw"))
    home = both.select(F.col("home").alias("team"), points("home_goals", "away_goals").alias("points"), (3 * F.col("win") + F.col("draw")).alias("xpts"))
    away = both.select(F.col("away").alias("team"), points("away_goals", "home_goals").alias("points"), (3 * lose + F.col("draw")).alias("xpts"))
    out = home.unionByName(away).groupBy("team").agg(F.count("*").alias("played"), F.sum("points").alias("points"), F.sum("xpts").alias("xpts"))
    return out.withColumn("luck", F.col("points") - F.col("xpts"))
