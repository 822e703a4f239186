"""Queries over matches, seasons and pitches, with the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import scalars as S
from tallyspark.operators import aggregates as A
from tallyspark.operators import lookups as L
from tallyspark.operators import matches as M
from tallyspark.operators import peers as R
from tallyspark.operators import windows as W
from tallyspark.plans import bindings as B
from tallyspark.plans.catalog import SQL, query
from tallyspark.plans.registry import _AT, _PEER_SQL, _SEASON_SQL, _XT_SQL, _peers, _seasons, _threat
from tallyspark.sources.tables import table


def _games(spark, sf):
    games = B.scorelines(spark, sf)
    return games.withColumns({f"{s}_xg": F.col(f"{s}_xg100") / F.lit(100.0) for s in ("home", "away")})


_SIDES_SQL = B.SCORE_SQL + """,
sides AS (SELECT match_id, season, "at", 'home' AS side, home AS team, CASE WHEN home_goals > away_goals THEN 3 WHEN home_goals = away_goals THEN 1 ELSE 0 END::DOUBLE AS points, home_goals::DOUBLE AS gf, away_goals::DOUBLE AS ga,
    home_xg100 / 100.0::DOUBLE AS xgf, away_xg100 / 100.0::DOUBLE AS xga, home_shots::DOUBLE AS sf, away_shots::DOUBLE AS sa FROM score
  UNION ALL SELECT match_id, season, "at", 'away', away, CASE WHEN away_goals > home_goals THEN 3 WHEN home_goals = away_goals THEN 1 ELSE 0 END::DOUBLE, away_goals::DOUBLE, home_goals::DOUBLE,
    away_xg100 / 100.0::DOUBLE, home_xg100 / 100.0::DOUBLE, away_shots::DOUBLE, home_shots::DOUBLE FROM score)"""


def _near(column, digits=6, shift=100):
    return S.half_up(F.col(column) + shift, digits).alias(column)


@query(f"""WITH {_SIDES_SQL}, f AS (SELECT match_id, side, count(*) OVER w AS played, """ + ", ".join(f"(sum({c}) OVER w) / count(*) OVER w AS {c}" for c in M.RUNNING) + """
  FROM sides WINDOW w AS (PARTITION BY season, team ORDER BY "at", match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
j AS (SELECT h.match_id, h.played AS h_played, a.played AS a_played, """ + ", ".join(f"h.{c} AS h_{c}, a.{c} AS a_{c}, h.{c} - a.{c} AS d_{c}" for c in M.RUNNING) + """, (h.xgf - h.xga) - (a.xgf - a.xga) AS d_xg_net
  FROM f AS h JOIN f AS a ON a.match_id = h.match_id WHERE h.side = 'home' AND a.side = 'away' AND h.played >= 4 AND a.played >= 4)
SELECT match_id, season, CASE WHEN home_goals > away_goals THEN 0 WHEN home_goals = away_goals THEN 1 ELSE 2 END AS y, h_played, a_played, """ + ", ".join(f"floor(({p}_{c} + 100) * 1e6 + 0.5) / 1e6 AS {p}_{c}" for p in "had" for c in M.RUNNING) + """, floor((d_xg_net + 100) * 1e6 + 0.5) / 1e6 AS d_xg_net FROM j JOIN score USING (match_id)""")
def form_features(spark, sf):
    found = M.form_features(_games(spark, sf))
    return found.select("match_id", "season", "y", "h_played", "a_played", *[_near(f"{p}_{c}") for p in "had" for c in M.RUNNING], _near("d_xg_net"))


_ODDS_SQL = SQL["expected_table"].split("rows_ AS (")[0]


@query(_ODDS_SQL + """sums AS (SELECT match_id, sum(xg100) FILTER (is_home) / 100.0::DOUBLE AS hx, sum(xg100) FILTER (NOT is_home) / 100.0::DOUBLE AS ax FROM line GROUP BY match_id),
g AS (SELECT game.*, win, draw, coalesce(hx, 0) AS hx, coalesce(ax, 0) AS ax FROM game JOIN odds USING (match_id) JOIN sums USING (match_id)),
r AS (SELECT season, home AS team, CASE WHEN home_goals > away_goals THEN 3 WHEN home_goals = away_goals THEN 1 ELSE 0 END AS points, 3 * win + draw AS xpts, home_goals AS gf, away_goals AS ga, hx AS xgf, ax AS xga FROM g
  UNION ALL SELECT season, away, CASE WHEN away_goals > home_goals THEN 3 WHEN home_goals = away_goals THEN 1 ELSE 0 END, 3 * greatest(0, 1 - win - draw) + draw, away_goals, home_goals, ax, hx FROM g)
SELECT season, team, count(*) AS played, sum(points)::BIGINT AS points, floor(sum(xpts) * 1e4 + 0.5) / 1e4 AS xpts, sum(gf)::BIGINT AS gf, sum(ga)::BIGINT AS ga, floor(sum(xgf) * 1e4 + 0.5) / 1e4 AS xgf, floor(sum(xga) * 1e4 + 0.5) / 1e4 AS xga,
  floor((sum(points) - sum(xpts) + 1000) * 1e4 + 0.5) / 1e4 AS luck FROM r GROUP BY season, team ORDER BY season, sum(points) DESC, sum(gf) - sum(ga) DESC, team""")
def league_tables(spark, sf):
    """Expected tables in full, by season: points first, then the difference of goals, then the team."""
    complete = B.fixtures(spark, sf).groupBy("season").agg(F.count("*").alias("n")).filter("n >= 100")
    games = B.scorelines(spark, sf).join(complete.select("season"), "season", "left_semi")
    side = lambda home: F.sort_array(F.collect_list(F.when(F.col("is_home") == home, F.col("xg100")))).alias("home_xg" if home else "away_xg")
    shots = B.lines(spark, sf).groupBy("match_id").agg(side(True), side(False))
    shots = shots.select("match_id", *[F.transform(c, lambda x: x / F.lit(100.0)).alias(c) for c in ("home_xg", "away_xg")])
    out = M.league_tables(shots, games).orderBy("season", F.desc("points"), F.desc(F.col("gf") - F.col("ga")), "team")
    rounded = lambda c, shift=0: S.half_up(F.col(c) + shift, 4).alias(c)
    return out.select("season", "team", "played", "points", rounded("xpts"), "gf", "ga", rounded("xgf"), rounded("xga"), rounded("luck", 1000))


def _acted(spark, sf):
    acts = B.actions(spark, sf)
    moved = F.when(F.col("event_type").isin("click", "view"), F.struct(F.col("next_x").alias("end_x"), F.col("next_y").alias("end_y"), (F.col("event_type") == "view").alias("completed")))
    shot = F.when(F.col("event_type") == "purchase", F.struct((F.col("x") / 1000).alias("xg"), F.when(F.col("x") >= 60, "goal").otherwise("saved").alias("outcome")))
    return acts.select("player", "day", F.col("event_id").alias("seq"), "x", "y", moved.alias("move"), shot.alias("shot"))


_MAP_SQL = f"""{B.ACTION_SQL}, a AS (SELECT *, {_AT} AS cell, (least(greatest(trunc(next_y / 10)::INTEGER, 0), 7) * 12 + least(greatest(trunc(next_x / 10)::INTEGER, 0), 11)) AS to_cell FROM action)"""


def _map_query(keys):
    by = ", ".join(keys)
    return f"""WITH {_MAP_SQL}, c AS (SELECT {by}, cell, count(*) AS n FROM a GROUP BY ALL), m AS (SELECT {by}, cell || '-' || to_cell AS pair, count(*) AS n FROM a WHERE event_type = 'view' AND next_x IS NOT NULL GROUP BY ALL),
g AS (SELECT {by}, sum(n)::BIGINT AS actions, string_agg(cell || ':' || n, ',' ORDER BY cell) AS grid FROM c GROUP BY ALL),
s AS (SELECT {by}, count(*) AS n_shots, string_agg(event_id || CASE WHEN x >= 60 THEN ' goal' ELSE ' saved' END, ',' ORDER BY event_id) AS shots FROM a WHERE event_type = 'purchase' GROUP BY ALL),
p AS (SELECT {by}, string_agg(pair || ':' || n, ',' ORDER BY pair) AS moves, sum(n)::BIGINT AS completed FROM m GROUP BY ALL)
SELECT {by}, actions, grid, coalesce(n_shots, 0) AS n_shots, coalesce(shots, '') AS shots, coalesce(moves, '') AS moves, coalesce(completed, 0) AS completed FROM g LEFT JOIN s USING ({by}) LEFT JOIN p USING ({by})"""


def _maps(spark, sf, keys):
    made = M.maps(M.reduced_events(_acted(spark, sf), keys), keys)
    joined = lambda entries, form: F.coalesce(F.array_join(F.transform(entries, form), ","), F.lit(""))
    cells = F.filter(F.transform("grid", lambda n, k: F.struct(k.alias("k"), n.alias("n"))), lambda x: x["n"] > 0)
    pairs = F.array_sort(F.map_entries("moves"))
    return made.select(
        *keys,
        "actions",
        joined(cells, lambda x: F.concat_ws(":", x["k"], x["n"])).alias("grid"),
        F.when(F.col("shots").isNull(), 0).otherwise(F.size("shots")).cast("long").alias("n_shots"),
        joined(F.col("shots"), lambda s: F.concat_ws(" ", s["seq"], s["outcome"])).alias("shots"),
        joined(pairs, lambda e: F.concat_ws(":", e["key"], e["value"])).alias("moves"),
        F.coalesce(F.aggregate(F.map_values("moves"), F.lit(0).cast("long"), lambda s, n: s + n), F.lit(0)).alias("completed"),
    )


@query(_map_query(("player", "day")))
def event_maps(spark, sf):
    """What a player did in one match: cells, shots in order, completed moves between cells."""
    return _maps(spark, sf, ["player", "day"])


@query(_map_query(("player",)))
def season_maps(spark, sf):
    """The same over all matches: counts add up, shots line up."""
    return _maps(spark, sf, ["player"])


@query(f"""WITH {_PEER_SQL}, {B.ACTION_SQL}, g AS (SELECT player, count(*) AS actions, avg((x >= 80)::INTEGER) AS final_third FROM action GROUP BY player)
SELECT player, season, coalesce(actions, -1) AS actions FROM peer LEFT JOIN g USING (player)""")
def zones_of_seasons(spark, sf):
    """Zone features joined to player-seasons; who has no map keeps an unknown, here -1."""
    grid = B.actions(spark, sf).groupBy("player", S.cell(F.col("x"), F.col("y")).alias("cell")).agg(F.count("*").alias("n"))
    zones = A.zone_features(grid, "player").select("player", "actions")
    return _peers(spark, sf).join(zones, "player", "left").select("player", "season", F.coalesce("actions", F.lit(-1)).alias("actions"))


@query(f"""WITH {_XT_SQL}, d AS (SELECT a.player, cell AS from_cell, {_AT.replace("x /", "next_x /").replace("y /", "next_y /")} AS to_cell, day FROM a WHERE moved),
w AS (SELECT player, day, sum(e.threat - s.threat) AS added FROM d JOIN xt AS s ON s.cell = from_cell JOIN xt AS e ON e.cell = to_cell GROUP BY ALL),
t AS (SELECT player, day, count(*) AS actions FROM action GROUP BY ALL), b AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY player ORDER BY actions DESC, day) = 1),
v AS (SELECT player, day, actions, c_mktsegment AS grp, floor((added / (actions * 3) * 90 + 100) * 1e6 + 0.5) / 1e6 AS xt_per90 FROM b JOIN w USING (player, day) JOIN customer ON c_custkey = player)
SELECT player, day, actions, xt_per90, (rank() OVER (PARTITION BY grp ORDER BY xt_per90) - 1)::DOUBLE / count(*) OVER (PARTITION BY grp) * 100 AS xt_percentile FROM v""")
def pitch_profile(spark, sf):
    """A player's busiest match day with what its moves added per 90 and the share of peers strictly below."""
    grid, _ = _threat(spark, sf)
    acts = B.actions(spark, sf)
    moved = acts.filter(F.col("event_type").isin("click", "view") & F.col("next_x").isNotNull())
    moves = moved.groupBy("player", "day", S.cell(F.col("x"), F.col("y")).alias("from_cell"), S.cell(F.col("next_x"), F.col("next_y")).alias("to_cell")).agg(F.count("*").alias("n"))
    start, end = (grid.select(F.col("cell").alias(f"{w}_cell"), F.col("threat").alias(w)) for w in ("from", "to"))
    added = moves.join(start, "from_cell").join(end, "to_cell").groupBy("player", "day").agg(F.sum(F.col("n") * (F.col("to") - F.col("from"))).alias("added"))
    days = acts.groupBy("player", "day").agg(F.count("*").alias("actions"))
    busiest = W.first_by(days, ["player"], [F.desc("actions"), F.col("day")])
    peers = table(spark, sf, "customer").select(F.col("c_custkey").alias("player"), F.col("c_mktsegment").alias("grp"))
    per90 = S.half_up(F.col("added") / (F.col("actions") * 3) * 90 + 100, 6)
    rows = busiest.join(added, ["player", "day"]).join(peers, "player").withColumn("xt_per90", per90)
    return R.ranked(rows, ["player"], {"xt_percentile": "xt_per90"}, ["grp"], R.below_percentile).select("player", "day", "actions", "xt_per90", "xt_percentile")


@query(f"""WITH {B.FIXTURE_SQL}, b AS (SELECT home AS team, competition, 0 AS r, "at", match_id FROM fixture UNION ALL SELECT away, competition, 1, "at", match_id FROM fixture)
SELECT team, competition FROM b QUALIFY row_number() OVER (PARTITION BY team ORDER BY r DESC, "at" DESC, match_id DESC) = 1""")
def played_in(spark, sf):
    return L.played_in(B.fixtures(spark, sf), ["at", "match_id"])


@query(f"""WITH {B.FIXTURE_SQL}, p AS (SELECT season, count(DISTINCT o_custkey) AS n_players FROM fixture JOIN orders ON o_orderkey = match_id GROUP BY season),
sides AS (SELECT season, home AS team FROM fixture UNION SELECT season, away FROM fixture), t AS (SELECT season, count(*) AS n_teams FROM sides GROUP BY season), n AS (SELECT season, any_value(competition) AS competition, count(*) AS n_matches FROM fixture GROUP BY season),
c AS (SELECT season, competition, n_matches, n_players, least(n_matches::DOUBLE / (n_teams * (n_teams - 1)), 1.0) AS coverage FROM n JOIN t USING (season) JOIN p USING (season))
SELECT season, n_matches, n_players, coverage, coverage < 0.9 AS fragment, sum(n_matches) OVER ()::BIGINT AS all_matches, (SELECT count(DISTINCT competition) FROM c) AS competitions FROM c ORDER BY coverage DESC, n_players DESC, season""")
def coverage_totals(spark, sf):
    """Seasons by coverage and players, each flagged if it is a fragment, with totals over all of them. Seasons are
    few: a row each."""
    games = B.fixtures(spark, sf)
    players = games.join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("match_id"), "o_custkey"), "match_id").groupBy("season").agg(F.count_distinct("o_custkey").alias("n_players"), F.min("competition").alias("competition"))
    rows = A.season_coverage(games).join(players, "season")
    totals = rows.agg(F.sum("n_matches").alias("all_matches"), F.count_distinct("competition").alias("competitions"))
    out = rows.crossJoin(F.broadcast(totals)).select("season", "n_matches", "n_players", "coverage", (F.col("coverage") < 0.9).alias("fragment"), "all_matches", "competitions")  # one row
    return out.orderBy(F.desc("coverage"), F.desc("n_players"), "season")


@query(f"""WITH {_SEASON_SQL}, r AS (SELECT player, sum(goals) AS goals, sum(shots) AS shots, sum(passes) AS passes FROM season GROUP BY player)
SELECT DISTINCT player FROM ((SELECT player FROM r ORDER BY goals DESC, player LIMIT 4) UNION ALL (SELECT player FROM r ORDER BY shots DESC, player LIMIT 4) UNION ALL (SELECT player FROM r ORDER BY passes DESC, player LIMIT 2))""")
def team_labels(spark, sf):
    rows = _seasons(spark, sf).groupBy("player").agg(*[F.sum(c).alias(c) for c in ("goals", "shots", "passes")])
    tops = [rows.orderBy(F.desc(c), "player").limit(n).select("player") for c, n in (("goals", 4), ("shots", 4), ("passes", 2))]
    return tops[0].unionByName(tops[1]).unionByName(tops[2]).distinct()


_DUEL_PCT = ", ".join(f"(rank() OVER (PARTITION BY grp ORDER BY {c}_per90) + (count(*) OVER (PARTITION BY grp, {c}_per90) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY grp) * 100 AS {c}" for c in ("goals", "shots", "passes"))


@query(f"""WITH {_PEER_SQL}, p AS (SELECT player, season, {_DUEL_PCT} FROM peer)
SELECT a.player, a.season, """ + " + ".join(f"(a.{c} - b.{c} >= 2)::INTEGER" for c in ("goals", "shots", "passes")) + " AS wins, " + " + ".join(f"(abs(a.{c} - b.{c}) < 2)::INTEGER" for c in ("goals", "shots", "passes")) + """ AS ties
FROM p AS a JOIN p AS b ON b.player = a.player AND b.season = a.season - 1""")
def percentile_duel(spark, sf):
    """A player's season against the one before: percentiles less than two points apart tie."""
    names = ("goals", "shots", "passes")
    now = R.ranked(_peers(spark, sf).select("player", "season", "grp", *[f"{c}_per90" for c in names]), ["player", "season"], {c: f"{c}_per90" for c in names}, ["grp"])
    before = now.select("player", (F.col("season") + 1).alias("season"), *[F.col(c).alias(f"b_{c}") for c in names])
    count = lambda test: sum((test(F.col(c) - F.col(f"b_{c}")).cast("int") for c in names), F.lit(0))
    return now.join(before, ["player", "season"]).select("player", "season", count(lambda d: d >= 2).alias("wins"), count(lambda d: F.abs(d) < 2).alias("ties"))


@query(f"""WITH {_SEASON_SQL} SELECT a.player, a.season, a.goals + a.shots - b.goals - b.shots AS edge FROM season AS a JOIN season AS b ON b.player = a.player AND b.season = a.season - 1""")
def matchup_edges(spark, sf):
    now = _seasons(spark, sf).select("player", "season", (F.col("goals") + F.col("shots")).alias("own"))
    before = now.select("player", (F.col("season") + 1).alias("season"), F.col("own").alias("other"))
    return now.join(before, ["player", "season"]).select("player", "season", (F.col("own") - F.col("other")).alias("edge"))


@query(f"""WITH {_SEASON_SQL}, s AS (SELECT player, season, goals::DOUBLE / (goals + shots + passes) AS g, shots::DOUBLE / (goals + shots + passes) AS s, passes::DOUBLE / (goals + shots + passes) AS p FROM season),
l AS (SELECT player, season, unnest([{{'n': 'goals', 'v': g}}, {{'n': 'passes', 'v': p}}, {{'n': 'shots', 'v': s}}]) AS x FROM s)
SELECT player, season, string_agg(x.n, ',' ORDER BY x.v DESC, x.n) FILTER (x.v >= 0.01) AS style FROM l GROUP BY ALL""")
def style_profile(spark, sf):
    """What a player's actions are made of: at most five kinds of a hundredth or more, largest first."""
    whole = F.col("goals") + F.col("shots") + F.col("passes")
    parts = F.array(*[F.struct((-(F.col(c) / whole)).alias("down"), F.lit(c).alias("name")) for c in ("goals", "passes", "shots")])
    kept = F.slice(F.array_sort(F.filter(parts, lambda x: x["down"] <= -0.01)), 1, 5)
    return _seasons(spark, sf).select("player", "season", F.array_join(F.transform(kept, lambda x: x["name"]), ",").alias("style"))


#: What kind of play a metric belongs to.
CATEGORIES = {"attack": ("goals", "shots", "xg100"), "passing": ("passes",), "defense": ()}


@query(f"""WITH {_SEASON_SQL} SELECT 'attack' AS category, sum(goals + shots + xg100)::BIGINT AS n FROM season UNION ALL SELECT 'passing', sum(passes)::BIGINT FROM season UNION ALL SELECT 'defense', 0::BIGINT""")
def metric_categories(spark, sf):
    sums = _seasons(spark, sf).agg(*[F.sum(sum((F.col(c) for c in names), F.lit(0))).cast("long").alias(k) for k, names in CATEGORIES.items()])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(k).alias("category"), F.col(k).alias("n")) for k in CATEGORIES])).alias("x")).select("x.*")


@query("""SELECT (SELECT count(*) FROM customer) AS pool, (SELECT count(*) FROM supplier) AS fitted_on, abs((SELECT count(*) FROM customer) - (SELECT count(*) FROM supplier)) > greatest(5, 0.02 * (SELECT count(*) FROM supplier)) AS stale""")
def staleness(spark, sf):
    """Whether a model's pool has changed by more than five rows and a fiftieth since it was fitted."""
    pool, fitted = table(spark, sf, "customer").agg(F.count("*").alias("pool")), table(spark, sf, "supplier").agg(F.count("*").alias("fitted_on"))
    both = pool.crossJoin(fitted)  # one row each
    return both.withColumn("stale", F.abs(F.col("pool") - F.col("fitted_on")) > F.greatest(F.lit(5.0), F.col("fitted_on") * 0.02))


@query("""SELECT l_orderkey AS match_id, l_linenumber % 2 = 1 AS is_home, string_agg(printf('%.3f', round(l_discount * 100) / 100), ',' ORDER BY l_linenumber, l_discount) AS xg FROM lineitem GROUP BY ALL""")
def team_shots(spark, sf):
    """The chances of each side of a match in the order of its events."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_discount")
    shots = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_discount")))
    said = F.array_join(F.transform(shots, lambda s: F.format_string("%.3f", F.round(s["l_discount"] * 100) / 100)), ",")
    return lines.groupBy(F.col("l_orderkey").alias("match_id"), (F.col("l_linenumber") % 2 == 1).alias("is_home")).agg(said.alias("xg"))
