"""Every query of the library and the SQL it is compared with, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.functions import scalars as S
from tallyspark.operators import aggregates as A
from tallyspark.operators import matches as X
from tallyspark.operators import models as M
from tallyspark.operators import peers as R
from tallyspark.operators import search as Q
from tallyspark.operators import windows as W
from tallyspark.plans import bindings as B
from tallyspark.plans.catalog import QUERIES, SQL, query  # noqa: F401
from tallyspark.sources.tables import table
from tallyspark.streaming import state, streams

def _seasons(spark, sf):
    return A.rollup(B.league(spark, sf), ["player", "season"], B.SUMS, "match_id")


_SEASON_SQL = B.LINE_SQL + """,
season AS (
  SELECT player, season, sum(minutes) AS minutes, sum(goals)::BIGINT AS goals, sum(shots)::BIGINT AS shots, sum(xg100)::BIGINT AS xg100,
         sum(passes)::BIGINT AS passes, count(DISTINCT match_id) AS matches FROM line GROUP BY player, season
)"""


@query(f"WITH {_SEASON_SQL} SELECT * FROM season")
def season_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return _seasons(spark, sf)


_RATES = ["goals", "shots", "xg100", "passes"]


def _rates(spark, sf):
    out = _seasons(spark, sf)
    return out.withColumns({f"{c}_per90": S.per90(F.col(c), F.col("minutes")) for c in _RATES})


_RATE_SQL = _SEASON_SQL + ",\nrate AS (SELECT *, " + ", ".join(f"CASE WHEN minutes > 0 THEN {c} * (90.0::DOUBLE / minutes) ELSE 0 END AS {c}_per90" for c in _RATES) + " FROM season)"


@query(f"WITH {_RATE_SQL} SELECT player, season, " + ", ".join(f"{c}_per90" for c in _RATES) + " FROM rate")
def per90(spark, sf):
    return _rates(spark, sf).select("player", "season", *[f"{c}_per90" for c in _RATES])


@query(f"""WITH {B.LINE_SQL}, t AS (SELECT player, position, sum(minutes) AS minutes FROM line GROUP BY ALL)
SELECT player, position, minutes FROM t QUALIFY row_number() OVER (PARTITION BY player ORDER BY minutes DESC, position NULLS FIRST) = 1""")
def primary_position(spark, sf):
    return A.most_played(B.league(spark, sf, positions=True), ["player"], "position", "minutes")


_WEIGHTS = {"goals": 0.5, "shots": 0.3, "xg100": 0.2}


def _peers(spark, sf):
    players = table(spark, sf, "customer").select(F.col("c_custkey").alias("player"), F.col("c_mktsegment").alias("grp"))
    return _rates(spark, sf).filter("minutes >= 100").join(players, "player")


def _percentiles(spark, sf, grp=None):
    """grp: a group to rank by itself; ranks lie within groups, so the others have no part in them."""
    peers = _peers(spark, sf)
    return R.ranked(peers if grp is None else peers.filter(F.col("grp") == grp), ["player", "season"], {f"{c}_pct": f"{c}_per90" for c in _WEIGHTS}, ["grp"])


def _pct_sql(c):
    return f"(rank() OVER (PARTITION BY grp ORDER BY {c}_per90) + (count(*) OVER (PARTITION BY grp, {c}_per90) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY grp) * 100 AS {c}_pct"


_PEER_SQL = _RATE_SQL + ",\npeer AS (SELECT rate.*, c_mktsegment AS grp FROM rate JOIN customer ON c_custkey = player WHERE minutes >= 100)"
_PCT_SQL = _PEER_SQL + ",\npct AS (SELECT *, " + ", ".join(_pct_sql(c) for c in _WEIGHTS) + " FROM peer)"
_SCORE_EXPR = "0.0::DOUBLE" + "".join(f" + {c}_pct * {w}::DOUBLE" for c, w in _WEIGHTS.items())


@query(f"WITH {_PCT_SQL} SELECT player, season, grp, floor(({_SCORE_EXPR}) * 10 + 0.5) / 10 AS score FROM pct WHERE grp = 'BUILDING' ORDER BY score DESC, player, season LIMIT 50")
def rankings(spark, sf):
    """Weighted percentile score within the peer group; the limit comes after scoring."""
    score = S.half_up(W.weighted_score({c: F.col(f"{c}_pct") for c in _WEIGHTS}, _WEIGHTS), 1)
    scored = W.ranked(_percentiles(spark, sf, "BUILDING"), score, [F.col("player"), F.col("season")], 50)
    return scored.select("player", "season", "grp", "score")


@query(f"WITH {_PCT_SQL} SELECT player, season, grp, floor(({_SCORE_EXPR}) * 10 + 0.5) / 10 AS score FROM pct WHERE grp = 'BUILDING' AND player % 3 = 0 ORDER BY score DESC, player, season LIMIT 50")
def rankings_by_gender(spark, sf):
    """The women of a group by the score that they have among all of the group: gender filters after scoring."""
    score = S.half_up(W.weighted_score({c: F.col(f"{c}_pct") for c in _WEIGHTS}, _WEIGHTS), 1)
    women = B.people(spark, sf).filter("gender = 'female'").select("player")
    chosen = _percentiles(spark, sf, "BUILDING").join(women, "player", "left_semi")
    return W.ranked(chosen, score, [F.col("player"), F.col("season")], 50).select("player", "season", "grp", "score")


@query(f"WITH {_PCT_SQL} " + " UNION ALL ".join(f"SELECT player, season, '{c}' AS metric, floor({c}_pct * {w}::DOUBLE * 1e6 + 0.5) / 1e6 AS part FROM pct" for c, w in _WEIGHTS.items()))
def score_breakdown(spark, sf):
    parts = F.array(*[F.struct(F.lit(c).alias("metric"), S.half_up(F.col(f"{c}_pct") * F.lit(w), 6).alias("part")) for c, w in _WEIGHTS.items()])
    return _percentiles(spark, sf).select("player", "season", F.explode(parts).alias("p")).select("player", "season", "p.*")


@query(f"WITH {_PCT_SQL} SELECT player, season, " + ", ".join(f"floor({c}_pct * 10 + 0.5) / 10 AS {c}_pct" for c in _WEIGHTS) + " FROM pct")
def radar_percentiles(spark, sf):
    return _percentiles(spark, sf).select("player", "season", *[S.half_up(F.col(f"{c}_pct"), 1).alias(f"{c}_pct") for c in _WEIGHTS])


@query(f"""WITH {_PEER_SQL}, z AS (SELECT player, season, grp, minutes, """ + ", ".join(f"({c}_per90 - avg({c}_per90) OVER g) / CASE WHEN stddev_pop({c}_per90) OVER g = 0 THEN 1 ELSE stddev_pop({c}_per90) OVER g END AS {c}" for c in _WEIGHTS) + f""" FROM peer WINDOW g AS (PARTITION BY grp)),
target AS (SELECT * FROM z WHERE player = (SELECT min(player) FROM z) ORDER BY minutes DESC, player, season LIMIT 1),
near AS (SELECT z.player, z.season, ({" + ".join(f"z.{c} * t.{c}" for c in _WEIGHTS)}) / (sqrt({" + ".join(f"z.{c} * z.{c}" for c in _WEIGHTS)}) * sqrt({" + ".join(f"t.{c} * t.{c}" for c in _WEIGHTS)})) AS s
  FROM z JOIN target AS t ON t.grp = z.grp AND t.player <> z.player)
SELECT player, season, floor((s + 1) * 1e6 + 0.5) / 1e6 AS similarity FROM near
QUALIFY row_number() OVER (PARTITION BY player ORDER BY s DESC, season) = 1 ORDER BY s DESC, player, season LIMIT 20""")
def zscore_similarity(spark, sf):
    peers = _peers(spark, sf)
    first = peers.agg(F.min("player").alias("first"))  # one row
    marked = peers.crossJoin(F.broadcast(first)).withColumn("is_target", F.col("player") == F.col("first"))
    near = W.similar(marked, F.col("is_target"), ["player", "season"], [f"{c}_per90" for c in _WEIGHTS], ["grp"], 20, "minutes")
    return near.withColumn("similarity", S.half_up(F.col("similarity") + 1, 6))


_PROBE = [1.0 if k % 2 else 0.5 for k in range(64)]
_PROBE_SQL = "[" + ", ".join(f"{x}::DOUBLE" for x in _PROBE) + "]"


def _search_sql(where=""):
    return f"""WITH s AS (SELECT vec_id, list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), {_PROBE_SQL}) AS s FROM embeddings {where})
SELECT vec_id, floor((s + 1) * 1e6 + 0.5) / 1e6 AS similarity FROM s ORDER BY s DESC, vec_id LIMIT 10"""


def _searched(df):
    return Q.nearest(df, "embedding", _PROBE, 10, ["vec_id"]).select("vec_id", S.half_up(F.col("similarity") + 1, 6).alias("similarity"))


@query(_search_sql())
def embedding_topk(spark, sf):
    return _searched(table(spark, sf, "embeddings"))


@query(_search_sql("WHERE label IN (1, 3)"))
def masked_topk(spark, sf):
    return _searched(Q.matching(table(spark, sf, "embeddings"), {"label": F.col("label").isin(1, 3)}))


@query("""WITH u AS (SELECT list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_inner_product(list_transform(embedding, lambda y: y::DOUBLE), list_transform(embedding, lambda y: y::DOUBLE)))) AS v FROM embeddings WHERE label = 2),
m AS (SELECT i, avg(v[i + 1]) AS x FROM u, range(64) AS r(i) GROUP BY i)
SELECT i::INTEGER AS i, floor((x / sqrt(sum(x * x) OVER ()) + 1) * 1e6 + 0.5) / 1e6 AS x FROM m""")
def centroid(spark, sf):
    one = Q.centroid(table(spark, sf, "embeddings").filter("label = 2"), "embedding")
    return one.select(F.posexplode("centroid").alias("i", "x")).withColumn("x", S.half_up(F.col("x") + 1, 6))


@query(f"""WITH {B.FIXTURE_SQL}, sides AS (SELECT season, home AS team FROM fixture UNION SELECT season, away FROM fixture),
n AS (SELECT season, count(*) AS n_matches FROM fixture GROUP BY season), t AS (SELECT season, count(*) AS n_teams FROM sides GROUP BY season),
p AS (SELECT season, max(n) AS most FROM (SELECT season, team, count(*) AS n FROM (SELECT season, home AS team FROM fixture UNION ALL SELECT season, away FROM fixture WHERE away <> home) GROUP BY ALL) GROUP BY season)
SELECT season, n_matches, n_teams, most = n_matches AND n_teams > 2 AS focus,
  least(n_matches::DOUBLE / (CASE WHEN most = n_matches AND n_teams > 2 THEN 2 * (n_teams - 1) ELSE n_teams * (n_teams - 1) END), 1.0) AS coverage
FROM n JOIN t USING (season) JOIN p USING (season)""")
def season_coverage(spark, sf):
    return A.season_coverage(B.fixtures(spark, sf))


@query(f"""WITH {B.FIXTURE_SQL}, sides AS (SELECT season, home AS team FROM fixture UNION SELECT season, away FROM fixture),
c AS (SELECT season, least(any_value(n)::DOUBLE / (count(*) * (count(*) - 1)), 1.0) AS coverage FROM sides JOIN (SELECT season, count(*) AS n FROM fixture GROUP BY season) USING (season) GROUP BY season)
SELECT season, count(*) AS n_matches FROM fixture WHERE season NOT IN (SELECT season FROM c WHERE coverage < 0.6) GROUP BY season""")
def fragments(spark, sf):
    games = B.fixtures(spark, sf)
    return A.without_fragments(games, A.season_coverage(games), 0.6).groupBy("season").agg(F.count("*").alias("n_matches"))


@query("""SELECT c_custkey, c_mktsegment, c_acctbal FROM customer WHERE c_acctbal > 1000 AND c_acctbal <= 9000 AND lower(c_mktsegment) = 'building' AND contains(lower(c_name), '1')
ORDER BY c_acctbal DESC, c_custkey LIMIT 40""")
def structured_search(spark, sf):
    asked = Q.Query(("c_acctbal",), (("c_acctbal", "gt", 1000), ("c_acctbal", "lte", 9000)), (("c_mktsegment", "building"),), (("c_name", "1"),), "c_acctbal", True, 40)
    return Q.execute(table(spark, sf, "customer"), asked, ["c_custkey"]).select("c_custkey", "c_mktsegment", "c_acctbal")


@query("""SELECT c_custkey, c_name, max(o_totalprice) AS most FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_name ILIKE '%7%' GROUP BY ALL ORDER BY most DESC, c_name, c_custkey LIMIT 30""")
def player_list(spark, sf):
    named = table(spark, sf, "customer").filter(F.col("c_name").ilike("%7%")).select("c_custkey", "c_name")
    most = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("most"))
    return named.join(most, "c_custkey").orderBy(F.desc("most"), "c_name", "c_custkey").limit(30)


@query("SELECT c_custkey, c_nationkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def players_with_stats(spark, sf):
    done = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey", "c_nationkey").join(done, "c_custkey", "left_semi")


@query(f'WITH {B.SCORE_SQL} SELECT * EXCLUDE ("at") FROM score')
def scoreline(spark, sf):
    return B.scorelines(spark, sf).drop("at")


def _sides(spark, sf):
    games = B.scorelines(spark, sf)
    side = lambda own, other: games.select("match_id", "season", "at", F.col(own).alias("team"), *[F.col(f"{own}_{c}").alias(c) for c in ("goals", "shots", "xg100")], F.col(f"{other}_goals").alias("conceded"))
    return side("home", "away").unionByName(side("away", "home"))


_SIDE_SQL = B.SCORE_SQL + """,
side AS (SELECT match_id, season, "at", home AS team, home_goals AS goals, home_shots AS shots, home_xg100 AS xg100, away_goals AS conceded FROM score
  UNION ALL SELECT match_id, season, "at", away, away_goals, away_shots, away_xg100, home_goals FROM score)"""


@query(f"""WITH {_SIDE_SQL}, f AS (SELECT match_id, season, team, count(*) OVER w AS prior, """ + ", ".join(f"(sum({c}) OVER w)::DOUBLE / count(*) OVER w AS mean_{c}" for c in ("goals", "shots", "xg100", "conceded")) + """
  FROM side WINDOW w AS (PARTITION BY season, team ORDER BY "at", match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT * FROM f WHERE prior >= 4""")
def running_form(spark, sf):
    """Means of earlier matches only: a match's own score can't reach its features."""
    names = ["goals", "shots", "xg100", "conceded"]
    form = W.running_means(_sides(spark, sf), ["season", "team"], ["at", "match_id"], names, 4)
    return form.select("match_id", "season", "team", "prior", *[f"mean_{c}" for c in names])


@query(f'WITH {B.FIXTURE_SQL} SELECT match_id, season, row_number() OVER (PARTITION BY season ORDER BY "at", match_id) - 1 >= floor(count(*) OVER (PARTITION BY season) * 0.7::DOUBLE) AS is_test FROM fixture')
def time_split(spark, sf):
    return W.time_split(B.fixtures(spark, sf), ["season"], "at", ["match_id"]).select("match_id", "season", "is_test")


@query(f"""WITH RECURSIVE {B.SCORE_SQL}, complete AS (SELECT season FROM (SELECT season, count(*) AS n FROM fixture GROUP BY season) WHERE n >= 100),
game AS (SELECT * FROM score WHERE season IN (SELECT season FROM complete)),
chance AS (SELECT match_id, is_home, xg100 / 100.0::DOUBLE AS p, row_number() OVER (PARTITION BY match_id, is_home ORDER BY xg100) AS k FROM line WHERE match_id IN (SELECT match_id FROM game)),
start AS (SELECT match_id, is_home, 0 AS k, [1.0::DOUBLE] || list_transform(range(10), lambda x: 0.0::DOUBLE) AS d FROM (SELECT match_id, unnest([true, false]) AS is_home FROM game)),
dist AS (SELECT * FROM start UNION ALL
  SELECT dist.match_id, dist.is_home, chance.k, list_transform(range(11), lambda j: d[j + 1] * (1 - p) + (CASE WHEN j > 0 THEN d[j] ELSE 0 END) * p)
  FROM dist JOIN chance ON chance.match_id = dist.match_id AND chance.is_home = dist.is_home AND chance.k = dist.k + 1),
last AS (SELECT match_id, is_home, arg_max(d, k) AS d FROM dist GROUP BY ALL),
odds AS (SELECT h.match_id, list_sum(list_transform(range(1, 11), lambda j: h.d[j + 1] * list_sum(a.d[1:j]))) AS win, list_sum(list_transform(range(11), lambda j: h.d[j + 1] * a.d[j + 1])) AS draw
  FROM last AS h JOIN last AS a ON a.match_id = h.match_id WHERE h.is_home AND NOT a.is_home),
rows_ AS (SELECT home AS team, CASE WHEN home_goals > away_goals THEN 3 WHEN home_goals = away_goals THEN 1 ELSE 0 END AS points, 3 * win + draw AS xpts FROM game JOIN odds USING (match_id)
  UNION ALL SELECT away, CASE WHEN away_goals > home_goals THEN 3 WHEN home_goals = away_goals THEN 1 ELSE 0 END, 3 * greatest(0, 1 - win - draw) + draw FROM game JOIN odds USING (match_id))
SELECT team, count(*) AS played, sum(points)::BIGINT AS points, floor(sum(xpts) * 1e4 + 0.5) / 1e4 AS xpts FROM rows_ GROUP BY team""")
def expected_table(spark, sf):
    games = B.scorelines(spark, sf)
    complete = B.fixtures(spark, sf).groupBy("season").agg(F.count("*").alias("n")).filter("n >= 100")
    games = games.join(complete.select("season"), "season", "left_semi")
    side = lambda home: F.sort_array(F.collect_list(F.when(F.col("is_home") == home, F.col("xg100")))).alias("home_xg" if home else "away_xg")
    shots = B.lines(spark, sf).groupBy("match_id").agg(side(True), side(False))
    shots = shots.select("match_id", *[F.transform(c, lambda x: x / F.lit(100.0)).alias(c) for c in ("home_xg", "away_xg")])
    out = A.expected_table(shots, games.select("match_id", "home", "away", "home_goals", "away_goals"))
    return out.select("team", "played", "points", S.half_up(F.col("xpts"), 4).alias("xpts"))


_CELL = "(least(greatest(trunc({y} / 10)::INTEGER, 0), 7) * 12 + least(greatest(trunc({x} / 10)::INTEGER, 0), 11))"
_AT, _NEXT = _CELL.format(x="x", y="y"), _CELL.format(x="next_x", y="next_y")


def _grid(spark, sf):
    return B.actions(spark, sf).groupBy("player", S.cell(F.col("x"), F.col("y")).alias("cell")).agg(F.count("*").alias("n"))


@query(f"WITH {B.ACTION_SQL} SELECT player, {_AT} AS cell, count(*) AS n FROM action GROUP BY ALL")
def pitch_grid(spark, sf):
    return _grid(spark, sf)


@query(f"""WITH {B.ACTION_SQL}, g AS (SELECT player, {_AT} AS cell, count(*) AS n FROM action GROUP BY ALL), c AS (SELECT player, n, cell % 12 * 10 + 5 AS cx, cell // 12 * 10 + 5 AS cy FROM g),
s AS (SELECT player, sum(n)::BIGINT AS actions, sum(n * cx)::BIGINT AS sx, sum(n * cx * cx)::BIGINT AS sxx, sum(n * cy)::BIGINT AS sy, sum(n * cy * cy)::BIGINT AS syy,
  sum(n) FILTER (cx >= 80) AS f, sum(n) FILTER (cx < 40) AS o, sum(n) FILTER (cy < 26) AS l, sum(n) FILTER (cy > 54) AS r, sum(n) FILTER (cy < 20 OR cy >= 60) AS w FROM c GROUP BY player)
SELECT player, actions, sx::DOUBLE / actions AS mean_x, sy::DOUBLE / actions AS mean_y, sqrt((sxx * actions - sx * sx)::DOUBLE / (actions * actions)) AS spread_x, sqrt((syy * actions - sy * sy)::DOUBLE / (actions * actions)) AS spread_y,
  coalesce(f, 0)::DOUBLE / actions AS final_third, coalesce(o, 0)::DOUBLE / actions AS own_third, coalesce(l, 0)::DOUBLE / actions AS left_share, coalesce(r, 0)::DOUBLE / actions AS right_share, coalesce(w, 0)::DOUBLE / actions AS wide_share FROM s""")
def zone_features(spark, sf):
    return A.zone_features(_grid(spark, sf), "player")


def _threat(spark, sf):
    acts = B.actions(spark, sf).withColumn("cell", S.cell(F.col("x"), F.col("y")))
    goal = (F.col("event_type") == "purchase") & (F.col("x") >= 60)
    moved = F.col("event_type").isin("click", "view") & F.col("next_x").isNotNull()
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    cells = acts.groupBy("cell").agg(count(F.col("event_type") == "purchase").alias("shots"), count(goal).alias("goals"), count(moved).alias("moves"))
    to = S.cell(F.col("next_x"), F.col("next_y"))
    moves = acts.filter(moved).groupBy("player", F.col("cell").alias("from_cell"), to.alias("to_cell")).agg(F.count("*").alias("n"))
    return A.expected_threat(cells, moves.groupBy("from_cell", "to_cell").agg(F.sum("n").alias("n"))), moves


_XT_SQL = f"""RECURSIVE {B.ACTION_SQL}, a AS (SELECT *, {_AT} AS cell, event_type IN ('click', 'view') AND next_x IS NOT NULL AS moved FROM action),
c AS (SELECT cell, count(*) FILTER (event_type = 'purchase') AS shots, count(*) FILTER (event_type = 'purchase' AND x >= 60) AS goals, count(*) FILTER (moved) AS moves FROM a GROUP BY cell),
m AS (SELECT player, cell AS from_cell, {_NEXT} AS to_cell, count(*) AS n FROM a WHERE moved GROUP BY ALL),
l AS (SELECT from_cell, to_cell, sum(n)::BIGINT AS n FROM m GROUP BY ALL),
grid AS (SELECT k AS cell, coalesce(CASE WHEN shots + moves > 0 THEN shots::DOUBLE / (shots + moves) ELSE 0 END * CASE WHEN shots > 0 THEN goals::DOUBLE / shots ELSE 0 END, 0) AS pay,
  coalesce(CASE WHEN shots + moves > 0 THEN moves::DOUBLE / (shots + moves) ELSE 0 END, 0) AS go, coalesce(moves, 0) AS tries, coalesce(t, []) AS leads
  FROM range(96) AS r(k) LEFT JOIN c ON c.cell = k LEFT JOIN (SELECT from_cell, list({{'t': to_cell, 'n': n}} ORDER BY to_cell) AS t FROM l GROUP BY from_cell) ON from_cell = k),
whole AS (SELECT list({{'p': pay, 'g': go, 'tries': tries, 'l': leads}} ORDER BY cell) AS g FROM grid),
step AS (SELECT 0 AS i, list_transform(range(96), lambda k: 0.0::DOUBLE) AS x UNION ALL
  SELECT i + 1, list_transform(g, lambda q: q.p + CASE WHEN q.tries > 0 THEN q.g * coalesce(list_sum(list_transform(q.l, lambda e: e.n::DOUBLE / q.tries * x[e.t + 1])), 0) ELSE 0 END) FROM step, whole WHERE i < 50),
xt AS (SELECT unnest(range(96))::INTEGER AS cell, unnest(x) AS threat FROM step WHERE i = 50)"""


@query(f"WITH {_XT_SQL} SELECT cell, floor(threat * 1e6 + 0.5) / 1e6 AS threat FROM xt")
def xt_grid(spark, sf):
    return _threat(spark, sf)[0].select("cell", S.half_up(F.col("threat"), 6).alias("threat"))


@query(f"""WITH {_XT_SQL} SELECT player, floor((sum(n * (e.threat - s.threat)) + 100) * 1e6 + 0.5) / 1e6 AS added FROM m JOIN xt AS s ON s.cell = from_cell JOIN xt AS e ON e.cell = to_cell GROUP BY player""")
def xt_added(spark, sf):
    grid, moves = _threat(spark, sf)
    return A.threat_added(moves, grid, "player").select("player", S.half_up(F.col("added") + 100, 6).alias("added"))


@query("""SELECT o_custkey, o_orderkey, abs(date_diff('day', DATE '1996-01-01', o_orderdate::DATE))::INTEGER AS gap FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY abs(date_diff('day', DATE '1996-01-01', o_orderdate::DATE)), o_orderdate, o_orderkey) = 1""")
def nearest_valuation(spark, sf):
    gap = F.abs(F.datediff(F.col("o_orderdate").cast("date"), F.lit("1996-01-01").cast("date")))
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", gap.alias("gap"))
    return W.first_by(rows, ["o_custkey"], [F.col("gap"), F.col("o_orderdate"), F.col("o_orderkey")]).drop("o_orderdate")


@query("""WITH u AS (SELECT p_name, max(p_retailprice) AS p_retailprice FROM part GROUP BY p_name HAVING count(*) = 1) SELECT p_partkey, u.p_retailprice AS price FROM part LEFT JOIN u ON u.p_name = part.p_name""")
def unique_key_lookup(spark, sf):
    part = table(spark, sf, "part")
    return Q.unique_lookup(part.select("p_partkey", "p_name"), part.select("p_name", F.col("p_retailprice").alias("price")), "p_name", "price").select("p_partkey", "price")


_FOLD = "translate(lower(text), 'áàâäãåéèêëíìîïóòôöõúùûüñç', 'aaaaaaeeeeiiiiooooouuuunc')"


@query(f"SELECT token, count(*) AS n FROM (SELECT unnest(list_distinct(regexp_extract_all({_FOLD}, '[a-z0-9]+'))) AS token FROM documents) GROUP BY token HAVING count(*) > 3")
def shared_tokens(spark, sf):
    return Q.shared_tokens(table(spark, sf, "documents"), "text")


@query(f"WITH {B.QUESTION_SQL} SELECT player, question, {B.said_sql(B.BEGIN, 0)} OR question LIKE '%mais de%' AS leaders FROM question")
def leader_flags(spark, sf):
    """Whether a question asks for leaders; the SQL knows it from how the question was made."""
    return B.questions(spark, sf).withColumn("leaders", Q.asks_for_leaders(F.col("question")))


def _first_sql(rules):
    return "(SELECT v FROM (VALUES " + ", ".join(f"('{v}', nullif(strpos(q, nullif(regexp_extract(q, '{p}'), '')), 0))" for v, p in rules) + ") AS r(v, spot) WHERE spot IS NOT NULL ORDER BY spot, v LIMIT 1)"


@query(f"""WITH {B.QUESTION_SQL}, asked AS (SELECT player, question, strip_accents(lower(question)) AS q FROM question)
SELECT player, question, {_first_sql(Q.FOOT_WORDS)} AS foot, {_first_sql(Q.GROUP_WORDS)} AS position_group,
  coalesce(try_cast(nullif(regexp_extract(q, '{Q.OLDEST}', 1), '') AS INTEGER), CASE WHEN regexp_matches(q, '{Q.YOUNG}') THEN {Q.YOUNG_MOST} END, -1) AS max_age,
  coalesce(try_cast(nullif(regexp_extract(q, '{Q.YOUNGEST}', 1), '') AS INTEGER), CASE WHEN regexp_matches(q, '{Q.VETERAN}') THEN {Q.VETERAN_LEAST} END, -1) AS min_age FROM asked""")
def constraint_parse(spark, sf):
    found = Q.parse_constraints("question")
    return B.questions(spark, sf).select("player", "question", *[(F.coalesce(found[n], F.lit(-1)) if n.endswith("age") else found[n]).alias(n) for n in ("foot", "position_group", "max_age", "min_age")])


@query("SELECT event_type, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS k, count(*) AS n FROM events GROUP BY event_type")
def json_metric(spark, sf):
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, sf, "events").groupBy("event_type").agg(F.sum(k).alias("k"), F.count("*").alias("n"))


@query(f"WITH {_PEER_SQL} SELECT grp, floor((corr(goals_per90, shots_per90) + 1) * 1e6 + 0.5) / 1e6 AS r FROM peer GROUP BY grp")
def pearson_pair(spark, sf):
    return _peers(spark, sf).groupBy("grp").agg(S.half_up(F.corr("goals_per90", "shots_per90") + 1, 6).alias("r"))


@query(f"WITH {_PEER_SQL} SELECT player, season, (rank() OVER (PARTITION BY grp ORDER BY goals_per90) - 1)::DOUBLE / count(*) OVER (PARTITION BY grp) * 100 AS below FROM peer")
def below_percentile(spark, sf):
    return R.ranked(_peers(spark, sf), ["player", "season"], {"below": "goals_per90"}, ["grp"], R.below_percentile).select("player", "season", "below")


@query(f"""WITH {_SEASON_SQL} SELECT a.player, a.season, (a.goals > b.goals)::INTEGER + (a.shots > b.shots)::INTEGER + (a.passes > b.passes)::INTEGER AS wins,
(a.goals = b.goals)::INTEGER + (a.shots = b.shots)::INTEGER + (a.passes = b.passes)::INTEGER AS ties FROM season AS a JOIN season AS b ON b.player = a.player AND b.season = a.season - 1""")
def stat_duel(spark, sf):
    now = _seasons(spark, sf)
    before = now.select("player", (F.col("season") + 1).alias("season"), *[F.col(c).alias(f"b_{c}") for c in ("goals", "shots", "passes")])
    count = lambda op: sum((op(F.col(c), F.col(f"b_{c}")).cast("int") for c in ("goals", "shots", "passes")), F.lit(0))
    return now.join(before, ["player", "season"]).select("player", "season", count(F.Column.__gt__).alias("wins"), count(F.Column.__eq__).alias("ties"))


@query("SELECT quality, count(*) AS n, avg((quality = 1 - toxic)::INTEGER)::DOUBLE AS recall FROM labels GROUP BY quality")
def class_recall(spark, sf):
    return table(spark, sf, "labels").groupBy("quality").agg(F.count("*").alias("n"), F.avg((F.col("quality") == 1 - F.col("toxic")).cast("int")).alias("recall"))


@query("""WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 0) AS b, count(*) FILTER (quality = 0 AND toxic = 1) AS c FROM labels)
SELECT b, c, CASE WHEN b + c > 0 THEN (abs(b - c) - 1)::DOUBLE * (abs(b - c) - 1) / (b + c) ELSE 0 END AS statistic FROM c""")
def mcnemar(spark, sf):
    pair = lambda q, t: F.sum(F.when((F.col("quality") == q) & (F.col("toxic") == t), 1).otherwise(0))
    counts = table(spark, sf, "labels").agg(F.coalesce(pair(1, 0), F.lit(0)).alias("b"), F.coalesce(pair(0, 1), F.lit(0)).alias("c"))
    gap = F.abs(F.col("b") - F.col("c")) - 1
    return counts.withColumn("statistic", F.when(F.col("b") + F.col("c") > 0, gap.cast("double") * gap / (F.col("b") + F.col("c"))).otherwise(0.0))


@query("""WITH u AS (SELECT user_id, ln(avg(value)) AS x, ln(var_samp(value)) AS y FROM events GROUP BY user_id HAVING count(*) > 2)
SELECT count(*) AS n, floor((regr_slope(y, x) + 100) * 1e4 + 0.5) / 1e4 AS slope, floor((regr_intercept(y, x) + 100) * 1e4 + 0.5) / 1e4 AS intercept FROM u""")
def log_variance_residual(spark, sf):
    users = table(spark, sf, "events").groupBy("user_id").agg(F.log(F.avg("value")).alias("x"), F.log(F.var_samp("value")).alias("y"), F.count("*").alias("n")).filter("n > 2")
    return users.agg(F.count("*").alias("n"), S.half_up(F.regr_slope("y", "x") + 100, 4).alias("slope"), S.half_up(F.regr_intercept("y", "x") + 100, 4).alias("intercept"))


@query("SELECT season, appearance, count(*) AS n FROM (SELECT year(o_orderdate)::INTEGER AS season, row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderdate, o_orderkey) - 1 AS appearance FROM orders) GROUP BY ALL")
def appearances(spark, sf):
    own = Window.partitionBy("o_custkey", "season").orderBy("o_orderdate", "o_orderkey")
    rows = table(spark, sf, "orders").withColumn("season", F.year("o_orderdate")).withColumn("appearance", (F.row_number().over(own) - 1).cast("long"))
    return rows.groupBy("season", "appearance").agg(F.count("*").alias("n"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_tumbling(spark, sf):
    """The batch form of the tumbling stream: one aggregate, over all rows."""
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return streams.tumbling(events).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w >= INTERVAL 30 MINUTE, true)::INTEGER AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_session(spark, sf):
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return streams.sessions(events).withColumn("start", F.col("start").cast("timestamp_ntz"))


#: Calls that a client has in a window, and its seconds: events are some hours apart, so a minute would refuse none.
_CALLS, _SECONDS = 3, 48 * 3600


@query(f"""WITH RECURSIVE c AS (SELECT user_id, event_id, epoch_us(ts) AS "at", row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
step AS (SELECT DISTINCT user_id, 0::BIGINT AS k, 0::BIGINT AS event_id, 0::BIGINT AS "at", []::BIGINT[] AS f, []::BIGINT[] AS kept FROM c
  UNION ALL SELECT c.user_id, c.k, c.event_id, c."at", list_filter(kept, lambda x: c."at" - x <= {_SECONDS * 1_000_000}),
    CASE WHEN len(list_filter(kept, lambda x: c."at" - x <= {_SECONDS * 1_000_000})) < {_CALLS} THEN list_append(list_filter(kept, lambda x: c."at" - x <= {_SECONDS * 1_000_000}), c."at") ELSE list_filter(kept, lambda x: c."at" - x <= {_SECONDS * 1_000_000}) END
  FROM step JOIN c ON c.user_id = step.user_id AND c.k = step.k + 1)
SELECT user_id, event_id, len(f) < {_CALLS} AS allowed, CASE WHEN len(f) >= {_CALLS} THEN (({_SECONDS * 1_000_000} - ("at" - f[1])) // 1000000 + 1)::INTEGER END AS retry_after FROM step WHERE k > 0""")
def rate_limit(spark, sf):
    """Which calls of a client a limit lets through, and how long the others have to wait: the batch form of the stream."""
    return state.limited(table(spark, sf, "events").select("user_id", "event_id", "ts"), _CALLS, _SECONDS)


@query()
def team_strength(spark, sf):
    """Attack and defence of every team by a Poisson regression, strongest attack first."""
    games = B.scorelines(spark, sf)
    side = lambda own, other: games.select(F.col(own).alias("team"), F.col(other).alias("opponent"), F.col(f"{own}_goals").alias("goals"), F.lit(own == "home").alias("is_home"))
    return M.team_strengths(side("home", "away").unionByName(side("away", "home")))[0]


@query()
def strengths_by_competition(spark, sf):
    """The same for each competition by itself and for all together, every fit in a task of its own."""
    games = B.scorelines(spark, sf).withColumn("scope", F.explode(F.array(F.col("competition").cast("string"), F.lit("overall"))))
    side = lambda own, other: games.select("scope", F.col(own).alias("team"), F.col(other).alias("opponent"), F.col(f"{own}_goals").alias("goals"), F.lit(own == "home").alias("is_home"))
    return M.strengths_by_scope(side("home", "away").unionByName(side("away", "home")), "scope")


@query()
def outcome_model(spark, sf):
    form = X.form_features(B.scorelines(spark, sf).withColumns({f"{s}_xg": F.col(f"{s}_xg100") / 100 for s in ("home", "away")}))
    split = W.time_split(form.join(B.fixtures(spark, sf).select("match_id", "at"), "match_id").withColumn("y", F.col("y").cast("double")), ["season"], "at", ["match_id"])
    return M.outcome_model(split, ["d_points", "d_gf", "d_ga", "d_xg_net"], "y").select("match_id", "is_test", "y", "p")


@query()
def classifier(spark, sf):
    return M.classify(_peers(spark, sf), [f"{c}_per90" for c in _RATES], "grp", "player").select("player", "season", "grp", "is_test", "predicted", "confidence")


@query()
def classifier_report(spark, sf):
    """How the classifier does on what it has not seen: recall by class."""
    found = M.classify(_peers(spark, sf), [f"{c}_per90" for c in _RATES], "grp", "player").filter("is_test")
    return found.groupBy("grp").agg(F.count("*").alias("n"), F.avg((F.col("predicted") == F.col("grp")).cast("int")).alias("recall"), F.avg("confidence").alias("confidence"))


@query()
def feature_importance(spark, sf):
    return M.importance(_peers(spark, sf), [f"{c}_per90" for c in _RATES], "grp")


@query()
def value_model(spark, sf):
    priced = _peers(spark, sf).join(table(spark, sf, "customer").select(F.col("c_custkey").alias("player"), F.greatest("c_acctbal", F.lit(0.0)).alias("value")), "player")
    return M.value_model(priced, [f"{c}_per90" for c in _RATES], "value", "player").select("player", "season", "is_test", "value", "predicted", "predicted_low", "predicted_high", "residual")
