"""Profile, retrieval, match and evaluation queries with the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import scalars as S
from tallyspark.operators import aggregates as A
from tallyspark.operators import profiles as P
from tallyspark.operators import peers as R
from tallyspark.plans import bindings as B
from tallyspark.plans.catalog import query
from tallyspark.plans.registry import _PCT_SQL, _PEER_SQL, _WEIGHTS, _peers, _percentiles
from tallyspark.sources.tables import table

#: Market segments stand in for position groups; furniture is a group that no weights know.
_GROUPS = {"BUILDING": "FWD", "AUTOMOBILE": "MID", "MACHINERY": "DEF", "HOUSEHOLD": "GK"}
_NAMES = {"goals": "goals", "shots": "shots", "xg": "xg100", "passes_completed": "passes"}


def _group_sql():
    pct = lambda m, c: f"(rank() OVER (PARTITION BY g ORDER BY {c}_per90) + (count(*) OVER (PARTITION BY g, {c}_per90) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY g) * 100 AS p_{m}"
    total = lambda w: "0.0::DOUBLE" + "".join(f" + p_{m} * {x}::DOUBLE" for m, x in w.items() if m in _NAMES)
    score = "CASE g " + "".join(f"WHEN '{g}' THEN {total(w)} " for g, w in P.WEIGHTS.items()) + "ELSE 0.0::DOUBLE END"
    group = "CASE grp " + "".join(f"WHEN '{s}' THEN '{g}' " for s, g in _GROUPS.items()) + "ELSE 'Unknown' END AS g"
    return f"""WITH {_PEER_SQL}, grouped AS (SELECT *, {group} FROM peer), scored AS (SELECT player, season, g, {", ".join(pct(m, c) for m, c in _NAMES.items())} FROM grouped)
SELECT player, season, g AS position_group, floor(({score}) * 10 + 0.5) / 10 AS score FROM scored"""


@query(_group_sql())
def position_scores(spark, sf):
    group = F.lit("Unknown")
    for segment, name in _GROUPS.items():
        group = F.when(F.col("grp") == segment, name).otherwise(group)
    frame = _peers(spark, sf).select("player", "season", group.alias("position_group"), *[F.col(f"{c}_per90").alias(f"{n}_per90") for n, c in _NAMES.items()])
    return P.position_scores(frame, ["player", "season"]).select("player", "season", "position_group", S.half_up(F.col("score"), 1).alias("score"))


@query(f"""WITH {_PCT_SQL}, m AS ({" UNION ALL ".join(f"SELECT player, season, '{c}' AS name, {c}_pct AS p FROM pct" for c in _WEIGHTS)}),
n AS (SELECT *, row_number() OVER (PARTITION BY player, season ORDER BY p DESC, name) AS k FROM m)
SELECT player, season, string_agg(name, ',' ORDER BY k) FILTER (k <= 2) AS strengths, max(name) FILTER (k = 3) AS weakest FROM n GROUP BY player, season""")
def profile_strengths(spark, sf):
    ranked = P.ranked_metrics({c: F.col(f"{c}_pct") for c in _WEIGHTS})
    rows = _percentiles(spark, sf).select("player", "season", ranked.alias("m"))
    return rows.select("player", "season", F.array_join(P.strengths(F.col("m"), 2)["name"], ",").alias("strengths"), F.get(P.weaknesses(F.col("m"), 1), F.lit(0))["name"].alias("weakest"))


_QUESTION = "Compare customer 000000007 with 000000123 or the best player"


@query("""WITH t AS (SELECT c_custkey, c_name, unnest(list_distinct(regexp_extract_all(lower(c_name), '[a-z0-9]+'))) AS token FROM customer)
SELECT DISTINCT c_custkey, c_name FROM t WHERE token IN ('customer', '000000007', '000000123') AND token NOT IN (SELECT token FROM t GROUP BY token HAVING count(*) > 3)""")
def mentioned_names(spark, sf):
    return P.mentioned(table(spark, sf, "customer").select("c_custkey", "c_name"), "c_name", _QUESTION)


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE label IN (1, 2, 3)),
u AS (SELECT list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM e WHERE vec_id < 20),
m AS (SELECT i, avg(v[i + 1]) AS x FROM u, range(64) AS r(i) GROUP BY i), q AS (SELECT list(x ORDER BY i) AS q FROM m),
s AS (SELECT vec_id, vec_id < 20 AS pinned, list_cosine_similarity(v, q) AS s FROM e, q)
SELECT vec_id, pinned, floor((s + 1) * 1e6 + 0.5) / 1e6 AS similarity FROM s ORDER BY pinned DESC, s DESC, vec_id LIMIT 25""")
def hybrid_retrieval(spark, sf):
    pool = table(spark, sf, "embeddings").filter("label in (1, 2, 3)")
    found = P.retrieved(pool, "embedding", F.col("vec_id") < 20, 25, ["vec_id"])
    return found.select("vec_id", "pinned", S.half_up(F.col("similarity") + 1, 6).alias("similarity"))


@query(f"""WITH {_PEER_SQL}, b AS (SELECT player, season, goals_per90 FROM peer WHERE grp = 'MACHINERY' QUALIFY row_number() OVER (PARTITION BY player ORDER BY goals_per90 DESC NULLS LAST, player, season) = 1)
SELECT * FROM b ORDER BY goals_per90 DESC NULLS LAST, player, season LIMIT 30""")
def metric_leaders(spark, sf):
    pool = _peers(spark, sf).filter("grp = 'MACHINERY'").select("player", "season", "goals_per90")
    return P.leaders(pool, "goals_per90", "player", ["player", "season"], 30)


_KINDS = {"purchase": "Shot", "click": "Pass", "view": "Carry", "signup": "Substitution", "error": "Bad Behaviour"}
_MATCH_SQL = """e AS (SELECT user_id AS player_id, ts::DATE AS match_id, event_id, hour(ts) * 60 + minute(ts) AS minute, event_type FROM events),
f AS (SELECT match_id, max(minute) AS last FROM e GROUP BY match_id)"""


@query(f"""WITH {_MATCH_SQL} SELECT match_id, player_id, greatest(0, coalesce(arg_max(minute, event_id) FILTER (event_type = 'error'), arg_max(minute, event_id) FILTER (event_type = 'signup'), any_value(last)) - min(minute))::INTEGER AS minutes,
count(*) FILTER (event_type = 'purchase') AS shots, count(*) FILTER (event_type = 'click') AS passes_completed, count(*) FILTER (event_type = 'view') AS carries FROM e JOIN f USING (match_id) GROUP BY match_id, player_id""")
def match_totals(spark, sf):
    kind = F.create_map(*[F.lit(x) for pair in _KINDS.items() for x in pair])
    minute = F.hour("ts") * 60 + F.minute("ts")
    card = F.when(F.col("event_type") == "error", "Red Card")
    events = table(spark, sf, "events").select(F.to_date("ts").alias("match_id"), F.col("event_id").alias("seq"), kind[F.col("event_type")].alias("type"), minute.alias("minute"), F.col("user_id").alias("player_id"), card.alias("card"))
    return A.match_totals(events).select("match_id", "player_id", "minutes", "shots", "passes_completed", "carries")


_POISSON = "list_transform(range(11), lambda k: exp(-{r}) * pow({r}, k) / factorial(k::INTEGER))"


@query(f"""WITH {B.SCORE_SQL}, r AS (SELECT season, sum(home_goals)::DOUBLE / count(*) AS h, sum(away_goals)::DOUBLE / count(*) AS a FROM score GROUP BY season),
g AS (SELECT season, {_POISSON.format(r="h")} AS h, {_POISSON.format(r="a")} AS a FROM r),
o AS (SELECT season, list_sum(list_transform(range(1, 11), lambda k: h[k + 1] * list_sum(a[1:k]))) AS win, list_sum(list_transform(range(11), lambda k: h[k + 1] * a[k + 1])) AS draw, list_sum(list_transform(range(1, 11), lambda k: a[k + 1] * list_sum(h[1:k]))) AS lose FROM g)
SELECT season, floor(win / (win + draw + lose) * 1e6 + 0.5) / 1e6 AS win, floor(draw / (win + draw + lose) * 1e6 + 0.5) / 1e6 AS draw, floor(lose / (win + draw + lose) * 1e6 + 0.5) / 1e6 AS lose FROM o""")
def outcome_probabilities(spark, sf):
    rate = lambda c: F.sum(c).cast("double") / F.count("*")
    rates = B.scorelines(spark, sf).groupBy("season").agg(rate("home_goals").alias("h"), rate("away_goals").alias("a"))
    found = rates.select("season", S.outcome_probabilities(F.col("h"), F.col("a")).alias("p"))
    return found.select("season", *[S.half_up(F.col(f"p.{c}"), 6).alias(c) for c in ("win", "draw", "lose")])


@query(f"""WITH {B.FIXTURE_SQL}, p AS (SELECT season, count(DISTINCT o_custkey) AS n_players FROM fixture JOIN orders ON o_orderkey = match_id GROUP BY season),
t AS (SELECT season, count(DISTINCT team) AS n_teams FROM (SELECT season, home AS team FROM fixture UNION ALL SELECT season, away FROM fixture) GROUP BY season)
SELECT season, count(*) AS n_matches, any_value(n_teams) AS n_teams, any_value(n_players) AS n_players FROM fixture JOIN p USING (season) JOIN t USING (season) GROUP BY season""")
def coverage_report(spark, sf):
    games = B.fixtures(spark, sf)
    played = games.join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("match_id"), "o_custkey"), "match_id")
    players = played.groupBy("season").agg(F.count_distinct("o_custkey").alias("n_players"))
    return A.season_coverage(games).join(players, "season").select("season", "n_matches", "n_teams", "n_players")


@query("""WITH h AS (SELECT quality, (quality = 1 - toxic)::INTEGER AS hit FROM labels), r AS (SELECT quality, avg(hit)::DOUBLE AS recall, sum(hit)::BIGINT AS hits, count(*) AS n FROM h GROUP BY quality)
SELECT sum(hits)::DOUBLE / sum(n)::DOUBLE AS accuracy, sum(recall) / count(*) AS balanced, sum(n)::BIGINT AS n FROM r""")
def accuracy(spark, sf):
    hit = (F.col("quality") == 1 - F.col("toxic")).cast("long")
    classes = table(spark, sf, "labels").groupBy("quality").agg(F.avg(hit).alias("recall"), F.sum(hit).alias("hits"), F.count("*").alias("n"))
    return classes.agg((F.sum("hits").cast("double") / F.sum("n")).alias("accuracy"), (F.sum("recall") / F.count("*")).alias("balanced"), F.sum("n").alias("n"))


@query(f"""WITH {_PEER_SQL}, k AS (SELECT grp, rank() OVER (PARTITION BY grp ORDER BY goals_per90) + (count(*) OVER (PARTITION BY grp, goals_per90) - 1) / 2.0::DOUBLE AS x,
rank() OVER (PARTITION BY grp ORDER BY passes_per90) + (count(*) OVER (PARTITION BY grp, passes_per90) - 1) / 2.0::DOUBLE AS y FROM peer)
SELECT grp, floor((corr(x, y) + 1) * 1e6 + 0.5) / 1e6 AS rho FROM k GROUP BY grp""")
def rank_correlation(spark, sf):
    ranks = R.ranked(_peers(spark, sf), ["player", "season"], {"x": "goals_per90", "y": "passes_per90"}, ["grp"], R.average_rank)
    return ranks.groupBy("grp").agg(S.half_up(F.corr("x", "y") + 1, 6).alias("rho"))


@query(f"""WITH {B.QUESTION_SQL} SELECT player, question, array_to_string(list_filter([{B.said_sql(B.FIRST, 5)}, {B.said_sql(B.SECOND, 6)}, {B.said_sql(B.THIRD, 7)}], lambda m: m IS NOT NULL), ',') AS metrics FROM question""")
def metrics_asked(spark, sf):
    """The metrics that questions name; the SQL knows them from how the questions were made."""
    return B.questions(spark, sf).withColumn("metrics", F.array_join(P.metrics_in(F.col("question")), ","))
