"""Queries over feeds: nested events with versions, filling by need and published sets, with the SQL they are compared
with."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators import enrichment as N
from tallyspark.operators import matches as X
from tallyspark.plans.catalog import query
from tallyspark.plans.registry import _AT, _PCT_SQL, _percentiles, _seasons
from tallyspark.sources import publication as U
from tallyspark.sources import raw
from tallyspark.sources.tables import artifact, shared_folder, table


def event_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a provider sends them: match_id (a day), version and line (nested JSON). Every third match was sent
    again, a metre further up the pitch and without each tenth event; one line in seventeen broke off."""
    key = F.col("event_id")
    k = F.get_json_object("props", "$.k").cast("int")
    events = table(spark, sf, "events").withColumn("match_id", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long")).withColumn("k", k)
    sent = events.withColumn("version", F.explode(F.when(F.col("match_id") % 3 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    sent = sent.filter((F.col("version") == 1) | (key % 10 != 0))
    named = lambda c: F.struct(c.alias("name"))
    is_ = lambda t: F.col("event_type") == t
    x = F.col("value") % 110 + F.col("version")
    place = F.array(x, (F.col("k") % 80).cast("double"))
    end = F.when(key % 11 != 0, F.array(F.col("value") % 60, (F.col("k") % 40).cast("double")))
    kinds = F.create_map(*[F.lit(w) for pair in {"click": "Pass", "view": "Carry", "purchase": "Shot", "error": "Pressure", "signup": "Block"}.items() for w in pair])
    outcome = F.get(F.array(*map(F.lit, ("Goal", "Saved", "Wayward", "Strange"))), (key % 4).cast("int"))
    event = F.struct(
        key.cast("string").alias("id"), key.alias("index"), named(kinds[F.col("event_type")]).alias("type"),
        F.when(key % 19 != 0, F.struct(F.col("user_id").alias("id"))).alias("player"),
        F.when(key % 23 == 0, F.slice(place, 1, 1)).otherwise(place).alias("location"),
        F.when(is_("click"), F.struct(F.when(key % 7 == 0, named(F.lit("Corner"))).alias("type"), F.when(key % 3 == 0, named(F.lit("Incomplete"))).alias("outcome"), end.alias("end_location"))).alias("pass"),
        F.when(is_("view"), F.struct(end.alias("end_location"))).alias("carry"),
        F.when(is_("purchase"), F.struct((F.col("k") / 100).alias("xg"), F.when(key % 5 == 0, named(F.lit("Penalty"))).alias("type"), named(outcome).alias("outcome"), F.when(key % 2 == 0, named(F.lit("Head"))).alias("body_part"))).alias("shot"),
    )
    text = F.to_json(event)
    return sent.select("match_id", "version", F.when(key % 17 == 0, F.substring(text, 1, 40)).otherwise(text).alias("line"))


_RAW_SQL = f"""sent AS (
  SELECT event_id AS e, date_diff('day', DATE '2024-01-01', ts::DATE) AS match_id, user_id AS player, event_type AS kind, value, json_extract(props, '$.k')::INTEGER AS k FROM events),
kept AS (SELECT *, CASE WHEN match_id % 3 = 0 THEN 2 ELSE 1 END AS version FROM sent WHERE match_id % 3 <> 0 OR e % 10 <> 0),
act AS (SELECT *, value % 110 + version AS x, (k % 80)::DOUBLE AS y, (kind = 'click' AND e % 7 <> 0) OR kind = 'view' AS moved, e % 11 <> 0 AND (kind = 'view' OR e % 3 <> 0) AS arrives
  FROM kept WHERE e % 17 <> 0 AND e % 19 <> 0 AND e % 23 <> 0)"""


def _last_events(spark, sf):
    return raw.newest(raw.event_texts(event_lines(spark, sf), "line"))


@query(f"""WITH {_RAW_SQL} SELECT match_id, player, count(*) AS actions, count(*) FILTER (moved) AS moves, count(*) FILTER (moved AND arrives) AS completed, count(*) FILTER (kind = 'purchase') AS shots,
count(*) FILTER (kind = 'purchase' AND e % 4 = 0) AS goals, count(*) FILTER (kind = 'purchase' AND e % 5 = 0) AS penalties, count(*) FILTER (kind = 'purchase' AND e % 2 = 0) AS headers,
coalesce(sum(k * 10) FILTER (kind = 'purchase'), 0)::BIGINT AS milli_xg FROM act GROUP BY match_id, player""")
def nested_events(spark, sf):
    """What players did in a match by the newest version of its raw events."""
    sums = raw.summed(raw.actions(_last_events(spark, sf), ["match_id"]), ["match_id", "player"])
    return sums.withColumn("milli_xg", F.round(F.col("chances") * 1000).cast("long")).drop("chances")


@query(f"""WITH {_RAW_SQL} SELECT match_id, {_AT} AS cell, count(*) AS n, count(*) FILTER (moved) AS tried FROM act GROUP BY ALL""")
def nested_cells(spark, sf):
    """Where a match was played, and from where the ball was moved, out of the same reduction as prepared events."""
    reduced = X.reduced_events(raw.actions(_last_events(spark, sf), ["match_id"]), ["match_id"])
    tried = reduced["moves_from"].withColumnRenamed("n", "tried")
    return reduced["cells"].join(tried, ["match_id", "cell"], "left").withColumn("tried", F.coalesce("tried", F.lit(0)))


@query(f"""WITH {_RAW_SQL} SELECT match_id, max(version)::INTEGER AS version, count(*) AS lines, count(*) FILTER (e % 17 = 0) AS broken FROM kept GROUP BY match_id""")
def feed_health(spark, sf):
    """Lines of each match's newest version, and those that don't parse."""
    return _last_events(spark, sf).groupBy("match_id").agg(F.max("version").alias("version"), F.count("*").alias("lines"), F.count("corrupt").alias("broken"))


@query("""WITH s AS (SELECT DISTINCT date_diff('day', DATE '2024-01-01', ts::DATE) AS match_id FROM events) SELECT match_id FROM s WHERE match_id % 3 <> 0""")
def outdated_matches(spark, sf):
    """Matches that the store has by an older version only, or lacks."""
    lines = event_lines(spark, sf).select("match_id", "version")
    return raw.outdated(lines, lines, 2)


#: Portions that all matches are cut into, about: a competition has one more at most, for what doesn't fill one.
PORTIONS = 12

_NEED_SQL = """game AS (SELECT o_orderkey AS match_id, year(o_orderdate)::INTEGER AS competition FROM orders),
known AS (SELECT l_orderkey AS match_id, l_suppkey AS player, CASE WHEN l_orderkey % 3 <> 0 THEN 'nick' || l_partkey % 50 END AS nickname, CASE WHEN l_partkey % 4 <> 0 THEN 'country' || l_partkey % 25 END AS country FROM lineitem),
player AS (SELECT s_suppkey AS player, CASE WHEN s_suppkey % 4 = 0 THEN 'own' || s_suppkey END AS nickname, CASE WHEN s_suppkey % 3 <> 1 THEN 'home' || s_suppkey % 9 END AS country FROM supplier),
need AS (SELECT competition, count(DISTINCT player) FILTER (player.nickname IS NULL OR player.country IS NULL) AS need FROM known JOIN game USING (match_id) JOIN player USING (player) GROUP BY competition),
first AS (SELECT known.player, known.nickname, known.country, match_id, competition FROM known JOIN game USING (match_id) JOIN need USING (competition)
  QUALIFY row_number() OVER (PARTITION BY known.player ORDER BY need DESC, competition, match_id, known.nickname IS NULL, known.country IS NULL, known.nickname, known.country) = 1)"""


@query(f"""WITH {_NEED_SQL} SELECT player, coalesce(player.nickname, first.nickname) AS nickname, coalesce(player.country, first.country) AS country,
CASE WHEN player.nickname IS NULL OR player.country IS NULL THEN match_id END AS match_id FROM player LEFT JOIN first USING (player)""")
def filled_by_need(spark, sf):
    """Players with nicknames and countries of line-ups, and the match that gave them. Line-ups are stored by competition
    once, so that a portion reads its own competition's and no others; portions grow with the matches, so that their
    number doesn't."""
    key = F.col("s_suppkey")
    players = table(spark, sf, "supplier").select(
        key.alias("player"), F.when(key % 4 == 0, F.concat(F.lit("own"), key)).alias("nickname"), F.when(key % 3 != 1, F.concat(F.lit("home"), key % 9)).alias("country")
    )
    part = F.col("l_partkey")
    games = table(spark, sf, "orders").select(F.col("o_orderkey").alias("match_id"), F.year("o_orderdate").alias("competition"))
    squads = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("match_id"), F.col("l_suppkey").alias("player"),
        F.when(F.col("l_orderkey") % 3 != 0, F.concat(F.lit(" nick"), part % 50, F.lit(" "))).otherwise(F.lit(" ")).alias("nickname"), F.when(part % 4 != 0, F.concat(F.lit("country"), part % 25)).alias("country"),
    )
    stored = f"{shared_folder(spark)}/squads-{uuid.uuid4().hex}"
    placed = squads.join(games, "match_id")
    placed.write.partitionBy("competition").parquet(stored)
    store = spark.read.schema(placed.schema).parquet(stored)
    path = f"{shared_folder(spark)}/line-ups-{uuid.uuid4().hex}"
    read = lambda some: store.join(some, ["competition", "match_id"]).drop("competition")
    N.scan_by_need(players, store.select("player", "competition"), games, read, ["nickname", "country"], path, max(500, -(-games.count() // PORTIONS)))
    seen = artifact(spark, path)
    filled = N.filled_from_scan(players, seen, ["nickname", "country"])
    return filled.withColumn("match_id", F.lit(None).cast("long")) if seen is None else filled.join(seen.select("player", "match_id"), "player", "left")


@query(f"""WITH {_PCT_SQL}, s AS (SELECT count(*) AS n, count(*) FILTER (season < 1998) AS was FROM pct)
SELECT 'percentiles' AS name, was AS rows, n AS pool, was AS fitted_on, abs(n - was) > greatest(5, n * 0.02) AS stale FROM s
UNION ALL SELECT 'totals', (SELECT count(*) FROM season WHERE season < 1998), n, was, abs(n - was) > greatest(5, n * 0.02) FROM s""")
def published_sets(spark, sf):
    """Percentiles and totals of the seasons before 1998, published as one set, and whether it still fits the pool."""
    folder = f"{shared_folder(spark)}/published-{uuid.uuid4().hex}"
    pool = _percentiles(spark, sf)
    old = pool.filter("season < 1998")
    bounds = {"within bounds": F.col("goals_pct").between(0, 100) & F.col("shots_pct").between(0, 100)}
    sets = {"percentiles": U.Artifact(old, bounds), "totals": U.Artifact(_seasons(spark, sf).filter("season < 1998"), {"played": F.col("matches") > 0})}
    U.publish(spark, folder, sets, old.count(), "percentiles-1")
    state = U.stale(spark, folder, pool, "percentiles-1")
    sizes = U.manifest(spark, folder).select(F.explode("tables").alias("t")).select("t.name")
    counted = [U.published(spark, folder, n).agg(F.lit(n).alias("name"), F.count("*").alias("rows")) for n in sets]
    return counted[0].unionByName(counted[1]).join(sizes, "name").join(state.select("pool", "fitted_on", "stale"), F.lit(True))
