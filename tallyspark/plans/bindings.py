"""How the driver's tables stand in for entity-performance data, in Spark and, for the comparison, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.sources.tables import table

SUMS = ["minutes", "goals", "shots", "xg100", "passes"]


def league(spark: SparkSession, sf: str, positions: bool = False) -> DataFrame:
    """A row per line: player, match_id, season, minutes and counts and, if asked for, position, the only column that
    parts are joined for: every line has one. Joins are on keys; which side is broadcast is left to the sizes that
    Spark measures."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus", "l_discount")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    if positions:
        joined = joined.join(table(spark, sf, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(
        F.col("o_custkey").alias("player"),
        F.col("l_orderkey").alias("match_id"),
        F.year("o_orderdate").alias("season"),
        F.col("o_orderdate").alias("at"),
        *[F.col("p_type").alias("position")] * positions,
        F.col("l_quantity").alias("minutes"),
        (F.col("l_returnflag") == "R").cast("long").alias("goals"),
        (F.col("l_linestatus") == "F").cast("long").alias("shots"),
        F.round(F.col("l_discount") * 100).cast("long").alias("xg100"),
        F.lit(1).cast("long").alias("passes"),
        (F.col("l_linenumber") % 2 == 1).alias("is_home"),
    )


def fixtures(spark: SparkSession, sf: str) -> DataFrame:
    """A row per match: match_id, season, at, competition, home, away."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select(
        F.col("o_orderkey").alias("match_id"),
        F.year("o_orderdate").alias("year"),
        F.col("o_orderdate").alias("at"),
        F.col("n_regionkey").alias("competition"),
        F.concat_ws("-", "n_regionkey", F.year("o_orderdate")).alias("season"),
        F.col("c_nationkey").alias("home"),
        ((F.col("c_nationkey") + 1 + F.col("o_orderkey") % 24) % 25).cast("int").alias("away"),
    )


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """A row per line: match_id, is_home, goals, shots and xg100, without what orders know of it."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_discount")
    return rows.select(
        F.col("l_orderkey").alias("match_id"),
        (F.col("l_linenumber") % 2 == 1).alias("is_home"),
        (F.col("l_returnflag") == "R").cast("long").alias("goals"),
        (F.col("l_linestatus") == "F").cast("long").alias("shots"),
        F.round(F.col("l_discount") * 100).cast("long").alias("xg100"),
    )


def scorelines(spark: SparkSession, sf: str) -> DataFrame:
    """Fixtures with goals, shots and xg of both sides; matches without lines vanish. Lines are added up by their key
    alone before they meet a match, of which there is one an order, so no line is sorted for a join."""
    side = lambda c, home: F.sum(F.when(F.col("is_home") == home, F.col(c)).otherwise(0))
    names = [(f"{s}_{c}", c, s == "home") for s in ("home", "away") for c in ("goals", "shots", "xg100")]
    sums = lines(spark, sf).groupBy("match_id").agg(*[side(c, home).alias(name) for name, c, home in names])
    return fixtures(spark, sf).join(sums, "match_id")


def actions(spark: SparkSession, sf: str) -> DataFrame:
    """Events as actions on the pitch: player, kind, x, y and the next action's place on the same day."""
    from pyspark.sql import Window

    events = table(spark, sf, "events")
    placed = events.select(
        F.col("user_id").alias("player"),
        "event_id",
        "ts",
        F.to_date("ts").alias("day"),
        "event_type",
        (F.col("value") % 120).alias("x"),
        (F.get_json_object("props", "$.k").cast("int") % 80).cast("double").alias("y"),
    )
    nxt = Window.partitionBy("player", "day").orderBy("ts", "event_id")
    return placed.withColumn("next_x", F.lead("x").over(nxt)).withColumn("next_y", F.lead("y").over(nxt))


def people(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as players, with attributes made from their keys: some unknown, heights all."""
    key = F.col("c_custkey")
    customers = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    named = customers.join(table(spark, sf, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    return named.select(
        key.alias("player"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("grp"),
        F.when(key % 3 == 0, "female").otherwise("male").alias("gender"),
        F.when(key % 5 == 1, "").when(key % 5 == 2, "left").when(key % 5 == 3, "right").when(key % 5 == 4, "both").alias("foot"),
        F.when(key % 7 != 0, F.col("n_name")).alias("nationality"),
        F.when(key % 11 != 0, 16 + key % 25).cast("double").alias("age"),
        F.lit(None).cast("int").alias("height"),
        F.date_add(F.lit("1960-01-01").cast("date"), (key * 37 % 9000).cast("int")).alias("birth"),
    )


PEOPLE_SQL = """
people AS (
  SELECT c_custkey AS player, c_name AS name, c_mktsegment AS grp, CASE WHEN c_custkey % 3 = 0 THEN 'female' ELSE 'male' END AS gender,
         CASE c_custkey % 5 WHEN 1 THEN '' WHEN 2 THEN 'left' WHEN 3 THEN 'right' WHEN 4 THEN 'both' END AS foot, CASE WHEN c_custkey % 7 <> 0 THEN n_name END AS nationality,
         CASE WHEN c_custkey % 11 <> 0 THEN (16 + c_custkey % 25)::DOUBLE END AS age, NULL::INTEGER AS height, DATE '1960-01-01' + (c_custkey * 37 % 9000)::INTEGER AS birth
  FROM customer JOIN nation ON n_nationkey = c_nationkey
)"""
LINE_SQL = """
line AS (
  SELECT o_custkey AS player, l_orderkey AS match_id, year(o_orderdate)::INTEGER AS season, o_orderdate AS "at", p_type AS position, l_quantity AS minutes,
         (l_returnflag = 'R')::BIGINT AS goals, (l_linestatus = 'F')::BIGINT AS shots, round(l_discount * 100)::BIGINT AS xg100, 1::BIGINT AS passes,
         l_linenumber % 2 = 1 AS is_home
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey
)"""
FIXTURE_SQL = """
fixture AS (
  SELECT o_orderkey AS match_id, year(o_orderdate)::INTEGER AS year, o_orderdate AS "at", n_regionkey AS competition,
         n_regionkey || '-' || year(o_orderdate) AS season, c_nationkey AS home, ((c_nationkey + 1 + o_orderkey % 24) % 25)::INTEGER AS away
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
)"""
SCORE_SQL = (
    LINE_SQL
    + ","
    + FIXTURE_SQL
    + """,
score AS (
  SELECT fixture.*, s.* EXCLUDE (match_id) FROM fixture JOIN (
    SELECT match_id, sum(CASE WHEN is_home THEN goals ELSE 0 END)::BIGINT AS home_goals, sum(CASE WHEN is_home THEN shots ELSE 0 END)::BIGINT AS home_shots,
           sum(CASE WHEN is_home THEN xg100 ELSE 0 END)::BIGINT AS home_xg100, sum(CASE WHEN NOT is_home THEN goals ELSE 0 END)::BIGINT AS away_goals,
           sum(CASE WHEN NOT is_home THEN shots ELSE 0 END)::BIGINT AS away_shots, sum(CASE WHEN NOT is_home THEN xg100 ELSE 0 END)::BIGINT AS away_xg100
    FROM line GROUP BY match_id) AS s ON s.match_id = fixture.match_id
)"""
)
ACTION_SQL = """
action AS (
  SELECT *, lead(x) OVER w AS next_x, lead(y) OVER w AS next_y FROM (
    SELECT user_id AS player, event_id, ts, ts::DATE AS day, event_type, value % 120 AS x, ((json_extract(props, '$.k')::INTEGER) % 80)::DOUBLE AS y FROM events)
  WINDOW w AS (PARTITION BY player, day ORDER BY ts, event_id)
)"""


#: What questions are put together from, a piece of each by the customer's key: how they begin, feet, positions, genders,
#: ages, metrics; what each piece says stands beside it.
BEGIN = (("Who makes the most", True), ("Quem lidera em", True), ("Find me", False), ("Compare", False))
FEET = (("", None), ("left-footed", "left"), ("canhotos", "left"), ("two-footed", "both"), ("destro", "right"))
PLACES = ("", "winger", "full-backs", "defesas centrais", "médio ala", "goalkeepers", "a midfielder who plays as a winger")
GENDERS = (("", None), ("women", "female"), ("homens", "male"), ("women and men", None))
AGES = ("", "under 23", "over 30", "sub-21", "jovens", "veteran", "mais de 25 and under 29")
FIRST = (("", None), ("expected goals", "xg"), ("remates", "shots"), ("progressive passes", "progressive_passes"), ("pressing", "pressures"))
SECOND = (("", None), ("tackles", "tackles"), ("passes certos", "passes_completed"), ("conduções", "carries"))
THIRD = (("", None), ("golos", "goals"), ("blocks", "blocks"), ("alívios", "clearances"))


def _pieces() -> list[tuple[str, ...]]:
    first = lambda rules: tuple(r[0] for r in rules)
    return [first(BEGIN), first(FEET), PLACES, first(GENDERS), AGES, first(FIRST), first(SECOND), first(THIRD)]


#: By what the key is divided before the piece is taken, so that pieces go together in many ways.
_STRIDES = (1, 1, 3, 2, 5, 1, 7, 11)


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """A question a customer: player and question, with the name of the customer's nation in two of three."""
    key = F.col("c_custkey")
    said = [F.get(F.array(*map(F.lit, p)), (F.floor(key / stride) % len(p)).cast("int")) for p, stride in zip(_pieces(), _STRIDES)]
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.when(F.col("n_nationkey") % 8 == 0, "espanholas").otherwise(F.col("n_name")).alias("nation"))
    rows = table(spark, sf, "customer").select("c_custkey", "c_nationkey").join(nations, "c_nationkey")
    words = F.array(*said[:5], F.when(key % 3 != 0, F.concat(F.lit("from "), F.col("nation"))), *said[5:])
    return rows.select(key.alias("player"), F.array_join(F.filter(words, lambda w: w != ""), " ").alias("question"))


def _piece_sql(k: int) -> str:
    words = _pieces()[k]
    return "[" + ", ".join(f"'{w}'" for w in words) + f"][(c_custkey // {_STRIDES[k]}) % {len(words)} + 1]"


def said_sql(rules, k: int) -> str:
    """What the piece of kind k says, null where it says nothing."""
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for _, v in rules) + f"][(player // {_STRIDES[k]}) % {len(rules)} + 1]"


QUESTION_SQL = f"""
question AS (
  SELECT c_custkey AS player, array_to_string(list_filter([{", ".join(map(_piece_sql, range(5)))}, CASE WHEN c_custkey % 3 <> 0 THEN 'from ' || CASE WHEN n_nationkey % 8 = 0 THEN 'espanholas' ELSE n_name END END,
         {", ".join(map(_piece_sql, range(5, 8)))}], lambda w: w <> ''), ' ') AS question
  FROM customer JOIN nation ON n_nationkey = c_nationkey
)"""
