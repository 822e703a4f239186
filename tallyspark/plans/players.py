"""Queries over players and questions about them, with the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import scalars as S
from tallyspark.functions import texts as X
from tallyspark.operators import lookups as L
from tallyspark.operators import peers as R
from tallyspark.operators import profiles as P
from tallyspark.operators import search as Q
from tallyspark.operators import windows as W
from tallyspark.plans import bindings as B
from tallyspark.plans.catalog import query
from tallyspark.plans.registry import _PEER_SQL, _RATE_SQL, _peers, _rates
from tallyspark.sources import tables as I
from tallyspark.sources.tables import table


@query("""SELECT c_custkey, c_name, c_mktsegment, round_even(c_acctbal, 3) AS c_acctbal FROM customer WHERE c_acctbal >= 500 AND lower(c_mktsegment) = 'machinery' ORDER BY customer.c_acctbal, c_custkey LIMIT 30""")
def search_projection(spark, sf):
    """A search's rows with who they are and the fields the search names, rounded, and nothing else."""
    asked = Q.Query(("c_acctbal", "c_nationkey"), (("c_acctbal", "gte", 500),), (("c_mktsegment", "machinery"),), (), "c_acctbal", False, 30)
    return Q.projected(Q.execute(table(spark, sf, "customer"), asked, ["c_custkey"]), asked, ["c_custkey", "c_name", "c_mktsegment"])


@query(f"""WITH {B.PEOPLE_SQL}, n AS (SELECT count(*) AS whole, count(*) FILTER (foot IS NULL OR foot = '') AS foot, count(*) FILTER (nationality IS NULL) AS nationality, count(*) FILTER (age IS NULL) AS age, count(*) FILTER (height IS NULL) AS height FROM people)
SELECT attribute, n FROM (SELECT 'foot' AS attribute, foot AS n, whole FROM n UNION ALL SELECT 'nationality', nationality, whole FROM n UNION ALL SELECT 'age', age, whole FROM n UNION ALL SELECT 'height', height, whole FROM n) WHERE n > 0 AND n < whole""")
def unknown_dropped(spark, sf):
    return L.unknown_dropped(B.people(spark, sf), {"foot": F.col("foot").isNull() | (F.col("foot") == ""), "nationality": F.col("nationality").isNull(), "age": F.col("age").isNull(), "height": F.col("height").isNull()})


@query(f"WITH {B.PEOPLE_SQL} SELECT player, age FROM people WHERE foot = 'left' AND age >= 20 AND age <= 30")
def constraint_mask(spark, sf):
    """Age bounds are inclusive, an unknown age or foot fails, and a height that nobody has is no filter."""
    return Q.matching(B.people(spark, sf), {"foot": F.col("foot") == "left", "age": F.col("age").between(20, 30), "height": F.col("height") >= 180}).select("player", "age")


@query(f"""WITH {B.PEOPLE_SQL}, {B.FIXTURE_SQL}, span AS (SELECT competition, year, min(epoch("at")) AS f, max(epoch("at")) AS l FROM fixture GROUP BY ALL)
SELECT player, year, round_even((f + (l - f) / 2 - epoch(birth::TIMESTAMP)) / 86400 / 365, 1) AS age FROM people LEFT JOIN span ON span.competition = player % 6""")
def season_ages(spark, sf):
    frame = B.people(spark, sf).select("player", "birth", (F.col("player") % 6).cast("int").alias("competition"))
    spans = L.season_spans(B.fixtures(spark, sf), ["competition", "year"], "at")
    years = frame.join(spans.select("competition", "year"), "competition", "left")
    return L.age_at_season(years, spans, ["competition", "year"], "birth").select("player", "year", "age")


@query("SELECT o_custkey AS player, min(o_orderpriority) AS gender FROM orders GROUP BY o_custkey")
def player_gender(spark, sf):
    return L.one_value(table(spark, sf, "orders").select(F.col("o_custkey").alias("player"), F.col("o_orderpriority").alias("gender")), "player", "gender")


@query(f"""WITH {B.PEOPLE_SQL}, known AS (SELECT s_name AS key, CASE WHEN s_suppkey % 3 > 0 THEN s_acctbal END AS value FROM supplier), p AS (SELECT player, replace(name, 'Customer', 'Supplier') AS name, 'Supplier#' || lpad((player % 150)::VARCHAR, 9, '0') AS nick FROM people)
SELECT player, CASE WHEN n.key IS NOT NULL THEN n.value ELSE f.value END AS value FROM p LEFT JOIN known AS n ON n.key = p.nick LEFT JOIN known AS f ON f.key = p.name""")
def nickname_lookup(spark, sf):
    known = table(spark, sf, "supplier").select(F.col("s_name").alias("key"), F.when(F.col("s_suppkey") % 3 > 0, F.col("s_acctbal")).alias("value"))
    nick = F.concat(F.lit("Supplier#"), F.lpad((F.col("player") % 150).cast("string"), 9, "0"))
    rows = B.people(spark, sf).select("player", F.replace(F.col("name"), F.lit("Customer"), F.lit("Supplier")).alias("name"), nick.alias("nick"))
    return L.by_first_known_name(rows, known, "nick", "name", "value").select("player", "value")


@query(f"""WITH {B.PEOPLE_SQL}, known AS (SELECT s_suppkey AS player, CASE s_suppkey % 4 WHEN 0 THEN 'odd' WHEN 1 THEN 'left' ELSE 'right' END AS foot FROM supplier)
SELECT people.player, coalesce(people.foot, CASE WHEN known.foot IN ('left', 'right', 'both') THEN known.foot END) AS foot FROM people LEFT JOIN known USING (player)""")
def lineup_fill(spark, sf):
    known = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("player"), F.when(F.col("s_suppkey") % 4 == 0, "odd").when(F.col("s_suppkey") % 4 == 1, "left").otherwise("right").alias("foot"))
    return P.filled(B.people(spark, sf).select("player", "foot"), known, "player", {"foot": F.col("foot").isin("left", "right", "both")})


@query(f"""WITH {B.PEOPLE_SQL}, known AS (SELECT s_suppkey AS player, CASE s_suppkey % 4 WHEN 0 THEN 'odd' WHEN 1 THEN 'left' ELSE 'right' END AS foot FROM supplier),
e AS (SELECT people.gender, CASE WHEN known.foot IN ('left', 'right', 'both') THEN known.foot END AS k FROM people LEFT JOIN known USING (player) WHERE people.foot IS NULL)
SELECT count(*) FILTER (gender = 'male' AND k IS NOT NULL) AS matched, count(*) FILTER (gender = 'male' AND k IS NULL) AS unmatched, count(*) FILTER (gender <> 'male') AS outside FROM e""")
def backfill_counts(spark, sf):
    known = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("player"), F.when(F.col("s_suppkey") % 4 == 0, "odd").when(F.col("s_suppkey") % 4 == 1, "left").otherwise("right").alias("foot"))
    return L.fill_report(B.people(spark, sf).select("player", "foot", "gender"), known, "player", "foot", F.col("foot").isin("left", "right", "both"), F.col("gender") == "male")


@query(f"""WITH {B.LINE_SQL}, s AS (SELECT player, season, sum(minutes) AS minutes, max(CASE WHEN season % 2 = 0 THEN '{{}}' ELSE position END) AS position FROM line GROUP BY ALL),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY player ORDER BY minutes DESC, season) = 1)
SELECT player, CASE WHEN position <> '{{}}' THEN split_part(position, ' ', 1) END AS role FROM b""".replace("'{}'", "''"))
def role_index(spark, sf):
    seasons = B.league(spark, sf, positions=True).groupBy("player", "season").agg(F.sum("minutes").alias("minutes"), F.max(F.when(F.col("season") % 2 != 0, F.col("position"))).alias("position"))
    return L.role_of_busiest(seasons, "player", "minutes", ["season"], "position", F.split_part(F.col("position"), F.lit(" "), F.lit(1)))


@query("SELECT o_orderkey, coalesce(s_name, 'team ' || o_custkey) AS team FROM orders LEFT JOIN supplier ON s_suppkey = o_custkey")
def labelled_teams(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    names = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("o_custkey"), F.col("s_name").alias("team"))
    return L.labelled(rows, names, "o_custkey", "team", F.concat(F.lit("team "), F.col("o_custkey").cast("string"))).select("o_orderkey", "team")


@query(f"WITH {B.PEOPLE_SQL} SELECT DISTINCT nationality FROM people WHERE nationality IS NOT NULL ORDER BY nationality")
def countries(spark, sf):
    """The vocabulary that questions are read against, as a table."""
    return B.people(spark, sf).select("nationality").filter("nationality is not null").distinct().orderBy("nationality")


@query(f"""WITH {_RATE_SQL} SELECT player || '-' || season AS id, goals_per90 AS value, minutes FROM rate WHERE minutes >= 60 AND goals_per90 IS NOT NULL""")
def metric_distribution(spark, sf):
    rows = _rates(spark, sf).filter("minutes >= 60 and goals_per90 is not null")
    return rows.select(F.concat_ws("-", "player", "season").alias("id"), F.col("goals_per90").alias("value"), "minutes")


@query(f"""WITH {_PEER_SQL}, o AS (SELECT grp, list(goals_per90 ORDER BY goals_per90) AS v FROM peer GROUP BY grp)
SELECT grp, v[floor(0.25::DOUBLE * len(v))::BIGINT + 1] AS q25, v[floor(0.5::DOUBLE * len(v))::BIGINT + 1] AS q50, v[floor(0.9::DOUBLE * len(v))::BIGINT + 1] AS q90 FROM o""")
def nearest_rank_quantiles(spark, sf):
    """sorted[floor(q n)], read off the ranks of the distinct values, so that no group is collected."""
    ranks = R.value_ranks(_peers(spark, sf), ["goals_per90"], ["grp"])
    place = lambda q: F.floor(F.lit(q) * F.col("known"))
    at = lambda q: F.max(F.when((F.col("below") <= place(q)) & (place(q) < F.col("below") + F.col("ties")), F.col("value")))
    return ranks.groupBy("grp").agg(at(0.25).alias("q25"), at(0.5).alias("q50"), at(0.9).alias("q90"))


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(strip_accents(lower(text)), '[^\x00-\x7F]', '', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS clean FROM documents""")
def clean_names(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.ascii_name(F.col("text")).alias("clean"))


@query("""SELECT n_nationkey, trim(regexp_replace(strip_accents(lower(split_part(n_name || ' (of ' || n_nationkey || ')', '(', 1))), '\\s+', ' ', 'g')) AS country FROM nation""")
def country_keys(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", X.country_key(F.concat(F.col("n_name"), F.lit(" (of "), F.col("n_nationkey").cast("string"), F.lit(")"))).alias("country"))


@query("""WITH p AS (SELECT p_partkey, string_split(trim(p_type), ' ') AS w FROM part)
SELECT p_partkey, unnest(list_distinct(CASE WHEN len(w) > 2 THEN [array_to_string(w, ' '), w[1] || ' ' || w[-1], w[1] || ' ' || w[2]] ELSE [array_to_string(w, ' ')] END)) AS variant FROM p""")
def name_variants(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.explode(X.name_variants(F.col("p_type"))).alias("variant"))


@query(f"""WITH {B.PEOPLE_SQL} SELECT player, CASE WHEN coalesce(foot, '') <> '' THEN (foot = 'left')::INTEGER END AS foot_left, CASE WHEN coalesce(foot, '') <> '' THEN (foot = 'right')::INTEGER END AS foot_right,
CASE WHEN coalesce(foot, '') <> '' THEN (foot = 'both')::INTEGER END AS foot_both, upper(gender[1]) || ':' || grp AS peers FROM people""")
def player_features(spark, sf):
    foot = F.nullif(F.col("foot"), F.lit(""))
    columns = {f"foot_{n}": c for n, c in S.one_hot(foot, ("left", "right", "both")).items()}
    return B.people(spark, sf).select("player", *[c.alias(n) for n, c in columns.items()], S.peer_group(F.col("gender"), F.col("grp")).alias("peers"))


@query("""WITH v AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '€' || (c_custkey % 90)::VARCHAR || '.5M' WHEN 1 THEN '€' || (c_custkey % 900)::VARCHAR || 'K' WHEN 2 THEN c_custkey::VARCHAR WHEN 3 THEN '' END AS raw FROM customer)
SELECT c_custkey, coalesce(try_cast(nullif(regexp_extract(raw, '[0-9]+(\\.[0-9]+)?'), '') AS DOUBLE), 0) * CASE WHEN raw LIKE '%M' THEN 1e6 WHEN raw LIKE '%K' THEN 1e3 ELSE 1 END AS euros FROM v""")
def value_strings(spark, sf):
    key = F.col("c_custkey")
    raw = F.when(key % 5 == 0, F.concat(F.lit("€"), (key % 90).cast("string"), F.lit(".5M"))).when(key % 5 == 1, F.concat(F.lit("€"), (key % 900).cast("string"), F.lit("K"))).when(key % 5 == 2, key.cast("string")).when(key % 5 == 3, "")
    return table(spark, sf, "customer").select("c_custkey", S.value_in_euros(raw).alias("euros"))


@query("""SELECT o_orderkey, try_cast(substr(CASE WHEN o_orderkey % 4 = 0 THEN 'unknown date' ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M') END, 1, 10) AS DATE) AS day, round_even(date_diff('day', DATE '1980-03-01', o_orderdate::DATE) / 365.25::DOUBLE, 1) AS years FROM orders""")
def parsed_days(spark, sf):
    raw = F.when(F.col("o_orderkey") % 4 == 0, "unknown date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm"))
    years = S.years_between(F.col("o_orderdate").cast("date"), F.lit("1980-03-01").cast("date"))
    return table(spark, sf, "orders").select("o_orderkey", S.day_of(raw).alias("day"), years.alias("years"))


@query(f"""WITH {B.PEOPLE_SQL} SELECT player, concat_ws(', ', CASE WHEN foot = 'both' THEN 'two-footed' WHEN foot <> '' THEN foot || '-footed' END, lower(grp) || 's', 'from ' || nationality, 'aged ' || round_even(age, 0)::INTEGER || ' or under') AS said FROM people""")
def described_constraints(spark, sf):
    role = F.col("grp")
    return B.people(spark, sf).select("player", X.described(F.col("foot"), role, F.lit(None).cast("string"), F.col("nationality"), F.col("age"), F.lit(None).cast("double")).alias("said"))


@query(f"""WITH {B.PEOPLE_SQL} SELECT player, name || ': goals ' || printf('%.2f', player % 7 / 4.0) || ' per 90' || CASE WHEN player % 3 > 0 THEN ', xG ' || printf('%.2f', player % 3 / 8.0) || ' per 90' ELSE '' END || '.' AS note FROM people WHERE player % 5 > 0""")
def metric_notes(spark, sf):
    known = {"goals_per90": F.when(F.col("player") % 5 > 0, F.col("player") % 7 / 4.0), "xg_per90": F.when((F.col("player") % 3 > 0) & (F.col("player") % 5 > 0), F.col("player") % 3 / 8.0)}
    return B.people(spark, sf).select("player", X.metric_note(F.col("name"), known).alias("note")).filter("note is not null")


@query(f"""WITH {B.PEOPLE_SQL} SELECT player, name || ', a ' || lower(grp) || ' player' || CASE WHEN nationality IS NULL THEN '' ELSE ', from ' || nationality END || CASE WHEN age IS NULL THEN '' ELSE ', ' || round_even(age, 0)::INTEGER || ' years old' END
  || CASE WHEN foot = 'both' THEN ', two-footed' WHEN foot <> '' THEN ', ' || foot || '-footed' ELSE '' END || '. Best at goals (91st percentile) and shots (83rd percentile). Weakest at passes (12th percentile).' AS prose FROM people""")
def profile_prose(spark, sf):
    metrics = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(p).alias("percentile")) for n, p in (("goals", 91.0), ("shots", 83.0), ("passes", 12.0))])
    lead = F.concat(F.col("name"), F.lit(", a "), F.lower("grp"), F.lit(" player"))
    life = P.biography(F.col("nationality"), F.col("age"), F.col("foot"), F.lit(None).cast("int"))
    return B.people(spark, sf).select("player", X.prose(lead, life, P.strengths(metrics, 2), P.weaknesses(metrics, 1)).alias("prose"))


@query(f"""WITH {B.PEOPLE_SQL}, c AS (SELECT player, name, row_number() OVER (ORDER BY player) AS k FROM people WHERE player <= 5)
SELECT 'Question: who is next?' || chr(10) || 'Only players: left-footed.' || chr(10) || 'Players:' || chr(10) || string_agg('- ' || name, chr(10) ORDER BY k) AS prompt FROM c""")
def assistant_prompt(spark, sf):
    hits = B.people(spark, sf).filter("player <= 5").select("player", "name")
    return X.prompt(hits, F.lit("who is next?"), F.lit("left-footed"), F.concat(F.lit("- "), F.col("name")), ["player"])


@query(f"""WITH {_PEER_SQL}, m AS (SELECT player, season, unnest([{{'name': 'goals', 'v': goals_per90}}, {{'name': 'shots', 'v': shots_per90}}, {{'name': 'passes', 'v': passes_per90}}]) AS x FROM peer WHERE player < 50),
k AS (SELECT player, season, x.name AS name, x.v AS v, row_number() OVER (PARTITION BY player, season ORDER BY x.v DESC, x.name) AS r FROM m)
SELECT player, season, string_agg(name, ', ' ORDER BY r) FILTER (r <= 2) AS strengths, string_agg(name, ', ' ORDER BY r DESC) FILTER (r >= 2) AS weaknesses FROM k GROUP BY ALL""")
def report_context(spark, sf):
    """Strengths best first and weaknesses worst first, as a report's context lists them."""
    ranked = P.ranked_metrics({n: F.col(f"{n}_per90") for n in ("goals", "shots", "passes")})
    rows = _peers(spark, sf).filter("player < 50").select("player", "season", ranked.alias("m"))
    said = lambda c: F.array_join(F.transform(c, lambda m: m["name"]), ", ")
    return rows.select("player", "season", said(P.strengths(F.col("m"), 2)).alias("strengths"), said(P.weaknesses(F.col("m"), 2)).alias("weaknesses"))


#: A country that questions name by its people, beside those of the table.
_SPAIN = "SPAIN"


def _earliest_sql(rules):
    return "[" + ", ".join(f"{{'spot': nullif(strpos(q, nullif(regexp_extract(q, '{r[1]}'), '')), 0), 'a': '{r[0]}', 'b': '{r[-1]}'}}" for r in rules) + "]"


def _first_of(rules):
    return f"list_sort(list_filter({_earliest_sql(rules)}, lambda x: x.spot IS NOT NULL))[1]"


@query(f"""WITH {B.QUESTION_SQL}, asked AS (SELECT player, question, strip_accents(lower(question)) AS q FROM question),
f AS (SELECT player, question, q, {_first_of([(v, p) for v, p in Q.GROUP_WORDS])} AS g, {_first_of([(role, p, grp) for role, p, grp in Q.ROLE_WORDS])} AS r FROM asked),
d AS (SELECT *, r IS NOT NULL AND (g IS NULL OR r.spot <= g.spot) AS named FROM f)
SELECT player, question, CASE {" ".join(f"WHEN regexp_matches(q, '{p}') THEN '{v}'" for v, p in Q.FOOT_WORDS)} END AS foot, CASE WHEN named THEN r.a END AS role, CASE WHEN named THEN r.b ELSE g.a END AS position_group,
  CASE WHEN regexp_matches(q, '{Q.OLDEST}') THEN regexp_extract(q, '{Q.OLDEST}', 1)::INTEGER WHEN regexp_matches(q, '{Q.YOUNG}') THEN {Q.YOUNG_MOST} ELSE -1 END AS max_age,
  CASE WHEN regexp_matches(q, '{Q.YOUNGEST}') THEN regexp_extract(q, '{Q.YOUNGEST}', 1)::INTEGER WHEN regexp_matches(q, '{Q.VETERAN}') THEN {Q.VETERAN_LEAST} ELSE -1 END AS min_age,
  CASE WHEN player % 3 <> 0 THEN (SELECT CASE WHEN n_nationkey % 8 = 0 THEN '{_SPAIN}' ELSE n_name END FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey = player) END AS nationality FROM d""")
def question_constraints(spark, sf):
    """Foot, role, position group, age bounds and nationality of questions, against the table's countries."""
    found = Q.parse_constraints("question", [*Q.country_vocabulary(table(spark, sf, "nation"), "n_name"), _SPAIN])
    return B.questions(spark, sf).select("player", "question", *[(F.coalesce(c, F.lit(-1)) if n.endswith("age") else c).alias(n) for n, c in found.items()])


@query(f"WITH {B.QUESTION_SQL} SELECT player, {B.said_sql(B.GENDERS, 3)} AS gender FROM question")
def asked_genders(spark, sf):
    """The gender that a question names, null where it names none or both."""
    return B.questions(spark, sf).select("player", S.asked_gender(F.col("question")).alias("gender"))


@query("SELECT c_custkey AS left_id, s_suppkey AS right_id, 1 AS common, 100.0::DOUBLE AS score FROM customer JOIN (SELECT replace(s_name, 'Supplier', 'Customer') AS name, min(s_suppkey) AS s_suppkey FROM supplier GROUP BY ALL) ON name = c_name")
def entity_match(spark, sf):
    left = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    right = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.regexp_replace("s_name", "Supplier", "Customer").alias("name"))
    return Q.match_names(left, right)


@query(f"""WITH {B.PEOPLE_SQL}, e AS (SELECT DISTINCT player FROM people WHERE gender = 'male') SELECT player, c_acctbal AS value FROM e JOIN customer ON c_custkey = player WHERE c_acctbal > 0""")
def men_only_values(spark, sf):
    """The guard stands before the join: values are known of men alone."""
    men = B.people(spark, sf).filter("gender = 'male'").select("player").distinct()
    return men.join(table(spark, sf, "customer").select(F.col("c_custkey").alias("player"), F.col("c_acctbal").alias("value")), "player").filter("value > 0")


@query("SELECT c_custkey, s_suppkey, coalesce(s_acctbal, c_acctbal) AS acctbal FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def upserted_values(spark, sf):
    """Suppliers' balances replace customers' under the same key; suppliers beyond them don't arise."""
    old = table(spark, sf, "customer").select("c_custkey", F.lit(None).cast("long").alias("s_suppkey"), F.col("c_acctbal").alias("acctbal"))
    new = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("c_custkey"), "s_suppkey", F.col("s_acctbal").alias("acctbal"))
    return I.upserted(old, new, ["c_custkey"])


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def unseen_matches(spark, sf):
    done = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return I.unseen(table(spark, sf, "orders").select("o_orderkey"), done, ["o_orderkey"])


@query("""SELECT p_partkey, p_retailprice AS price FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20""")
def keyword_column(spark, sf):
    """The price column is found by a keyword, as feeds name it differently."""
    part = table(spark, sf, "part")
    price = I.column_like(part, "value", "price")
    return part.select("p_partkey", F.col(price).alias("price")).orderBy(F.desc("price"), "p_partkey").limit(20)


@query(f"""WITH {B.PEOPLE_SQL}, v AS (SELECT c_custkey AS player, o_orderkey, o_totalprice AS value, abs(date_diff('day', DATE '1996-01-01', o_orderdate::DATE)) AS gap, o_orderdate FROM customer LEFT JOIN orders ON o_custkey = c_custkey),
n AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY player ORDER BY gap NULLS LAST, o_orderdate, o_orderkey) = 1)
SELECT player, value, birth, round_even(date_diff('day', birth, DATE '2016-01-01') / 365.25::DOUBLE, 1) AS age FROM n LEFT JOIN people USING (player)""")
def valuations_with_players(spark, sf):
    """The valuation nearest to a date, left-joined to what is known of the player, with the age at that date."""
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("player"), "o_orderkey", F.col("o_totalprice").alias("value"), "o_orderdate")
    gap = F.abs(F.datediff(F.col("o_orderdate").cast("date"), F.lit("1996-01-01").cast("date")))
    people = B.people(spark, sf).select("player", "birth")
    near = W.first_by(people.select("player").join(orders, "player", "left").withColumn("gap", gap), ["player"], [F.col("gap").asc_nulls_last(), F.col("o_orderdate"), F.col("o_orderkey")])
    return near.select("player", "value").join(people, "player", "left").withColumn("age", S.years_between(F.lit("2016-01-01").cast("date"), F.col("birth")))


def _index(spark, sf):
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("player"), F.col("embedding").alias("vector"))
    group = F.when(F.col("grp") == "BUILDING", "FWD").when(F.col("grp") == "MACHINERY", "DEF").otherwise("MID")
    return B.people(spark, sf).join(vectors, "player").withColumns({"position_group": group, "goals_per90": (F.col("player") % 97 / 10.0)})


@query(f"""WITH {B.PEOPLE_SQL}, pool AS (SELECT player, (player % 97) / 10.0::DOUBLE AS goals FROM people JOIN embeddings ON vec_id = player WHERE foot = 'left' AND age <= 30 AND grp = 'BUILDING')
SELECT player, row_number() OVER (ORDER BY goals DESC, player) AS place FROM pool QUALIFY place <= 8""")
def retrieve_leaders(spark, sf):
    """A question with requirements that asks for the leaders of a metric."""
    found = P.retrieve(_index(spark, sf), "which left-footed forwards under 30 score the most goals?", 8)
    return found.select("player", F.col("place").cast("long").alias("place"))


@query(f"""WITH {B.PEOPLE_SQL}, pool AS (SELECT player, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM people JOIN embeddings ON vec_id = player),
s AS (SELECT player, player = 7 AS pinned, list_cosine_similarity(v, (SELECT v FROM pool WHERE player = 7)) AS s FROM pool)
SELECT player, row_number() OVER (ORDER BY pinned DESC, s DESC, player) AS place FROM s QUALIFY place <= 8""")
def retrieve_named(spark, sf):
    """A question that names a player: that one first, then who is most alike."""
    found = P.retrieve(_index(spark, sf), "who resembles customer 000000007?", 8)
    return found.select("player", F.col("place").cast("long").alias("place"))


@query(f"""WITH {_RATE_SQL} SELECT season, minutes, goals, goals_per90 FROM rate WHERE player = 1 ORDER BY season DESC""")
def player_seasons(spark, sf):
    return _rates(spark, sf).filter("player = 1").select("season", "minutes", "goals", "goals_per90").orderBy(F.desc("season"))
