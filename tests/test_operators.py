"""Reference operators on small closed cases."""

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import scalars as S
from tallyspark.operators import aggregates as A
from tallyspark.operators import profiles as P
from tallyspark.operators import search as Q


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_cells_and_zones(spark):
    assert [one(spark, S.cell(F.lit(x), F.lit(y))) for x, y in ((0.0, 0.0), (120.0, 80.0), (15.0, 0.0), (0.0, 15.0))] == [0, 95, 1, 12]
    left = spark.createDataFrame([(1, 10, 4)], "player int, cell int, n long")  # x 105, y 5
    row = A.zone_features(left, "player").first()
    assert (row.mean_x, row.mean_y, row.spread_x, row.spread_y) == (105.0, 5.0, 0.0, 0.0)
    assert (row.final_third, row.own_third, row.left_share, row.right_share, row.wide_share) == (1.0, 0.0, 1.0, 0.0, 1.0)
    assert not A.zone_features(left.withColumn("n", F.lit(0)), "player").count()


@pytest.mark.parametrize(
    "position, group, role",
    [(None, "Unknown", "Unknown"), ("Left Wing Back", "DEF", "Wing Back"), ("Right Back", "DEF", "Full Back"), ("Center Attacking Midfield", "MID", "Attacking Midfield"), ("Left Wing", "FWD", "Winger"), ("Goalkeeper", "GK", "Goalkeeper"), ("Substitute", "MID", "Unknown")],
)
def test_positions(spark, position, group, role):
    at = F.lit(position).cast("string")
    assert (one(spark, S.position_group(at)), one(spark, S.position_role(at))) == (group, role)


def test_texts(spark):
    assert [one(spark, S.ordinal(F.lit(n))) for n in (1, 2, 10, 11, 13, 20, 21, 83, 113)] == ["1st", "2nd", "10th", "11th", "13th", "20th", "21st", "83rd", "113th"]
    assert [one(spark, S.label(F.lit(c))) for c in ("xg_per90", "ball_recoveries_per90")] == ["xG", "ball recoveries"]
    assert [one(spark, S.last_sentence(F.lit(t))) for t in ("One. Two. Thr", "none here", "")] == ["One. Two.", "none here", ""]
    assert [one(spark, S.first_json(F.lit(t))) for t in ('so: {"a": {"b": 1}} done', "nothing")] == ['{"a": {"b": 1}}', None]
    assert [one(spark, S.asked_gender(F.lit(t))) for t in ("women who press", "jogadoras e homens", "Men", "anyone")] == ["female", None, "male", None]
    assert [one(spark, S.recoded(F.lit(t).cast("string"), S.SHOT_OUTCOMES)) for t in ("Saved to Post", "Off T", "new", None)] == ["saved", "off-target", "other", "other"]
    assert one(spark, P.biography(F.lit("Brazil"), F.lit(24.5), F.lit("both"), F.lit(185))) == ", from Brazil, 24 years old, two-footed, 1.85m tall"
    assert one(spark, P.biography(*[F.lit(None).cast(t) for t in ("string", "double", "string", "double")])) == ""


def test_questions(spark):
    asked = {
        "Quem faz mais passes progressivos?": ["progressive_passes"],
        "interceptions and tackles": ["interceptions", "tackles"],
        "golos esperados, golos, remates, cortes": ["xg", "goals", "shots"],
        "nothing of the kind": [],
    }
    assert [one(spark, P.metrics_in(F.lit(q))) for q in asked] == list(asked.values())


@pytest.mark.parametrize("question, leaders", [("who makes the most tackles", True), ("Quem faz MAIS cortes", True), ("a mostly calm defender", False), ("", False)])
def test_leaders(spark, question, leaders):
    assert one(spark, Q.asks_for_leaders(F.lit(question))) is leaders


def test_mentioned(spark):
    names = spark.createDataFrame([("Ashley Young",), ("Ana Silva",), ("Rui Silva",), ("Joao Silva",), ("Eva Silva",), ("Kylian Mbappe",), (None,)], "name string")
    found = lambda q: sorted(r.name for r in P.mentioned(names, "name", q).collect())
    assert found("a young winger like Mbappe") == ["Kylian Mbappe"]
    assert found("like Silva") == [] and found("ashley") == ["Ashley Young"] and found("") == []


def test_match_totals(spark):
    rows = [
        (1, 0, "Starting XI", 0, None, None, None, None, None, None, None, [7]),
        (1, 1, "Shot", 10, 7, "Center Forward", "Goal", 0.45, None, [110.0, 40.0], None, None),
        (1, 2, "Pass", 20, 7, "Center Forward", None, None, None, [60.0, 40.0], [100.0, 40.0], None),
        (1, 3, "Pass", 70, 8, "Left Wing", None, None, "Incomplete", [60.0, 40.0], [100.0, 40.0], None),
        (1, 4, "Half End", 90, None, None, None, None, None, None, None, None),
    ]
    schema = "match_id int, seq int, type string, minute int, player_id int, position string, shot_outcome string, shot_xg double, pass_outcome string, location array<double>, pass_end array<double>, lineup array<int>"
    found = {r.player_id: r for r in A.match_totals(spark.createDataFrame(rows, schema)).collect()}
    assert (found[7].minutes, found[7].goals, found[7].shots, found[7].xg, found[7].passes_completed, found[7].progressive_passes, found[7].position) == (90, 1, 1, 0.45, 1, 1, "Center Forward")
    assert (found[8].minutes, found[8].passes, found[8].passes_completed, found[8].progressive_passes) == (20, 1, 0, 0)


def test_moves(spark):
    arr = "array<double>"
    move = lambda kind, t, o: one(spark, S.open_play_move(F.lit(kind), F.lit(t).cast("string"), F.lit(o).cast("string"), F.lit(None).cast(arr), F.lit(None).cast(arr)))
    assert move("Pass", "Corner", None) is None and move("Shot", None, None) is None
    assert move("Pass", "Throw-in", None).completed and not move("Pass", None, "Out").completed and move("Carry", None, None).completed


def test_outcomes(spark):
    even = one(spark, S.outcome_probabilities(F.lit(1.3), F.lit(1.3)))
    assert abs(even.win - even.lose) < 1e-12 and abs(even.win + even.draw + even.lose - 1) < 1e-12


def test_filled(spark):
    players = spark.createDataFrame([(1, "left", None), (2, None, None), (3, None, 170)], "id int, foot string, height int")
    known = spark.createDataFrame([(1, "right", 180), (2, "odd", 50), (3, "both", 190)], "id int, foot string, height int")
    got = P.filled(players, known, "id", {"foot": F.col("foot").isin("left", "right", "both"), "height": F.col("height") > 100})
    assert sorted(map(tuple, got.collect())) == [(1, "left", 180), (2, None, None), (3, "both", 170)]
