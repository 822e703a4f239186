"""Models on small made data whose answer is known, ranks and splits against plain versions."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.functions import scalars as S
from tallyspark.functions import texts as X
from tallyspark.operators import evaluation as E
from tallyspark.operators import lookups as L
from tallyspark.operators import models as M
from tallyspark.operators import peers as R
from tallyspark.operators import search as Q
from tallyspark.operators import windows as W


def test_ranks_equal_a_plain_version(spark):
    random.seed(5)
    rows = [(k, random.choice(["a", "b", None]), random.choice([None, 0.0, float(random.randint(0, 400))])) for k in range(3000)]
    df = spark.createDataFrame(rows, "id int, g string, x double")
    got = {r.id: (r.p, r.b) for r in R.ranked(R.ranked(df, ["id"], {"p": "x"}, ["g"]), ["id"], {"b": "x"}, ["g"], R.below_percentile).collect()}
    known = defaultdict(list)
    for _, g, x in rows:
        if x is not None:
            known[g].append(x)
    for k, g, x in rows:
        if x is None:
            assert got[k] == (None, None)
            continue
        below, ties, n = sum(v < x for v in known[g]), sum(v == x for v in known[g]), len(known[g])
        assert got[k] == ((below + 1 + (ties - 1) / 2) / n * 100, below / n * 100)
    top = Counter(r.g for r in R.top_of(df.filter("x is not null"), ["g"], [F.desc("x"), F.col("id")], 7).collect())
    assert top == {"a": 7, "b": 7, None: 7}


def test_ranks_hold_when_cuts_never_come_out_twice_alike(spark, monkeypatch):
    random_cuts = F.udf(lambda n: sorted(random.SystemRandom().uniform(0, 400) for _ in range(9)), "array<double>")
    monkeypatch.setattr(F, "percentile_approx", lambda value, *_: random_cuts(F.count(value)))
    rows = [(k, k % 2, float(k * 7 % 401)) for k in range(2000)]
    spark.conf.set("spark.sql.exchange.reuse", False)  # larger tables' plans sketch twice; so do these
    try:
        got = {r.id: r.b for r in R.ranked(spark.createDataFrame(rows, "id int, g int, x double"), ["id"], {"b": "x"}, ["g"], R.below_percentile).collect()}
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    known = defaultdict(list)
    for _, g, x in rows:
        known[g].append(x)
    assert got == {k: sum(v < x for v in known[g]) / len(known[g]) * 100 for k, g, x in rows}


def test_shortlists_end_at_their_size(spark):
    """The leader in goals has fewest shots: a pool of 100,000 of 100,010 rows doesn't hold it."""
    from tallyspark.plans.evaluation import _shortlists

    n = F.col("id")
    rows = spark.range(100_010).select(n.alias("player"), F.lit(1).alias("season"), n.cast("double").alias("goals_per90"), (-n).cast("double").alias("shots_per90"))
    got = {r.pool: (r.leaders, r.first_shown) for r in _shortlists(rows, (6, 100_000, 200_000)).collect()}
    assert got == {6: (0.0, 0), 100_000: (0.0, 0), 200_000: (1.0, 1)}


def test_standard_scores_of_equal_values_are_0(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (2, "a", 2.0), (3, "b", 1.0), (4, "b", 3.0)], "id int, g string, x double")
    assert {r.id: r.z_x for r in R.standardised(df, ["x"], ["g"]).collect()} == {1: 0.0, 2: 0.0, 3: -1.0, 4: 1.0}


def test_splits_in_time_equal_a_plain_version(spark):
    random.seed(6)
    rows = [(k, random.choice("ab"), f"2020-01-{random.randint(1, 9):02d} {random.randint(0, 23):02d}:00:00") for k in range(500)]
    df = spark.createDataFrame(rows, "id int, g string, at string").withColumn("at", F.col("at").cast("timestamp"))
    got = {r.id: r.is_test for r in W.time_split(df, ["g"], "at", ["id"]).collect()}
    for g in "ab":
        own = sorted((at, k) for k, h, at in rows if h == g)
        assert [got[k] for _, k in own] == [place >= int(len(own) * 0.7) for place in range(len(own))]


def test_the_better_team_is_stronger(spark):
    random.seed(1)
    strength = {"strong": 1.2, "middle": 0.2, "weak": -0.8}
    rows = []
    for _ in range(60):
        for a in strength:
            for b in strength:
                if a != b:
                    home, away = (2.0, 1.0)
                    rows += [(a, b, max(0, round(home + strength[a] - strength[b] + random.random() - 0.5)), True), (b, a, max(0, round(away + strength[b] - strength[a] + random.random() - 0.5)), False)]
    found, home = M.team_strengths(spark.createDataFrame(rows, "team string, opponent string, goals int, is_home boolean"))
    got = found.collect()
    assert [r.team for r in got] == ["strong", "middle", "weak"] and home > 1.1
    assert got[0].defence > got[1].defence > got[2].defence


def test_held_out_rows_are_told_apart_and_classified(spark):
    random.seed(2)
    rows = [(k, "left" if k % 2 else "right", (1.0 if k % 2 else -1.0) + random.random() / 2, random.random()) for k in range(400)] + [(900 + k, "rare", 0.0, 0.0) for k in range(3)]
    got = M.classify(spark.createDataFrame(rows, "id int, side string, x double, y double"), ["x", "y"], "side", "id").collect()
    held = [r for r in got if r.is_test]
    assert len(got) == 400 and 60 < len(held) < 140 and sum(r.predicted == r.side for r in held) > 0.95 * len(held)
    assert all(abs(sum(r.p) - 1) < 1e-9 and r.confidence == max(r.p) for r in got)
    top = spark.range(1).select(M.shortlist(F.array(F.lit(0.2), F.lit(0.5), F.lit(0.3)), ["a", "b", "c"], 2).alias("s")).first().s
    assert [(x.name, x.p) for x in top] == [("b", 0.5), ("c", 0.3)]


def test_values_of_unseen_keys_lie_in_the_band(spark):
    random.seed(3)
    rows = [(k, float(x := random.randint(0, 9)), 1000.0 * (x + 1) * random.uniform(0.9, 1.1)) for k in range(600)]
    got = [r for r in M.value_model(spark.createDataFrame(rows, "id int, x double, v double"), ["x"], "v", "id").collect() if r.is_test]
    assert all(r.predicted_low <= r.predicted <= r.predicted_high for r in got)
    assert sum(r.predicted_low <= r.v <= r.predicted_high for r in got) > 0.75 * len(got)
    assert M.linear_fit(spark.createDataFrame([(float(k), 2.0 * k) for k in range(9)], "a double, b double"), "a", "b").coefficients[0] == pytest.approx(2.0)
    assert M.importance(spark.createDataFrame([(k, str(k % 2), float(k % 2), 0.5) for k in range(60)], "id int, c string, x double, n double"), ["x", "n"], "c").first().feature == "x"


def test_resampling_covers_the_mean(spark):
    df = spark.createDataFrame([(k, float(k % 2)) for k in range(400)], "id int, hit double")
    r = E.bootstrap_mean(df, "id", "hit", 100).first()
    assert r.mean == 0.5 and 0.42 < r.low < 0.49 and 0.51 < r.high < 0.58


@pytest.mark.parametrize(
    "question, wanted",
    [
        ("right footed or left footed strikers", ("left", "Centre Forward", "FWD", None, None)),
        ("a midfielder who plays as a winger", (None, None, "MID", None, None)),
        ("médio ala", (None, None, "MID", None, None)),
        ("defesas centrais jovens", (None, "Centre Back", "DEF", 23, None)),
        ("young wingers under 20", (None, "Winger", "FWD", 20, None)),
        ("veteran full-backs", (None, "Full Back", "DEF", None, 32)),
        ("ambidestros", ("both", None, None, None, None)),
        ("qual e a media de remates", (None, None, None, None, None)),
    ],
)
def test_constraints(spark, question, wanted):
    found = Q.parse_constraints("q", ["Brazil", "Côte d'Ivoire", "Venezuela (Bolivarian Republic)"])
    row = spark.createDataFrame([(question,)], "q string").select(*[c.alias(n) for n, c in found.items()]).first()
    assert (row.foot, row.role, row.position_group, row.max_age, row.min_age) == wanted and row.nationality is None


def test_nationalities_are_the_vocabulary_s(spark):
    found = Q.parse_constraints("q", ["Brazil", "Côte d'Ivoire", "Venezuela (Bolivarian Republic)"])["nationality"]
    asked = ["brasileiras", "marfinenses", "from Venezuela", "French"]
    assert [r.n for r in spark.createDataFrame([(x,) for x in asked], "q string").select("q", found.alias("n")).collect()] == ["Brazil", "Côte d'Ivoire", "Venezuela (Bolivarian Republic)", None]


def test_names_and_positions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(X.ascii_name(F.lit("  Łukasz  FABIAŃSKI "))) == "ukasz fabianski"
    assert one(X.country_key(F.lit("Venezuela (Bolivarian Republic)"))) == "venezuela"
    assert one(X.name_variants(F.lit("Ana Maria da Silva"))) == ["Ana Maria da Silva", "Ana Silva", "Ana Maria"] and one(X.name_variants(F.lit("Ana Silva"))) == ["Ana Silva"]
    assert one(S.position_group(F.lit(""))) == "Unknown"
    lookup = spark.createDataFrame([("nick", None), ("full", 3)], "key string, v int")
    rows = spark.createDataFrame([(1, "nick", "full"), (2, None, "full"), (3, "x", "y")], "id int, nickname string, name string")
    assert {r.id: r.v for r in L.by_first_known_name(rows, lookup, "nickname", "name", "v").collect()} == {1: None, 2: 3, 3: None}


@pytest.mark.parametrize("bad", [{"conditions": (("x", "like", 1),)}, {"conditions": (("y", "gt", 1),)}, {"order": "y"}, {"limit": 0}, {"limit": 101}])
def test_searches_are_checked_before_any_plan(bad):
    with pytest.raises(ValueError):
        Q.Query(("x",), **bad)


def test_strengths_of_each_scope_are_those_of_its_own_rows(spark):
    """The fit has one lowest point, so a slope of zero over a scope's own rows proves it."""
    rng = np.random.default_rng(4)
    rows = [(f"c{s}", a, b, int(rng.poisson(np.exp(0.1 * a - 0.1 * b + 0.25 * h))), bool(h)) for s in range(3) for a in range(5 + s) for b in range(5 + s) if a != b for h in (0, 1) for _ in range(6)]
    rows += [("one", 1, 2, 0, True), (None, 1, 2, 3, True), ("one", None, 2, 3, True)]
    df = spark.createDataFrame(rows, "scope string, team int, opponent int, goals int, is_home boolean").repartition(5)
    got = M.strengths_by_scope(df, "scope").collect()
    assert {r.scope for r in got} == {"c0", "c1", "c2", "one"}
    for s in range(3):
        own = {r.team: r for r in got if r.scope == f"c{s}"}
        mine = [r for r in rows if r[0] == f"c{s}"]
        attack, defence = ({t: getattr(r, c) for t, r in own.items()} for c in ("attack", "defence"))
        home = np.log(own["0"].home)
        eta = np.array([attack[str(a)] - defence[str(b)] + home * h for _, a, b, _, h in mine])
        y = np.array([r[3] for r in mine])
        level = y.sum() / np.exp(eta).sum()  # the intercept and the centring, in one
        miss = level * np.exp(eta) - y
        for t in own:
            by = np.array([str(a) == t for _, a, *_ in mine]), np.array([str(b) == t for _, _, b, *_ in mine])
            assert abs(miss[by[0]].sum() / len(mine) + 1e-3 * attack[t]) < 1e-6
            assert abs(miss[by[1]].sum() / len(mine) - 1e-3 * defence[t]) < 1e-6
        assert own["0"].played == 2 * 6 * (4 + s) and attack[str(4 + s)] > attack["0"]


def test_team_strengths_are_fitted_on_pairs_of_teams(spark, monkeypatch):
    """However many matches two teams played, the fit reads a row for them and a place."""
    sizes, fit = [], M.GeneralizedLinearRegression.fit
    monkeypatch.setattr(M.GeneralizedLinearRegression, "fit", lambda self, data: sizes.append(data.count()) or fit(self, data))
    rows = [(a, b, (k + len(a)) % 3, k % 2 == 0) for k in range(50) for a, b in (("x", "yy"), ("yy", "x"))]
    found, _ = M.team_strengths(spark.createDataFrame(rows, "team string, opponent string, goals int, is_home boolean"))
    assert sizes == [4] and {r.team: r.played for r in found.collect()} == {"x": 50, "yy": 50}


def test_outcome_model_reads_written_rows(spark):
    """What the rows come from is not made again for each fit and the prediction."""
    rows = [(k, float(k % 3), float(k % 7), k % 4 == 0) for k in range(80)]
    found = M.outcome_model(spark.createDataFrame(rows, "k int, y double, x double, is_test boolean"), ["x"], "y")
    assert found.count() == 80 and found.inputFiles() and all("/rows-" in f for f in found.inputFiles())
