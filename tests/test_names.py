"""Folding of accents and matching of names on closed cases and against a plain version."""

import random
from collections import Counter

from pyspark.sql import functions as F

from tallyspark.functions import scalars as S
from tallyspark.functions.names import fold, weighted_ratio
from tallyspark.operators import profiles as P
from tallyspark.operators import search as Q


def test_folded(spark):
    cases = {"Modrić": "modric", "Fabiański": "fabianski", "ČŠŽőăÝ": "cszoay", "Suárez": "suarez", "José": "jose", "ﬁn": "fin", "Ødegaard": "ødegaard", "ABC": "abc", "": "", None: None}
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", S.folded(F.col("t")).alias("f")).collect()
    assert {r.t: r.f for r in rows} == cases


def test_accented_names_are_found(spark):
    names = spark.createDataFrame([("Luka Modrić",), ("Łukasz Fabiański",)], "name string")
    found = lambda q: [r.name for r in P.mentioned(names, "name", q).collect()]
    assert found("passes like Modric") == found("passes like MODRIĆ") == ["Luka Modrić"] and found("is Fabianski good") == ["Łukasz Fabiański"]
    tokens = {r.token for r in Q.shared_tokens(names.union(names).union(names).union(names), "name").collect()}
    assert {"modric", "fabianski"} <= tokens
    asked = spark.createDataFrame([("léft foot médio, quem tem máis",)], "q string")
    assert asked.select(Q.parse_constraints("q")["position_group"].alias("g"), Q.asks_for_leaders(F.col("q")).alias("l")).first() == ("MID", True)


def test_scores():
    scores = [round(weighted_ratio(*p), 1) for p in (("lionel andres messi cuccittini", "lionel messi"), ("charly musonda junior", "son"), ("luis suarez", "luis suarez"), ("", "x"), ("messi lionel", "lionel messi"))]
    assert scores == [85.5, 90.0, 100.0, 0.0, 95.0]


def plain_tokens(name):
    return {w for w in fold(name).translate(str.maketrans(".-'", "   ")).split() if len(w) > 2}


def plain_matches(left, right, least):
    """All pairs."""
    count = [Counter(w for _, n in rows for w in plain_tokens(n or "")) for rows in (left, right)]
    out = {}
    for i, a in left:
        best = None
        for j, b in right:
            x, y = (fold(n or "").strip() for n in (a, b))
            shared = plain_tokens(x) & plain_tokens(y)
            if x and y and (x == y or len(shared) >= 2 or any(count[0][w] == count[1][w] == 1 for w in shared)) and (score := weighted_ratio(x, y)) >= least:
                best = min(best or (0, 0, 0), (-score, j, len(shared)))
        if best:
            out[i] = (best[1], best[2], round(-best[0], 6))
    return out


def matches(spark, left, right, least=90.0):
    frames = [spark.createDataFrame(rows, "id long, name string") for rows in (left, right)]
    rows = Q.match_names(*frames, least).collect()
    assert len({r.left_id for r in rows}) == len(rows)
    return {r.left_id: (r.right_id, r.common, round(r.score, 6)) for r in rows}


def test_match_names_known_cases(spark):
    left = ["Amanda Sampedro Bustos", "Charly Musonda Junior", "Carlos Henrique Casimiro", "Lionel Andres Messi Cuccittini", "Neymar da Silva Santos Junior", "Henrique Adriano Buss", "Li Na", "Luka Modrić", None]
    right = ["Pedro", "Son", "Henrique", "Lionel Messi", "Neymar", "Li Na", "Luka Modric", "", None]
    rows = [list(enumerate(names)) for names in (left, right)]
    assert {i: m[0] for i, m in matches(spark, *rows, 80.0).items()} == {3: 3, 4: 4, 6: 5, 7: 6}
    assert {i: m[0] for i, m in matches(spark, *rows).items()} == {4: 4, 6: 5, 7: 6}


def test_match_names_equals_all_pairs(spark):
    dice = random.Random(5)
    parts = ["Silva", "Silva", "Silva", "João", "Joao", "Ana", "Li", "Na", "Souza", "Sousa", "O'Neil", "Modrić", "Smith-Jones", "de", "Rui", "Andrés", "Carlos", "Carlo"]
    name = lambda k: " ".join(dice.sample(parts, dice.randint(1, 4)) + ([f"Only{k}"] if dice.random() < 0.2 else []))
    left, right = [(k, name(k)) for k in range(150)], [(k, name(k)) for k in range(120)]
    for least in (90.0, 80.0):
        wanted = plain_matches(left, right, least)
        assert matches(spark, left, right, least) == wanted and len(wanted) > 20
