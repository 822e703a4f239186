"""What the findings of round 3 asked for, on small tables."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyspark.functions import names
from tallyspark.functions import scalars as S
from tallyspark.operators import models, peers, profiles, vectors
from tallyspark.plans import bindings
from tallyspark.plans import models as plans

FOLDER = "/root/testdata/sf0.001"


def plan(df, stage="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), stage)().toString()


class Reached(Exception):
    pass


def test_lines_are_added_up_before_they_meet_matches(spark):
    assert plan(bindings.scorelines(spark, FOLDER)).count("Join ") == 3  # customers, nations, sums


def test_groups_are_broadcast(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 2.0)], "g string, x double")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = peers.standardised(rows, ["x"], ["g"])
        assert "SortMergeJoin" not in plan(made, "sparkPlan")
        assert sorted(r.z_x for r in made.collect()) == [-1.0, 0.0, 1.0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_cells_are_large_and_compared_in_slices(spark, monkeypatch):
    many = spark.range(20_000).withColumn("list", F.lit(0))
    assert vectors._dealt(many, "list", "id", "p").agg(F.max("ps")).first()[0] == 2
    dice = np.random.default_rng(4)
    made = dice.normal(size=(40, 3))
    rows = spark.createDataFrame([(k, 0, k % 7, made[k].tolist()) for k in range(40)], "key long, list int, owner long, vector array<double>")
    wanted = {r for r in vectors.nearest_of_many(rows.withColumnRenamed("key", "query"), rows, 5).collect()}
    monkeypatch.setattr(vectors, "SLICE", 7)
    assert {r for r in vectors.nearest_of_many(rows.withColumnRenamed("key", "query"), rows, 5).collect()} == wanted and len(wanted) == 200


def test_distinct_words_equal_those_of_the_folded_text(spark):
    texts = ["Café cafe CAFÉ-au-lait", "été ́abc", "½ x²y ﬁn", "", None, "ΣΑΣ straße İzmir", "a b\tC_d~9 \U0001d400z", "plain Words words"]
    found = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", S.distinct_words(F.col("text")).alias("w")).collect()
    for r in found:
        text = texts[r.i]
        assert (set(r.w) if r.w is not None else None) == (set(re.findall("[a-z0-9]+", names.fold(text))) if text is not None else None), text
        assert r.w is None or len(set(r.w)) == len(r.w)


def test_questions_meet_phrases_without_a_search_for_each(monkeypatch):
    monkeypatch.setattr(profiles.re, "search", None)
    asked = pd.Series(["xg and completed passes, passes", "impress", None])
    assert list(profiles._metrics.func(asked)) == [["xg", "passes_completed", "passes"], [], []]


@pytest.mark.parametrize("query", [plans.style_profiles, plans.model_mismatches])
def test_frames_are_written_before_they_are_split(spark, monkeypatch, query):
    def split(rows, target):
        assert "Join" not in plan(rows)
        raise Reached

    monkeypatch.setattr(plans, "_split", split)
    with pytest.raises(Reached):
        query(spark, FOLDER)


def test_classifier_reads_its_rows_once(spark, monkeypatch):
    def saved(df, name):
        raise Reached

    monkeypatch.setattr(models, "saved", saved)
    with pytest.raises(Reached):
        models.classify(spark.range(3), ["id"], "id", "id")
