"""Tables in and out, round trips over small folders."""

import math

import pytest
from pyspark.sql import functions as F

from tallyspark.sources import tables as I


def test_slices_are_replaced_and_others_stay(spark, tmp_path):
    path = str(tmp_path / "slices")
    I.overwrite_slices(spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, season string, n int"), path, ["season"])
    I.overwrite_slices(spark.createDataFrame([(3, "b", 3)], "id int, season string, n int"), path, ["season"])
    assert sorted((r.id, r.season) for r in I.artifact(spark, path).collect()) == [(1, "a"), (3, "b")]
    assert I.artifact(spark, str(tmp_path / "none")) is None


def test_upserts_and_unseen(spark):
    old = spark.createDataFrame([(1, "x"), (2, "y")], "id int, name string")
    new = spark.createDataFrame([(2, "z", 5), (3, "w", 6)], "id int, name string, extra int")
    got = I.upserted(old.withColumn("extra", F.lit(None).cast("int")), new, ["id"])
    assert sorted(map(tuple, got.collect())) == [(1, "x", None), (2, "z", 5), (3, "w", 6)]
    assert [r.id for r in I.unseen(new, old, ["id"]).collect()] == [3]


def test_columns_by_keyword_and_default(spark):
    df = spark.createDataFrame([(1, 2)], "short_name int, value_eur int")
    assert I.column_like(df, "price", "value") == "value_eur" and I.column_like(df, "none") is None
    assert df.select(I.column_or(df, "absent", 7).alias("x")).first().x == 7


def test_valuations_from_csv(spark, tmp_path):
    (tmp_path / "v.csv").write_text("player,at,value,competition\n1,2015-12-30,5,GB1\n1,2016-01-03 00:00,9,GB1\n2,2014-01-01,3,ES1\n3,unknown,1,GB1\n4,2016-01-01,2,XX\n")
    (tmp_path / "p.csv").write_text("player,born\n1,1990-05-01\n")
    values = I.csv_table(spark, str(tmp_path / "v.csv"), "player int, at string, value int, competition string", ("at",))
    players = I.csv_table(spark, str(tmp_path / "p.csv"), "player int, born string", ("born",))
    got = I.valuations(players, values.filter("at is not null"), "player", "at", "2016-01-01", ["GB1", "ES1"]).collect()
    assert sorted((r.player, r.value, str(r.born)) for r in got) == [(1, 5, "1990-05-01"), (2, 3, "None")]


def test_loading_by_pair(spark):
    matches = spark.createDataFrame([(3, "a", "1"), (1, "a", "1"), (2, "b", "1")], "match_id int, competition string, season string")
    assert [r.match_id for r in I.loaded(matches, "a", "1", 1).collect()] == [1] and I.loaded(matches, "a", "1").count() == 2
    with pytest.raises(ValueError):
        I.loaded(matches, "c", "1")


def test_records_and_snapshots(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5), (2, math.nan)], "id int, value double")
    I.write_records(df, str(tmp_path / "r"))
    assert sorted((r.id, r.value) for r in I.read_records(spark, str(tmp_path / "r"), df.schema).collect()) == [(1, 2.5), (2, None)]
    assert I.read_records(spark, str(tmp_path / "none"), df.schema) is None
    (tmp_path / "s.json").write_text('{"n": 3,\n "kinds": {"a": 0.5}}')
    assert I.snapshot(spark, str(tmp_path / "s.json")).first().kinds.a == 0.5 and I.snapshot(spark, str(tmp_path / "t.json")) is None


def test_index_is_built_saved_and_read(spark, tmp_path):
    docs = spark.createDataFrame([(k, "x" * k) for k in range(70)], "id int, text string").repartition(2)
    made = I.vector_index(docs, "id", "text", lambda texts: [[len(t), len(texts)] for t in texts])
    I.save_index(made, str(tmp_path / "index"))
    read = I.load_index(spark, str(tmp_path / "index")).collect()
    assert all(r.vector[0] == r.id and r.vector[1] <= 32 for r in read) and len(read) == 70
    assert I.load_index(spark, str(tmp_path / "none")) is None and I.load_index(spark, str(tmp_path / "none"), lambda: docs) is docs


def test_loading_goes_on_where_it_stopped(spark, tmp_path):
    source, path, seen = (str(tmp_path / n) for n in ("source", "table", "seen"))
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, season string")
    rows.coalesce(1).write.parquet(source)
    stream = lambda: spark.readStream.schema("id int, season string").parquet(source)
    I.keep_loading(stream(), path, seen, ["season"])
    spark.createDataFrame([(5, "b")], "id int, season string").coalesce(1).write.mode("append").parquet(source)
    I.keep_loading(stream(), path, seen, ["season"])
    assert sorted((r.id, r.season) for r in spark.read.parquet(path).collect()) == [(1, "a"), (5, "b")]
    added, seen = str(tmp_path / "added"), str(tmp_path / "seen-added")
    I.keep_loading(stream(), added, seen, ["season"], replace=False)
    spark.createDataFrame([(6, "b")], "id int, season string").coalesce(1).write.mode("append").parquet(source)
    for _ in range(2):
        I.keep_loading(stream(), added, seen, ["season"], replace=False)
    assert sorted((r.id, r.season) for r in spark.read.parquet(added).collect()) == [(1, "a"), (2, "b"), (5, "b"), (6, "b")]
