"""The vector index and the nearest rows of many questions, against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.operators import vectors as V

random.seed(3)
RNG = np.random.default_rng(3)


@pytest.fixture(scope="module")
def grouped(spark):
    """Vectors about 12 centres, some rows without one."""
    centres = RNG.normal(size=(12, 16))
    rows = [(k, k % 3, (centres[k % 12] + RNG.normal(size=16) * 0.2).tolist()) for k in range(600)]
    return rows, spark.createDataFrame([*rows, (600, 0, None), (601, 1, [0.0] * 16)], "id long, kind long, v array<double>").repartition(5)


def plain(questions, rows, top):
    """(query, key) by cosine to six digits, then key; own owner left out."""
    out = {}
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1)
    for q, owner, v in questions:
        scored = [(-np.floor(unit(v) @ unit(w) * 1e6 + 0.5) / 1e6, k) for k, o, w in rows if o is None or owner is None or o != owner]
        out[q] = [k for _, k in sorted(scored)[:top]]
    return out


@pytest.mark.parametrize("block", [7, 2048])
def test_cells_give_the_exact_nearest(spark, monkeypatch, block):
    monkeypatch.setattr(V, "BLOCK", block)
    rows = [(k, k % 5 or None, [random.choice((0.0, 1.0, -1.0)) for _ in range(4)]) for k in range(60)]
    made = spark.createDataFrame([(k, "a" if k < 45 else "b", o, v) for k, o, v in rows], "key long, list string, owner long, vector array<double>").repartition(3)
    asked = made.filter("key % 2 = 0").select(F.col("key").alias("query"), "list", "owner", "vector")
    got = {}
    for r in V.placed(V.nearest_of_many(asked, made, 6)).orderBy("query", "place").collect():
        got.setdefault(r["query"], []).append(r["key"])
    for low, high in ((0, 45), (45, 60)):
        own = rows[low:high]
        assert {q: got[q] for q in got if low <= q < high} == plain([r for r in own if r[0] % 2 == 0], own, 6)


def test_index_holds_every_vector_and_finds_the_nearest(spark, grouped, tmp_path):
    rows, df = grouped
    index = V.build(df, str(tmp_path / "index"), "id", "v", 12)
    assert sorted(r.id for r in index.rows(spark).collect()) == [k for k in range(602) if k != 600]
    asked = df.filter("id % 10 = 0 and v is not null").select(F.col("id").alias("query"), F.col("id").alias("owner"), F.col("v").alias("vector"))
    found = V.search_many(index, asked, "id", "v", 10, probes=3, owner="id")
    whole = df.filter("v is not null").select(F.col("id").alias("key"), F.lit(0).alias("list"), F.col("id").alias("owner"), F.col("v").alias("vector"))
    exact = V.nearest_of_many(asked.select("query", F.lit(0).alias("list"), F.col("query").alias("owner"), "vector"), whole, 10)
    shares = [r.recall for r in V.recall(found, exact).collect()]
    assert len(shares) == 60 and np.mean(shares) >= 0.9


def test_a_question_reads_the_probed_lists_only(spark, grouped, tmp_path):
    rows, df = grouped
    index = V.build(df, str(tmp_path / "index"), "id", "v", 12)
    one = V.search(index, spark, rows[5][2], "id", "v", 5, probes=2)
    plan = one._jdf.queryExecution().toString()
    assert "PartitionFilters: [list" in plan.replace("isnotnull(list", "list") and one.first().id == 5
    assert one.select("list").distinct().count() <= 2
    masked = [r.id for r in V.search(index, spark, rows[5][2], "id", "v", 7, where=F.col("kind") == 1).collect()]
    assert masked == plain([(0, None, rows[5][2])], [(k, None, v) for k, kind, v in rows if kind == 1], 7)[0]


def test_an_index_of_nothing(spark, grouped, tmp_path):
    index = V.build(grouped[1].limit(0), str(tmp_path / "index"), "id", "v", 12)
    assert index.centroids == ((0.0,),)


def test_spearman_shares_ranks_of_equal_values(spark):
    pairs = [([1.0, 2.0, 2.0, 5.0], [3.0, 1.0, 4.0, 4.0]), ([1.0, 2.0, 3.0], [3.0, 2.0, 1.0]), ([1.0, 1.0], [1.0, 2.0])]
    df = spark.createDataFrame(pairs, "a array<double>, b array<double>")
    got = [r[0] for r in df.select(V.spearman(F.col("a"), F.col("b"))).collect()]
    ranks = np.array([[1, 2.5, 2.5, 4], [2, 1, 3.5, 3.5]])
    assert got[0] == pytest.approx(np.corrcoef(ranks)[0, 1]) and got[1] == pytest.approx(-1) and got[2] is None
