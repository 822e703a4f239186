"""Queries over vectors: the index, the neighbour graph and what they are worth, with the SQL they are compared with."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyspark.functions import scalars as S
from tallyspark.operators import peers as R
from tallyspark.operators import vectors as V
from tallyspark.plans.catalog import query
from tallyspark.plans.registry import _PEER_SQL, _PROBE, _PROBE_SQL, _peers
from tallyspark.sources.tables import shared_folder, table

#: Lists of the index over embeddings and lists that a question reads: these vectors point anywhere and form no groups,
#: so that nine in ten of the nearest need three quarters of the lists.
LISTS, PROBES, TOP = 16, 12, 10


def _index(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    return V.build(rows, f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}", "vec_id", "embedding", LISTS)


def _asked(spark, sf, every):
    rows = table(spark, sf, "embeddings").filter(F.col("vec_id") % every == 0)
    return rows.select(F.col("vec_id").alias("query"), F.col("vec_id").alias("owner"), F.col("embedding").alias("vector"))


def _found(spark, sf, every):
    index = _index(spark, sf)
    queries = _asked(spark, sf, every)
    rows = index.rows(spark).select(F.col("vec_id").alias("key"), "list", F.col("vec_id").alias("owner"), F.col("embedding").alias("vector"))
    unit = S.unit(F.col("vector").cast("array<double>"))
    spread = queries.withColumn("vector", unit).withColumn("list", F.explode(index.lists_of(F.col("vector"), PROBES)))
    return V.placed(V.nearest_of_many(spread, rows, TOP))


@query()
def vector_index_search(spark, sf):
    """The ten nearest vectors of every vector whose id is divisible by 100, from the lists nearest to it."""
    return _found(spark, sf, 100).select("query", "place", F.col("key").alias("vec_id"), "similarity")


@query()
def neighbour_graph(spark, sf):
    """The ten nearest vectors of every vector, by the index: as many cells as its lists need, and ten rows a vector."""
    return _found(spark, sf, 1).select("query", "place", F.col("key").alias("vec_id"), "similarity")


@query()
def vector_index_recall(spark, sf):
    """How much of the exact answer the index finds, for every vector whose id is divisible by 100."""
    whole = table(spark, sf, "embeddings").select(F.col("vec_id").alias("key"), F.lit(0).alias("list"), F.col("vec_id").alias("owner"), F.col("embedding").alias("vector"))
    exact = V.nearest_of_many(_asked(spark, sf, 100).withColumn("list", F.lit(0)), whole, TOP)
    return V.recall(_found(spark, sf, 100), exact)


_EXACT_SQL = """v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query, r.vec_id AS vec_id, q.label AS asked, r.label AS label, floor(list_cosine_similarity(q.v, r.v) * 1e6 + 0.5) / 1e6 AS similarity FROM v AS q JOIN v AS r ON r.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
n AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, vec_id) AS place FROM s)"""


@query(f"WITH {_EXACT_SQL} SELECT query, vec_id, place::INTEGER AS place, similarity FROM n WHERE place <= 10")
def nearest_exact(spark, sf):
    """The exact answer for the same questions, in cells of rows and questions."""
    whole = table(spark, sf, "embeddings").select(F.col("vec_id").alias("key"), F.lit(0).alias("list"), F.col("vec_id").alias("owner"), F.col("embedding").alias("vector"))
    near = V.nearest_of_many(_asked(spark, sf, 100).withColumn("list", F.lit(0)), whole, TOP)
    return V.placed(near).select("query", F.col("key").alias("vec_id"), "place", "similarity")


@query(f"""SELECT vec_id, floor(list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), {_PROBE_SQL}) * 1e6 + 0.5) / 1e6 AS similarity FROM embeddings WHERE label = 2
ORDER BY similarity DESC, vec_id LIMIT 10""")
def masked_index_search(spark, sf):
    """A question with a condition is answered exactly, from the index's own rows."""
    return V.search(_index(spark, sf), spark, _PROBE, "vec_id", "embedding", TOP, where=F.col("label") == 2).select("vec_id", "similarity")


_METRICS = ("goals", "shots", "xg100", "passes")


def _graph(spark, sf, top, every=100):
    """query and its first top rows of other players of the group, with both sides' attributes. Questions are the
    seasons of every player whose id is divisible by every."""
    rates = [f"{c}_per90" for c in _METRICS]
    rows = R.standardised(_peers(spark, sf), rates, ["grp"])
    homes = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    homes = homes.select(F.col("c_custkey").alias("player"), (F.col("c_nationkey") % 4).alias("role"), F.col("n_regionkey").alias("competition"))
    vector = F.array(*[F.col(f"z_{c}") for c in rates])
    profile = F.array(*[S.half_up(F.col(f"z_{c}") + 100, 6) for c in rates])
    made = rows.join(homes, "player").select((F.col("player") * 10_000 + F.col("season")).alias("key"), F.col("player").alias("owner"), F.col("grp").alias("list"), "role", "competition", vector.alias("vector"), profile.alias("profile"))
    asked = made.filter(F.col("owner") % every == 0).select(F.col("key").alias("query"), "list", "owner", "vector")
    near = V.placed(V.nearest_of_many(asked, made, top))
    side = lambda name, prefix: made.select(F.col("key").alias(name), *[F.col(c).alias(f"{prefix}{c}") for c in ("role", "competition", "profile")])
    return near.join(side("query", "own_"), "query").join(side("key", ""), "key")


_Z = ", ".join(f"({c}_per90 - avg({c}_per90) OVER g) / CASE WHEN stddev_pop({c}_per90) OVER g = 0 THEN 1 ELSE stddev_pop({c}_per90) OVER g END" for c in _METRICS)
_GRAPH_SQL = f"""{_PEER_SQL}, z AS (SELECT player * 10000 + season AS key, player, grp, [{_Z}] AS v FROM peer WINDOW g AS (PARTITION BY grp)),
y AS (SELECT z.*, c_nationkey % 4 AS role, n_regionkey AS competition, list_transform(v, lambda x: floor((x + 100) * 1e6 + 0.5) / 1e6) AS profile FROM z JOIN customer ON c_custkey = player JOIN nation ON n_nationkey = c_nationkey),
ranked AS (SELECT *, list_transform(profile, lambda x: len(list_filter(profile, lambda p: p < x)) + (len(list_filter(profile, lambda p: p = x)) + 1) / 2.0::DOUBLE - 2.5) AS r FROM y),
pair AS (SELECT q.key AS query, n.key AS key, q.role AS own_role, n.role AS role, q.competition AS own_competition, n.competition AS competition, q.r AS own_r, n.r AS r,
  floor(list_cosine_similarity(q.v, n.v) * 1e6 + 0.5) / 1e6 AS similarity FROM ranked AS q JOIN ranked AS n ON n.grp = q.grp AND n.player <> q.player WHERE q.player % 100 = 0),
near AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, key) AS place FROM pair)"""


@query(f"""WITH {_GRAPH_SQL}, c AS (SELECT *, CASE WHEN list_inner_product(own_r, own_r) * list_inner_product(r, r) > 0 THEN list_inner_product(own_r, r) / sqrt(list_inner_product(own_r, own_r) * list_inner_product(r, r)) END AS rho FROM near WHERE place <= 10)
SELECT query, count(*) AS n, avg((role = own_role)::INTEGER) AS role_share, avg((competition <> own_competition)::INTEGER) AS cross_league, floor((avg(rho) + 1) * 1e6 + 0.5) / 1e6 AS profile_r FROM c GROUP BY query""")
def similarity_graph(spark, sf):
    """Of each question's ten most similar rows: how many share its role, come from another competition, and how their
    profiles correlate with its own by rank."""
    near = _graph(spark, sf, 10)
    share = lambda c: F.avg(c.cast("int"))
    return near.groupBy("query").agg(
        F.count("*").alias("n"),
        share(F.col("role") == F.col("own_role")).alias("role_share"),
        share(F.col("competition") != F.col("own_competition")).alias("cross_league"),
        S.half_up(F.avg(V.spearman(F.col("own_profile"), F.col("profile"))) + 1, 6).alias("profile_r"),
    )


@query(f"WITH {_GRAPH_SQL} SELECT query, key, similarity, row_number() OVER (PARTITION BY query ORDER BY place)::INTEGER AS hardness FROM near WHERE place <= 20 AND role <> own_role QUALIFY hardness <= 3")
def hard_negatives(spark, sf):
    """Of each question's twenty most similar rows the first three of another role: what a model takes for right."""
    wrong = _graph(spark, sf, 20).filter(F.col("role") != F.col("own_role"))
    hardness = F.row_number().over(Window.partitionBy("query").orderBy("place"))
    return wrong.withColumn("hardness", hardness).filter("hardness <= 3").select("query", "key", "similarity", "hardness")
