"""A partitioned vector index, and the nearest rows of many queries without a table of pairs.

Vectors are dealt to lists by their nearest centroid, centroids being fitted on a bounded sample, and every vector is
written under its list. A question reads the lists whose centroids are nearest to it and no other. Many questions at
once meet the rows of their lists in cells of at most BLOCK rows of either side; a cell multiplies two matrices and
gives back the first rows of each question, so what leaves it is as long as the questions and not their product. Rows
are sent once to every part of the other side, so cells are large, and a cell works through its questions in slices.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.functions import scalars as S
from tallyspark.operators import peers

#: Rows of either side in a cell; its questions that are compared at once; vectors that centroids are fitted on; digits that similarities are rounded to before
#: they are compared, so that equal ones tie on any machine.
BLOCK, SLICE, SAMPLE, DIGITS = 16_384, 256, 50_000, 6


def rounded(similarity: Column, digits: int = DIGITS) -> Column:
    return F.floor(similarity * F.lit(10.0**digits) + 0.5) / F.lit(10.0**digits)


def _dealt(df: DataFrame, by: str, key: str, name: str) -> DataFrame:
    """df with a part of its list, of about BLOCK rows, and how many parts the list has. What is joined has a row per
    list and is broadcast: dealt by list, one task would sort all of a list."""
    counts = df.groupBy(by).agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias(f"{name}s"))
    return df.join(F.broadcast(counts), by).withColumn(name, F.pmod(F.xxhash64(key), F.col(f"{name}s")).cast("int"))


def nearest_of_many(queries: DataFrame, rows: DataFrame, top: int, digits: int = DIGITS) -> DataFrame:
    """query, key, similarity: for each query its first top rows of its lists by cosine, then by key.

    queries: query, list, owner, vector; a query may stand in several lists. rows: key, list, owner, vector. Rows of the
    query's own owner are left out; a null owner is nobody's. A vector of zeros is like nothing (0). Lists of any size
    are cut into parts on both sides and each two parts meet in one cell.
    """
    asked = _dealt(queries.select("query", F.col("list").alias("list"), F.col("owner").cast("long").alias("owner"), F.col("vector").cast("array<double>").alias("vector")), "list", "query", "qpart")
    held = _dealt(rows.select("key", F.col("list").alias("list"), F.col("owner").cast("long").alias("owner"), F.col("vector").cast("array<double>").alias("vector")), "list", "key", "rpart")
    q_parts, r_parts = asked.select("list", "qparts").distinct(), held.select("list", "rparts").distinct()
    asked = asked.drop("qparts").join(F.broadcast(r_parts), "list").withColumn("rpart", F.explode(F.sequence(F.lit(0), F.col("rparts") - 1))).drop("rparts")
    held = held.drop("rparts").join(F.broadcast(q_parts), "list").withColumn("qpart", F.explode(F.sequence(F.lit(0), F.col("qparts") - 1))).drop("qparts")
    schema = T.StructType([queries.schema["query"], rows.schema["key"], T.StructField("similarity", T.DoubleType())])
    names, scale = schema.names, 10.0**digits

    def matrix(table: pa.Table) -> np.ndarray:
        column = table.column("vector").combine_chunks()
        found = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
        length = np.sqrt((found * found).sum(axis=1, keepdims=True))
        return found / np.where(length == 0, 1, length)

    def cell(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not len(asked) or not len(held):
            return schema_table([], [], [])
        keys = np.array(held.column("key").to_pylist(), object)
        place = np.empty(len(keys), np.int64)
        place[np.argsort(keys, kind="stable")] = np.arange(len(keys))
        owner_of = lambda t: (t.column("owner").fill_null(0).to_numpy(), t.column("owner").is_null().to_numpy())
        (own, unowned), (other, nobodys) = owner_of(asked), owner_of(held)
        of_query, of_row, values = [], [], []
        questions, answers = matrix(asked), matrix(held).T
        for k in range(len(questions)):
            if k % SLICE == 0:
                part = slice(k, k + SLICE)
                found = np.floor(questions[part] @ answers * scale + 0.5) / scale
                found[(own[part, None] == other) & ~unowned[part, None] & ~nobodys] = -np.inf
            line = found[k % SLICE]
            least = np.partition(line, len(line) - top)[len(line) - top] if len(line) > top else -np.inf
            able = np.flatnonzero((line >= least) & (line > -np.inf))
            first = able[np.lexsort((place[able], -line[able]))[:top]]
            of_query.append(np.full(len(first), k))
            of_row.append(first)
            values.append(line[first])
        return schema_table(np.concatenate(of_query), np.concatenate(of_row), np.concatenate(values), asked, held)

    def schema_table(of_query, of_row, values, asked=None, held=None):
        if asked is None:
            from pyspark.sql.pandas.types import to_arrow_schema

            return to_arrow_schema(schema).empty_table()
        return pa.table({names[0]: asked.column("query").take(pa.array(of_query)), names[1]: held.column("key").take(pa.array(of_row)), names[2]: pa.array(values)})

    by = ["list", "qpart", "rpart"]
    met = asked.groupBy(*by).cogroup(held.groupBy(*by)).applyInArrow(cell, schema)
    return peers.top_of(met, ["query"], [F.desc("similarity"), F.col("key")], top, parts=1)


@dataclass(frozen=True)
class Index:
    """Where an index lies, and its centroids, a unit vector for each list."""

    path: str
    centroids: tuple[tuple[float, ...], ...]

    def lists_of(self, vector: Column, probes: int) -> Column:
        """The lists whose centroids are nearest, nearest first."""
        centroids = F.lit(np.array(self.centroids).ravel().tolist())
        dims = len(self.centroids[0])
        dot = lambda k: F.aggregate(F.zip_with(vector, F.slice(centroids, k * dims + 1, F.lit(dims)), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        scored = F.transform(F.sequence(F.lit(0), F.lit(len(self.centroids) - 1)), lambda k: F.struct((-dot(k)).alias("far"), k.alias("list")))
        return F.transform(F.slice(F.array_sort(scored), 1, probes), lambda s: s["list"])

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/rows")


def build(df: DataFrame, path: str, key: str, vector: str, lists: int, sample: int = SAMPLE, seed: int = 42) -> Index:
    """Writes df with its vectors as units and the list of each (column list) to path. Every row with a vector is in the
    index; rows without one are like nothing and are left out. Centroids are fitted on at most sample vectors, the first
    by a hash of their keys, so that the same table gives the same index; they come to the driver, lists of them."""
    spark = df.sparkSession
    units = df.filter(F.col(vector).isNotNull()).withColumn(vector, S.unit(F.col(vector).cast("array<double>")))
    fitted = units.select(F.xxhash64(F.lit(seed), key).alias("h"), key, vector).orderBy("h", key).limit(sample)
    model = KMeans(k=lists, seed=seed, maxIter=10, initMode="random").fit(fitted.select(array_to_vector(vector).alias("features"))) if not fitted.isEmpty() else None
    centers = [c / (np.linalg.norm(c) or 1.0) for c in model.clusterCenters()] if model else [np.zeros(1)]
    centers.sort(key=lambda c: c.tolist())
    index = Index(path, tuple(tuple(float(x) for x in c) for c in centers))
    matrix, schema = np.array(centers), T.StructType([*units.schema.fields, T.StructField("list", T.IntegerType())])

    def dealt(batches):
        for batch in batches:
            own = batch.column(vector)
            found = own.flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1) if len(own) else np.empty((0, matrix.shape[1]))
            nearest = np.argmax(found @ matrix.T, axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest)], names=schema.names)

    units.mapInArrow(dealt, schema).repartition(F.col("list"), F.pmod(F.xxhash64(key), F.lit(8))).write.mode("overwrite").partitionBy("list").parquet(f"{path}/rows")
    return index


def search(index: Index, spark: SparkSession, asked: list[float], key: str, vector: str, top: int, probes: int | None = None, where: Column | None = None) -> DataFrame:
    """The first top rows of an index by cosine. Of the files only the lists of the probes nearest centroids are read;
    without probes, as for a question with conditions (where), all are, and the answer is exact."""
    rows = index.rows(spark)
    if probes:
        order = np.argsort(-(np.array(index.centroids) @ np.array(asked)), kind="stable")[:probes]
        rows = rows.filter(F.col("list").isin(*map(int, order)))
    if where is not None:
        rows = rows.filter(where)
    similarity = rounded(S.cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in asked])))
    return rows.withColumn("similarity", similarity).orderBy(F.desc("similarity"), key).limit(top)


def search_many(index: Index, queries: DataFrame, key: str, vector: str, top: int, probes: int, owner: str | None = None) -> DataFrame:
    """query, key, similarity: the first top rows of the index for each query (query, vector and, where rows of the
    query's own owner are to be left out, owner)."""
    who = lambda name: F.col(name) if name else F.lit(None).cast("long")
    unit = S.unit(F.col("vector").cast("array<double>"))
    spread = queries.filter("vector is not null").select("query", who("owner" if owner else None).alias("owner"), unit.alias("vector"))
    spread = spread.withColumn("list", F.explode(index.lists_of(F.col("vector"), probes)))
    rows = index.rows(queries.sparkSession).select(F.col(key).alias("key"), "list", who(owner).alias("owner"), F.col(vector).alias("vector"))
    return nearest_of_many(spread, rows, top)


def placed(near: DataFrame) -> DataFrame:
    """near with place, 1 for the nearest; a query has as many rows as were asked for."""
    return near.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "key")))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """query, recall: the share of a query's exact rows (query, key) that were found. Rows that tie with the last one
    are no better than it, so those with an equal similarity count as found."""
    least = exact.groupBy("query").agg(F.count("*").alias("n"), F.min("similarity").alias("least"))
    good = found.join(least, "query").filter(F.col("similarity") >= F.col("least")).groupBy("query").agg(F.count("*").alias("good"))
    return least.join(good, "query", "left").select("query", F.least(F.coalesce("good", F.lit(0)) / F.col("n"), F.lit(1.0)).alias("recall"))


def spearman(a: Column, b: Column) -> Column:
    """Rank correlation of two arrays of one length, equal values sharing their mean rank; null where one is constant."""
    ranks = lambda v: F.transform(v, lambda x: F.size(F.filter(v, lambda y: y < x)) + (F.size(F.filter(v, lambda y: y == x)) + 1) / F.lit(2.0))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    mean = (F.size(a) + 1) / F.lit(2.0)
    x, y = F.transform(ranks(a), lambda r: r - mean), F.transform(ranks(b), lambda r: r - mean)
    square = lambda v: total(F.transform(v, lambda r: r * r))
    spread = square(x) * square(y)
    return F.when(spread > 0, total(F.zip_with(x, y, lambda p, q: p * q)) / F.sqrt(spread))
