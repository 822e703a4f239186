"""What each filter removes, in every order of the filters, from counted masks.

Every document leaves one bit per filter that it fails. Documents are counted by part and mask, at most 2 ** filters
cells a part however many documents there are, and only these cells are unpivoted: one row for each cell, order and
step. A running bit-or over a cell's steps in an order tells whether an earlier filter has removed it; sums under
conditions give what a step keeps, removes and finds removed already, and a total over a filter's steps in all orders
gives its Shapley sum. Windows hold as many rows as an order has steps, or as there are orders.

Whether an earlier text is the same is decided by SHA-256. A text's smallest id is an aggregate, combined before it is
shuffled, and it goes back by text and id, so a group of copies is spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import Scratch, documents, let, text_of, words_of

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The letter of the filter that looks beyond a document's own text.
REPEATED = "E"


def _few_distinct(words: Column) -> Column:
    return F.size(F.array_distinct(words)).cast("long") * 100 < F.size(words).cast("long") * 50


#: letter: condition on a text and its words under which a document fails. A filter's bit is its place; E's comes last.
FILTERS: dict[str, Callable[[Column, Column], Column]] = {
    "A": lambda text, words: F.size(words) < 200,
    "B": lambda text, words: _few_distinct(words),
    "C": lambda text, words: (F.length(text) - F.length(F.translate(text, UPPER, ""))).cast("long") * 100 > F.length(text).cast("long") * 2,
    "D": lambda text, words: text.rlike(r"[#$%&*|]"),
}
LETTERS = "".join(FILTERS) + REPEATED


def _own_mask(text: Column) -> Column:
    def masked(words):
        mask = F.lit(0)
        for k, fails in enumerate(FILTERS.values()):
            mask = mask.bitwiseOR(F.when(fails(text, words), F.lit(1 << k)).otherwise(F.lit(0)))
        return mask

    return let(words_of(text), masked)


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", scratch: Scratch | None = None) -> DataFrame:
    """doc_id, part, mask: one row per row of docs, a bit for each of LETTERS that it fails."""
    scratch = scratch or Scratch(docs.sparkSession, "filter-audit")
    text = text_of(text_col)
    given = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("sha"),
        _own_mask(text).alias("own"),
    )
    rows = scratch.save(given, "rows")
    first = rows.groupBy("sha").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    found = rows.filter("doc_id is not null").join(first, ["sha", "doc_id"], "left").select("doc_id", "part", "own", F.col("first").isNull().alias("repeated"))
    found = found.unionByName(rows.filter("doc_id is null").select("doc_id", "part", "own", F.lit(False).alias("repeated")))
    bit = F.lit(1 << len(FILTERS))
    return found.select("doc_id", "part", F.col("own").bitwiseOR(F.when(F.col("repeated"), bit).otherwise(F.lit(0))).alias("mask"))


def cells(masked: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """part, mask, n, n_good, n_toxic. labels: doc_id, quality, toxic; an id that is labelled more than once is good or
    toxic if one of its labels says so. Ids without a label and null ids are neither."""
    both = masked.withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    if labels is not None:
        says = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
        known = labels.filter("doc_id is not null").groupBy("doc_id").agg(says("quality").alias("good"), says("toxic").alias("toxic"))
        known = known.filter("good or toxic")
        named = masked.filter("doc_id is not null").join(known, "doc_id", "left")
        named = named.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
        both = named.unionByName(both.filter("doc_id is null"))
    one = lambda c: F.sum(F.col(c).cast("long"))
    return both.groupBy("part", "mask").agg(F.count("*").alias("n"), one("good").alias("n_good"), one("toxic").alias("n_toxic"))


def audit(counted: DataFrame, letters: str = LETTERS) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: one row for each
    part of counted (part, mask, n, n_good, n_toxic), order of the letters and step."""
    orders = F.split(F.lit(",".join(map("".join, permutations(letters)))), ",")
    long = counted.withColumn("filter_order", F.explode(orders))
    long = long.select(*long.columns, F.posexplode(F.split("filter_order", "")).alias("place", "filter"))
    bit = F.call_function("shiftleft", F.lit(1), F.call_function("instr", F.lit(letters), F.col("filter")) - 1)
    long = long.select(*counted.columns, "filter_order", (F.col("place") + 1).alias("step"), "filter", bit.alias("bit"))
    failed = F.col("mask").bitwiseAND(F.col("bit"))
    earlier = Window.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    long = long.withColumns({"hit": failed != 0, "gone": F.coalesce(F.bit_or(failed).over(earlier), F.lit(0)) != 0})
    total = lambda condition, n="n": F.sum(F.when(condition, F.col(n)).otherwise(0)).cast("long")
    hit, gone = F.col("hit"), F.col("gone")
    by_step = long.groupBy("part", "filter_order", "step", "filter").agg(
        total(~gone & ~hit).alias("kept"),
        total(~gone & hit).alias("removed"),
        total(gone & hit).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(~gone & hit, "n_good").alias("good_lost"),
        total(~gone & hit, "n_toxic").alias("toxic_lost"),
    )
    shapley = F.sum("removed").over(Window.partitionBy("part", "filter")).cast("long")
    return by_step.withColumn("shapley", shapley).drop("filter")


def filter_audit(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """audit() of all rows of docs by part, with labels' losses.

    A null text counts as empty, and a null part as the empty one. A null id is neither smaller nor larger than any, so
    its row fails no E and stands for no other; repeated rows are counted each, and rows that share the smallest id of a
    text pass E together. Very long texts are measured whole; an empty table gives an empty one; other columns are not
    read.
    """
    scratch = Scratch(docs.sparkSession, "filter-audit")
    counted = scratch.save(cells(masks(docs, id_col, text_col, part_col, scratch), labels), "cells")
    scratch.keep("cells")
    return audit(counted)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
marked AS (SELECT doc_id, part, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
  100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
  coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e FROM t),
said AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
fate AS (SELECT part, map {'A': a, 'B': b, 'C': c, 'D': d, 'E': e} AS fails, a::INT + b::INT + c::INT + d::INT + e::INT AS n_fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM marked LEFT JOIN said ON said.doc_id = marked.doc_id),
tally AS (SELECT part, fails, n_fails, good, toxic, count(*) AS n FROM fate GROUP BY ALL),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (SELECT a.l || b.l || c.l || d.l || e.l AS o FROM letter AS a, letter AS b, letter AS c, letter AS d, letter AS e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps AS (SELECT o, s::INTEGER AS s, o[s] AS l, o[1:s - 1] AS before FROM orders, range(1, 6) AS r(s)),
met AS (SELECT tally.*, o, s, l, fails[l] AS hit, len(list_filter(string_split(before, ''), lambda x: x <> '' AND fails[x])) > 0 AS gone FROM tally, steps),
found AS (SELECT part, o AS filter_order, s AS step, l, coalesce(sum(n) FILTER (NOT gone AND NOT hit), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT gone AND hit), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (gone AND hit), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (hit AND n_fails = 1), 0)::BIGINT AS unique_fails,
  coalesce(sum(n) FILTER (NOT gone AND hit AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (NOT gone AND hit AND toxic), 0)::BIGINT AS toxic_lost FROM met GROUP BY ALL)
SELECT * EXCLUDE (l), (sum(removed) OVER (PARTITION BY part, l))::BIGINT AS shapley FROM found
"""
