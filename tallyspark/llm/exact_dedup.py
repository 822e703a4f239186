"""Exact dedup by deterministic block naming.

Every text is cut into blocks of a fixed number of bytes. The distinct blocks are sorted and numbered; a document
is then a sequence of integers, whose adjacent pairs are sorted and numbered in turn, until one integer is left. Two
documents that end on the same level with the same name have equal texts, and only those: no hash decides.

Blocks travel once, already collapsed by each map task. Names go back to the documents by a 128-bit fingerprint of
the block, after a check over the distinct blocks that no two of them share one; where two do, by the block itself.
Groups of copies, however large, never meet in one task: aggregates are combined before they are shuffled and joins
are between tables at rest, which adaptive execution splits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import Scratch, columns_of, documents, let, text_of, unused

BLOCK_BYTES = 4096


def fingerprint(block: Column) -> Column:
    return F.struct(F.xxhash64(block).alias("h1"), F.xxhash64(F.lit(1), block).alias("h2"))


def _blocks(text: Column, size: int) -> Column:
    return let(
        text.cast("binary"),
        lambda b: F.transform(
            F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length(b) / F.lit(size)).cast("int") - 1)),
            lambda i: F.substring(b, i * size + 1, F.lit(size)),
        ),
    )


def _numbered(distinct: DataFrame, keys: list[str]) -> DataFrame:
    """An integer for each row: its place in the sorted partition. Rows of a partition and their order are fixed by
    the keys, so a task that runs again gives the same numbers."""
    return distinct.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def identities(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, fingerprint=fingerprint, scratch: Scratch | None = None
) -> DataFrame:
    """One row per row of docs: row_id, doc_id, text_sha256, level, name; (level, name) is equal for equal texts only.

    Null texts count as empty. Repeated ids and repeated rows are rows of their own, told apart by row_id.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "exact-dedup")
    given = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    rows = scratch.save(
        given.select(
            F.monotonically_increasing_id().alias("row_id"),
            "doc_id",
            F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
            F.transform(_blocks(F.col("text"), block_bytes), fingerprint).alias("prints"),
        ),
        "rows",
    )
    distinct = given.select(F.explode(_blocks(F.col("text"), block_bytes)).alias("block")).select(fingerprint(F.col("block")).alias("print"), "block").distinct()
    numbered = _numbered(distinct, ["print", "block"])
    names = scratch.save(numbered.select("print", "name"), "names-0")
    if names.groupBy("print").count().filter("count > 1").isEmpty():
        occurrences = rows.select("row_id", F.posexplode("prints").alias("pos", "print")).join(names, "print")
    else:  # two blocks share a fingerprint: the blocks themselves are compared
        names = scratch.save(numbered.select("block", "name"), "names-0-blocks")
        again = given.select(
            F.monotonically_increasing_id().alias("row_id"), "doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), _blocks(F.col("text"), block_bytes).alias("blocks")
        )
        kept = scratch.save(again, "rows-blocks")
        rows = kept.drop("blocks")
        occurrences = kept.select("row_id", F.posexplode("blocks").alias("pos", "block")).join(names, "block")

    def regrouped(found: DataFrame) -> DataFrame:
        """A document's names in order; as many as it has blocks, so a group is never larger than its text."""
        return found.groupBy("row_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("names"))

    current = scratch.save(regrouped(occurrences), "level-0")
    longest = current.agg(F.max(F.size("names"))).first()[0] or 1
    done = [current.filter(F.size("names") == 1).withColumn("level", F.lit(0))]
    for level in range(1, math.ceil(math.log2(longest)) + 1 if longest > 1 else 1):
        active = current.filter(F.size("names") > 1)
        pairs = F.transform(
            F.sequence(F.lit(0), F.ceil(F.size("names") / 2).cast("int") - 1),
            lambda i: F.struct(F.get("names", i * 2).alias("a"), F.coalesce(F.get("names", i * 2 + 1), F.lit(-1)).alias("b")),
        )
        occurrences = active.select("row_id", F.posexplode(pairs).alias("pos", "pair"))
        names = _numbered(occurrences.select("pair").distinct(), ["pair"])
        current = scratch.save(regrouped(occurrences.join(names, "pair")), f"level-{level}")
        done.append(current.filter(F.size("names") == 1).withColumn("level", F.lit(level)))
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return rows.select("row_id", "doc_id", "text_sha256").join(found.select("row_id", "level", F.get("names", F.lit(0)).alias("name")), "row_id")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, fingerprint=fingerprint) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of docs, dropped ones too.

    Of equal texts the row with the largest id stays (a null id is the smallest; of rows that share the largest id,
    one stays). An empty table gives no rows. Other columns of docs are not read.
    """
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    named = scratch.save(identities(docs, id_col, text_col, block_bytes, fingerprint, scratch), "named")
    groups = scratch.save(
        named.groupBy("level", "name").agg(F.max(F.struct(F.col("doc_id"), (-F.col("row_id")).alias("row"))).alias("keep"), F.count("*").alias("group_size")), "groups"
    )
    scratch.keep("named", "groups")
    return named.join(groups, ["level", "name"]).select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("row_id") == -F.col("keep.row")).alias("kept"), "text_sha256"
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns: of equal texts the one with the largest id, a null id being
    the smallest; of rows that share that id, repeated rows too, one. Null and empty texts are equal; very long ones
    are cut like any other; an empty table gives an empty one. Columns may have any name, with dots too.

    Identities decide who stays; the rows are then found again by their id and the SHA-256 of their text.
    """
    kept = exact_groups(docs, id_col, text_col).filter("kept")
    key = lambda i, sha: F.concat_ws(":", sha, F.coalesce(i.cast("string"), F.lit("null")))
    name, place = unused(docs, "__key"), unused(docs, "__first")
    keys = kept.select(key(F.col("doc_id"), F.col("text_sha256")).alias(name))
    first = F.row_number().over(Window.partitionBy(name).orderBy(F.lit(0)))
    keyed = docs.withColumn(name, key(F.col(id_col), F.sha2(text_of(text_col).cast("binary"), 256)))
    return keyed.join(keys, name, "left_semi").withColumn(place, first).filter(F.col(place) == 1).select(*columns_of(docs))


def op4_exact_dedup(spark, sf_dir):
    return exact_groups(documents(spark, sf_dir))


SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
