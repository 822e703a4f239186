"""SimHash near-dedup over a byte-position inverted index with count filtering.

A fingerprint is eight bytes, each with its position. Two fingerprints that differ in at most d bits share at least
8 - d positional bytes, the guaranteed minimum, and so at least four of the first d + 4. The index posts each
fingerprint under every four of these (35 keys at d = 3), as single positional bytes would post a 256th of all rows
under one key. Within a posting the shared positional bytes of pairs are tallied, pairs that reach the minimum are
retained, and bit distance verifies them. Postings of one member go before that. A posting with more than MANY members
is posted again under each fifth byte, which pairs at the minimum share as well.

Copies share a fingerprint and enter the index once. A posting gives no table of pairs but a star per connected part,
found by breadth-first search from a member to those that are left, at most a link per member. Components come from
those links by alternating large and small stars, as joins and aggregates over tables at rest. These tables grow with
the rows and random fingerprints look small when compressed, so both sides are dealt by key and none is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.common import Scratch, columns_of, documents, text_of, unused

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
SEED, SHINGLE, DISTANCE = 42, 3, 3
#: Shingles whose bits are counted together; bytes of a posting's key; members from which a posting is posted again.
BITS_AT_ONCE, KEY_BYTES, MANY = 65_536, 4, 4096


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """A bit is set if it is in over half of the shingles' hashes, repeats included."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    lasts = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    digest, seed = xxhash.xxh64_intdigest, SEED
    parts = ([digest(line[a:b], seed) for a, b in zip(starts[k : k + BITS_AT_ONCE].tolist(), lasts[k : k + BITS_AT_ONCE].tolist())] for k in range(0, n, BITS_AT_ONCE))
    return majority(n, (np.array(part, ">u8") for part in parts))


def majority(n: int, parts: Iterable[np.ndarray]) -> int:
    """The bits that are set in over half of n hashes, given as big-endian parts."""
    ones = np.zeros(64, np.int64)
    for hashes in parts:
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key (a hash that tells texts of one id apart), print (the fingerprint as a signed long): one row per
    row of docs. A null text counts as empty, and a text without words has fingerprint zero."""
    given = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_of(text_col)).alias("text_key"), F.encode(text_of(text_col), "UTF-8").alias("text"))

    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle) for t in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(found, pa.int64())], names=["doc_id", "text_key", "print"])

    return given.mapInArrow(run, T.StructType([given.schema["doc_id"], given.schema["text_key"], T.StructField("print", T.LongType())]))


def _tallied(values: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of the distinct fingerprints the place of the first member of its connected part, if those that share
    8 - distance positional bytes or more and differ in at most distance bits are connected, and the tally of the pair
    that connected it."""
    n = len(values)
    root, tally = np.full(n, -1, np.int64), np.full(n, 8, np.int32)
    parent = np.arange(n)
    left = np.arange(n)
    for first in range(n):
        if root[first] >= 0:
            continue
        root[first], todo = first, [first]
        while todo:
            at = todo.pop()
            left = left[root[left] < 0]
            differing = values[left] ^ values[at]
            shared = (differing.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
            enough = shared >= 8 - distance
            kept, counts = left[enough], shared[enough]
            near = np.bitwise_count(differing[enough]) <= distance
            root[kept[near]], parent[kept[near]], tally[kept[near]] = first, at, counts[near]
            todo += kept[near].tolist()
    return parent, tally


def _flipped(values: np.ndarray, distance: int, places: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The same for many sorted fingerprints that can differ in the bytes at places alone: all flips are looked up."""
    n = len(values)
    single = [1 << 8 * (7 - p) + b for p in places for b in range(8)]
    flips = np.array([sum(c) for d in range(1, distance + 1) for c in combinations(single, d)], np.uint64)
    seen, parent, tally = np.zeros(n, bool), np.arange(n), np.full(n, 8, np.int32)
    for first in range(n):
        if seen[first]:
            continue
        seen[first], todo = True, [first]
        while todo:
            at = todo.pop()
            tried = values[at] ^ flips
            place = np.minimum(np.searchsorted(values, tried), n - 1)
            near = place[(values[place] == tried) & ~seen[place]]
            seen[near], parent[near] = True, at
            tally[near] = ((values[near] ^ values[at]).view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
            todo += near.tolist()
    return parent, tally


def links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """a, b, shared (positional bytes of the pair): links between distinct fingerprints whose connected components
    are those of all pairs within distance. prints: one column print, distinct."""
    if not 1 <= distance <= 3:
        raise ValueError("the index is made for distances of 1 to 3")
    sets = list(combinations(range(distance + KEY_BYTES), KEY_BYTES))
    byte_of = lambda p: F.shiftrightunsigned("print", 8 * (7 - p)).bitwiseAND(F.lit(255))
    entries = []
    for k, places in enumerate(sets):
        key = F.lit(k).cast("long")
        for p in places:
            key = F.shiftleft(key, 8).bitwiseOR(byte_of(p))
        entries.append(key)
    posted = prints.select(F.explode(F.array(*entries)).alias("posting"), "print")
    scratch = Scratch(prints.sparkSession, "postings")
    # counts are combined before they are shuffled and joined back: no task has to hold a posting to count it
    held = posted.groupBy("posting").agg(F.count("*").alias("held")).filter("held > 1")
    met = scratch.save(posted.join(held.hint("merge"), "posting"), "met")
    others = F.lit([[p for p in range(8) if p not in places] for places in sets])
    fifth = F.transform(
        F.get(others, F.shiftright("posting", 8 * KEY_BYTES).cast("int")),
        lambda p: p * 256 + F.call_function("shiftrightunsigned", F.col("print"), 8 * (7 - p)).bitwiseAND(F.lit(255)).cast("int"),
    )
    few = met.filter(F.col("held") <= MANY).select("posting", F.lit(-1).alias("fifth"), "print")
    many = met.filter(F.col("held") > MANY).select("posting", F.explode(fifth).alias("fifth"), "print")
    dealt = few.unionByName(many).repartition("posting", "fifth").sortWithinPartitions("posting", "fifth", "print")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("shared", T.IntegerType())])

    def linked(keys: np.ndarray, fifths: np.ndarray, values: np.ndarray):
        """Whole postings, sorted."""
        starts = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (fifths[1:] != fifths[:-1]))))
        sizes = np.diff(np.concatenate((starts, [len(keys)])))
        a, b, tallies = [], [], []
        for s, n in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
            own = np.sort(values[s : s + n].view(np.uint64))
            if n <= MANY:
                parent, tally = _tallied(own, distance)
            else:
                same = {*sets[int(keys[s]) >> 8 * KEY_BYTES], int(fifths[s]) >> 8}
                parent, tally = _flipped(own, distance, [p for p in range(8) if p not in same])
            child = np.flatnonzero(parent != np.arange(n))
            a.append(own[parent[child]])
            b.append(own[child])
            tallies.append(tally[child])
        if not a:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)] + [pa.array(np.concatenate(tallies))], names=["a", "b", "shared"])

    def run(batches):
        held = [[np.empty(0, t)] for t in (np.int64, np.int32, np.int64)]
        for batch in batches:
            keys, fifths, values = (batch.column(k).to_numpy() for k in range(3))
            if not len(keys):
                continue
            # the last posting may go on in the next batch
            cut = int(np.flatnonzero((keys != keys[-1]) | (fifths != fifths[-1]))[-1]) + 1 if (keys[0], fifths[0]) != (keys[-1], fifths[-1]) else 0
            if cut or (len(held[0][-1]) and (held[0][-1][-1], held[1][-1][-1]) != (keys[0], fifths[0])):
                out = linked(*[np.concatenate((*h, c[:cut])) for h, c in zip(held, (keys, fifths, values))])
                held = [[], [], []]
                if out:
                    yield out
            for h, c in zip(held, (keys, fifths, values)):
                h.append(c[cut:])
        if len(held[0]) and (whole := [np.concatenate(h) for h in held]) and len(whole[0]) and (out := linked(*whole)):
            yield out

    return dealt.mapInArrow(run, schema)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, root: the smallest node of each connected component, for every node that has an edge (a, b).

    Alternates large stars (every larger neighbour moves to a node's smallest) with small stars (a node's smaller
    neighbours move to the smallest of them) until a turn changes nothing; each turn is written and reread.
    """
    current = scratch.save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges-0")
    state, turn = None, 0
    while True:
        turn += 1
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.filter("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = scratch.save(large, f"large-{turn}")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        nxt = scratch.save(moved.unionByName(least.withColumnRenamed("m", "v")).distinct(), f"edges-{turn}")
        now = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(f"large-{turn}", f"edges-{turn - 1}")
        current = nxt
        if tuple(now) == state:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = tuple(now)


def near_groups(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, print, root (smallest fingerprint), component_id (smallest id reachable over fingerprints within distance): one row per row of docs.

    Null, empty and other texts without words are linked like any other. Null ids are no component's smallest unless
    it has no other. Repeated ids and rows get a row each; very long texts are read whole; an empty table gives an
    empty one; other columns of docs are not read.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.save(fingerprints(docs, shingle, id_col, text_col), "rows")
    distinct = scratch.save(rows.groupBy("print").agg(F.min("doc_id").alias("least")), "distinct")
    found = components(scratch.save(links(distinct.select("print"), distance), "links"), scratch)
    rooted = distinct.join(found.withColumnRenamed("node", "print").hint("merge"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    rooted = scratch.save(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = scratch.save(rooted.join(least.hint("merge"), "root").select("print", "root", "component_id"), "components")
    scratch.keep("rows", "components")
    return rows.join(named.hint("merge"), "print").select("doc_id", "text_key", "print", "root", "component_id")


def one_each(docs: DataFrame, groups: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of docs for each root of groups (doc_id, text_key, root), the one with the smallest id, with all its columns."""
    key = lambda i, text: F.concat_ws(".", F.coalesce(i.cast("string"), F.lit("null")), text)
    scratch = Scratch(docs.sparkSession, "near-kept")
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("i"), F.col("text_key").alias("t"))).alias("x"))
    name, place = unused(docs, "__key"), unused(docs, "__one")
    kept = scratch.save(first.select(key(F.col("x.i"), F.col("x.t")).alias(name)), "kept")
    keyed = docs.withColumn(name, key(F.col(id_col), F.xxhash64(text_of(text_col))))
    one = F.row_number().over(Window.partitionBy(name).orderBy(F.lit(0)))
    return keyed.join(kept.hint("merge"), name, "left_semi").withColumn(place, one).filter(F.col(place) == 1).select(*columns_of(docs))


def near_dedup(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each component, the one with the smallest id, with all its columns; nulls, repeats and
    empty tables are as in near_groups, and of rows that share that id one stays. Columns may have any name."""
    return one_each(docs, near_groups(docs, shingle, distance, id_col, text_col), id_col, text_col)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir)).select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
